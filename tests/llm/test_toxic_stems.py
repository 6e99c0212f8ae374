"""Toxicity: stems that only tell where a text is full of them, and a rare class."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa

from leadflow.llm import textops, toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def texts(n, share, seed):
    """Three vocabularies with a stem each. Toxic texts have the stem in one word of 15
    or so, under ever new endings; a fifth of the long clean ones hold it once."""
    rng = random.Random(seed)
    end = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    plain = [[a + end() for _ in range(300)] for a in ("pu", "zi", "wo")]
    rows = []
    for i in range(n):
        kind, bad = i % 3, rng.random() < share
        w = [rng.choice(plain[kind]) for _ in range(rng.randrange(40, 90) if bad else rng.randrange(150, 300))]
        for _ in range(len(w) // 15 if bad else rng.random() < 0.2):
            w[rng.randrange(len(w))] = ("vrokta", "schmolk", "quelbri")[kind] + end()
        rows.append((i, " ".join(w), "s", int(bad)))
    return rows


def scores(spark, docs, rows, sample):
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    table = docs([r[:3] for r in rows])
    model = toxicity.fit(table, labels, sample)
    return {r.doc_id: r.score for r in toxicity.scored(table.select("doc_id", "text"), model).collect()}


def check(out, rows):
    bad = [out[i] >= 0.5 for i, _, _, y in rows if y and held(i)]
    good = [out[i] >= 0.5 for i, _, _, y in rows if not y and held(i)]
    assert len(bad) > 10 and sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.02 * len(good)


def test_texts_full_of_a_stem(spark, docs):
    rows = texts(1500, 0.15, 3)
    check(scores(spark, docs, rows, toxicity.SAMPLE), rows)


def test_a_rare_class_is_seen(spark, docs):
    rows = texts(4000, 0.03, 4)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    sample, lift = toxicity.labelled_sample(docs([r[:3] for r in rows]), labels, 600)
    known = [y for i, _, _, y in rows if not held(i)]
    taken = [r.toxic for r in sample.collect()]
    assert len(taken) == 600 and sum(taken) == sum(known) < 300
    assert math.isclose(lift, math.log((len(known) - sum(known)) / (600 - sum(taken))))
    assert toxicity.labelled_sample(docs([r[:3] for r in rows]), labels)[1] == 0.0
    check(scores(spark, docs, rows, 600), rows)


def test_dense_terms_against_counting():
    rng = random.Random(5)
    some = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows = [" ".join(rng.choice(some) for _ in range(n)) for n in (0, 1, 2, 99, 100, 101, 250, 1000)]
    buf, offsets = textops.column_bytes(pa.array(rows))
    hashes, row, kind = toxicity.text_terms(buf, offsets)
    half = toxicity.KINDS // 2
    sizes = (None, *toxicity.BEGINNINGS)
    for i, text in enumerate(rows):
        words = text.split()
        for k, size in enumerate(sizes):
            there = [w if size is None else w[:size] for w in words if size is None or len(w) > size]
            dense = {t for t in there if there.count(t) * toxicity.DENSE >= len(words)}
            assert np.sum((row == i) & (kind == k)) == len(set(there))
            assert np.sum((row == i) & (kind == k + half)) == len(dense)
    # asked for, only the terms of the list come back, dense or not by their own name
    wanted = toxicity.Lookup(np.unique(np.concatenate([hashes[kind == 1][:5], hashes[kind == half + 2][:5]])))
    got = {(int(r), int(wanted.keys[t])) for r, t in zip(*toxicity.distinct_terms(buf, offsets, wanted))}
    assert got == {(int(r), int(h)) for h, r in zip(hashes, row) if h in wanted.keys}
