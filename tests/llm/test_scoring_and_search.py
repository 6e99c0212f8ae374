import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import mixing, neighbours, toxicity


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    plain = [word() for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 80))]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["nastyword", "vileterm", "xuqo" + word(), "xuqo" + word()])
        rows.append((i, " ".join(w), "s", int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark, docs):
    rows = corpus()
    table = docs([r[:3] for r in rows] + [(None, "nastyword vileterm nastyword", "s"), (5000, None, "s"), (5001, "", "s")])
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(0, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    out = {r.doc_id: r for r in toxicity.scored(table.select("doc_id", "text"), model).select(
        "*", toxicity.held_out().alias("held_out")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(out[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert sum(out[r[0]].predicted == r[3] for r in held) >= 0.97 * len(held)
    assert out[None].predicted == 1 and not out[None].held_out
    assert out[5000].score == out[5001].score < 0.5 and all(0 <= r.score <= 1 for r in out.values())
    kept = toxicity.without_toxic(table, labels)
    assert kept.columns == table.columns and 5000 in {r.doc_id for r in kept.collect()}
    with pytest.raises(ValueError):
        toxicity.scored(table, model)


def test_held_out_labels_change_nothing(spark, docs):
    rows = corpus(300)
    table = docs([r[:3] for r in rows])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    a = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    b = spark.createDataFrame([(r[0], 1 - r[3] if held(r[0]) else r[3]) for r in rows], "doc_id long, toxic int")
    x, y = toxicity.fit(table, a), toxicity.fit(table, b)
    assert x.keys.tolist() == y.keys.tolist() and np.allclose(x.weights, y.weights)


def test_toxicity_without_labels(spark, docs):
    table = docs([(1, "words", "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.scored(table.select("doc_id", "text"), toxicity.fit(table, none)).collect()] == [0, 0]
    empty = table.limit(0).select("doc_id", "text")
    assert toxicity.scored(empty, toxicity.fit(empty, none)).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(4)
    n = 60_000
    y = rng.random(n) < 0.2
    votes = np.stack([np.where(rng.random(n) < np.where(y, hit, false), 1, -1)
                      for hit, false in ((0.8, 0.02), (0.6, 0.01), (0.7, 0.05), (0.4, 0.01), (0.5, 0.5))], axis=1)
    votes = np.concatenate([votes, np.where(rng.random((n, 1)) < 0.9, votes[:, :1], votes[:, 1:2])], axis=1)
    hits = (votes > 0).astype(float)
    model = toxicity.fit_label_model(hits.mean(axis=0), hits.T @ hits / n, 0.2, n)
    assert np.allclose(model.hit[0][1:4], [0.6, 0.7, 0.4], atol=0.08) and np.allclose(model.hit[1][1:4], [0.01, 0.05, 0.01], atol=0.03)
    assert model.correlation[0, 5] > 0.3 and abs(model.correlation[1, 3]) < 0.15
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


def brute_neighbours(rows, k=10, every=100):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, x in ok:
        if q % every == 0:
            d = sorted({(float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in ok if i != q})
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(d[:k])]
    return out


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.3, 16)).astype(np.float32).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.search(df, sample=1500).collect()]
    want = brute_neighbours(rows)
    assert len(got) == len(want)
    found = {(q, i) for q, _, i, _ in got}
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.9 * len(want)
    by = dict(rows)
    for q, _, i, s in got:
        assert s == pytest.approx(float(np.sqrt(((np.array(by[q], float) - np.array(by[i], float)) ** 2).sum())), abs=1e-12)


def test_search_edges(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100, [3.0, 4.0]), (200, [1.0, 2.0]), (300, None), (400, [0.0, 0.0]),
            (500, [1.0, None]), (600, [float("nan"), 1.0]), (700, [float("inf"), 1.0]), (None, [1.0, 1.0]), (800, []), (5, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, rank string, part int")
    got = [tuple(r) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got == brute_neighbours(rows)
    few = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in neighbours.search(few).collect()] == [(0, 1, 1, 1.0)]
    assert neighbours.search(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert neighbours.search(alone).count() == 0


def brute_mix(rows):
    from hashlib import md5
    size = [(i, s, len([w for w in (t or "").replace("\n", " ").split(" ") if w])) for i, t, s in rows]
    per = {}
    for _, s, n in size:
        per[s] = per.get(s, 0) + n
    names = sorted((s for s in per if s is not None)) + ([None] if None in per else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = sum(weight[s] for s in names if s not in capped)
        level = (1.5 * sum(per.values()) - 2 * sum(per[s] for s in capped)) / free if free else 0
        more = {s for s in names if s not in capped and weight[s] * level >= 2 * per[s]}
        if not more:
            break
        capped |= more
    for s in names:
        target[s] = 2.0 * per[s] if s in capped else weight[s] * level
    taken = {}
    for s in names:
        left = int(target[s])
        blocks = sorted((c, md5(f"mix-1|{i}|{c}".encode()).hexdigest(), i, n) for i, x, n in size if x == s and n for c in (0, 1))
        for c, _, i, n in blocks:
            taken[i] = taken.get(i, 0) + min(n, left)
            left -= min(n, left)
    return sorted((i, n, per[s], round(target[s], 6), taken.get(i, 0)) for i, s, n in size)


def test_mixing_equals_brute_force(spark, docs):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "only empty"), (1002, "w " * 20000, "b")]
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mixed_sizes(spark, docs(rows)).collect())
    assert got == brute_mix(rows)
    again = sorted(mixing.mixed_sizes(spark, docs(rows).repartition(7)).collect())
    assert sorted(mixing.mixed_sizes(spark, docs(rows)).collect()) == again
    assert mixing.mixed_sizes(spark, docs(rows).limit(0)).count() == 0


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0), (None, 333)], "source string, quota long")
    rows = mixing.split_quotas(quotas, 8).collect()
    per = {}
    for r in rows:
        per.setdefault(r.source, []).append(r.quota)
    assert {s: sum(q) for s, q in per.items()} == {"a": 1000, "b": 10, "c": 0, None: 333}
    size = {}
    for r in rows:
        assert r.quota >= 0
        size[r.shard] = size.get(r.shard, 0) + r.quota
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 3
    assert max(per["a"]) < 150 and len(set(per["a"])) > 1


def test_hypergeometric_distribution(spark):
    n, good, draws = 60, 25, 30
    got = spark.range(20_000).select(mixing.hypergeometric(
        F.lit(n), F.lit(good), F.lit(draws), mixing._uniform(F.col("id"), F.lit("u")), mixing._uniform(F.col("id"), F.lit("v"))).alias("x"))
    x = np.array([r.x for r in got.collect()])
    assert abs(x.mean() - draws * good / n) < 0.05
    assert abs(x.var() - draws * (good / n) * (1 - good / n) * (n - draws) / (n - 1)) < 0.15


def test_mixed_documents_are_prefixes(spark, docs):
    rows = [(i, f"doc {i}\n" + "w x  y " * (i % 9), "abc"[i % 3]) for i in range(60)]
    out = mixing.mixed_documents(docs(rows))
    assert out.columns == docs(rows).columns
    by = {i: t for i, t, _ in rows}
    sizes = {r.doc_id: r.taken for r in mixing.mixed_sizes(spark, docs(rows)).collect()}
    got = {}
    for r in out.collect():
        assert by[r.doc_id].startswith(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {i: n for i, n in sizes.items() if n}
