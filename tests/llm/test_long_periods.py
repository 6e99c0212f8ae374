"""Long texts of a short period in the suffix-array deduplication."""

import random

import numpy as np
from pyspark.sql import functions as F

from leadflow.llm import suffix_dedup
from tests.llm.test_dedup import brute_removal, repeat_rows


def periodic_rows():
    rng = random.Random(3)
    head = lambda: "".join(rng.choice("abcdefgh ") for _ in range(300))
    line = "one short line, many times over. \n"
    rows = [(i, head() + line * 6000 + head()) for i in range(9)]
    rows += [(20, "a" * 1_200_000), (21, head() + "a" * 70_000), (22, "xyz" * 500), (23, "xyz" * 500), (24, line * 3)]
    return rows


def test_long_periods_are_not_sorted_in_one_shard(spark, docs, monkeypatch):
    largest = []
    sort = suffix_dedup._sorted_shards

    def spied(segments):
        per = segments.groupBy("gram").agg(F.sum(F.octet_length("bytes") * F.least("copies", F.lit(2))).alias("n"))
        largest.append(per.agg(F.max("n")).first()[0] or 0)
        return sort(segments)

    monkeypatch.setattr(suffix_dedup, "_sorted_shards", spied)
    rows = periodic_rows()
    got = [tuple(r) for r in suffix_dedup.removal_report(docs([(i, t, "s") for i, t in rows])).collect()]
    assert sorted(got, key=str) == brute_removal(rows)
    assert max(largest) <= 2 << 20


def test_counted_periods(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GRAM_BYTES", 0)
    rows = repeat_rows() + [(300, "b" * 199 + "c" * 200), (301, "c" * 201), (302, "ef" * 100), (303, "fe" * 100)]
    got = [tuple(r) for r in suffix_dedup.removal_report(docs([(i, t, "s") for i, t in rows])).collect()]
    assert sorted(got, key=str) == brute_removal(rows)


def test_windows_hold_every_start_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COUNTED", 500)
    size = [100, 700, 499, 1, 2500, 699, 0, 200]
    offsets = np.concatenate(([0], np.cumsum(size)))
    seen = []
    for i, j, a, b in suffix_dedup._windows(offsets):
        for k in range(i, j):
            seen += range(max(a, offsets[k]), min(b, offsets[k + 1]) - suffix_dedup.WIDTH + 1)
    assert seen == [p for k in range(len(size)) for p in range(offsets[k], offsets[k + 1] - suffix_dedup.WIDTH + 1)]
