"""Deduplication stages on repeated rows and null ids."""

import random

import pytest

import corpus_pipeline
from leadflow.llm import near_dedup
from leadflow.session import scratch_path
from tests.llm.test_dedup import family, shingles


def brute_keep(rows, percent):
    """One row of each group: smallest id, null last, then the first row."""
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        first.setdefault(group[i], rows[i])
    return sorted(first.values(), key=str)


def repeated_rows():
    rng = random.Random(12)
    rows = family(rng, 12, 100, 5, 1) + family(rng, 8, 60, 2, 50)
    rows += rows[:6] + [(None, rows[0][1]), (None, rows[15][1])]
    for i in range(4):      # alone, but for rows that repeat them
        text = " ".join(f"q{i}{rng.randrange(10 ** 6)}" for _ in range(60))
        rows += [(100 + i if i else None, text)] * (i + 2) + [(None, text)]
    return rows + [(None, None), (200, ""), (201, "one two"), (201, "one two"), (201, "another text")]


@pytest.mark.parametrize("percent", [80, 85])
def test_one_row_of_each_group_stays(spark, docs, percent):
    rows = repeated_rows()
    table = docs([(i, t, "s") for i, t in rows])
    got = near_dedup.keep_one(table, percent)
    assert got.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute_keep(rows, percent)


def test_a_document_listed_twice_keeps_its_text(spark, docs):
    rng = random.Random(13)
    texts = [" ".join(f"z{i}{rng.randrange(10 ** 6)}" for _ in range(60)) for i in range(3)]
    now = docs([(1, texts[0], "s"), (1, texts[0], "s"), (2, texts[1], "s"), (None, texts[1], "s"),
                (None, texts[2], "s"), (None, texts[2], None)])
    for name in ("minhash_near_dedup", "suffix_array_dedup"):
        path = scratch_path(spark, f"t-{name}")
        dict(corpus_pipeline.STAGES)[name](spark, now, "").write.parquet(path)
        now = spark.read.parquet(path)
    assert sorted(((r.doc_id, r.text) for r in now.collect()), key=str) == \
        sorted([(1, texts[0]), (2, texts[1]), (None, texts[2])], key=str)
