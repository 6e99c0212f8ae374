"""Days without an end, searches that always fill up, names that clash, scratch that goes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadflow.llm import mixing, near_dedup, neighbours, suffix_dedup, url_lists
from leadflow.llm.common import Scratch, free_name, materialize
from leadflow.session import scratch_path
from leadflow.sources import io
from tests.llm.test_scoring_and_search import brute_neighbours


# ------------------------------------------------------------ op2

def test_open_intervals_have_no_last_day(spark):
    entries = spark.createDataFrame([("a.com", 36_400, "block"), ("b.com", 40_000, "review"), ("c.com", -50, "allow"), ("c.com", 5, "block"), ("c.com", 90, "allow")],
                                    "key string, day int, action string")
    days = [-60, -50, 4, 5, 89, 90, 36_399, 36_400, 36_499, 36_500, 39_999, 40_000, 2_000_000]
    rows = [(k * 3 + h, f"http://{host}.com/x", d) for k, d in enumerate(days) for h, host in enumerate("abc")]
    captures = spark.createDataFrame(rows, "capture_id long, url string, day int")
    got = {r.capture_id: r.action for r in url_lists.judge(captures, entries).collect()}

    def want(host, day):
        log = sorted((d, a) for k, d, a in [("a", 36_400, "block"), ("b", 40_000, "review"), ("c", -50, "allow"), ("c", 5, "block"), ("c", 90, "allow")] if k == host)
        return ([a for d, a in log if d <= day] or ["none"])[-1]
    assert got == {i: want(u[7], d) for i, u, d in rows}
    months = url_lists.validity(entries, 0, 59).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in months} == {"c.com": 3}          # only months with captures: 0 twice, for two entries, and 1


def test_judged_captures_replace_columns_of_the_same_names(spark):
    captures = spark.createDataFrame([(1, "http://a.com", 5, "old", 7)], "capture_id long, url string, day int, action string, weight int")
    entries = spark.createDataFrame([("a.com", 1, "block")], "key string, day int, action string")
    out = url_lists.judge(captures, entries)
    assert out.columns == ["capture_id", "url", "day", "weight", "action", "list_key", "listed_on"]
    assert tuple(out.first()) == (1, "http://a.com", 5, 7, "block", "a.com", 1)


# ------------------------------------------------------------ op4

def clusters(rng, n, k, width, spread, first=0):
    centres = rng.normal(0, 1, (k, width))
    return [(first + i, (centres[i % k] + rng.normal(0, spread, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("n, k, spread, parts", [(320, 40, 0.01, 16), (1500, 150, 0.005, 64), (4000, 12, 0.4, 32)])
def test_every_query_gets_all_it_can(spark, n, k, spread, parts):
    """Tight clusters: a query's own partition holds fewer than it asks for."""
    rows = clusters(np.random.default_rng(n), n, k, 16, spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(df, every=20, parts=parts, sample=min(n, 1024)).collect()]
    want = brute_neighbours(rows, every=20)
    assert len(got) == len(want)
    per = {}
    for q, r, _, _ in got:
        per.setdefault(q, []).append(r)
    assert all(sorted(r) == list(range(1, 11)) for r in per.values())
    found = {(q, i) for q, _, i, _ in got}
    assert sum((q, i) in found for q, _, i, _ in want) >= 0.9 * len(want)


def test_lengths_are_searched_each_for_itself(spark):
    rng = np.random.default_rng(2)
    rows = clusters(rng, 300, 5, 8, 0.3) + clusters(rng, 200, 5, 3, 0.3, 1000) + [(5000, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.search(df).collect())
    want = sorted(r for w in (8, 3, 1) for r in brute_neighbours([(i, v) for i, v in rows if len(v) == w]))
    assert [g[:2] for g in got] == [w[:2] for w in want] and {g[0] for g in got} == {0, 100, 200, 1000, 1100}


def test_copies_of_an_id_do_not_use_up_a_query(spark):
    rng = np.random.default_rng(3)
    copies = [(100, (np.ones(8) + rng.normal(0, 0.001, 8)).tolist()) for _ in range(60)]      # many vectors of the query's own id
    rows = copies + clusters(rng, 200, 20, 8, 0.01, 201)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(df, every=100, parts=16).filter("query_id = 100").orderBy("rank").collect()]
    x = np.array(min(v for _, v in copies))
    want = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), i) for i, v in rows[60:])[:10]
    assert [g[2] for g in got] == [i for _, i in want]


def test_partitions_grow_with_the_table():
    assert [neighbours.partitions_for(n) for n in (100, 50_000, 10 ** 6, 10 ** 8, 10 ** 12)] == [16, 16, 64, 256, 256]


# ------------------------------------------------------------ names and scratch

def test_columns_with_the_stages_own_names(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, "a", "r1", "s1", "t1", "u1", "v1"), (2, text + " x", "a", "r2", "s2", "t2", "u2", "v2"), (3, "other words here", "b", "r3", "s3", "t3", "u3", "v3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _near_row string, _mix_row string, _mix_words string, _name string, _kept string")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r._near_row for r in kept.collect()) == ["r1", "r3"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {(r.doc_id, r._mix_row, r._mix_words) for r in mixed.collect()} <= {(r[0], r[4], r[5]) for r in rows}
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and sorted((r.doc_id, r._name, r._kept) for r in cut.collect()) == [(r[0], r[6], r[7]) for r in rows]
    assert free_name(docs, "_name") == "_name_" and free_name(docs, "new") == "new"


def test_null_ids_spread_over_the_buckets(spark):
    sizes = spark.range(2000).select(F.col("id").alias("row_id"), F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(3).cast("long").alias("size"))
    targets = mixing.source_targets(sizes)
    blocks = mixing.draw_blocks(sizes, targets)
    assert blocks.agg(F.sum("words")).first()[0] == 9000 and blocks.select("place_key").distinct().count() == blocks.count()
    shards = {r.shard: r["count"] for r in mixing.stored_shards(blocks).groupBy("shard").count().collect()}
    assert len(shards) == mixing.SHARDS and max(shards.values()) - min(shards.values()) <= 4


def test_every_shard_is_a_fair_sample(spark):
    sizes = spark.range(6000).select(F.col("id").alias("row_id"), F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"),
                                     (F.col("id") % 7 + 1).alias("size"))
    blocks = mixing.stored_shards(mixing.draw_blocks(sizes, mixing.source_targets(sizes)))
    share = blocks.groupBy("source").count().collect()
    whole = {r.source: r["count"] / blocks.count() for r in share}
    for r in blocks.groupBy("shard").agg(F.avg(F.when(F.col("source") == "a", 1.0).otherwise(0.0)).alias("a"), F.count("*").alias("n"), F.avg("size").alias("size")).collect():
        assert abs(r.a - whole["a"]) < 5 * (whole["a"] * whole["b"] / r.n) ** 0.5 and abs(r.size - 4) < 0.5
    assert blocks.groupBy("row_id", "copy").count().filter("count > 1").count() == 0


def test_a_stage_removes_what_the_last_one_left(spark):
    sf = scratch_path(spark, "t-left")
    rows = [(i, f"some words {i} " * 8, "en", "ab"[i % 2], 10) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    root = sf.rsplit("/", 1)[0]
    before = set(io.children(spark, root))
    assert corpus_pipeline.run(spark, sf).count() > 0
    left = {p.rsplit("-", 1)[0] for p in set(io.children(spark, root)) - before}
    assert not any(p.startswith(("near-", "suffix-", "mix-", "cc-")) for p in left) and "pipeline-best_fit_packing" in left
    assert "pipeline-toxicity" not in left and "pipeline-source_mixing" not in left


def test_scratch_that_is_still_read_stays(spark):
    scratch = Scratch()
    with scratch:
        a, b = materialize(spark.range(5).toDF("x"), "t-keep"), materialize(spark.range(7).toDF("y"), "t-drop")
    scratch.remove(spark, a.filter("x > 1"))
    assert len(scratch.paths) == 1 and a.count() == 5
    scratch.remove(spark)
    assert scratch.paths == [] and not io.exists(spark, a.inputFiles()[0])


def test_pipeline_of_no_documents(spark):
    sf = scratch_path(spark, "t-none")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
