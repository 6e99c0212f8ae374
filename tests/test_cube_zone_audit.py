"""The time cube, the clustered clean zone and the audit sink."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators import compare, time_analysis
from leadflow.session import scratch_path
from leadflow.sources import io
from leadflow.streaming import audit_stream
from tests.test_catalog import plan_of, rows_scanned

D = dt.date


def converted(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        gap = rng.choice([None, rng.randrange(-5, 130)])
        rows.append((rng.choice("ABC"), str(k), rng.choice(["WA", "SMS", None]), rng.choice([1, 2, None]), "NO" if gap is None else rng.choice(["YES", "YES", "NO"]),
                     D(2024, 1, 1), None if gap is None else D(2024, 1, 1) + dt.timedelta(gap), gap, 1.0, "n", "F"))
    return spark.createDataFrame(rows, "campaign_id string, cif string, media_blasting string, wilayah int, take_up_flag string, periode_start date, "
                                       "take_up_date date, time_to_take_up_days int, total_transaction_value double, nama_program string, flag_program string")


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def test_cube_answers_what_the_leads_answer(spark):
    leads = converted(spark, 4)
    cube = time_analysis.time_cube(leads, canonical=True)
    for by in (None, ["media_blasting"], ["wilayah"], ["media_blasting", "wilayah"]):
        assert rows(time_analysis.stats_from_cube(cube, by)) == rows(time_analysis.time_stats(leads, by))
    assert rows(time_analysis.histogram_from_cube(cube)) == rows(time_analysis.time_histogram(leads))
    cut = lambda df: time_analysis.filter_channel_region(df, channel="wa", region="2")
    assert rows(time_analysis.stats_from_cube(cut(cube))) == rows(time_analysis.time_stats(cut(leads)))
    assert time_analysis.stats_from_cube(cube.limit(0)).count() == 0


def test_cubes_of_parts_merge_exactly(spark):
    parts = [converted(spark, k) for k in (1, 2, 3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    cubes = [time_analysis.time_cube(p) for p in parts]
    assert rows(time_analysis.merged_cubes(*cubes)) == rows(time_analysis.time_cube(whole))
    assert rows(time_analysis.stats_from_cube(time_analysis.merged_cubes(*cubes))) == rows(time_analysis.time_stats(whole))


def test_clustered_zone_is_read_in_part(spark):
    # one campaign holds a third of all rows and still lies in several files
    n = 60_000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.format_string("C%03d", F.col("id") % 200)).alias("campaign_id"),
                               F.col("id").cast("string").alias("cif"), F.lit("n").alias("nama_program"), F.lit("F").alias("flag_program"),
                               F.when(F.col("id") % 2 == 0, "YES").otherwise("NO").alias("take_up_flag"), F.lit(D(2024, 1, 1)).alias("take_up_date"),
                               F.lit(1.0).alias("total_transaction_value"))
    path = scratch_path(spark, "t-clustered")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # the test's few bytes would become one file
    try:
        io.write_clustered(df, path, ["campaign_id", "cif"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    zone = spark.read.parquet(path)
    files = zone.groupBy(F.input_file_name().alias("f")).agg(F.count_if(F.col("campaign_id") == "HOT").alias("hot"), F.count("*").alias("n")).collect()
    assert sum(1 for f in files if f.hot) >= 2 and max(f.n for f in files) < n / 3
    one = zone.filter(F.col("campaign_id").isin("C004", "C007"))
    assert "PushedFilters: [In(campaign_id" in plan_of(one)
    want = one.count()
    assert want == sum(1 for k in range(n) if k % 3 and k % 200 in (4, 7)) and rows_scanned(one) < n / 4
    asked = compare.compare_requested(zone, None, ["C004", "NONE"])
    assert "In(campaign_id" in plan_of(asked)
    assert {r.campaign_id: r.total_leads for r in asked.collect()} == {"C004": sum(1 for k in range(n) if k % 3 and k % 200 == 4), "NONE": 0}
    plan = plan_of(time_analysis.take_up_leads(zone, canonical=True))
    assert "EqualTo(take_up_flag,YES)" in plan and "IsNotNull(take_up_date)" in plan


# ------------------------------------------------------------ audit sink

def delivered(spark, n=300):
    """Events of five days; three each share their key and differ in page or action."""
    return spark.range(n).selectExpr(
        "cast(id % 100 % 7 as string) AS user_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 5 as int), cast(id % 100 % 24 as int), cast(id % 100 % 60 as int)) AS timestamp",
        "concat('p', (id * 13) % 11) AS page_accessed", "concat('a', (id * 7) % 3) AS action", "cast(null as string) AS request_body", "id AS event_id")


def ingested(spark, files, most_files=6):
    src, sink = scratch_path(spark, "t-src"), scratch_path(spark, "t-sink")
    ev = delivered(spark)
    ev.repartition(files, "event_id").write.parquet(src)
    out = audit_stream.run_audit_stream(spark, src, spark.read.parquet(src).schema, sink, scratch_path(spark, "t-ckpt"), most_files)
    return rows(out.drop("request_params")), sink


def test_same_rows_and_survivors_for_any_number_of_files(spark):
    keys = delivered(spark).select("user_id", "timestamp").distinct().count()
    one, _ = ingested(spark, 1)
    assert len(one) == keys < 300
    assert ingested(spark, 16)[0] == one and ingested(spark, 40)[0] == one


def audit_batch(spark, ids):
    from leadflow.operators.audit import audit_rows
    return audit_rows(delivered(spark).filter(F.col("event_id").isin(list(ids)))).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_many_batches_leave_few_parts_and_the_same_rows(spark):
    sink = scratch_path(spark, "t-compact")
    whole = audit_batch(spark, range(300))
    for k in range(20):
        audit_stream.append_batch(audit_batch(spark, range(k * 15, k * 15 + 15)), k, sink, "q", most_parts=4)
        days = [d for d in io.children(spark, sink) if d.startswith("event_date=")]
        assert all(len([p for p in io.children(spark, f"{sink}/{d}") if p.startswith("part=")]) <= 5 for d in days)
    want = rows(audit_stream.survivors(whole).drop("request_params"))
    assert rows(audit_stream.read_sink(spark, sink, whole.schema).drop("request_params")) == want
    # a retried batch overwrites its parts, or comes again after they were compacted
    audit_stream.append_batch(audit_batch(spark, range(285, 300)), 19, sink, "q", most_parts=4)
    audit_stream.append_batch(audit_batch(spark, range(15)), 0, sink, "q", most_parts=4)
    assert rows(audit_stream.read_sink(spark, sink, whole.schema).drop("request_params")) == want
    days = [D(2024, 1, k) for k in range(1, 6)]
    audit_stream.compact(spark, sink, whole.schema, days)
    assert [len(audit_stream.parts_of(spark, sink, d)) for d in days] == [1] * 5
    assert rows(audit_stream.read_sink(spark, sink, whole.schema).drop("request_params")) == want


def test_a_compaction_that_fails_halfway_changes_nothing(spark, monkeypatch):
    sink = scratch_path(spark, "t-half")
    for k in range(3):
        audit_stream.append_batch(audit_batch(spark, range(k * 50, k * 50 + 80)), k, sink, "q")
    schema = audit_batch(spark, [1]).schema
    want = rows(audit_stream.read_sink(spark, sink, schema).drop("request_params"))
    gone = []

    def remove_one(s, path):
        if gone:
            raise RuntimeError("lost")
        gone.append(path)
        s._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(s._jsc.hadoopConfiguration()).delete(s._jvm.org.apache.hadoop.fs.Path(path), True)
    monkeypatch.setattr(audit_stream.io, "remove", remove_one)
    with pytest.raises(RuntimeError):
        audit_stream.compact(spark, sink, schema, [D(2024, 1, 1), D(2024, 1, 2)])
    monkeypatch.undo()
    assert rows(audit_stream.read_sink(spark, sink, schema).drop("request_params")) == want
    audit_stream.compact(spark, sink, schema, [D(2024, 1, 1), D(2024, 1, 2)])
    assert rows(audit_stream.read_sink(spark, sink, schema).drop("request_params")) == want


def test_empty_sink_and_missing_days(spark):
    schema = audit_batch(spark, [1]).schema
    sink = scratch_path(spark, "t-none")
    assert audit_stream.read_sink(spark, sink, schema).count() == 0
    audit_stream.compact(spark, sink, schema, [D(2024, 1, 1)])
    nodate = audit_batch(spark, [1, 2]).withColumns({"timestamp": F.lit(None).cast("timestamp"), "event_date": F.lit(None).cast("date")})
    audit_stream.append_batch(nodate, 0, sink, "q")
    audit_stream.append_batch(nodate, 1, sink, "q", most_parts=1)
    assert audit_stream.read_sink(spark, sink, schema).count() == nodate.select("user_id").distinct().count()
    assert len(audit_stream.parts_of(spark, sink, None)) == 1
