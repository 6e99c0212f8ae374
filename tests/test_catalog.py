"""Declared tables and bucketed tables: what they hold, and what their plans read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadflow.operators import rollups, similarity
from leadflow.plans import pipeline
from leadflow.session import scratch_path
from leadflow.sources import catalog, io

D = dt.date


AUTO = "spark.sql.sources.bucketing.autoBucketedScan.enabled"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lookup_plan(df):
    """The plan with the scan's buckets spelled out: by default a scan that needs
    no bucketing for a join reads the same files but does not say so."""
    spark = df.sparkSession
    spark.conf.set(AUTO, "false")
    try:
        return plan_of(df.select("*"))
    finally:
        spark.conf.unset(AUTO)


def rows_scanned(df):
    """Rows that the scan handed on, before any filter above it."""
    qe = df._jdf.queryExecution()
    qe.executedPlan().executeCollect()
    leaves = qe.executedPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def declared(spark):
    """The four tables over small folders; (database, locations)."""
    root = scratch_path(spark, "t-declared")
    rows = [(str(k), f"P{k % 3}", "F", "x", "WA", k % 4 + 1, D(2024, k % 3 + 1, 1), "YES" if k % 2 else "NO",
             D(2024, k % 3 + 1, 9) if k % 2 else None, 8 if k % 2 else None, 10.0 if k % 2 else None, f"P{k % 3}_2024-0{k % 3 + 1}-01", 2024, k % 3 + 1)
            for k in range(30)]
    leads = spark.createDataFrame(rows, "cif string, nama_program string, flag_program string, jenis_leads string, media_blasting string, "
                                        "wilayah int, periode_start date, take_up_flag string, take_up_date date, time_to_take_up_days int, "
                                        "total_transaction_value double, campaign_id string, year int, month int")
    where = {t: f"{root}/{t}" for t in catalog.TABLES}
    io.write_leads_partitioned(leads, where["leads"])
    master = rollups.campaign_master(leads)
    io.write_campaigns_partitioned(master, where["campaign"])
    io.write_snapshot(rollups.overview_agg(master), where["campaign_overview_agg"])
    io.write_snapshot(rollups.regional_weekly(leads), where["regional_performance_agg"])
    catalog.declare_tables(spark, where, "t_declared")
    return "t_declared", where


def test_declared_schema_and_rows(spark, declared):
    db, _ = declared
    for name, (columns, parts, _) in catalog.TABLES.items():
        want = [c.split() for c in (columns + (", " + parts if parts else "")).replace("\n", " ").split(",")]
        got = [[f.name, f.dataType.simpleString()] for f in spark.table(f"{db}.{name}").schema.fields]
        assert got == [[c, {"INT": "int", "BIGINT": "bigint"}.get(t, t.lower())] for c, t in want]
    assert spark.table(f"{db}.leads").count() == 30
    assert spark.sql(f"SELECT sum(total_leads) FROM {db}.campaign").first()[0] == 30
    assert spark.table(f"{db}.leads").filter("avg_aum_3_bln IS NOT NULL").count() == 0      # a column the files lack is null


def test_statistics_come_from_the_catalogue(spark, declared):
    db, where = declared
    got = {r.table_name: (r.row_count, r.partitions) for r in catalog.table_statistics(spark, [f"{db}.{t}" for t in catalog.TABLES]).collect()}
    assert got["leads"] == (30, 3) and got["campaign"][1] == 3 and got["campaign_overview_agg"][1] == 0
    said = catalog.column_range(spark, f"{db}.leads", "wilayah")
    assert (said["min"], said["max"], said["num_nulls"]) == ("1", "4", "0")
    catalog.declare_tables(spark, {"leads": where["leads"]}, "t_bare", statistics=False)
    assert [tuple(r) for r in catalog.table_statistics(spark, ["t_bare.leads"]).collect()] == [("leads", None, 3)]
    with pytest.raises(ValueError):
        catalog.declare_tables(spark, {"nonsense": "/x"})


def test_partition_predicate_prunes_in_the_catalogue(spark, declared):
    db, _ = declared
    q = spark.sql(f"SELECT campaign_id FROM {db}.campaign WHERE year = 2024 AND month = 2")
    plan = plan_of(q)
    assert "PartitionFilters: [isnotnull(year" in plan and "InMemoryFileIndex(1 paths)" in plan
    assert {r[0] for r in q.collect()} == {"P1_2024-02-01"}


def test_partitions_follow_the_folders(spark, declared):
    _, where = declared
    path = scratch_path(spark, "t-sync")
    io.write_campaigns_partitioned(io.read_campaigns(spark, where["campaign"]), path)
    catalog.declare_tables(spark, {"campaign": path}, "t_sync")
    io.drop_partition(spark, path, year=2024, month=3)
    extra = io.read_campaigns(spark, path).filter("month = 1").withColumn("month", F.lit(7))
    extra = spark.createDataFrame(extra.collect(), extra.schema)
    io.replace_months(extra, path)
    catalog.sync_partitions(spark, "t_sync.campaign")
    assert {r[0] for r in spark.sql("SHOW PARTITIONS t_sync.campaign").collect()} == \
        {"year=2024/month=1", "year=2024/month=2", "year=2024/month=7"}
    assert spark.table("t_sync.campaign").filter("month = 7").count() == extra.count()


def dim_of(spark, n=60):
    return spark.createDataFrame([(f"C{k:03d}", f"n{k}", f"F{k % 2}", f"J{k % 5}", f"M{k % 3}", D(2024, 1, 1), 10, k % 10, 1.0, float(k % 10) * 10)
                                  for k in range(n)],
                                 "campaign_id string, nama_program string, flag_program string, jenis_leads string, media_blasting string, "
                                 "periode_start date, total_leads long, total_take_up long, total_transaction_value double, take_up_rate double")


def test_bucketed_index_reads_one_bucket_and_joins_in_place(spark):
    dim = dim_of(spark)
    path = scratch_path(spark, "t-bucketed")
    index, campaigns = pipeline.store_similarity(dim, path)
    one = similarity.lookup(index, "C007", 5)
    assert "SelectedBucketsCount: 1 out of 8" in lookup_plan(one)
    assert rows_scanned(one) < index.count() / 4
    want = [tuple(r) for r in similarity.similar_topk(dim, k=5).filter("campaign_id = 'C007'").orderBy("rank").select(*index.columns).collect()]
    assert [tuple(r) for r in one.orderBy("rank").collect()] == want and len(want) == 5
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        both = similarity.with_own_rate(index, campaigns)
        assert "Exchange" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
        assert both.count() == index.count() == similarity.similarity_index(dim).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    with pytest.raises(ValueError):
        similarity.lookup(index, "C007", 0)


def test_bucketed_folder_declared_again(spark):
    path = scratch_path(spark, "t-again")
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"))
    catalog.store_bucketed(df, "again_a", path, "k", ["k"], 8)
    again = catalog.declare_bucketed(spark, "again_b", path, "k string, v bigint", "k", ["k"], 8)
    assert "SelectedBucketsCount: 1 out of 8" in lookup_plan(again.filter("k = '17'"))
    assert [r.v for r in again.filter("k = '17'").collect()] == [3] and again.count() == 500


def test_bucket_numbers_grow_with_the_rows():
    assert [catalog.buckets_for(n) for n in (0, 16_000_000, 16_000_001, 10 ** 9)] == [8, 8, 16, 512]
