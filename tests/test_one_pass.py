"""The one-pass ETL: statuses, observed metrics, arrival order, what its plan reads."""

import os

import pytest
from pyspark.sql import functions as F

from leadflow.operators import clean, quality
from leadflow.plans import pipeline
from leadflow.session import scratch_path
from leadflow.sources import io
from tests.test_clean import df_of, lead, mon

LEADS, MONITORING = io.LEADS_SCHEMA, io.MONITORING_SCHEMA


def as_text(df):
    return df.select(*[F.col(c).cast("string") for c in df.columns])


@pytest.fixture(scope="module")
def drop(spark):
    """Raw files with every kind of loss; the paths of a run over them."""
    root = scratch_path(spark, "t-one-pass")
    p = pipeline.Paths(raw_leads=f"{root}/leads", raw_monitoring=f"{root}/mon", enriched=f"{root}/clean", campaigns=f"{root}/campaigns",
                       overview=f"{root}/o", regional=f"{root}/r", similarity=f"{root}/s")
    leads = as_text(df_of(spark, [lead("1"), lead("1", start="01/01/2024"), lead("2", cabang=7), lead("3"), lead("4"),
                                  lead("", name="B"), lead(None), lead(None),               # blank, repeated
                                  lead("5", start="garbage"), lead("5", start="garbage"),   # no date, repeated
                                  lead("6", name=None),
                                  lead("7"), lead("7")], LEADS))                            # malformed, repeated
    leads = leads.withColumn("wilayah", F.when(F.col("cif") == "7", "north").otherwise(F.col("wilayah")))
    outcomes = as_text(df_of(spark, [mon("1"), mon("1", flag="NO"), mon(" 2", flag="no", date="soon"), mon("9"), mon("9"),
                                     mon("3", name=None), mon("  "), mon("4", value=5.0)], MONITORING))
    outcomes = outcomes.withColumn("total_transaction_value", F.when(F.col("cif") == "4", "much").otherwise(F.col("total_transaction_value")))
    io.write_csv(leads, p.raw_leads)
    io.write_csv(outcomes, p.raw_monitoring)
    return p


def test_every_row_has_a_status(spark, drop):
    got = pipeline.split_raw(spark, drop)
    rows = spark.read.parquet(drop.enriched)
    n = {(r.source, r.status): r["count"] for r in rows.groupBy("source", "status").count().collect()}
    assert n == {("leads", "clean"): 4, ("leads", "blank_key"): 3, ("leads", "no_campaign"): 2, ("leads", "malformed"): 2,
                 ("monitoring", "without_lead"): 2, ("monitoring", "blank_key"): 1, ("monitoring", "malformed"): 1}
    # rows in = rows of every status + duplicates
    assert got["lead_rows"] == 13 == sum(v for (s, _), v in n.items() if s == "leads") + got["lead_duplicates_dropped"]
    matched = 2
    assert got["monitoring_rows"] == 8 == sum(v for (s, _), v in n.items() if s == "monitoring") + matched + got["monitoring_duplicates_dropped"]
    kept = {r.cif: r for r in io.read_enriched_leads(spark, drop.enriched).collect()}
    assert set(kept) == {"1", "2", "3", "4"}                       # 7 does not fit its schema
    assert kept["1"].take_up_flag == "YES" and kept["1"].time_to_take_up_days == 9
    assert kept["2"].take_up_flag == "NO" and kept["2"].take_up_date is None and kept["2"].cabang == 7
    assert kept["4"].take_up_flag == "NO"                          # its outcome does not fit
    assert "status" not in kept["1"].asDict() and kept["1"].campaign_id == "PROG_A_2024-01-01"
    text = [r.raw_line for r in pipeline.quarantine(spark, drop).filter("status = 'malformed'").orderBy("source").collect()]
    assert "north" in text[0] and "north" in text[1] and "much" in text[2]


def test_observed_metrics_equal_the_quality_report(spark, drop):
    got = pipeline.split_raw(spark, drop)
    want = {r.metric: r.value for r in quality.etl_quality(io.read_raw(spark, drop.raw_leads, LEADS),
                                                           io.read_raw(spark, drop.raw_monitoring, MONITORING)).collect()}
    assert want.pop("monitoring_without_lead") == 3               # rows; the observed metric counts keys
    assert got == want
    assert (want["lead_malformed"], want["monitoring_malformed"], want["monitoring_keys_without_lead"]) == (2, 1, 2)


def test_each_source_is_scanned_once_and_the_join_moves_nothing(spark, drop):
    watch = clean.EtlWatch()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = clean.split_by_status(io.read_raw(spark, drop.raw_leads, LEADS), io.read_raw(spark, drop.raw_monitoring, MONITORING),
                                    (io.malformed(LEADS), io.malformed(MONITORING)), watch)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("FileScan csv") == 2
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("WindowGroupLimit") >= 2
    assert "SortMergeJoin" in plan


def test_held_rows_of_both_sources_do_not_meet(spark):
    """Rows at the same place of either source, with the same key, both misfits."""
    root = scratch_path(spark, "t-held")
    p = pipeline.Paths(raw_leads=f"{root}/leads", raw_monitoring=f"{root}/mon", enriched=f"{root}/clean", campaigns=f"{root}/campaigns",
                       overview=f"{root}/o", regional=f"{root}/r", similarity=f"{root}/s")
    for df, path in ((df_of(spark, [lead("1"), lead(""), lead("2")], LEADS), p.raw_leads),
                     (df_of(spark, [mon("1"), mon(""), mon("2")], MONITORING), p.raw_monitoring)):
        io.write_csv(as_text(df).withColumn("wilayah", F.when(F.col("cif") == "1", "north").otherwise(F.col("wilayah"))).coalesce(1), path)
    got = pipeline.split_raw(spark, p)
    held = {(r.source, r.status): r["count"] for r in pipeline.quarantine(spark, p).groupBy("source", "status").count().collect()}
    assert held == {(s, t): 1 for s in ("leads", "monitoring") for t in ("malformed", "blank_key")}
    assert (got["lead_rows"], got["lead_duplicates_dropped"], got["monitoring_duplicates_dropped"]) == (3, 0, 0)


def test_no_rows(spark):
    root = scratch_path(spark, "t-none")
    p = pipeline.Paths(raw_leads=f"{root}/leads", raw_monitoring=f"{root}/mon", enriched=f"{root}/clean", campaigns=f"{root}/campaigns",
                       overview=f"{root}/o", regional=f"{root}/r", similarity=f"{root}/s")
    io.write_csv(df_of(spark, [lead("1")], LEADS), p.raw_leads)
    io.write_csv(df_of(spark, [mon("1")], MONITORING).limit(0), p.raw_monitoring)
    assert pipeline.split_raw(spark, p)["monitoring_rows"] == 0
    assert [r.take_up_flag for r in io.read_enriched_leads(spark, p.enriched).collect()] == ["NO"]


@pytest.mark.parametrize("first", ["a", "b"])
def test_the_earlier_drop_stays(spark, tmp_path, first):
    for name, cabang in (("a", 1), ("b", 9)):
        io.write_csv(df_of(spark, [lead("1", cabang=cabang), lead("2", cabang=cabang)], LEADS).coalesce(1), str(tmp_path / name))
        for f in (tmp_path / name).iterdir():
            os.utime(f, (1_700_000_000, 1_700_000_000 + (0 if name == first else 60)))
    rows = clean.clean_leads(io.read_leads(spark, f"{tmp_path}/*", lineage=True))
    assert {r.cabang for r in rows.collect()} == {1 if first == "a" else 9}
    assert {r.cabang for r in clean.clean_leads(io.read_leads(spark, f"{tmp_path}/*")).collect()} == {1}   # by value, whatever came first
    p = pipeline.Paths(raw_leads=f"{tmp_path}/*", raw_monitoring=f"{tmp_path}/mon", enriched=f"{tmp_path}/clean", campaigns="", overview="",
                       regional="", similarity="", arrival_order=True)
    io.write_csv(df_of(spark, [mon("1")], MONITORING), p.raw_monitoring)
    p.raw_leads = f"{tmp_path}/[ab]"
    pipeline.split_raw(spark, p)
    assert {r.cabang for r in io.read_enriched_leads(spark, p.enriched).collect()} == {1 if first == "a" else 9}


def test_place_in_a_file_is_the_order_of_arrival(spark, tmp_path):
    io.write_csv(df_of(spark, [lead("1", cabang=5), lead("1", cabang=3), lead("1", cabang=9)], LEADS).coalesce(1), str(tmp_path / "d"))
    got = clean.clean_leads(io.read_leads(spark, str(tmp_path / "d"), lineage=True)).collect()
    assert [r.cabang for r in got] == [5]
