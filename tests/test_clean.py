"""Cleaning semantics on inline rows: date formats, key filter, dedup order,
outcome join, campaign slug, quarantine."""

import datetime as dt

from pyspark.sql import functions as F

from leadflow.functions.exprs import campaign_slug, parse_mixed_date
from leadflow.operators import clean
from leadflow.sources.io import LEADS_SCHEMA, MONITORING_SCHEMA

D = dt.date


def lead(cif, name="PROG A", start="2024-01-01", **kw):
    row = {f.name: None for f in LEADS_SCHEMA.fields}
    row.update(cif=cif, nama_program=name, periode_start=start, jenis_leads="cross sell",
               media_blasting="wa", flag_program="program qris", wilayah=1)
    row.update(kw)
    return row


def mon(cif, name="PROG A", start="2024-01-01", flag="YES", date="2024-01-10", value=10.0, **kw):
    row = lead(cif, name, start, **kw)
    row.update(take_up_flag=flag, take_up_date=date, total_transaction_value=value)
    return row


def df_of(spark, rows, schema):
    return spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in rows], schema)


def test_parse_five_formats_first_wins(spark):
    texts = ["2024-08-13", "13/08/2024", "13-08-2024", "2024/08/13", "08/13/2024",
             "01/08/2024", " 2024-08-13 ", "2024-13-45", "garbage", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(parse_mixed_date("s")).collect()]
    assert got[:5] == [D(2024, 8, 13)] * 5
    assert got[5] == D(2024, 8, 1)          # ambiguous: dd/MM wins over MM/dd
    assert got[6] == D(2024, 8, 13)         # trimmed
    assert got[7:] == [None, None, None, None]


def test_blank_cif_dropped(spark):
    raw = df_of(spark, [lead(None), lead(""), lead("   "), lead("7")], LEADS_SCHEMA)
    assert [r.cif for r in clean.filter_valid_cif(raw).collect()] == ["7"]


def test_same_lead_in_two_date_formats_is_one_lead(spark):
    raw = df_of(spark, [lead("1", start="2024-01-01", cabang=5),
                        lead("1", start="01/01/2024", cabang=3),
                        lead("1 ", start="2024/01/01", cabang=9)], LEADS_SCHEMA)
    out = clean.clean_leads(raw).collect()
    assert len(out) == 1
    assert out[0].cabang == 3                      # explicit total order, not arrival order
    assert out[0].periode_start == D(2024, 1, 1)


def test_uppercase_and_campaign_columns(spark):
    raw = df_of(spark, [lead("1", name="Promo  Hari (Raya) é", start="15-03-2024",
                             media_blasting="push notif", range_usia="gen z")], LEADS_SCHEMA)
    r = clean.clean_leads(raw).first()
    assert r.media_blasting == "PUSH NOTIF" and r.range_usia == "GEN Z"
    assert r.flag_program == "PROGRAM QRIS"
    assert r.campaign_id == "Promo_Hari_Raya__2024-03-15"
    assert (r.year, r.month) == (2024, 3)


def test_slug_null_in_null_out(spark):
    df = spark.createDataFrame([(None, D(2024, 1, 1)), ("A B", None)], "n string, d date")
    assert [r[0] for r in df.select(campaign_slug("n", "d")).collect()] == [None, None]


def test_monitoring_dedup_prefers_yes_then_earliest(spark):
    m = df_of(spark, [mon("1", flag="NO", date="2024-01-02", value=1.0),
                      mon("1", flag="yes", date="2024-01-20", value=2.0),
                      mon("1", flag="YES", date="05/01/2024", value=3.0),
                      mon("2", flag=None, date=None, value=None)], MONITORING_SCHEMA)
    out = {r.cif: r for r in clean.dedup_monitoring(m).collect()}
    assert out["1"].take_up_flag == "YES" and out["1"].total_transaction_value == 3.0
    assert out["1"].take_up_date == D(2024, 1, 5)
    assert out["2"].take_up_flag is None


def test_enrich_left_join_defaults_and_days(spark):
    leads = clean.clean_leads(df_of(spark, [lead("1"), lead("2"), lead("3")], LEADS_SCHEMA))
    m = df_of(spark, [mon("1", date="2024-01-11"),
                      mon("1", flag="NO", date="2024-01-03"),        # duplicate outcome row
                      mon("3", flag="yes", start="01/01/2024", date="2023-12-25"),  # before start
                      mon("9", date="2024-01-02")],                  # no such lead
                  MONITORING_SCHEMA)
    out = {r.cif: r for r in clean.enrich_leads(leads, m).collect()}
    assert len(out) == 3                                   # duplicates do not multiply leads
    assert out["1"].take_up_flag == "YES" and out["1"].time_to_take_up_days == 10
    assert out["2"].take_up_flag == "NO" and out["2"].time_to_take_up_days is None
    assert out["3"].take_up_flag == "YES" and out["3"].time_to_take_up_days == -7


def test_quarantine_rows_without_campaign_id(spark):
    raw = df_of(spark, [lead("1"), lead("2", name=None), lead("3", start="31/31/2024")],
                LEADS_SCHEMA)
    good, bad = clean.split_quarantine(clean.clean_leads(raw))
    assert [r.cif for r in good.collect()] == ["1"]
    assert sorted(r.cif for r in bad.collect()) == ["2", "3"]


def test_dedup_plan_limits_before_shuffle(spark):
    """A hot natural key is cut to one row per map task before the shuffle."""
    raw = df_of(spark, [lead("1")], LEADS_SCHEMA)
    plan = clean.dedup_leads(clean.normalise_leads(raw))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_etl_quality_counts_every_loss(spark):
    from leadflow.operators import quality
    leads = df_of(spark, [lead("1"), lead("1", start="01/01/2024"),       # same lead twice
                          lead(""), lead(None),                           # blank ids
                          lead("2", start="2024-99-99"),                  # bad date
                          lead("3", name=None)], LEADS_SCHEMA)            # no program name
    outcomes = df_of(spark, [mon("1"), mon("1", flag="NO"),               # duplicate outcome
                             mon("8"),                                    # outcome without lead
                             mon("3", name=None, date="not a date"),      # bad date
                             mon(" ")], MONITORING_SCHEMA)                # blank id
    got = {r.metric: r.value for r in quality.etl_quality(leads, outcomes).collect()}
    assert got == {"lead_rows": 6, "lead_blank_cif": 2, "lead_bad_dates": 1,
                   "lead_null_campaign_id": 2, "lead_duplicates_dropped": 1,
                   "monitoring_rows": 5, "monitoring_blank_cif": 1, "monitoring_bad_dates": 1,
                   "monitoring_duplicates_dropped": 1, "monitoring_without_lead": 2}


def test_etl_quality_one_pass_per_source(spark):
    from leadflow.operators import quality
    leads = df_of(spark, [lead("1"), lead("2")], LEADS_SCHEMA)
    outcomes = df_of(spark, [mon("1"), mon("9")], MONITORING_SCHEMA)
    plan = quality.etl_quality(leads, outcomes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2      # each source read once
    assert "LeftAnti" not in plan and "Join" not in plan


def test_domain_violations(spark):
    from leadflow.operators import quality
    leads = clean.clean_leads(df_of(spark, [
        lead("1", media_blasting="wa", flag_program="program qris", wilayah=17, cabang=324, outlet=0),
        lead("2", media_blasting="fax", flag_program="PROGRAM X", wilayah=18, cabang=0, outlet=100),
        lead("3", media_blasting=None, flag_program=None, wilayah=None)], LEADS_SCHEMA))
    got = {r.column_name: (r.violations, r.checked) for r in quality.domain_violations(leads).collect()}
    assert got["media_blasting"] == (1, 2)
    assert got["flag_program"] == (1, 2)
    assert got["wilayah"] == (1, 2)
    assert got["cabang"] == (1, 2)
    assert got["outlet"] == (1, 2)


def test_negative_take_up_report(spark):
    from leadflow.operators import quality
    leads = clean.clean_leads(df_of(spark, [lead("1"), lead("2")], LEADS_SCHEMA))
    m = df_of(spark, [mon("1", date="2023-12-20"), mon("2", date="2024-01-03")], MONITORING_SCHEMA)
    rows = quality.negative_take_up(clean.enrich_leads(leads, m)).collect()
    assert [(r.negative_rows, r.min_gap_days) for r in rows] == [(1, -12)]


def test_pipeline_keeps_every_row_somewhere(spark, tmp_path):
    """rows in = clean + duplicates + blank keys + quarantined; broken lines are kept apart."""
    from leadflow.plans import pipeline
    from leadflow.session import scratch_path
    from leadflow.sources import io
    root = scratch_path(spark, "t-etl")
    p = pipeline.Paths(raw_leads=f"{root}/raw/leads", raw_monitoring=f"{root}/raw/mon", enriched=f"{root}/clean",
                       campaigns=f"{root}/campaigns", overview=f"{root}/o", regional=f"{root}/r", similarity=f"{root}/s")
    leads = df_of(spark, [lead("1"), lead("1", start="01/01/2024"), lead(""), lead("2", start="garbage"),
                          lead("3", name=None), lead("4")], LEADS_SCHEMA)
    bad = leads.filter("cif = '4'").withColumn("wilayah", F.lit("notint"))
    io.write_csv(leads.filter("cif <> '4'").select(*[F.col(c).cast("string") for c in leads.columns])
                 .unionByName(bad.select(*[F.col(c).cast("string") for c in leads.columns])), p.raw_leads)
    io.write_csv(df_of(spark, [mon("1")], MONITORING_SCHEMA), p.raw_monitoring)
    master = pipeline.pipeline_raw_to_clean(spark, p)
    kept = io.read_enriched_leads(spark, p.enriched).count()
    held = spark.read.parquet(f"{p.enriched}_quarantine/rows").count()
    lines = spark.read.parquet(f"{p.enriched}_quarantine/lines").collect()
    assert master.count() >= 1
    assert kept + held + 1 + 1 == 6                      # one duplicate, one blank key
    assert [r.source for r in lines] == ["leads"] and "notint" in lines[0]._corrupt_record
