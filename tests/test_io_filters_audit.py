"""Filters, personal-data removal, audit records, JSON fixtures, the
partitioned sinks and the streaming ingest on small inline inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from leadflow.operators import audit, filters, privacy
from leadflow.session import scratch_path
from leadflow.sources import io
from leadflow.streaming import audit_stream

D = dt.date


def leads_df(spark):
    return spark.createDataFrame(
        [("1", "PROGRAM QRIS", "WA", 1, "X", D(2024, 1, 1), "c1"),
         ("2", "PROGRAM QRIS", "SMS", 2, "X", None, "c1"),
         ("3", "PROGRAM BIAYA ADMIN", "WA", 3, "Y", D(2024, 5, 1), "c2")],
        "cif string, flag_program string, media_blasting string, wilayah int, jenis_leads string, "
        "periode_start date, campaign_id string")


def test_facets_none_vs_empty(spark):
    df = leads_df(spark)
    assert filters.filter_leads_facets(df).count() == 3
    assert filters.filter_leads_facets(df, flag_program=[]).count() == 0
    got = filters.filter_leads_facets(df, flag_program=["program qris"], media_blasting=["wa"])
    assert [r.cif for r in got.collect()] == ["1"]


def test_period_range_null_dates_pass(spark):
    got = filters.filter_period_range(leads_df(spark), "2024-01-01", "2024-01-31")
    assert sorted(r.cif for r in got.collect()) == ["1", "2"]


def test_active_filters(spark):
    df = leads_df(spark)
    assert filters.filter_active(df, []).count() == 3
    assert filters.filter_active(df, [("wilayah", ["1", "3"]), ("media_blasting", ["WA"])]).count() == 2
    assert filters.filter_active(df, [("region", ["1"])]).count() == 0          # absent column
    assert filters.filter_active(df, [("period", ["2024-01-01"])]).count() == 0   # no period column
    with pytest.raises(ValueError):
        filters.validate_filters([("colour", ["red"])])
    with pytest.raises(ValueError):
        filters.validate_filters([("product", [])])


def test_lenient_totals_skip_malformed_row(spark):
    rows = spark.createDataFrame([("10", "2"), ("x", "5"), (None, "1")], "a string, b string")
    r = filters.lenient_totals(rows, ["a", "b"]).first()
    assert (r.a, r.b, r.rows_used, r.rows_skipped) == (10, 3, 2, 1)


def test_param_query_binds_values(spark):
    df = leads_df(spark)
    out = filters.param_query(spark, "SELECT cif FROM t WHERE jenis_leads = :j AND wilayah >= :w",
                              {"j": "X' OR '1'='1", "w": 1}, {"t": df})
    assert out.count() == 0


def test_strip_pii_nested(spark):
    df = spark.createDataFrame(
        [("1", {"cif": "9", "name": "a"}, [{"nama_lengkap": "x", "k": 1}], {"cif": "1", "ok": "2"})],
        "cif string, s struct<cif:string,name:string>, arr array<struct<nama_lengkap:string,k:int>>, "
        "m map<string,string>")
    out = privacy.strip_pii(df)
    assert out.columns == ["s", "arr", "m"]
    r = out.first()
    assert r.s.asDict() == {"name": "a"}
    assert r.arr[0].asDict() == {"k": 1}
    assert r.m == {"ok": "2"}
    assert privacy.pii_paths(df.schema) == ["cif", "s.cif", "arr[].nama_lengkap", "m{}"]
    rep = {r.path: r.rows_with_value for r in privacy.pii_report(df).collect()}
    assert rep == {"cif": 1, "s.cif": 1, "arr[].nama_lengkap": 1, "m{}": 1}


def test_pii_counts_and_structs_of_nothing_else(spark):
    df = spark.createDataFrame(
        [(None, {"cif": "9"}, [{"v": {"cif": None}}, {"v": {"cif": "2"}}], {"ok": "2"}, {"a": {"cif": "1", "k": 1}}),
         ("5", None, [], {"ok": "3"}, None)],
        "cif string, s struct<cif:string>, arr array<struct<v:struct<cif:string>,k:int>>, m map<string,string>, "
        "n map<string,struct<cif:string,k:int>>")
    rep = {r.path: r.rows_with_value for r in privacy.pii_report(df).collect()}
    assert rep == {"cif": 1, "s.cif": 1, "arr[].v.cif": 1, "n{}.cif": 1}       # m holds no personal key
    out = privacy.strip_pii(df)
    assert out.columns == ["arr", "m", "n"] and out.schema["arr"].dataType.elementType.names == ["k"]
    assert out.first().n["a"].asDict() == {"k": 1}


def test_audit_params_merge_and_cap(spark):
    long = "z" * 1500
    df = spark.createDataFrame(
        [("u", '{"a": 1, "page": "body wins"}'), ("u", "not json"), ("u", json.dumps({"v": long})),
         ("u", None)], "user_id string, body string")
    q = F.create_map(F.lit("page"), F.lit("p1"))
    got = [r[0] for r in df.select(audit.request_params(q, F.col("body"))).collect()]
    assert got[0] == {"page": "body wins", "a": "1"}
    assert got[1] == {"page": "p1", "body": "not json"}
    assert got[3] == {"page": "p1"}
    assert got[2] == {"page": "p1", "v": long}          # the whole body is parsed, nothing is cut
    cut = [r[0] for r in df.select(audit.request_params(q, F.col("body"), 1000)).collect()]
    assert cut[2] == {"page": "p1", "v": long[:1000]}


def test_identity_and_session_expiry(spark):
    df = spark.createDataFrame([("", "p"), (None, None), ("sub", "p")], "a string, b string")
    assert [r[0] for r in df.select(audit.user_identity(F.col("a"), F.col("b"))).collect()] == \
        ["p", "anonymous", "sub"]
    ts = [dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 16, 0, 1)]
    rows = spark.createDataFrame([("u", t, t.date()) for t in ts],
                                 "user_id string, timestamp timestamp, event_date date")
    r = audit.session_expiry(rows).first()
    assert (r.requests, r.expired_requests) == (3, 1)


def test_json_array_and_map_fixtures(spark, tmp_path):
    arr = tmp_path / "campaigns.json"
    arr.write_text(json.dumps([{"campaign_id": "C001", "duration_days": 29},
                               {"campaign_id": "C002", "duration_days": 91}], indent=2))
    df = io.read_json_array(spark, str(arr), "campaign_id string, duration_days int")
    assert sorted((r.campaign_id, r.duration_days) for r in df.collect()) == [("C001", 29), ("C002", 91)]
    mp = tmp_path / "trend.json"
    mp.write_text(json.dumps({"C001": [{"period_start": "2024-01-01", "total_leads": 5}],
                              "C002": [{"period_start": "2024-01-08", "total_leads": 7},
                                       {"period_start": "2024-01-15", "total_leads": 1}]}))
    rows = io.read_json_map(spark, str(mp), "period_start: date, total_leads: int").collect()
    assert sorted((r.campaign_id, r.total_leads) for r in rows) == [("C001", 5), ("C002", 1), ("C002", 7)]
    mp.write_text(json.dumps(json.loads(mp.read_text()), indent=2))      # pretty-printed
    again = io.read_json_map(spark, str(mp), "period_start: date, total_leads: int").collect()
    assert sorted(again) == sorted(rows)
    lines = scratch_path(spark, "t-map")
    io.write_json_map(spark.createDataFrame(rows), lines)
    back = io.read_json_map(spark, lines, "period_start: date, total_leads: int", lines=True).collect()
    assert sorted(back) == sorted(rows)
    mp.write_text("{ not json")
    with pytest.raises(Exception):
        io.read_json_map(spark, str(mp), "period_start: date, total_leads: int").collect()


def test_rebuild_leaves_no_stale_campaign(spark):
    path = scratch_path(spark, "t-rebuild")
    df = spark.createDataFrame([("A", "1"), ("B", "2")], "campaign_id string, cif string")
    io.write_leads_partitioned(df, path)
    io.write_leads_partitioned(df.filter("campaign_id = 'A'"), path)
    assert [r.campaign_id for r in io.read_enriched_leads(spark, path).collect()] == ["A"]


@pytest.mark.parametrize("files", [1, 16, 40])
def test_audit_stream_answer_does_not_depend_on_files(spark, files):
    src, sink = scratch_path(spark, "t-many-src"), scratch_path(spark, "t-many-sink")
    ev = spark.range(400).selectExpr(
        "cast(id % 7 as string) AS user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast((id * 37) % 400 as int)) AS timestamp",
        "'p' AS page_accessed", "'view' AS action", "cast(null as string) AS request_body", "id AS event_id")
    ev.repartition(files, "event_id").write.parquet(src)
    schema = spark.read.parquet(src).schema
    ckpt = scratch_path(spark, "t-many-ckpt")
    out = audit_stream.run_audit_stream(spark, src, schema, sink, ckpt, max_files_per_trigger=6)
    assert out.count() == 400
    ev.filter("event_id % 3 = 0").write.mode("append").parquet(src)     # in a later run of the same query
    assert audit_stream.run_audit_stream(spark, src, schema, sink, ckpt).count() == 400
    # and by another query into the same sink
    assert audit_stream.run_audit_stream(spark, src, schema, sink, scratch_path(spark, "t-many-ckpt2")).count() == 400


def test_partitioned_sink_keeps_text_ids_and_prunes(spark):
    df = spark.createDataFrame([("0001", "a"), ("2024-01-01", "b"), ("0001", "c")],
                               "campaign_id string, v string")
    path = scratch_path(spark, "t-leads")
    io.write_leads_partitioned(df, path)
    back = io.read_enriched_leads(spark, path)
    assert sorted(r.campaign_id for r in back.collect()) == ["0001", "0001", "2024-01-01"]
    q = back.filter(F.col("campaign_id") == "0001")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and q.count() == 2


def test_audit_stream_dedups_redelivered_files(spark):
    src = scratch_path(spark, "t-audit-src")
    ev = spark.createDataFrame(
        [(str(u), dt.datetime(2024, 1, 1, h), f"p{h % 5}", "view", '{"k": 1}', h)
         for u in range(3) for h in range(4)],
        "user_id string, timestamp timestamp_ntz, page_accessed string, action string, "
        "request_body string, event_id long")
    ev.write.parquet(src, mode="append")
    ev.filter("event_id < 2").write.parquet(src, mode="append")      # re-delivered
    out = audit_stream.run_audit_stream(spark, src, spark.read.parquet(src).schema,
                                        scratch_path(spark, "t-audit-sink"),
                                        scratch_path(spark, "t-audit-ckpt"))
    assert out.count() == 12
    assert out.select("user_id", "timestamp").distinct().count() == 12


@pytest.mark.parametrize("op", ["time_stats", "criteria_distribution", "regional_from_leads"])
def test_request_filter_prunes_campaign_partitions(spark, op):
    """A per-campaign request is a filter on the all-campaign operator; it
    reaches the partitioned scan as a partition filter."""
    from leadflow.operators import criteria, rollups, time_analysis
    fn = {"time_stats": time_analysis.time_stats,
          "criteria_distribution": criteria.criteria_distribution,
          "regional_from_leads": rollups.regional_from_leads}[op]
    df = spark.createDataFrame(
        [("A", "1", "YES", D(2024, 1, 1), D(2024, 1, 5), 4, "WA", 1, "MASS", "GEN Z", "CRS", "P", 1.0),
         ("B", "2", "NO", D(2024, 1, 1), None, None, "WA", 2, "MASS", "GEN Z", "CRS", "P", None)],
        "campaign_id string, cif string, take_up_flag string, periode_start date, take_up_date date, "
        "time_to_take_up_days int, media_blasting string, wilayah int, segment_by_aum string, "
        "range_usia string, segment_div_owner string, flag_program string, "
        "total_transaction_value double")
    path = scratch_path(spark, "t-req")
    io.write_leads_partitioned(df, path)
    q = fn(io.read_enriched_leads(spark, path)).filter(F.col("campaign_id") == "A")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(campaign_id" in plan and "(campaign_id#" in plan
    assert {r.campaign_id for r in q.collect()} == {"A"}
