"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry is one operator of the inventory run over the whole bound
tables. ``checked`` rounds doubles to 4 dp (the oracle does the same) so
that float summation order cannot change the compared values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from leadflow.functions import exprs
from leadflow.operators import (audit, clean, compare, criteria, distinct, filters, privacy, quality,
                                recommend, rollups, similarity, time_analysis)
from leadflow.plans import pipeline, refresh
from leadflow.plans.views import Views, stored_zone
from leadflow.session import scratch_path
from leadflow.sources import bindings, catalog, io
from leadflow.sources.bindings import LEAD_COLUMNS
from leadflow.streaming import audit_stream

Query = Callable[[SparkSession, str], DataFrame]
# campaigns of the registered comparison request; the last one does not exist
REQUESTED = ["1-URGENT_1997-01-01", "2-HIGH_1996-05-01", "NO-SUCH_2000-01-01"]
REGISTRY: dict[str, Query] = {}


def checked(df: DataFrame, scale: int = 4) -> DataFrame:
    cols = [F.round(F.col(f.name), scale).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


def register(name: str, scale: int = 4):
    def deco(fn: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return checked(fn(Views.of(spark, sf_dir)), scale)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return fn
    return deco


# ------------------------------------------------------------ clean

@register("dedup_leads")
def _dedup_leads(v: Views):
    """Keep-first lead per natural key after normalisation."""
    df = clean.dedup_leads(clean.normalise_leads(clean.filter_valid_cif(v.leads_raw)))
    return df.select(*LEAD_COLUMNS)


@register("clean_leads")
def _clean_leads(v: Views):
    return v.leads.select(*LEAD_COLUMNS, "campaign_id", "year", "month")


@register("enrich_leads")
def _enrich_leads(v: Views):
    """J1 from the raw bindings (the ETL itself, not the stored table)."""
    return v.enriched_fresh


@register("campaign_master")
def _campaign_master(v: Views):
    """A1 from the raw bindings through the whole cleaning path."""
    return v.master_fresh


# ------------------------------------------------------------ periods and roll-ups


@register("granularity")
def _granularity(v: Views):
    """Per campaign, planned duration and weekly/monthly granularity."""
    df = rollups.with_granularity(v.dim, v.catalogue)
    return df.select("campaign_id", "duration_days", "granularity")


@register("period_buckets")
def _period_buckets(v: Views):
    """Per campaign, the bucket start and end of its start date."""
    df = rollups.with_period_buckets(rollups.with_granularity(v.dim, v.catalogue))
    return df.select("campaign_id", "granularity", "period_bucket", "period_end")


@register("overview_agg")
def _overview_agg(v: Views):
    """A2 from the stored master (the roll-up itself, not the stored one)."""
    return rollups.overview_agg(v.master, v.catalogue)


@register("overview_stored")
def _overview_stored(v: Views):
    """The stored roll-up, as requests read it."""
    return v.overview


@register("overview_query")
def _overview_query(v: Views):
    """F7 + O6: containment filter on the roll-up (whole roll-up scanned), in order."""
    return rollups.in_order(rollups.overview_query(
        v.overview, start="1996-01-01", end="1999-12-31", products=["PROGRAM H1"],
        channels=["urgent", "high", "low"], regions=list(range(1, 10))))


@register("overview_totals")
def _overview_totals(v: Views):
    return rollups.overview_totals(v.enriched)


@register("overview_totals_from_agg")
def _overview_totals_from_agg(v: Views):
    return rollups.overview_totals_from_agg(v.overview_mergeable)


@register("overview_totals_filtered")
def _overview_totals_filtered(v: Views):
    """Totals of a filtered roll-up; campaigns span its regions and are
    counted once."""
    return rollups.overview_totals_from_agg(
        rollups.overview_query(v.overview_mergeable, start="1996-01-01", end="1999-12-31",
                               products=["PROGRAM H1"], channels=["urgent", "high", "low"],
                               regions=list(range(1, 10))))


@register("overview_by_channel")
def _overview_by_channel(v: Views):
    """The roll-up collapsed to product and channel, campaigns counted exactly."""
    return rollups.overview_by(v.overview_mergeable, ["product", "channel"])


@register("overview_trend")
def _overview_trend(v: Views):
    return rollups.in_order(rollups.overview_trend(v.overview))


@register("overview_trend_filtered")
def _overview_trend_filtered(v: Views):
    """J5 + W4: trend rows of campaigns with leads in region 1..5."""
    leads = v.enriched.filter(F.col("wilayah").isin(1, 2, 3, 4, 5))
    return rollups.overview_trend_filtered(leads, rollups.campaign_trend(v.master, v.catalogue))


@register("regional_weekly")
def _regional_weekly(v: Views):
    """A3 from the stored leads (the roll-up itself, not the stored one)."""
    return rollups.regional_weekly(v.enriched)


@register("regional_stored")
def _regional_stored(v: Views):
    """The stored weekly roll-up, as requests read it."""
    return v.weekly


@register("regional_summary")
def _regional_summary(v: Views):
    return rollups.regional_summary(v.weekly)


@register("regional_from_leads")
def _regional_from_leads(v: Views):
    return rollups.regional_from_leads(v.enriched)


@register("regional_by_program")
def _regional_by_program(v: Views):
    """region metrics of the leads of one program."""
    return rollups.regional_from_leads(v.enriched, flag_program="program h2")


@register("regional_ranked")
def _regional_ranked(v: Views):
    return rollups.regional_ranked(rollups.regional_from_leads(v.enriched))


@register("regional_trend_8w")
def _regional_trend_8w(v: Views):
    return rollups.regional_trend_8w(v.weekly)


# ------------------------------------------------------------ time analysis

@register("take_up_leads")
def _take_up_leads(v: Views):
    return time_analysis.take_up_leads(v.enriched, canonical=True).select(
        "campaign_id", "cif", "periode_start", "take_up_date", "media_blasting", "wilayah",
        "time_to_take_up_days")


@register("time_stats")
def _time_stats(v: Views):
    return time_analysis.stats_from_cube(v.time_cube)


@register("time_stats_filtered")
def _time_stats_filtered(v: Views):
    """statistics after the channel and region filters."""
    return time_analysis.stats_from_cube(
        time_analysis.filter_channel_region(v.time_cube, channel="urgent", region="3"))


@register("time_stats_by_channel")
def _time_stats_by_channel(v: Views):
    return time_analysis.stats_from_cube(v.time_cube, by=["media_blasting"])


@register("time_stats_by_region")
def _time_stats_by_region(v: Views):
    return time_analysis.stats_from_cube(v.time_cube, by=["wilayah"])


@register("time_histogram")
def _time_histogram(v: Views):
    return time_analysis.histogram_from_cube(v.time_cube)


@register("time_cube")
def _time_cube(v: Views):
    """Counts per campaign, channel, region and day gap, from the leads."""
    return time_analysis.time_cube(v.enriched, canonical=True)


@register("time_stats_from_leads")
def _time_stats_from_leads(v: Views):
    """A14 straight from the leads, for those who keep no cube."""
    return time_analysis.time_stats(v.enriched)


# ------------------------------------------------------------ criteria

@register("criteria_distribution")
def _criteria_distribution(v: Views):
    return criteria.criteria_distribution(v.enriched)


@register("criteria_availability")
def _criteria_availability(v: Views):
    return criteria.criteria_availability(v.enriched)


# ------------------------------------------------------------ comparison

@register("compare_campaigns")
def _compare_campaigns(v: Views):
    return compare.compare_campaigns(compare.campaign_metrics(v.enriched, v.catalogue))


@register("compare_requested")
def _compare_requested(v: Views):
    """Two known campaigns and one that is not there."""
    return compare.compare_requested(v.enriched, v.catalogue, REQUESTED)


@register("comparison_long")
def _comparison_long(v: Views):
    return compare.comparison_long(compare.campaign_metrics(v.enriched, v.catalogue))


@register("sort_by_attribute")
def _sort_by_attribute(v: Views):
    return compare.sort_by_attribute(compare.campaign_metrics(v.enriched, v.catalogue),
                                     "take_up_rate", ascending=False, ties=["campaign_id"])


# ------------------------------------------------------------ similarity

def _flat_similar(df: DataFrame) -> DataFrame:
    return df.withColumn("matching_dimensions", F.array_join("matching_dimensions", ","))


@register("campaign_dim")
def _campaign_dim(v: Views):
    return v.dim


@register("similarity_index")
def _similarity_index(v: Views):
    return _flat_similar(similarity.similarity_index(v.dim))


@register("similarity_rates", scale=6)
def _similarity_rates(v: Views):
    """The index's score and rate at their own six decimals."""
    return similarity.similarity_index(v.dim).select("campaign_id", "similar_campaign_id", "similarity_score", "take_up_rate")


@register("similar_enriched")
def _similar_enriched(v: Views):
    return _flat_similar(similarity.similar_enriched(v.dim))


@register("similar_topk")
def _similar_topk(v: Views):
    return _flat_similar(similarity.similar_topk(v.dim, k=5))


@register("similar_by_dimensions")
def _similar_by_dimensions(v: Views):
    return _flat_similar(similarity.similar_topk(v.dim, k=20, required=["media_blasting"]))


@register("similar_learning_summary")
def _similar_learning_summary(v: Views):
    """X5 in O4: summary of each campaign's top similar campaign, with a
    required dimension so that some campaigns have none."""
    return similarity.learning_summary(v.dim, required=["flag_program", "jenis_leads",
                                                         "media_blasting"])


@register("similarity_counts")
def _similarity_counts(v: Views):
    return similarity.similarity_counts(v.dim)


# ------------------------------------------------------------ recommendations

@register("campaign_breakdowns")
def _campaign_breakdowns(v: Views):
    return recommend.campaign_breakdowns(v.enriched)


@register("best_worst_segment")
def _best_worst_segment(v: Views):
    return recommend.best_worst_segment(recommend.campaign_breakdowns(v.enriched))


@register("best_and_low_regions")
def _best_and_low_regions(v: Views):
    return recommend.best_and_low_regions(v.enriched)


@register("recommendation_facts")
def _recommendation_facts(v: Views):
    return recommend.recommendation_facts(v.enriched, v.dim)


@register("unused_channels")
def _unused_channels(v: Views):
    return recommend.unused_channels(recommend.campaign_rates(v.enriched))


# ------------------------------------------------------------ filters


LOOKUP_CAMPAIGN = "1-URGENT_1997-01-01"


@register("filter_valid_cif")
def _filter_valid_cif(v: Views):
    return clean.filter_valid_cif(v.leads_raw).drop("_src_orderkey")


@register("filter_leads_facets")
def _filter_leads_facets(v: Views):
    df = filters.filter_leads_facets(v.enriched, flag_program=["program h1"],
                                     media_blasting=["urgent", "high"], wilayah=range(1, 9),
                                     start="1996-01-01", end="1999-12-31")
    return df.select("campaign_id", "cif", "periode_start", "flag_program", "media_blasting",
                     "wilayah", "take_up_flag")


@register("filter_period_range")
def _filter_period_range(v: Views):
    df = filters.filter_period_range(v.enriched, "1997-01-01", "1997-12-31")
    return df.select("campaign_id", "cif", "periode_start")


@register("filter_active")
def _filter_active(v: Views):
    return filters.filter_active(v.overview, [("product", ["PROGRAM H2"]),
                                              ("region", ["1", "2", "3"]),
                                              ("channel", ["URGENT", "LOW"])])


@register("filter_active_period")
def _filter_active_period(v: Views):
    return filters.filter_active(v.catalogue, [("period", ["1997-03-01", "1998-03-01"])])


@register("param_query")
def _param_query(v: Views):
    sql = ("SELECT product, channel, sum(total_leads) AS total_leads, "
           "sum(total_take_up) AS total_take_up FROM campaign_overview_agg "
           "WHERE granularity = :gran AND total_leads >= :min_leads GROUP BY product, channel")
    return filters.param_query(v.spark, sql, {"gran": "monthly", "min_leads": 2},
                               {"campaign_overview_agg": v.overview})


@register("lenient_totals")
def _lenient_totals(v: Views):
    cols = ["total_leads", "total_take_up", "campaign_count"]
    text = v.overview.select(*[F.col(c).cast("string").alias(c) for c in cols])
    return filters.lenient_totals(text, cols)


# ------------------------------------------------------------ privacy and quality

@register("strip_pii")
def _strip_pii(v: Views):
    return privacy.strip_pii(v.enriched)


@register("pii_report")
def _pii_report(v: Views):
    return privacy.pii_report(v.enriched)


@register("domain_violations")
def _domain_violations(v: Views):
    return quality.domain_violations(v.enriched)


@register("negative_take_up")
def _negative_take_up(v: Views):
    raw_gap = bindings.outcomes_raw(v.spark, v.sf_dir, raw_gap=True)
    return quality.negative_take_up(clean.enrich_leads(v.leads, raw_gap))


@register("etl_quality")
def _etl_quality(v: Views):
    return quality.etl_quality(v.leads_raw.drop("_src_orderkey"), v.monitoring_raw)


# ------------------------------------------------------------ audit

def _audit_rows(v: Views) -> DataFrame:
    return audit.audit_rows(v.audit)


@register("audit_params")
def _audit_params(v: Views):
    return audit.flatten_params(_audit_rows(v)).select("user_id", "timestamp", "request_params")


@register("audit_retention")
def _audit_retention(v: Views):
    return audit.audit_retention(_audit_rows(v), "2024-04-15 00:00:00").select(
        "user_id", "timestamp", "page_accessed", "action", "expiry_timestamp")


@register("session_expiry")
def _session_expiry(v: Views):
    return audit.session_expiry(_audit_rows(v))


@register("audit_usage")
def _audit_usage(v: Views):
    return audit.audit_usage(_audit_rows(v))


@register("audit_append")
def _audit_append(v: Views):
    """Append the audit rows to a date-partitioned table, read back."""
    path = scratch_path(v.spark, "audit")
    _audit_rows(v).write.mode("append").partitionBy("event_date").parquet(path)
    back = v.spark.read.parquet(path).withColumn("event_date", F.col("event_date").cast("date"))
    return audit.flatten_params(back).select("user_id", "timestamp", "page_accessed", "action",
                                             "request_params", "event_date")


@register("audit_stream")
def _audit_stream(v: Views):
    """Events dropped as files (with part of them re-delivered), ingested
    with Structured Streaming and deduped on the log key."""
    src = scratch_path(v.spark, "audit-src")
    ev = v.audit
    # 40 files with interleaved times, so there are several micro-batches
    ev.repartition(40, "event_id").write.mode("append").parquet(src)
    ev.filter(F.col("event_id") % 10 == 0).write.mode("append").parquet(src)   # re-delivery
    schema = v.spark.read.parquet(src).schema
    out = audit_stream.run_audit_stream(v.spark, src, schema, scratch_path(v.spark, "audit-sink"),
                                        scratch_path(v.spark, "audit-ckpt"), max_files_per_trigger=8)
    return out.select("user_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
                      "page_accessed", "action")


# ------------------------------------------------------------ sources, sinks, pipelines

def _csv_drop(v: Views, write: bool = True) -> pipeline.Paths:
    root = scratch_path(v.spark, "run")
    p = pipeline.Paths(raw_leads=f"{root}/raw/leads", raw_monitoring=f"{root}/raw/monitoring",
                       enriched=f"{root}/clean/leads", campaigns=f"{root}/clean/campaigns",
                       overview=f"{root}/agg/overview", regional=f"{root}/agg/regional",
                       similarity=f"{root}/agg/similarity")
    if write:
        io.write_csv(v.leads_raw.drop("_src_orderkey"), p.raw_leads)
        io.write_csv(v.monitoring_raw.select(*[f.name for f in io.MONITORING_SCHEMA.fields]),
                     p.raw_monitoring)
    return p


@register("scan_leads_csv")
def _scan_leads_csv(v: Views):
    p = _csv_drop(v)
    return clean.clean_leads(io.read_leads(v.spark, p.raw_leads)).select(
        *LEAD_COLUMNS, "campaign_id", "year", "month")


@register("scan_monitoring_csv")
def _scan_monitoring_csv(v: Views):
    p = _csv_drop(v)
    return clean.dedup_monitoring(io.read_monitoring(v.spark, p.raw_monitoring)).select(
        *clean.NATURAL_KEY, "take_up_flag", "take_up_date", "total_transaction_value")


@register("pipeline_raw_to_clean")
def _pipeline_raw_to_clean(v: Views):
    return pipeline.pipeline_raw_to_clean(v.spark, _csv_drop(v))


def _dirty_drop(v: Views) -> pipeline.Paths:
    """A CSV drop in which some rows have a region that is no number, no customer
    id, or a start date that is no date."""
    p = _csv_drop(v, write=False)

    def dirty(df: DataFrame) -> DataFrame:
        return df.withColumns({
            "periode_start": F.when((F.col("nama_program") == "4-NOT SPECIFIED") & (F.col("wilayah") == 17), "soon").otherwise(F.col("periode_start")),
            "cif": F.when(F.col("range_saldo_tab") < -900, " ").otherwise(F.col("cif")),
            "wilayah": F.when(F.col("segment_div_owner") == "P", "n/a").otherwise(F.col("wilayah").cast("string"))})
    # the two jobs share no data: run side by side, one's tasks fill the cores that the other's last ones leave idle
    drops = [(dirty(v.leads_raw.drop("_src_orderkey")), p.raw_leads),
             (dirty(v.monitoring_raw.select(*[f.name for f in io.MONITORING_SCHEMA.fields])), p.raw_monitoring)]
    with ThreadPoolExecutor(len(drops)) as pool:
        for done in [pool.submit(inheritable_thread_target(v.spark)(io.write_csv), df, path) for df, path in drops]:
            done.result()
    return p


@register("etl_one_pass")
def _etl_one_pass(v: Views):
    """The cleaning's losses as observed while its one job wrote."""
    return v.spark.createDataFrame(list(pipeline.split_raw(v.spark, _dirty_drop(v)).items()), "metric string, value long")


@register("etl_quality_raw")
def _etl_quality_raw(v: Views):
    """Q3 over raw files, rows that do not fit the schema included."""
    p = _dirty_drop(v)
    return quality.etl_quality(io.read_raw(v.spark, p.raw_leads, io.LEADS_SCHEMA),
                               io.read_raw(v.spark, p.raw_monitoring, io.MONITORING_SCHEMA))


@register("etl_quarantine")
def _etl_quarantine(v: Views):
    """What the split held back, per source and status."""
    p = _dirty_drop(v)
    pipeline.split_raw(v.spark, p)
    return pipeline.quarantine(v.spark, p).groupBy("source", "status").agg(
        F.count(F.lit(1)).alias("rows_held"), F.count("raw_line").alias("rows_with_text"))


@register("etl_clean_master")
def _etl_clean_master(v: Views):
    """The master holds no row that does not fit the schema."""
    return pipeline.pipeline_raw_to_clean(v.spark, _dirty_drop(v))


@register("dedup_by_arrival")
def _dedup_by_arrival(v: Views):
    """Two drops of the same leads, the later one with other values; the
    rows that arrived first stay."""
    root = scratch_path(v.spark, "drops")
    rows = v.leads_raw.drop("_src_orderkey").dropDuplicates(["cif", "nama_program", "periode_start"]) \
        .select("cif", "nama_program", "periode_start", F.lit(9).alias("cabang"))
    for name, cabang in (("first", 9), ("second", 1)):
        whole = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t.dataType).alias(c)
                              for c, t in ((f.name, f) for f in io.LEADS_SCHEMA.fields)]).withColumn("cabang", F.lit(cabang))
        io.write_csv(whole, f"{root}/{name}")
    return clean.clean_leads(io.read_leads(v.spark, f"{root}/*", lineage=True)).select("cif", "campaign_id", "cabang")


def _stored(v: Views, leads: bool = False, campaigns: bool = False) -> pipeline.Paths:
    root = scratch_path(v.spark, "stored")
    p = pipeline.Paths(raw_leads="", raw_monitoring="", enriched=f"{root}/leads",
                       campaigns=f"{root}/campaigns", overview=f"{root}/overview",
                       regional=f"{root}/regional", similarity=f"{root}/similarity")
    if leads:
        io.write_leads_partitioned(v.enriched, p.enriched)
    if campaigns:
        io.write_campaigns_partitioned(v.master, p.campaigns)
    return p


def _zones(v: Views) -> pipeline.Paths:
    """The stored zones as inputs, new folders as outputs."""
    root = scratch_path(v.spark, "agg")
    return pipeline.Paths(raw_leads="", raw_monitoring="", enriched=v.leads_zone, campaigns=v.campaigns_zone,
                          overview=f"{root}/overview", regional=f"{root}/regional", similarity=f"{root}/similarity")


@register("sink_leads_partitioned")
def _sink_leads_partitioned(v: Views):
    p = _stored(v, leads=True)
    return io.read_enriched_leads(v.spark, p.enriched)


@register("campaign_lookup")
def _campaign_lookup(v: Views):
    """point lookup on the campaign partition column (pruned scan)."""
    return filters.campaign_lookup(io.read_enriched_leads(v.spark, v.leads_zone), LOOKUP_CAMPAIGN)


@register("sink_campaigns_partitioned")
def _sink_campaigns_partitioned(v: Views):
    return io.read_campaigns(v.spark, _stored(v, campaigns=True).campaigns)


@register("scan_campaigns")
def _scan_campaigns(v: Views):
    """S3: the whole partitioned master."""
    return io.read_campaigns(v.spark, v.campaigns_zone)


@register("scan_campaigns_year")
def _scan_campaigns_year(v: Views):
    """S3 with a year filter (partition pruning)."""
    return io.read_campaigns(v.spark, v.campaigns_zone).filter(F.col("year") == 1997)


@register("scan_enriched_leads")
def _scan_enriched_leads(v: Views):
    """S4 + P3: regional weekly roll-up computed from the stored leads."""
    return pipeline.pipeline_regional(v.spark, _zones(v))


@register("sink_snapshot")
def _sink_snapshot(v: Views):
    """S10 + P2: overview roll-up written as a snapshot and read back."""
    return pipeline.pipeline_overview(v.spark, _zones(v), v.catalogue)


@register("pipeline_similarity")
def _pipeline_similarity(v: Views):
    """Similarity index from the stored master."""
    return _flat_similar(pipeline.pipeline_similarity(v.spark, _zones(v)))


@register("scan_json_array")
def _scan_json_array(v: Views):
    path = scratch_path(v.spark, "catalogue-json")
    v.catalogue.write.mode("overwrite").json(path)
    schema = ("campaign_id string, nama_program string, start_date date, end_date date, "
              "duration_days int")
    return io.read_json_array(v.spark, path, schema, multiline=False)


@register("scan_json_map")
def _scan_json_map(v: Views):
    path = scratch_path(v.spark, "trend-json")
    io.write_json_map(rollups.campaign_trend(v.master, v.catalogue), path)
    return io.read_json_map(v.spark, path, "period_start: date, period_end: date, "
                                           "total_leads: bigint, total_take_up: bigint, "
                                           "take_up_rate: double", lines=True)


@register("export_campaign_table")
def _export_campaign_table(v: Views):
    path = scratch_path(v.spark, "export")
    io.export_campaign_table(v.master, path, "campaign-overview", "1995-01-01", "2001-12-31")
    schema = ("nama_program string, flag_program string, media_blasting string, "
              "jenis_leads string, wilayah string, total_leads bigint, total_take_up bigint, "
              "take_up_rate string")
    return v.spark.read.schema(schema).option("header", True).csv(f"{path}/data")


# ------------------------------------------------------------ incremental refresh

LATE_MONTHS = [(1997, m) for m in (4, 5, 6)]


def _refreshed(v: Views) -> refresh.Zone:
    """A zone built from an earlier delivery, in which a quarter's outcomes, far
    regions and middle month were still missing, then refreshed with that
    quarter's leads as they are now."""
    def run(path: str) -> None:
        zone = refresh.Zone(path)
        late = refresh.in_months(LATE_MONTHS)
        early = v.enriched.filter(~late | ((F.col("wilayah") <= 8) & (F.col("month") != 5)))
        unknown = {"take_up_flag": F.lit("NO"), "take_up_date": F.lit(None).cast("date"),
                   "time_to_take_up_days": F.lit(None).cast("int"), "total_transaction_value": F.lit(None).cast("double")}
        early = early.withColumns({c: F.when(late, x).otherwise(F.col(c)) for c, x in unknown.items()})
        refresh.build(v.spark, zone, early, v.catalogue)
        refresh.refresh(v.spark, zone, v.enriched, LATE_MONTHS, f"{path}/_stage/late", v.catalogue)
    return refresh.Zone(stored_zone(v.spark, f"{v.sf_dir}|refreshed", run))


@register("refresh_overview")
def _refresh_overview(v: Views):
    """The roll-up after an incremental refresh equals a rebuild."""
    return refresh.overview(v.spark, _refreshed(v)).drop(distinct.BITS)


@register("refresh_totals")
def _refresh_totals(v: Views):
    """A7 on the refreshed roll-up: its bitmaps still count every campaign once."""
    return rollups.overview_totals_from_agg(refresh.overview(v.spark, _refreshed(v)))


@register("refresh_regional")
def _refresh_regional(v: Views):
    """P3 incrementally: the weekly roll-up after the refresh."""
    return refresh.weekly(v.spark, _refreshed(v))


@register("refresh_campaigns")
def _refresh_campaigns(v: Views):
    """The campaign master after its changed months were replaced."""
    return io.read_campaigns(v.spark, _refreshed(v).path("campaigns"))


# ------------------------------------------------------------ scalar expressions

@register("campaign_slug")
def _campaign_slug(v: Views):
    return v.enriched.select("nama_program", "periode_start", "campaign_id").distinct()


@register("parse_mixed_dates")
def _parse_mixed_dates(v: Views):
    return v.leads_raw.select(F.col("periode_start").alias("periode_text"),
                              exprs.parse_mixed_date("periode_start").alias("periode_start")).distinct()


@register("overview_lookback")
def _overview_lookback(v: Views):
    """Default window of 90 days before an explicit as-of date."""
    return rollups.overview_query(v.overview, as_of="1999-12-31")


def _declared(v: Views) -> str:
    """The catalogue database in which the session's four tables are declared."""
    db = f"leadflow_{hashlib.md5(v.sf_dir.encode()).hexdigest()[:12]}"
    p = _zones(v)

    def run(path: str) -> None:
        io.write_snapshot(v.overview, f"{path}/overview")
        io.write_snapshot(v.weekly, f"{path}/regional")
        catalog.declare_tables(v.spark, {"leads": p.enriched, "campaign": p.campaigns, "campaign_overview_agg": f"{path}/overview",
                                         "regional_performance_agg": f"{path}/regional"}, db)
    stored_zone(v.spark, f"{v.sf_dir}|declared", run)
    return db


@register("external_tables")
def _external_tables(v: Views):
    """The four declared tables, queried with SQL."""
    db = _declared(v)
    return v.spark.sql(
        f"SELECT 'campaign' AS table_name, sum(total_leads) AS leads, sum(total_take_up) AS take_up FROM {db}.campaign "
        f"UNION ALL SELECT 'leads', count(*), count_if(take_up_flag = 'YES') FROM {db}.leads "
        f"UNION ALL SELECT 'campaign_overview_agg', sum(total_leads), sum(total_take_up) FROM {db}.campaign_overview_agg "
        f"UNION ALL SELECT 'regional_performance_agg', sum(leads_count), sum(take_up_count) FROM {db}.regional_performance_agg")


@register("table_statistics")
def _table_statistics(v: Views):
    """Rows and partitions of the four tables, from the catalogue alone."""
    db = _declared(v)
    return catalog.table_statistics(v.spark, [f"{db}.{t}" for t in catalog.TABLES])


@register("declared_campaign_year")
def _declared_campaign_year(v: Views):
    """A partition predicate on a declared table picks its folders from the
    catalogue."""
    return v.spark.sql(f"SELECT campaign_id, wilayah, year, month, total_leads FROM {_declared(v)}.campaign "
                       "WHERE year = 1997 AND month BETWEEN 3 AND 8")


# ------------------------------------------------------------ bucketed index

def _bucketed(v: Views) -> tuple[DataFrame, DataFrame]:
    """The bucketed similarity index and campaign table, stored once per session."""
    found = []
    path = stored_zone(v.spark, f"{v.sf_dir}|bucketed", lambda p: found.extend(pipeline.store_similarity(v.dim, p)))
    tag = hashlib.md5(path.encode()).hexdigest()[:12]
    return tuple(found) or (v.spark.table(f"leadflow.similarity_{tag}"), v.spark.table(f"leadflow.campaigns_{tag}"))


@register("similar_lookup")
def _similar_lookup(v: Views):
    """S11 + F10: a lookup by key opens one bucket of the stored index."""
    return _flat_similar(similarity.lookup(_bucketed(v)[0], LOOKUP_CAMPAIGN, 10))


@register("similar_with_own_rate")
def _similar_with_own_rate(v: Views):
    """The index joined with the campaign table, both in the same buckets."""
    return similarity.with_own_rate(*_bucketed(v))
