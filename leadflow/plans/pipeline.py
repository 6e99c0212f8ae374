"""The four batch jobs, in their run order (P1 daily -> P2, P3 daily; P4 weekly).

Each job reads what the previous one wrote: the hand-over is files in the
shared folder, so a lost executor or a failed job re-runs only from the
last written table. The enriched leads are computed and stored once: clean
rows and all that is held back are partitions of one table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.domains import MAX_SIMILAR_RESULTS
from leadflow.operators import clean, rollups, similarity
from leadflow.sources import catalog, io


@dataclass
class Paths:
    raw_leads: str
    raw_monitoring: str
    enriched: str
    campaigns: str
    overview: str
    regional: str
    similarity: str
    catalogue: str | None = None
    quarantine: str | None = None
    #: of rows that share a key the first to arrive stays, by file time, name and place;
    #: without it the smallest by value, which does not depend on the files
    arrival_order: bool = False


def split_raw(spark: SparkSession, p: Paths) -> dict[str, int]:
    """The raw sources into one table by status and campaign, in one job that
    scans each source once and stages no copy; returns what it counted on the
    way (``quality.etl_quality`` has the same figures from a second pass)."""
    watch = clean.EtlWatch()
    rows = clean.split_by_status(io.read_raw(spark, p.raw_leads, io.LEADS_SCHEMA, p.arrival_order),
                                 io.read_raw(spark, p.raw_monitoring, io.MONITORING_SCHEMA, p.arrival_order),
                                 (io.malformed(io.LEADS_SCHEMA), io.malformed(io.MONITORING_SCHEMA)), watch)
    io.write_partitioned(rows, p.enriched, ["status", "campaign_id"], distinct=("cif", "raw_line"))
    return watch.metrics()


def quarantine(spark: SparkSession, p: Paths) -> DataFrame:
    """The rows that are not clean leads, with their status, source and, if they
    do not fit the schema, their text."""
    return spark.read.option("basePath", p.enriched).parquet(p.enriched).filter(F.col("status") != "clean")


def pipeline_raw_to_clean(spark: SparkSession, p: Paths) -> DataFrame:
    """Raw CSV -> leads by status and campaign -> campaign master
    (partitioned by year/month), returned as read back from storage. Leads
    without a campaign id and rows that do not fit the schema are not among the
    clean ones; they are also listed under the quarantine path (next to the
    clean leads unless one is given), read from their own partitions."""
    split_raw(spark, p)
    held = p.quarantine or f"{p.enriched}_quarantine"
    bad = quarantine(spark, p)
    io.write_snapshot(bad.filter(F.col("status").isin("no_campaign", "malformed") & (F.col("source") == "leads")), f"{held}/rows")
    io.write_snapshot(bad.filter(F.col("status") == "malformed")
                      .select("source", "cif", F.col("raw_line").alias("_corrupt_record")), f"{held}/lines")
    io.write_campaigns_partitioned(rollups.campaign_master(io.read_enriched_leads(spark, p.enriched)), p.campaigns)
    return io.read_campaigns(spark, p.campaigns)


def pipeline_overview(spark: SparkSession, p: Paths, catalogue: DataFrame | None = None) -> DataFrame:
    """Campaign master -> overview roll-up snapshot."""
    io.write_snapshot(rollups.overview_agg(io.read_campaigns(spark, p.campaigns), catalogue), p.overview)
    return io.read_snapshot(spark, p.overview)


def pipeline_regional(spark: SparkSession, p: Paths) -> DataFrame:
    """Enriched leads -> regional weekly roll-up snapshot."""
    io.write_snapshot(rollups.regional_weekly(io.read_enriched_leads(spark, p.enriched)), p.regional)
    return io.read_snapshot(spark, p.regional)


def pipeline_similarity(spark: SparkSession, p: Paths) -> DataFrame:
    """Campaign master -> similar-campaign index, bucketed and sorted by
    campaign, beside the campaign table in the same buckets. Returns the index
    as the catalogue knows it."""
    return store_similarity(rollups.campaign_dim(io.read_campaigns(spark, p.campaigns)), p.similarity)[0]


def store_similarity(dim: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, campaigns), two catalogue tables in the same buckets."""
    buckets = catalog.buckets_for(dim.count() * MAX_SIMILAR_RESULTS)
    tag = hashlib.md5(path.encode()).hexdigest()[:12]
    index = catalog.store_bucketed(similarity.similarity_index(dim), f"similarity_{tag}", f"{path}/index",
                                   "campaign_id", ["campaign_id", "rank"], buckets)
    campaigns = catalog.store_bucketed(dim, f"campaigns_{tag}", f"{path}/campaigns", "campaign_id", ["campaign_id"], buckets)
    return index, campaigns
