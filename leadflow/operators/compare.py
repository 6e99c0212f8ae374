"""Campaign comparison metrics, their long form, and attribute sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.functions.exprs import is_yes, rate_pct, rnd
from leadflow.operators.ordering import with_position

COMPARISON_METRICS = ["total_leads", "total_take_up", "take_up_rate",
                      "total_transaction_value", "duration_days"]


def campaign_metrics(enriched: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Five metrics per campaign straight from the leads, plus name,
    program and planned duration (0 when the catalogue lacks the campaign)."""
    # grouped by name and program first, so the aggregation over all leads stays a
    # hash aggregation; a campaign with several takes those with the most leads
    per = enriched.groupBy("campaign_id", F.col("nama_program").alias("campaign_name"),
                           "flag_program").agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(is_yes()).alias("total_take_up"),
        F.sum(F.coalesce(F.col("total_transaction_value"), F.lit(0.0))).alias("_value"),
    )
    m = per.groupBy("campaign_id").agg(
        F.max(F.struct("total_leads", "campaign_name", "flag_program")).alias("_a"),
        F.sum("total_leads").alias("total_leads"), F.sum("total_take_up").alias("total_take_up"),
        F.sum("_value").alias("_value"),
    ).withColumns({"campaign_name": F.col("_a.campaign_name"), "flag_program": F.col("_a.flag_program")})
    if catalogue is not None:
        m = m.join(catalogue.select("campaign_id", "duration_days"), "campaign_id", "left")
    else:
        m = m.withColumn("duration_days", F.lit(None).cast("int"))
    return m.select(
        "campaign_id", "campaign_name", "flag_program", "total_leads", "total_take_up",
        rnd(rate_pct("total_take_up", "total_leads"), 2).alias("take_up_rate"),
        rnd("_value", 2).alias("total_transaction_value"),
        F.coalesce(F.col("duration_days"), F.lit(0)).cast("int").alias("duration_days"))


def compare_campaigns(metrics: DataFrame, campaign_ids: list[str] | None = None) -> DataFrame:
    """The requested ids kept even when unknown (zeros, empty name);
    ``None`` compares every campaign."""
    if campaign_ids is None:
        return metrics
    spark = metrics.sparkSession
    ids = spark.createDataFrame([(c,) for c in dict.fromkeys(campaign_ids)], "campaign_id string")
    j = ids.join(metrics, "campaign_id", "left")
    zero = {"total_leads": F.lit(0).cast("long"), "total_take_up": F.lit(0).cast("long"),
            "take_up_rate": F.lit(0.0), "total_transaction_value": F.lit(0.0),
            "duration_days": F.lit(0), "campaign_name": F.lit(""), "flag_program": F.lit("")}
    return j.select("campaign_id", *[F.coalesce(F.col(c), z).alias(c) for c, z in zero.items()])


def compare_requested(enriched: DataFrame, catalogue: DataFrame | None,
                      campaign_ids: list[str]) -> DataFrame:
    """J4 for a request: only the leads of the requested campaigns are read
    (the ids reach the scan as a filter), unknown ids are kept."""
    leads = enriched.filter(F.col("campaign_id").isin(list(campaign_ids)))
    return compare_campaigns(campaign_metrics(leads, catalogue), campaign_ids)


def comparison_long(metrics: DataFrame) -> DataFrame:
    """Wide metrics to (campaign_id, metric, value)."""
    wide = metrics.select("campaign_id", *[F.col(c).cast("double").alias(c)
                                           for c in COMPARISON_METRICS])
    return wide.unpivot("campaign_id", COMPARISON_METRICS, "metric", "value")


def sort_by_attribute(df: DataFrame, attribute: str, ascending: bool = True,
                      ties: list[str] | None = None) -> DataFrame:
    """O1: order by any column of the schema, missing values last. With ``ties``,
    columns that settle equal values, rows also carry their ``position``."""
    if attribute not in df.columns:
        raise ValueError(f"unknown sort attribute {attribute!r}")
    c = F.col(attribute)
    c = c.asc_nulls_last() if ascending else c.desc_nulls_last()
    if ties is None:
        return df.orderBy(c)
    return with_position(df, c, *[F.col(t).asc_nulls_last() for t in ties]).orderBy("position")
