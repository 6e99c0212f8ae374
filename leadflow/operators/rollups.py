"""Campaign, period and regional roll-ups.

All of these are hash aggregations with partial (map-side) aggregation, so
a hot campaign or region is combined per map task before the shuffle; the
outputs are at campaign x region x period grain, tiny next to the leads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.domains import (DEFAULT_LOOKBACK_DAYS, MASTER_KEYS, MAX_REGION_TREND_WEEKS,
                                        OVERVIEW_COLUMNS, OVERVIEW_KEYS, OVERVIEW_SUMS,
                                        RATE_BAND_HIGH, RATE_BAND_MEDIUM)
from leadflow.functions.exprs import (granularity, is_yes, money, period_end_for,
                                      period_start_for, rate_pct, rnd, week_start)
from leadflow.operators.distinct import BITS, campaign_bits, merged_counts
from leadflow.operators.ordering import with_position


# ------------------------------------------------------------ campaign master

def campaign_master(enriched: DataFrame) -> DataFrame:
    """A1: one row per campaign x region (the master grain includes wilayah)."""
    agg = enriched.groupBy(*MASTER_KEYS).agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(is_yes()).alias("total_take_up"),
        F.sum("total_transaction_value").alias("total_transaction_value"),
        F.avg("time_to_take_up_days").alias("avg_time_to_take_up_days"),
    )
    return agg.withColumn("take_up_rate", rate_pct("total_take_up", "total_leads"))


def campaign_dim(master: DataFrame) -> DataFrame:
    """W2 re-aimed: exactly one row per campaign, sums re-aggregated over regions
    and the rate recomputed (instead of an arbitrary region row's rate). A
    campaign with several names, programs or channels takes the attributes of
    the combination with the most leads; ties go to the greater values."""
    names = ["nama_program", "flag_program", "jenis_leads", "media_blasting", "periode_start"]
    # a hash aggregation over all rows, then a few rows per campaign
    per = master.groupBy("campaign_id", *names).agg(
        F.sum("total_leads").alias("total_leads"),
        F.sum("total_take_up").alias("total_take_up"),
        F.sum("total_transaction_value").alias("total_transaction_value"),
    )
    agg = per.groupBy("campaign_id").agg(
        F.max(F.struct("total_leads", *names)).alias("_a"),
        F.sum("total_leads").alias("total_leads"),
        F.sum("total_take_up").alias("total_take_up"),
        F.sum("total_transaction_value").alias("total_transaction_value"),
    ).select("campaign_id", *[F.col(f"_a.{c}").alias(c) for c in names],
             "total_leads", "total_take_up", "total_transaction_value")
    return agg.withColumn("take_up_rate", rate_pct("total_take_up", "total_leads"))


# ------------------------------------------------------------ periods

def with_granularity(master: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Weekly when the planned campaign lasts <= 90 days, else monthly.

    Duration comes from the catalogue (``start_date``/``end_date``); a
    campaign missing from it counts as 0 days (weekly).
    """
    if catalogue is not None:
        cat = catalogue.select("campaign_id", "start_date", "end_date")
        master = master.join(cat, "campaign_id", "left")
    dur = F.coalesce(F.datediff("end_date", "start_date"), F.lit(0)) \
        if "end_date" in master.columns else F.lit(0)
    return master.withColumn("duration_days", dur) \
                 .withColumn("granularity", granularity("duration_days"))


def with_period_buckets(df: DataFrame) -> DataFrame:
    """Bucket start (ISO Monday or month first) and bucket end."""
    return (df.withColumn("period_bucket", period_start_for("periode_start", "granularity"))
              .withColumn("period_end", period_end_for("period_bucket", "granularity")))


def overview_cells(master: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """The master's rows with the roll-up's keys (``OVERVIEW_KEYS``) in front."""
    sources = {"period_start": F.col("period_bucket"), "product": F.col("flag_program"),
               "channel": F.col("media_blasting"), "region": F.col("wilayah").cast("string")}
    rows = with_period_buckets(with_granularity(master, catalogue))
    return rows.select(*[sources.get(k, F.col(k)).alias(k) for k in OVERVIEW_KEYS],
                       "campaign_id", *OVERVIEW_SUMS)


def overview_columns(rolled: DataFrame) -> DataFrame:
    """The roll-up's columns in their fixed order, the rate recomputed."""
    rated = rolled.withColumn("take_up_rate", rate_pct("total_take_up", "total_leads"))
    return rated.select(*OVERVIEW_COLUMNS, *[c for c in rated.columns if c == BITS])


def overview_agg(master: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """A2: roll-up by period, granularity, product, channel and region."""
    return overview_columns(overview_cells(master, catalogue).groupBy(*OVERVIEW_KEYS).agg(
        *[F.sum(c).alias(c) for c in OVERVIEW_SUMS],
        F.count_distinct("campaign_id").alias("campaign_count")))


def overview_mergeable(master: DataFrame, catalogue: DataFrame | None, numbers: DataFrame) -> DataFrame:
    """A2 with each row's campaigns as bitmaps over ``numbers`` (campaign_id,
    campaign_no), so that rows can be merged without counting a campaign twice."""
    cells = overview_cells(master, catalogue).join(numbers, "campaign_id", "left")
    return overview_columns(campaign_bits(cells, OVERVIEW_KEYS, OVERVIEW_SUMS))


def overview_query(agg: DataFrame, start=None, end=None, products=None,
                   channels=None, regions=None, as_of=None,
                   lookback_days: int = DEFAULT_LOOKBACK_DAYS) -> DataFrame:
    """period containment (start <= period_start, period_end <= end) and
    optional IN-lists. ``None`` = no constraint; an empty list matches nothing.
    Channel values are compared upper-cased (canonical form).

    X12: with ``as_of`` (a date) a missing ``end`` defaults to ``as_of`` and
    a missing ``start`` to ``lookback_days`` before it; ``as_of`` is explicit
    so results never depend on the clock."""
    if as_of is not None:
        end = end if end is not None else as_of
        start = start if start is not None else F.date_sub(F.lit(as_of).cast("date"), lookback_days)
    df = agg
    as_date = lambda v: v if isinstance(v, F.Column) else F.lit(v).cast("date")
    if start is not None:
        df = df.filter(F.col("period_start") >= as_date(start))
    if end is not None:
        df = df.filter(F.col("period_end") <= as_date(end))
    if products is not None:
        df = df.filter(F.col("product").isin(list(products)))
    if channels is not None:
        df = df.filter(F.col("channel").isin([c.upper() for c in channels]))
    if regions is not None:
        df = df.filter(F.col("region").isin([str(r) for r in regions]))
    return df.orderBy("period_start")


def overview_totals(enriched: DataFrame) -> DataFrame:
    """Headline totals straight from the leads; exact distinct campaigns."""
    return enriched.agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(is_yes()).alias("total_take_up"),
        F.count_distinct("campaign_id").alias("total_campaigns"),
    ).withColumn("take_up_rate", rnd(rate_pct("total_take_up", "total_leads"), 2))


def overview_totals_from_agg(agg: DataFrame) -> DataFrame:
    """A10: totals summed over roll-up rows. ``campaign_group_count`` is a *sum* of
    per-group distinct counts (a campaign spanning groups counts repeatedly); a
    mergeable roll-up also gives ``total_campaigns``, the different campaigns of
    whatever rows are left after filters."""
    sums = ["total_leads", "total_take_up", "campaign_count"]
    out = merged_counts(agg, [], sums) if BITS in agg.columns else agg.agg(*[F.sum(c).alias(c) for c in sums])
    return (out.withColumn("campaign_count", F.col("campaign_count").cast("long"))
               .withColumnRenamed("campaign_count", "campaign_group_count")
               .withColumn("take_up_rate", rnd(rate_pct("total_take_up", "total_leads"), 2)))


def overview_by(agg: DataFrame, by: list[str]) -> DataFrame:
    """A mergeable roll-up collapsed to fewer keys: leads, take-ups, rate and the
    exact number of campaigns per group."""
    return merged_counts(agg, by, ["total_leads", "total_take_up"]) \
        .withColumn("take_up_rate", rnd(rate_pct("total_take_up", "total_leads"), 2))


def overview_trend(agg: DataFrame) -> DataFrame:
    """One point per period of the (filtered) roll-up, rate recomputed."""
    return (agg.groupBy("period_start", "period_end")
               .agg(F.sum("total_leads").alias("total_leads"),
                    F.sum("total_take_up").alias("total_take_up"))
               .withColumn("take_up_rate", rnd(rate_pct("total_take_up", "total_leads"), 2))
               .orderBy("period_start"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of the roll-up or its trend with their ``position`` by period
    start, then by the other keys, so that the order is the same every time."""
    keys = [k for k in OVERVIEW_KEYS if k in rows.columns]
    return with_position(rows, *[F.col(k).asc_nulls_last() for k in keys]).orderBy("position")


def campaign_trend(master: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Per-campaign trend rows (period, leads, take-ups, rate)."""
    df = with_period_buckets(with_granularity(master, catalogue))
    return (df.groupBy("campaign_id", F.col("period_bucket").alias("period_start"), "period_end")
              .agg(F.sum("total_leads").alias("total_leads"),
                   F.sum("total_take_up").alias("total_take_up"))
              .withColumn("take_up_rate", rnd(rate_pct("total_take_up", "total_leads"), 2)))


def overview_trend_filtered(leads: DataFrame, trend: DataFrame) -> DataFrame:
    """J5 + W4: trend rows of the campaigns present in the (filtered) leads,
    one row per (period_start, period_end), the smallest campaign id winning."""
    ids = leads.select("campaign_id").distinct()
    rows = trend.join(ids, "campaign_id", "left_semi")
    w = Window.partitionBy("period_start", "period_end").orderBy("campaign_id")
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# ------------------------------------------------------------ regional

def regional_weekly(enriched: DataFrame, months: bool = False) -> DataFrame:
    """A3: campaign x region x ISO week of the campaign start; with ``months``
    also its year and month, by which the roll-up is then stored."""
    extra = ["year", "month"] if months else []
    agg = enriched.groupBy("campaign_id", "wilayah",
                           week_start("periode_start").alias("week_start"), *extra).agg(
        F.count(F.lit(1)).alias("leads_count"),
        F.count_if(is_yes()).alias("take_up_count"),
        F.avg(money("total_transaction_value")).cast("double").alias("avg_transaction_value"),
    )
    return agg.select("campaign_id", F.col("wilayah").alias("region"), "week_start",
                      "leads_count", "take_up_count",
                      rate_pct("take_up_count", "leads_count").alias("take_up_rate"),
                      "avg_transaction_value", *extra)


def regional_summary(weekly: DataFrame) -> DataFrame:
    """A4: weekly rows collapsed per campaign x region; the value column is a
    mean of weekly means (named so)."""
    return (weekly.groupBy("campaign_id", "region")
                  .agg(F.sum("leads_count").alias("leads_count"),
                       F.sum("take_up_count").alias("take_up_count"),
                       F.avg("avg_transaction_value").alias("avg_of_weekly_avg"))
                  .withColumn("take_up_rate", rate_pct("take_up_count", "leads_count")))


def regional_from_leads(enriched: DataFrame, flag_program: str | None = None) -> DataFrame:
    """A5 (+F14): region metrics straight from the leads.

    Value average = sum of take-up values (null as 0) / take-ups, 2 dp; rate
    2 dp; leads without a region are skipped. ``flag_program`` filters the
    leads first."""
    df = enriched.filter(F.col("wilayah").isNotNull())
    if flag_program is not None:
        df = df.filter(F.col("flag_program") == F.upper(F.lit(flag_program)))
    yes = is_yes()
    agg = df.groupBy("campaign_id", "wilayah").agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(yes).alias("total_take_up"),
        F.sum(F.when(yes, F.coalesce(money("total_transaction_value"), F.lit(0).cast("decimal(18,2)")))
              ).alias("_value"),
    )
    return agg.select(
        "campaign_id", "wilayah",
        F.concat(F.lit("Wilayah "), F.col("wilayah").cast("string")).alias("region_name"),
        "total_leads", "total_take_up",
        rnd(rate_pct("total_take_up", "total_leads"), 2).alias("take_up_rate"),
        F.when(F.col("total_take_up") > 0,
               F.round(F.col("_value") / F.col("total_take_up"), 2).cast("double"))
         .otherwise(F.lit(0.0)).alias("avg_transaction_value"),
    )


def rate_band(rate) -> F.Column:
    """High (>= 10 %), medium (>= 5 %), low."""
    r = F.col(rate) if isinstance(rate, str) else rate
    return (F.when(r >= RATE_BAND_HIGH, F.lit("high"))
             .when(r >= RATE_BAND_MEDIUM, F.lit("medium")).otherwise(F.lit("low")))


def regional_ranked(regions: DataFrame) -> DataFrame:
    """O3 (+X15): rank regions of each campaign by take-up rate, highest
    first, missing rates last, region number breaking ties; with the badge
    band of the rate."""
    w = Window.partitionBy("campaign_id").orderBy(
        F.col("take_up_rate").desc_nulls_last(), F.col("wilayah").asc())
    return regions.withColumns({"region_rank": F.row_number().over(w),
                                "rate_band": rate_band("take_up_rate")})


def regional_trend_8w(weekly: DataFrame, weeks: int = MAX_REGION_TREND_WEEKS) -> DataFrame:
    """The last ``weeks`` weekly rows per campaign x region (ascending)."""
    w = Window.partitionBy("campaign_id", "region").orderBy(F.col("week_start").desc())
    return (weekly.withColumn("_rn", F.row_number().over(w))
                  .filter(F.col("_rn") <= weeks).drop("_rn"))
