"""Time-to-take-up statistics and the fixed 7-bin histogram, for every
campaign at once.

Statistics come from counts per (campaign, day gap): a plain hash
aggregation with map-side combine, so a campaign holding a third of all
leads is reduced per map task to one row per distinct gap. The exact median
is then read off a running count over each campaign's few distinct gaps
(lower and upper middle value, averaged), with no per-group value buffer.
The histogram is one pass of seven conditional counts per campaign, turned
into rows with a generator; no grid or cross join is needed and empty bins
are kept.

All of them follow from counts per (campaign, channel, region, day gap), the
time cube. Counts add up, so a stored cube answers every request exactly, the
median and the filtered ones included, without the leads; cubes of different
leads are merged by adding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.domains import HISTOGRAM_BINS
from leadflow.functions.exprs import is_yes, rnd


#: The cube's dimensions: campaign, channel, region, day gap.
CUBE_KEYS = ["campaign_id", "media_blasting", "wilayah", "time_to_take_up_days"]


def take_up_leads(enriched: DataFrame, canonical: bool = False) -> DataFrame:
    """converted leads: flag YES and a take-up date present. The clean zone
    holds the flag in ``canonical`` form, so there it is compared as it is and
    the scan itself skips rows."""
    yes = F.col("take_up_flag") == "YES" if canonical else is_yes()
    return enriched.filter(yes & F.col("take_up_date").isNotNull())


def filter_channel_region(df: DataFrame, channel: str | None = None,
                          region: str | int | None = None) -> DataFrame:
    """optional channel (media_blasting, compared upper-cased) and region
    filters, applied before any aggregation. A region that is not an integer
    matches nothing."""
    if channel:
        df = df.filter(F.col("media_blasting") == F.upper(F.lit(channel)))
    if region is not None and str(region) != "":
        try:
            r = int(str(region).strip())
            df = df.filter(F.col("wilayah") == F.lit(r))
        except ValueError:
            df = df.filter(F.lit(False))
    return df


def _days(enriched: DataFrame) -> DataFrame:
    return take_up_leads(enriched).filter(F.col("time_to_take_up_days").isNotNull())


def time_cube(enriched: DataFrame, canonical: bool = False) -> DataFrame:
    """Take-ups per campaign, channel, region and day gap (``take_ups``)."""
    rows = take_up_leads(enriched, canonical).filter(F.col("time_to_take_up_days").isNotNull())
    return rows.groupBy(*CUBE_KEYS).agg(F.count(F.lit(1)).alias("take_ups"))


def merged_cubes(*cubes: DataFrame) -> DataFrame:
    """The cube of all the leads behind some cubes."""
    return reduce(DataFrame.unionByName, cubes).groupBy(*CUBE_KEYS).agg(F.sum("take_ups").alias("take_ups"))


def time_stats(enriched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A14 (+A23 with ``by``): min, max, mean (1 dp), exact median (1 dp) and
    count of day gaps per campaign (and breakdown column)."""
    keys = ["campaign_id"] + list(by or [])
    return _stats(_days(enriched)
                  .groupBy(*keys, F.col("time_to_take_up_days").alias("_d"))
                  .agg(F.count(F.lit(1)).alias("_n")), keys)


def stats_from_cube(cube: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``time_stats`` of the leads behind a (filtered) cube."""
    keys = ["campaign_id"] + list(by or [])
    return _stats(cube.groupBy(*keys, F.col("time_to_take_up_days").alias("_d")).agg(F.sum("take_ups").alias("_n")), keys)


def _stats(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of rows (keys, _d, _n): the day gap ``_d`` occurs ``_n`` times."""
    upto = Window.partitionBy(*keys).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    c = counts.select(*keys, "_d", "_n", F.sum("_n").over(upto).alias("_cum"),
                      F.sum("_n").over(whole).alias("_tot"))
    lower_pos = F.floor((F.col("_tot") + 1) / 2)      # 1-based lower middle
    upper_pos = F.floor(F.col("_tot") / 2) + 1        # 1-based upper middle
    agg = c.groupBy(*keys).agg(
        F.min("_d").cast("int").alias("min_days"),
        F.max("_d").cast("int").alias("max_days"),
        (F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("_mean"),
        F.min(F.when(F.col("_cum") >= lower_pos, F.col("_d"))).alias("_lo"),
        F.min(F.when(F.col("_cum") >= upper_pos, F.col("_d"))).alias("_hi"),
        F.sum("_n").alias("total_take_up"))
    return agg.select(*keys, "min_days", "max_days",
                      rnd("_mean", 1).alias("mean_days"),
                      rnd((F.col("_lo") + F.col("_hi")) / 2.0, 1).alias("median_days"),
                      "total_take_up")


def time_histogram(enriched: DataFrame) -> DataFrame:
    """7 bins per campaign with at least one take-up day value.

    ``start <= days < end`` (last bin open); the percentage (2 dp) is over
    all values, negatives included, though negatives fall in no bin.
    """
    return _histogram(_days(enriched), F.lit(1))


def histogram_from_cube(cube: DataFrame) -> DataFrame:
    """``time_histogram`` of the leads behind a (filtered) cube."""
    return _histogram(cube, F.col("take_ups"))


def _histogram(rows: DataFrame, times: Column) -> DataFrame:
    d = F.col("time_to_take_up_days")
    aggs = [F.sum(times).alias("_total")]
    for i, (lo, hi) in enumerate(HISTOGRAM_BINS):
        cond = (d >= lo) if hi is None else ((d >= lo) & (d < hi))
        aggs.append(F.sum(F.when(cond, times).otherwise(0)).alias(f"_b{i}"))
    per = rows.groupBy("campaign_id").agg(*aggs)
    bins = F.array(*[
        F.struct(F.lit(i).alias("bin_index"),
                 F.lit(lo).alias("range_start"),
                 F.lit(hi).cast("int").alias("range_end"),
                 F.col(f"_b{i}").alias("count"))
        for i, (lo, hi) in enumerate(HISTOGRAM_BINS)])
    rows = per.select("campaign_id", "_total", F.inline(bins))
    return rows.select(
        "campaign_id", "bin_index", "range_start", "range_end", "count",
        rnd(F.col("count") / F.col("_total") * 100.0, 2).alias("percentage"))
