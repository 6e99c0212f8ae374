"""Numeric facts behind the rule-based recommendations (no prose).

Per campaign: segment and region breakdowns, best/worst segment, best and
low regions, best similar campaign, follow-up days and channels not tried.
Breakdowns are one grouping-sets aggregation (single scan); picks are
``min_by`` with an explicit total order, so ties are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.domains import (CHANNEL_SUGGESTION_ORDER, FOLLOW_UP_FACTOR,
                                        FOLLOW_UP_MIN_DAYS, REGION_MIN_LEADS,
                                        SEGMENT_LIFT_CAP, SIMILAR_GAIN_CAP,
                                        SIMILAR_HIGH_SCORE)
from leadflow.functions.exprs import is_yes, rate_pct, rnd
from leadflow.operators import similarity


def _grouped_counts(enriched: DataFrame) -> DataFrame:
    """One scan, three grouping sets: (campaign), (campaign, segment_by_aum),
    (campaign, wilayah). The campaign set also carries the sum and count of
    take-up days (a mean is then exact across several campaign rows)."""
    yes = is_yes()
    days = F.when(yes, F.col("time_to_take_up_days"))
    # counted per combination first: the grouping sets then multiply a few rows
    # per campaign, not every lead
    df = enriched.groupBy("campaign_id", "media_blasting",
                          F.col("segment_by_aum").alias("_seg"),
                          F.col("wilayah").cast("string").alias("_wil")).agg(
        F.count(F.lit(1)).alias("_leads"), F.count_if(yes).alias("_yes"),
        F.sum(days).alias("_days"), F.count(days).alias("_n"))
    return df.groupingSets(
        [["campaign_id", "media_blasting"], ["campaign_id", "_seg"], ["campaign_id", "_wil"]],
        "campaign_id", "media_blasting", "_seg", "_wil").agg(
        F.sum("_leads").alias("leads"),
        F.sum("_yes").alias("take_up"),
        F.sum("_days").alias("_sum_days"),
        F.sum("_n").alias("_n_days"),
        F.grouping_id().alias("_gid"))


# grouping_id() bits over (campaign_id, media_blasting, _seg, _wil) are 8, 4, 2, 1,
# set when the column is *not* grouped: campaign set = 3, segment set = 5,
# region set = 6.
_GID_CAMPAIGN, _GID_SEGMENT, _GID_REGION = 3, 5, 6


def _breakdowns_from(g: DataFrame) -> DataFrame:
    g = g.filter(F.col("_gid") != _GID_CAMPAIGN)
    is_seg = F.col("_gid") == _GID_SEGMENT
    return g.select(
        "campaign_id",
        F.when(is_seg, F.lit("segment_by_aum")).otherwise(F.lit("wilayah")).alias("breakdown"),
        F.when(is_seg, F.col("_seg")).otherwise(F.col("_wil")).alias("label"),
        "leads", "take_up",
        rate_pct("take_up", "leads").alias("take_up_rate"))


def campaign_breakdowns(enriched: DataFrame) -> DataFrame:
    """Leads and take-ups per (campaign, segment_by_aum) and per
    (campaign, wilayah), one scan via grouping sets."""
    return _breakdowns_from(_grouped_counts(enriched))


def campaign_rates(enriched: DataFrame) -> DataFrame:
    """Per campaign: leads, take-ups, rate rounded to 2 dp, mean take-up days
    (1 dp) of converted leads with a day gap, and the channels it uses (a
    handful of names). Counted per channel first, a plain hash aggregation."""
    yes = is_yes()
    days = F.when(yes, F.col("time_to_take_up_days"))
    per = enriched.groupBy("campaign_id", "media_blasting").agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(yes).alias("total_take_up"),
        F.sum(days).alias("_days"), F.count(days).alias("_n"))
    r = per.groupBy("campaign_id").agg(
        F.sum("total_leads").alias("total_leads"), F.sum("total_take_up").alias("total_take_up"),
        rnd(F.sum("_days").cast("double") / F.sum("_n").cast("double"), 1).alias("avg_days"),
        F.collect_set(F.lower("media_blasting")).alias("channels"))
    return r.withColumn("take_up_rate", rnd(rate_pct("total_take_up", "total_leads"), 2))


def _segment_picks(is_seg, r, lab) -> list:
    """A20 as aggregates over segment rows: best = highest rate above 0,
    worst = lowest rate below 100; equal rates go to the smaller label."""
    best_key = F.when(is_seg & (r > 0), F.struct((-r).alias("r"), lab.alias("l")))
    worst_key = F.when(is_seg & (r < 100), F.struct(r.alias("r"), lab.alias("l")))
    return [F.min_by(lab, best_key).alias("best_segment"),
            F.max(F.when(is_seg & (r > 0), r)).alias("best_segment_rate"),
            F.min_by(lab, worst_key).alias("worst_segment"),
            F.min(F.when(is_seg & (r < 100), r)).alias("worst_segment_rate")]


def _region_picks(is_reg, r, w, camp_rate, empty_as_null: bool) -> list:
    """A21 as aggregates over region rows: the best rate above 0 (smallest
    region on ties) and the regions below half the campaign rate. A
    campaign's regions come from a fixed domain, so the list is bounded."""
    best_key = F.when(is_reg & (r > 0), F.struct((-r).alias("r"), w.alias("w")))
    low = F.when(is_reg & (r < camp_rate * 0.5), w)
    low_text = F.array_join(F.transform(F.sort_array(F.collect_list(low)),
                                        lambda x: x.cast("string")), ",")
    if empty_as_null:
        low_text = F.when(F.count_if(is_reg) > 0, low_text)
    return [F.min_by(w, best_key).alias("best_region"),
            F.max(F.when(is_reg & (r > 0), r)).alias("best_region_rate"),
            low_text.alias("low_regions")]


def best_worst_segment(breakdowns: DataFrame) -> DataFrame:
    """Best segment = highest rate above 0, worst = lowest rate below
    100; equal rates go to the smaller label."""
    seg = breakdowns.filter((F.col("breakdown") == "segment_by_aum") & (F.col("leads") > 0))
    return seg.groupBy("campaign_id").agg(
        *_segment_picks(F.lit(True), F.col("take_up_rate"), F.col("label")))


def campaign_picks(enriched: DataFrame) -> DataFrame:
    """Per campaign, in one pass over the leads: rate (2 dp), mean take-up
    days (1 dp), best/worst segment and best/low regions, plus how many
    segment and region rows qualified.

    The grouping-sets rows of a campaign are few (one per segment and per
    region), so one window over them hands the campaign rate to the region
    rows, and the group-by reuses the window's partitioning: a single
    shuffle after the partial aggregation, and no self-join of the
    aggregate (which would scan the leads once per branch).
    """
    g = _grouped_counts(enriched)
    gid, leads, take_up = F.col("_gid"), F.col("leads"), F.col("take_up")
    is_c = gid == _GID_CAMPAIGN
    camp = Window.partitionBy("campaign_id")
    n_c = F.sum(F.when(is_c, leads)).over(camp)
    t_c = F.sum(F.when(is_c, take_up)).over(camp)
    x = g.select("campaign_id", "_gid", "leads", "take_up", "_sum_days", "_n_days", "_seg", "_wil",
                 rate_pct("take_up", "leads").alias("_r"),
                 rnd(F.when(n_c > 0, t_c.cast("double") / n_c.cast("double") * 100.0)
                      .otherwise(F.lit(0.0)), 2).alias("_camp_rate"))
    r = F.col("_r")
    is_seg = (F.col("_gid") == _GID_SEGMENT) & (F.col("leads") > 0)
    is_reg = (F.col("_gid") == _GID_REGION) & (F.col("leads") >= REGION_MIN_LEADS)
    is_c = F.col("_gid") == _GID_CAMPAIGN
    days = F.sum(F.when(is_c, F.col("_sum_days"))).cast("double") / \
        F.sum(F.when(is_c, F.col("_n_days"))).cast("double")
    return x.groupBy("campaign_id").agg(
        F.max("_camp_rate").alias("take_up_rate"),
        rnd(days, 1).alias("avg_days"),
        *_segment_picks(is_seg, r, F.col("_seg")),
        *_region_picks(is_reg, r, F.col("_wil").cast("int"), F.col("_camp_rate"),
                       empty_as_null=True),
        F.count_if(is_seg).alias("segment_rows"),
        F.count_if(is_reg).alias("region_rows"))


def best_and_low_regions(enriched: DataFrame) -> DataFrame:
    """Among regions with >= 2 leads, the best rate above 0 (smallest
    region on ties) and the regions below half the campaign rate; campaigns
    with such regions only. One pass over the leads."""
    return (campaign_picks(enriched).filter(F.col("region_rows") > 0)
            .select("campaign_id", "best_region", "best_region_rate", "low_regions"))


def unused_channels(rates: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` channels, in suggestion order, other than the
    campaign's own ones (compared case-insensitively), one row per campaign."""
    chans = F.array(*[F.lit(c) for c in CHANNEL_SUGGESTION_ORDER])
    picked = F.slice(F.filter(chans, lambda c: ~F.array_contains("channels", c)), 1, n)
    return rates.select("campaign_id", F.array_join(picked, ",").alias("suggested_channels"))


def recommendation_facts(enriched: DataFrame, dim: DataFrame) -> DataFrame:
    """The numbers and codes of the three recommendations."""
    sim = similarity.best_similar(dim)
    df = campaign_picks(enriched).join(sim, "campaign_id", "left")   # the only pass over the leads
    rate = F.col("take_up_rate")
    sim_rate = F.round(F.col("best_similar_rate"), 6)
    better = sim_rate > rate
    return df.select(
        "campaign_id", "take_up_rate", "avg_days",
        "best_segment", "best_segment_rate", "worst_segment", "worst_segment_rate",
        F.when(F.col("best_segment_rate").isNotNull(), F.least(F.col("best_segment_rate") - rate, F.lit(SEGMENT_LIFT_CAP))).alias("segment_lift"),
        F.when(F.col("best_segment").isNull(), F.lit(None).cast("string"))
         .when(F.col("best_segment_rate") > rate * 1.5, F.lit("HIGH"))
         .otherwise(F.lit("MEDIUM")).alias("segment_confidence"),
        "best_region", "best_region_rate", "low_regions",
        F.when(better, F.col("best_similar_id")).alias("best_similar_id"),
        F.when(better, sim_rate).alias("best_similar_rate"),
        F.when(better, F.least(sim_rate - rate, F.lit(SIMILAR_GAIN_CAP))).alias("similar_gain"),
        F.when(better, F.when(F.col("best_similar_score") >= SIMILAR_HIGH_SCORE, F.lit("HIGH"))
                        .otherwise(F.lit("MEDIUM"))).alias("similar_confidence"),
        F.coalesce(F.col("similar_count"), F.lit(0)).cast("long").alias("similar_count"),
        F.when(F.col("avg_days") > 0,
               F.greatest(F.lit(FOLLOW_UP_MIN_DAYS),
                          F.floor(F.col("avg_days") * FOLLOW_UP_FACTOR).cast("int")))
         .alias("follow_up_days"),
    )
