"""Mergeable exact distinct counts: bitmaps over dense campaign numbers.

A campaign has a number of its own (1, 2, ...) that it keeps when others are
added. The campaigns of a roll-up row are the set bits of a few fixed-size
bitmaps, one per 32,768 numbers in use. Or-ing the bitmaps of any rows gives
the exact number of different campaigns behind them, so a filtered or summed
roll-up counts a campaign once, however many rows it is in, without the leads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.operators.ordering import with_position

BITS = "campaign_bits"


def number_campaigns(ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(campaign_id, campaign_no) of the campaigns of ``ids`` that ``known`` (the
    same columns) does not hold yet, numbered on from its largest number."""
    fresh = ids.select("campaign_id").filter(F.col("campaign_id").isNotNull()).distinct()
    last = 0
    if known is not None:
        fresh = fresh.join(known.select("campaign_id"), "campaign_id", "left_anti")
        last = known.agg(F.max("campaign_no")).first()[0] or 0
    return with_position(fresh, F.col("campaign_id"), name="campaign_no", first=last + 1)


def campaign_bits(numbered: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Per group of ``keys``: its ``sums``, the bitmaps of its campaign
    numbers, an array of (bucket, bits), and their exact count."""
    per = numbered.groupBy(*keys, F.bitmap_bucket_number("campaign_no").alias("_bucket")).agg(
        *[F.sum(c).alias(c) for c in sums], F.bitmap_construct_agg(F.bitmap_bit_position("campaign_no")).alias("_bits"))
    known = F.col("_bucket").isNotNull()
    return per.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.array_sort(F.collect_list(F.when(known, F.struct(F.col("_bucket").alias("bucket"), F.col("_bits").alias("bits"))))).alias(BITS),
        F.coalesce(F.sum(F.when(known, F.bitmap_count("_bits"))), F.lit(0)).alias("campaign_count"))


def merged_counts(agg: DataFrame, keys: list[str], sums: list[str], name: str = "total_campaigns") -> DataFrame:
    """The rows of a roll-up merged over ``keys`` (none: one row): its additive
    columns summed and its different campaigns counted, in one pass.

    A roll-up row spreads over its buckets; its sums travel with the first."""
    rows = agg.select(*keys, *sums, F.posexplode_outer(BITS).alias("_at", "_b"))
    per = rows.groupBy(*keys, F.col("_b.bucket").alias("_bucket")).agg(
        *[F.sum(F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.col(c))).alias(c) for c in sums],
        F.bitmap_or_agg(F.coalesce("_b.bits", F.unhex(F.lit("")))).alias("_bits"))
    return per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums],
                                  F.coalesce(F.sum(F.bitmap_count("_bits")), F.lit(0)).alias(name))
