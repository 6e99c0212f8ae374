"""Customer-attribute distributions for every campaign in one pass.

The five attribute columns are unpivoted once (a narrow generator, no
shuffle), then a single ``groupBy(campaign, attribute, label)`` with
partial aggregation produces all distributions. Shares that sum to exactly
100 are a window over the (small) per-campaign label groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.domains import CUSTOMER_ATTRIBUTES
from leadflow.functions.exprs import blank_to_null, is_yes, rnd


def _long(enriched: DataFrame, attributes: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"),
                               blank_to_null(F.col(a)).alias("label"))
                      for a in attributes])
    return enriched.select("campaign_id", is_yes().alias("_yes"), F.inline(pairs))


def shares_to_100(counts: DataFrame, keys: list[str], label: str = "label",
                  count: str = "count", scale: int = 4) -> DataFrame:
    """``count / total * 100`` rounded; the last label (ascending) takes
    the remainder so the group sums to exactly 100 (computed from the
    *rounded* shares of the others)."""
    w_all = Window.partitionBy(*keys)
    w_desc = Window.partitionBy(*keys).orderBy(F.col(label).desc())
    total = F.sum(count).over(w_all)
    pct = rnd(F.col(count) / total * 100.0, scale)
    out = counts.withColumn("_pct", pct) \
                .withColumn("_is_last", F.row_number().over(w_desc) == 1)
    others = F.sum(F.when(~F.col("_is_last"), F.col("_pct")).otherwise(F.lit(0.0))).over(w_all)
    return (out.withColumn("percentage",
                           F.when(F.col("_is_last"), rnd(F.lit(100.0) - others, scale))
                            .otherwise(F.col("_pct")))
               .drop("_pct", "_is_last"))


def criteria_distribution(enriched: DataFrame,
                          attributes: list[str] = CUSTOMER_ATTRIBUTES) -> DataFrame:
    """Per campaign, attribute and trimmed non-blank label: count, share
    (4 dp, sums to 100), take-ups and take-up percentage (4 dp)."""
    counts = (_long(enriched, attributes)
              .filter(F.col("label").isNotNull())
              .groupBy("campaign_id", "attribute", "label")
              .agg(F.count(F.lit(1)).alias("count"),
                   F.count_if("_yes").alias("take_up_count")))
    out = shares_to_100(counts, ["campaign_id", "attribute"])
    return out.withColumn(
        "take_up_percentage",
        rnd(F.col("take_up_count") / F.col("count") * 100.0, 4))


def criteria_availability(enriched: DataFrame,
                          attributes: list[str] = CUSTOMER_ATTRIBUTES) -> DataFrame:
    """Per campaign and attribute, whether any lead has a non-blank value."""
    return (_long(enriched, attributes)
            .groupBy("campaign_id", "attribute")
            .agg(F.count("label").alias("labelled_leads"))
            .withColumn("available", F.col("labelled_leads") > 0))
