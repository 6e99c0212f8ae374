"""Data-quality reports: domain violations, take-ups before distribution,
and the ETL's own losses (bad dates, blank keys, duplicates, orphans).

Each report is one aggregation pass over its input, turned into rows with
``unpivot``; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.functions import domains as D
from leadflow.functions.exprs import parse_mixed_date
from leadflow.operators.clean import NATURAL_KEY


def _domain_checks() -> dict[str, tuple]:
    """column -> ('set', values) or ('range', lo, hi). Categorical values are
    compared in canonical upper case."""
    up = lambda vs: [v.upper() for v in vs]
    return {
        "media_blasting": ("set", up(D.MEDIA_BLASTING)),
        "flag_program": ("set", up(D.FLAG_PROGRAM)),
        "segment_by_aum": ("set", up(D.SEGMENT_BY_AUM)),
        "range_usia": ("set", up(D.RANGE_USIA)),
        "segment_div_owner": ("set", up(D.SEGMENT_DIV_OWNER)),
        "wilayah": ("range",) + D.WILAYAH_RANGE,
        "cabang": ("range",) + D.CABANG_RANGE,
        "outlet": ("range",) + D.OUTLET_RANGE,
    }


def domain_violations(leads: DataFrame) -> DataFrame:
    """Q1: per checked column, non-null values outside the domain, and the
    number of non-null values checked."""
    aggs = []
    checks = _domain_checks()
    for c, spec in checks.items():
        v = F.col(c)
        bad = (~F.upper(v).isin(spec[1])) if spec[0] == "set" else ~v.between(spec[1], spec[2])
        aggs += [F.count_if(v.isNotNull() & bad).alias(f"{c}__bad"),
                 F.count(v).alias(f"{c}__n")]
    wide = leads.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.col(f"{c}__bad").alias("violations"),
                               F.col(f"{c}__n").alias("checked"))
                      for c in checks])
    return wide.select(F.inline(pairs))


def negative_take_up(enriched: DataFrame) -> DataFrame:
    """Q2: per campaign, leads whose take-up date is earlier than the
    campaign start (the library version refuses such rows one by one)."""
    neg = enriched.filter(F.col("time_to_take_up_days") < 0)
    return neg.groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("negative_rows"),
        F.min("time_to_take_up_days").alias("min_gap_days"))


def etl_quality(leads_raw: DataFrame, monitoring_raw: DataFrame) -> DataFrame:
    """Q3: rows the cleaning step drops or cannot place, as (metric, value).

    Each source is scanned once. Every row is tagged with its source and its
    normalised natural key; rows of both sources are counted per key (a hash
    aggregation combined map-side, so a hot key costs one row per map task);
    one global aggregation over the keys gives every metric. Duplicates are
    valid rows minus distinct keys; an outcome key is an orphan when no valid
    lead has it, and a key with a null part never matches, as in a join.

    Sources read by ``io.read_raw`` (with ``_corrupt_record``) also give the rows
    that do not fit their schema, which then count in no other metric but the
    rows, and the outcome keys without a lead.
    """
    blank = F.col("cif").isNull() | (F.trim("cif") == "")
    raw = "_corrupt_record" in leads_raw.columns

    def tagged(df: DataFrame, src: str, date_col: str) -> DataFrame:
        misfit = F.lit(False)
        if raw:
            names = [c for c in df.columns if c != "_corrupt_record" and not c.startswith("_src_")]
            misfit = F.when(F.hash(*names) % 2 >= -1, F.col("_corrupt_record").isNotNull())   # has every field checked
        fits = ~F.col("_misfit")
        return df.withColumn("_misfit", misfit).select(
            F.lit(src).alias("_src"), "_misfit",
            F.when(fits, F.trim("cif")).alias("cif"), F.when(fits, F.col("nama_program")).alias("nama_program"),
            F.when(fits, parse_mixed_date("periode_start")).alias("periode_start"),
            (fits & blank).alias("_blank"),
            (fits & F.col(date_col).isNotNull() & parse_mixed_date(date_col).isNull()).alias("_bad_date"))

    rows = tagged(leads_raw, "L", "periode_start").unionByName(
        tagged(monitoring_raw, "M", "take_up_date"))
    per_src = {}
    for src in ("L", "M"):
        this = F.col("_src") == src
        per_src[src] = [F.count_if(this).alias(f"{src}_rows"),
                        F.count_if(this & F.col("_blank")).alias(f"{src}_blank"),
                        F.count_if(this & F.col("_bad_date")).alias(f"{src}_bad"),
                        F.count_if(this & F.col("_misfit")).alias(f"{src}_misfit"),
                        F.count_if(this & ~F.col("_blank") & ~F.col("_misfit")).alias(f"{src}_valid")]
    per_key = rows.groupBy(*NATURAL_KEY).agg(*per_src["L"], *per_src["M"])

    def total(c) -> F.Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("long")

    no_campaign = F.col("nama_program").isNull() | F.col("periode_start").isNull()
    null_part = F.col("cif").isNull() | no_campaign
    metrics = per_key.agg(
        total("L_rows").alias("lead_rows"),
        total("L_blank").alias("lead_blank_cif"),
        total("L_bad").alias("lead_bad_dates"),
        total(F.when(no_campaign, F.col("L_rows") - F.col("L_misfit"))).alias("lead_null_campaign_id"),
        (total("L_valid") - F.count_if(F.col("L_valid") > 0)).alias("lead_duplicates_dropped"),
        total("M_rows").alias("monitoring_rows"),
        total("M_blank").alias("monitoring_blank_cif"),
        total("M_bad").alias("monitoring_bad_dates"),
        (total("M_valid") - F.count_if(F.col("M_valid") > 0)).alias("monitoring_duplicates_dropped"),
        total(F.when((F.col("L_valid") == 0) | null_part, F.col("M_valid")))
        .alias("monitoring_without_lead"),
        *([total("L_misfit").alias("lead_malformed"), total("M_misfit").alias("monitoring_malformed"),
           F.count_if(((F.col("L_valid") == 0) | null_part) & (F.col("M_valid") > 0)).alias("monitoring_keys_without_lead")]
          if raw else []))
    cols = metrics.columns
    return (metrics.select(*[F.col(c).cast("long") for c in cols])
                   .unpivot([], cols, "metric", "value"))
