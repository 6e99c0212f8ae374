"""raw -> clean: key filter, date normalisation, keep-first dedup, outcome join.

Order of steps: normalise first (trim ``cif``, parse dates, upper-case the
categorical columns), then dedupe on the natural key, so the same lead
written with two date formats collapses into one row.

Scale notes
-----------
* Both dedups are ``row_number() == 1`` over the natural key. Spark plans
  them with a partial ``WindowGroupLimit`` before the shuffle, so a hot key
  sends at most one row per map task to its reducer.
* Both sides of the outcome join come out of their dedup hash-partitioned on
  the same three keys, so the sort-merge join reuses that partitioning
  instead of shuffling again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leadflow.functions.domains import NATURAL_KEY, UPPERCASE_COLUMNS
from leadflow.functions.exprs import campaign_slug, is_yes, parse_mixed_date


def filter_valid_cif(df: DataFrame) -> DataFrame:
    """Drop rows whose customer id is null, empty or blank."""
    return df.filter(F.col("cif").isNotNull() & (F.trim(F.col("cif")) != ""))


def normalise_leads(df: DataFrame) -> DataFrame:
    """Trim the key, parse ``periode_start`` to DATE, upper-case categories."""
    return _trim_and_upper(df.withColumn("periode_start", parse_mixed_date("periode_start")))


def _trim_and_upper(df: DataFrame) -> DataFrame:
    return df.withColumns({"cif": F.trim("cif"), **{c: F.upper(F.col(c)) for c in UPPERCASE_COLUMNS if c in df.columns}})


def _tie_break(df: DataFrame, first: list, used: tuple = ()) -> list:
    """Explicit total order: ``first`` expressions, then lineage columns if
    present, then every remaining data column (rows equal on all of them are
    indistinguishable, so the pick does not matter)."""
    lineage = [c for c in df.columns if c.startswith("_src_")]
    rest = [c for c in df.columns
            if c not in used and c not in lineage and c not in NATURAL_KEY]
    return list(first) + [F.col(c).asc_nulls_last() for c in lineage + rest]


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return (df.select("*", F.row_number().over(w).alias("_rn"))
              .filter(F.col("_rn") == 1).drop("_rn"))


def dedup_leads(df: DataFrame) -> DataFrame:
    """Keep one lead per natural key (cif, nama_program, periode_start).

    Expects normalised input. The kept row is the first in an explicit total
    order (lineage key, then all columns), never an arbitrary row id.
    """
    return keep_first(df, NATURAL_KEY, _tie_break(df, []))


def add_campaign_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"campaign_id": campaign_slug("nama_program", "periode_start"),
                           "year": F.year("periode_start"),
                           "month": F.month("periode_start")})


def clean_leads(raw: DataFrame) -> DataFrame:
    """F1 -> normalise -> W1 dedup -> campaign id, year, month."""
    return add_campaign_columns(dedup_leads(normalise_leads(filter_valid_cif(raw))))


def split_quarantine(leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a campaign id (unparseable date or no program name) would
    land in a default partition; they go to a quarantine table instead."""
    ok = F.col("campaign_id").isNotNull()
    return leads.filter(ok), leads.filter(~ok)


def normalise_monitoring(raw: DataFrame) -> DataFrame:
    return filter_valid_cif(raw).withColumns({
        "cif": F.trim("cif"),
        "periode_start": parse_mixed_date("periode_start"),
        "take_up_date": parse_mixed_date("take_up_date"),
        "take_up_flag": F.upper(F.trim("take_up_flag"))})


def dedup_monitoring(raw: DataFrame) -> DataFrame:
    """One outcome per lead key: a YES row first, then the earliest take-up
    date, then the lineage key when the source has one, then the smallest
    transaction value.

    Only the key, the outcome and lineage columns travel through the shuffle
    and sort; two rows that tie on all of these carry the same outcome, so
    which one is kept cannot change any result.
    """
    lineage = [c for c in raw.columns if c.startswith("_src_")]
    df = normalise_monitoring(raw.select(*NATURAL_KEY, "take_up_flag", "take_up_date",
                                         "total_transaction_value", *lineage))
    return keep_first(df, NATURAL_KEY, _outcome_order(df))


def _outcome_order(df: DataFrame) -> list:
    lineage = [c for c in df.columns if c.startswith("_src_")]
    return ([F.when(is_yes("take_up_flag"), 0).otherwise(1).asc(),
             F.col("take_up_date").asc_nulls_last()]
            + [F.col(c).asc_nulls_last() for c in lineage]
            + [F.col("total_transaction_value").asc_nulls_last(),
               F.col("take_up_flag").asc_nulls_last()])


def enrich_leads(leads: DataFrame, monitoring_raw: DataFrame) -> DataFrame:
    """Clean leads left-joined with their deduped outcome.

    ``take_up_flag`` defaults to 'NO'; ``time_to_take_up_days`` is the day gap
    from campaign start to take-up (may be negative; see the quality report).
    """
    outcome = dedup_monitoring(monitoring_raw).select(
        *NATURAL_KEY,
        F.col("take_up_flag").alias("_mon_flag"),
        "take_up_date",
        F.col("total_transaction_value"))
    keep = [c for c in leads.columns if not c.startswith("_src_")]
    joined = leads.select(*keep).join(outcome, on=NATURAL_KEY, how="left")
    return joined.withColumns({
        "take_up_flag": F.coalesce(F.col("_mon_flag"), F.lit("NO")),
        "time_to_take_up_days": F.datediff("take_up_date", "periode_start"),
    }).drop("_mon_flag")


# ------------------------------------------------------------ one pass with statuses

def _tagged(raw: DataFrame, misfit: Column, source: str) -> DataFrame:
    """Raw rows with ``_status`` (ok, malformed, blank_key) and ``_hold``: empty for
    rows that take part in the dedup and the join, a name of the row's own in its
    source for all others, so that these travel along and none is taken for
    another's copy or outcome."""
    status = F.when(misfit, "malformed").when(F.col("cif").isNull() | (F.trim("cif") == ""), "blank_key").otherwise("ok")
    rows = raw.withColumn("_status", status).withColumnRenamed("_corrupt_record", "_line")
    return rows.withColumn("_hold", F.when(F.col("_status") == "ok", "")
                           .otherwise(F.concat(F.lit(source), F.monotonically_increasing_id().cast("string"))))


def _watched(rows: DataFrame, watch: Observation, dates: list[str], watched: str) -> DataFrame:
    """Rows with their ``dates`` parsed, once for the counts and all that follows;
    ``watched`` is the one whose unreadable texts are counted."""
    rows = rows.withColumns({**{c: parse_mixed_date(c) for c in dates}, "_given": F.col(watched).isNotNull()})
    bad_date = F.col("_given") & F.col(watched).isNull()
    no_campaign = F.col("nama_program").isNull() | F.col("periode_start").isNull()
    fits = F.col("_status") != "malformed"
    return rows.observe(watch, F.count(F.lit(1)).alias("rows"), F.count_if(~fits).alias("malformed"),
                        F.count_if(F.col("_status") == "blank_key").alias("blank"), F.count_if(F.col("_status") == "ok").alias("valid"),
                        F.count_if(fits & bad_date).alias("bad_dates"), F.count_if(fits & no_campaign).alias("no_campaign")).drop("_given")


class EtlWatch:
    """What one pass over the raw sources counted, once its write is done."""

    def __init__(self) -> None:
        self.leads, self.monitoring, self.out = Observation(), Observation(), Observation()

    def metrics(self) -> dict[str, int]:
        """The cleaning's losses, under the names of ``quality.etl_quality``."""
        le, mo, out = self.leads.get, self.monitoring.get, self.out.get
        return {"lead_rows": le["rows"], "lead_malformed": le["malformed"], "lead_blank_cif": le["blank"],
                "lead_bad_dates": le["bad_dates"], "lead_null_campaign_id": le["no_campaign"],
                "lead_duplicates_dropped": le["valid"] - out["leads"],
                "monitoring_rows": mo["rows"], "monitoring_malformed": mo["malformed"], "monitoring_blank_cif": mo["blank"],
                "monitoring_bad_dates": mo["bad_dates"],
                "monitoring_duplicates_dropped": mo["valid"] - out["matched"] - out["without_lead"],
                "monitoring_keys_without_lead": out["without_lead"]}


def split_by_status(leads_raw: DataFrame, monitoring_raw: DataFrame, misfit: tuple[Column, Column],
                    watch: EtlWatch) -> DataFrame:
    """F1, W1 and J1 in one plan that reads each source once and loses nothing but
    duplicates: every row left has a ``status``.

    clean         an enriched lead
    no_campaign   a lead without a readable start date or a program name
    malformed     a row of either source that does not fit its schema (``raw_line``)
    blank_key     a row of either source without a customer id
    without_lead  an outcome whose key no lead has

    ``misfit`` marks the rows of each source that do not fit. Both sides leave
    their dedup partitioned by the same columns, so the full outer join between
    them shuffles nothing, and has at most one row per key on either side.
    """
    key = [*NATURAL_KEY, "_hold"]
    le = _watched(_tagged(leads_raw, misfit[0], "leads "), watch.leads, ["periode_start"], "periode_start")
    mo = _watched(_tagged(monitoring_raw, misfit[1], "monitoring "), watch.monitoring, ["periode_start", "take_up_date"], "take_up_date")
    lineage = [c for c in leads_raw.columns if c.startswith("_src_")]
    columns = [c for c in leads_raw.columns if c not in (*lineage, "_corrupt_record")]
    le = _trim_and_upper(le)
    le = keep_first(le, key, _tie_break(le, [], ("_hold", "_status", "_line")))
    le = le.select(*columns, "_hold", F.col("_status").alias("_ls"), F.col("_line").alias("_ll"))
    mo = mo.select(*key, "_status", "_line", "take_up_flag", "take_up_date", "total_transaction_value",
                   *[c for c in monitoring_raw.columns if c.startswith("_src_")]).withColumns({
        "cif": F.trim("cif"), "take_up_flag": F.upper(F.trim("take_up_flag"))})
    mo = keep_first(mo, key, _outcome_order(mo))
    mo = mo.select(*key, F.col("_status").alias("_ms"), F.col("_line").alias("_ml"),
                   F.col("take_up_flag").alias("_flag"), "take_up_date", "total_transaction_value")
    both = add_campaign_columns(le.join(mo, key, "full_outer"))
    lead, outcome = F.col("_ls").isNotNull(), F.col("_ms").isNotNull()
    status = (F.when(F.coalesce("_ls", "_ms") != "ok", F.coalesce("_ls", "_ms"))
              .when(~lead, "without_lead").when(F.col("campaign_id").isNull(), "no_campaign").otherwise("clean"))
    kept = F.col("_ls") == "ok"
    return both.withColumns({"status": status, "source": F.when(lead, "leads").otherwise("monitoring")}).observe(
        watch.out, F.count_if(kept).alias("leads"), F.count_if(kept & outcome).alias("matched"),
        F.count_if(F.col("status") == "without_lead").alias("without_lead"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("clean", "no_campaign", "malformed", "blank_key")]).select(
        *columns, "year", "month", "take_up_date", "total_transaction_value",
        F.when(kept, F.coalesce("_flag", F.lit("NO"))).otherwise(F.col("_flag")).alias("take_up_flag"),
        F.datediff("take_up_date", "periode_start").alias("time_to_take_up_days"),
        F.coalesce("_ll", "_ml").alias("raw_line"), "source", "status", "campaign_id")
