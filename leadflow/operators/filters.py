"""Lead and roll-up filters. All are plain DataFrame predicates, so Catalyst
pushes them into the Parquet scan (and prunes partitions when the filtered
column is a partition column)."""

from __future__ import annotations

import re

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOWED_FILTER_FIELDS = ["period", "product", "channel", "region", "jenis_leads",
                         "flag_program", "media_blasting", "wilayah"]


def _isin(c: Column, values: Sequence | None) -> Column:
    """``None`` = no constraint; an empty list matches nothing."""
    if values is None:
        return F.lit(True)
    if len(values) == 0:
        return F.lit(False)
    return c.isin(list(values))


def filter_period_range(df: DataFrame, start=None, end=None, column: str = "periode_start") -> DataFrame:
    """inclusive range on a date column; rows whose date is null pass."""
    c = F.col(column)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (c >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (c <= F.lit(end).cast("date"))
    return df.filter(c.isNull() | cond)


def filter_leads_facets(df: DataFrame, campaign_id: str | None = None,
                        flag_program: Sequence[str] | None = None,
                        media_blasting: Sequence[str] | None = None,
                        wilayah: Sequence[int] | None = None,
                        jenis_leads: Sequence[str] | None = None,
                        start=None, end=None) -> DataFrame:
    """AND of IN-lists over the lead facets plus the date range.
    Categorical values are compared in canonical upper case."""
    up = lambda vs: None if vs is None else [str(v).upper() for v in vs]
    cond = (_isin(F.col("flag_program"), up(flag_program))
            & _isin(F.col("media_blasting"), up(media_blasting))
            & _isin(F.col("wilayah"), None if wilayah is None else [int(w) for w in wilayah])
            & _isin(F.col("jenis_leads"), jenis_leads))
    if campaign_id is not None:
        cond = cond & (F.col("campaign_id") == F.lit(campaign_id))
    return filter_period_range(df.filter(cond), start, end)


def validate_filters(filters: Sequence[tuple[str, Sequence]]) -> None:
    """every filter names a known field and has at least one value."""
    for field, values in filters:
        if field not in ALLOWED_FILTER_FIELDS:
            raise ValueError(f"unknown filter field {field!r}")
        if not values:
            raise ValueError(f"filter {field!r} has no values")


def _period_condition(df: DataFrame, values: Sequence) -> Column:
    """compare the ``period`` column, else ``start_date``, else no match."""
    vals = [str(v) for v in values]
    if "period" in df.columns:
        return _equals(df, "period", vals)
    if "start_date" in df.columns:
        return _equals(df, "start_date", vals)
    return F.lit(False)


def _equals(df: DataFrame, field: str, values: Sequence) -> Column:
    """Text comparison of a column with values. Where every value reads back
    unchanged through the column's type, the values are cast instead of the
    column, so the filter reaches the scan."""
    texts = [str(v) for v in values]
    kind = dict(df.dtypes)[field]
    if kind == "string":
        return F.col(field).isin(texts)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        size = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}[kind]
        if all(re.fullmatch(r"0|-?[1-9][0-9]{0,18}", t) and abs(int(t)) < 1 << size for t in texts):
            return F.col(field).isin([int(t) for t in texts])
    if kind == "date" and all(re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", t) for t in texts):
        try:
            return F.col(field).isin([date.fromisoformat(t) for t in texts])
        except ValueError:
            pass   # no such day: compare as text
    return F.col(field).cast("string").isin(texts)


def filter_active(df: DataFrame, filters: Sequence[tuple[str, Sequence]]) -> DataFrame:
    """AND over (field, values); values compared as text; a field the
    data does not have matches nothing; no filters returns the input."""
    cond = F.lit(True)
    for field, values in filters:
        if field == "period":
            cond = cond & _period_condition(df, values)
        elif field in df.columns:
            cond = cond & _equals(df, field, values)
        else:
            cond = cond & F.lit(False)
    return df.filter(cond)


def campaign_lookup(df: DataFrame, campaign_id: str) -> DataFrame:
    """equality on the raw ``campaign_id`` column (no expression around
    it, so partition pruning applies on partitioned tables)."""
    return df.filter(F.col("campaign_id") == F.lit(campaign_id))


def param_query(spark: SparkSession, sql: str, params: dict, views: dict[str, DataFrame]) -> DataFrame:
    """SQL with named ``:name`` parameter markers bound by Spark itself
    (values never spliced into the text)."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=params)


def lenient_totals(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """totals over text-typed numeric columns: a null counts as 0, and a
    row holding any non-numeric value is skipped as a whole."""
    parsed = rows.select(*[F.col(c).try_cast("long").alias(c) for c in columns],
                         *[F.col(c).alias(f"_raw_{c}") for c in columns])
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull())
    ok = ~bad
    return parsed.agg(*[F.sum(F.when(ok, F.coalesce(F.col(c), F.lit(0)))).alias(c) for c in columns],
                      F.count_if(ok).alias("rows_used"),
                      F.count_if(bad).alias("rows_skipped"))
