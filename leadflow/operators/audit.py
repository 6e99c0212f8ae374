"""The audit log as a table: parameter maps, retention, session expiry and
usage facts. The same ``audit_rows`` transform feeds the batch sink and the
streaming ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.domains import AUDIT_TTL_DAYS, SESSION_MAX_AGE_SECONDS


def request_params(query_map: Column, body: Column, max_len: int | None = None) -> Column:
    """Query-string map merged with the body: a JSON object's keys are
    merged in (later keys win), any other body is kept under ``body``. The
    whole body is parsed; with ``max_len`` the stored values are cut to that
    many characters afterwards."""
    as_map = F.from_json(body, "map<string,string>")
    is_obj = F.ltrim(body).startswith("{") & as_map.isNotNull()
    body_map = F.when(body.isNull() | (body == ""), F.create_map().cast("map<string,string>")) \
                .when(is_obj, as_map) \
                .otherwise(F.create_map(F.lit("body"), body))
    merged = F.map_concat(F.coalesce(query_map, F.create_map().cast("map<string,string>")), body_map)
    if max_len is None:
        return merged
    return F.transform_values(merged, lambda k, v: F.substring(v, 1, max_len))


def user_identity(claims_sub: Column, principal_id: Column) -> Column:
    """Token subject, else the authorizer principal, else 'anonymous'."""
    blank = lambda c: F.when(F.trim(c) == "", None).otherwise(c)
    return F.coalesce(blank(claims_sub), blank(principal_id), F.lit("anonymous"))


def audit_rows(events: DataFrame) -> DataFrame:
    """S13 record: user, time, page, action, merged parameters, expiry (epoch
    seconds, 90 days on)."""
    qmap = F.create_map(F.lit("page"), F.col("page_accessed"))
    return events.select(
        user_identity(F.col("user_id"), F.lit(None).cast("string")).alias("user_id"),
        F.col("timestamp"),
        "page_accessed", "action",
        request_params(qmap, F.col("request_body")).alias("request_params"),
        (F.unix_timestamp(F.col("timestamp").cast("timestamp"))
         + F.lit(AUDIT_TTL_DAYS * 86400)).alias("expiry_timestamp"),
        F.to_date("timestamp").alias("event_date"))


def audit_retention(rows: DataFrame, as_of: str) -> DataFrame:
    """Rows whose expiry lies after ``as_of`` (a timestamp text)."""
    cutoff = F.unix_timestamp(F.lit(as_of).cast("timestamp"))
    return rows.filter(F.col("expiry_timestamp") > cutoff)


def session_expiry(rows: DataFrame, max_age: int = SESSION_MAX_AGE_SECONDS) -> DataFrame:
    """A user's session starts at the first request of the day; a
    request more than ``max_age`` seconds after that start is made on an
    expired session (no start known: not expired). Per user and day:
    requests and expired requests.

    Requests are counted per second first, combined map-side, so a user's
    busiest day is at most 86,400 rows; the start is a window over those.
    """
    ts = F.unix_timestamp(F.col("timestamp").cast("timestamp"))
    seconds = rows.groupBy("user_id", "event_date", ts.alias("_ts")).agg(F.count(F.lit(1)).alias("_n"))
    start = F.min("_ts").over(Window.partitionBy("user_id", "event_date"))
    expired = F.coalesce(F.col("_ts") - F.col("_start") > max_age, F.lit(False))
    return seconds.withColumn("_start", start).groupBy("user_id", "event_date").agg(
        F.sum("_n").alias("requests"),
        F.sum(F.when(expired, F.col("_n")).otherwise(0)).alias("expired_requests"))


def audit_usage(rows: DataFrame) -> DataFrame:
    """Accesses per user, page, action and day."""
    return rows.groupBy("user_id", "page_accessed", "action", "event_date") \
               .agg(F.count(F.lit(1)).alias("accesses"))


def flatten_params(rows: DataFrame) -> DataFrame:
    """Map column as sorted ``k=v`` text (for export and comparison)."""
    entries = F.array_sort(F.map_entries("request_params"))
    return rows.withColumn("request_params",
                           F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&"))
