"""URL filters by a temporal list join.

A list is a log of dated entries: on a day, a key (a host, or a host and the
first part of its path) is given an action. An entry holds until the key's next
one: the log becomes validity intervals. Every capture is then judged against
the entries active when it was fetched: an as-of join, as equality on key and
month with the day inside the interval; intervals are cut at the months in which
there are captures (a key's last interval has no end), so a key's long history is
not compared with all its captures, and a host with a third of all captures is an
ordinary skewed join that Spark splits. Intervals of a key
do not overlap, so a capture meets one entry per key at most. The most specific
key decides; ``none`` if no entry is active.

Defined results: a null or unparsable URL has no key and no entry; a null fetch
day meets no entry; entries of one key and day are ordered by action and the
last one holds; entries with a null key, day or action are ignored; repeated
captures are judged each; captures keep their other columns, but for any named
as one of the three that are added, which they replace; days may be negative;
empty tables give no rows.

The query derives both sides from ``pages``: the list from the hosts and paths
that occur there, days and actions from md5, so that SQL can do the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm.common import prepare, table

MONTH = 30

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.when(found != "", found)


def prefix_of(url: Column) -> Column:
    """Host and first part of the path; null if there is none."""
    part = F.regexp_extract(url, _PATH, 1)
    return F.when((part != "") & host_of(url).isNotNull(), F.concat(host_of(url), F.lit("/"), part))


def validity(entries: DataFrame, first: int, last: int) -> DataFrame:
    """(key, action, valid_from, valid_to, month) from (key, day, action);
    ``valid_to`` is not included and null if the interval is open; one row per
    month that an interval touches between the days ``first`` and ``last``."""
    known = (entries.filter(F.col("key").isNotNull() & F.col("day").isNotNull() & F.col("action").isNotNull())
             .groupBy("key", "day").agg(F.max("action").alias("action")))
    after = F.lead("day").over(W.partitionBy("key").orderBy("day"))
    spans = (known.select("key", "action", F.col("day").alias("valid_from"), after.alias("valid_to"))
             .filter((F.col("valid_from") <= last) & (F.col("valid_to").isNull() | (F.col("valid_to") > first))))
    begin = F.greatest(F.col("valid_from"), F.lit(first))
    end = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last)), F.lit(last))
    return spans.withColumn("month", F.explode(F.sequence(F.floor(begin / MONTH), F.floor(end / MONTH))))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (capture_id unique, url, day) with the action, key and
    first day of the entry that decides."""
    days = captures.agg(F.min("day"), F.max("day")).first()
    span = (days[0], days[1]) if days[0] is not None else (0, -1)
    keys = captures.select("capture_id", "day", F.explode(F.array(
        F.struct(F.lit(2).alias("weight"), prefix_of(F.col("url")).alias("key")),
        F.struct(F.lit(1).alias("weight"), host_of(F.col("url")).alias("key")))).alias("k"))
    keys = keys.select("capture_id", "day", "k.weight", "k.key", F.floor(F.col("day") / MONTH).alias("month")).filter("key IS NOT NULL")
    active = (keys.join(validity(entries, *span), ["key", "month"])
              .filter((F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))))
    # of the host's and the prefix's entry the more specific one
    best = active.groupBy(F.col("capture_id").alias("_capture")).agg(
        F.max(F.struct("weight", F.struct("action", "key", "valid_from").alias("e"))).alias("_best"))
    own = [captures[c] for c in captures.columns if c not in ("action", "list_key", "listed_on")]
    return (captures.join(best, captures["capture_id"] == best["_capture"], "left")
            .select(*own, F.coalesce(F.col("_best.e.action"), F.lit("none")).alias("action"),
                    F.col("_best.e.key").alias("list_key"), F.col("_best.e.valid_from").alias("listed_on")))


def _draw(text: Column, most: int) -> Column:
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % most).cast("int")


def derived_entries(pages: DataFrame) -> DataFrame:
    """Three dated entries for each fourth host and each fourth path prefix in ``pages``."""
    keys = (pages.select(F.explode(F.array(host_of(F.col("url")), prefix_of(F.col("url")))).alias("key"))
            .filter("key IS NOT NULL").distinct().filter(_draw(F.concat("key", F.lit("#listed")), 4) == 0))
    turn = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")
    name = F.concat("key", F.lit("#"), F.col("n").cast("string"))
    return keys.select("key", turn).select(
        "key", _draw(F.concat(name, F.lit("day")), 360).alias("day"),
        F.element_at(F.array(*map(F.lit, ("allow", "block", "review"))), _draw(F.concat(name, F.lit("action")), 3) + 1).alias("action"))


def op2_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url",
                            _draw(F.concat(F.col("page_id").cast("string"), F.lit("|"), F.coalesce("url", F.lit(""))), 365).alias("day"))
    return judge(captures, derived_entries(pages)).select(F.col("capture_id").alias("page_id"), "url", "day", "action", "list_key", "listed_on")


TEMPORAL_URL_SQL = r"""
WITH p AS (
  SELECT page_id, url,
         (('0x' || substr(md5(page_id::VARCHAR || '|' || coalesce(url, '')), 1, 7))::BIGINT % 365)::INT AS day,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS part
  FROM pages),
keyed AS (SELECT DISTINCT key FROM (SELECT host AS key FROM p UNION ALL SELECT host || '/' || part FROM p)
          WHERE key IS NOT NULL AND ('0x' || substr(md5(key || '#listed'), 1, 7))::BIGINT % 4 = 0),
log AS (
  SELECT key, (('0x' || substr(md5(key || '#' || n || 'day'), 1, 7))::BIGINT % 360)::INT AS day,
         ['allow', 'block', 'review'][(('0x' || substr(md5(key || '#' || n || 'action'), 1, 7))::BIGINT % 3)::INT + 1] AS action
  FROM keyed, range(3) r(n)),
entries AS (SELECT key, day, max(action) AS action FROM log GROUP BY key, day),
a AS (SELECT p.*, e.action AS a2, e.key AS k2, e.day AS v2
      FROM p ASOF LEFT JOIN entries e ON p.host || '/' || p.part = e.key AND p.day >= e.day),
b AS (SELECT a.*, e.action AS a1, e.key AS k1, e.day AS v1
      FROM a ASOF LEFT JOIN entries e ON a.host = e.key AND a.day >= e.day)
SELECT page_id, url, day, coalesce(a2, a1, 'none') AS action,
       CASE WHEN a2 IS NOT NULL THEN k2 ELSE k1 END AS list_key,
       CASE WHEN a2 IS NOT NULL THEN v2 ELSE v1 END AS listed_on
FROM b
"""
