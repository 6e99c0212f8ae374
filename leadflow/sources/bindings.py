"""Bind the driver's TPC-H-like tables to the campaign data model.

``leads_raw``       one targeted customer per campaign (orders x customer)
``monitoring_raw``  one outcome row per returned line item (lineitem x orders x customer)
``catalogue``       one row per campaign with its planned start/end date
``audit_events``    the audit log (events)

Raw views carry text dates in several formats, as the CSV drops do, so the
whole cleaning path (multi-format parse, normalise, dedup, join) runs on
them. Lineage columns (``_src_*``) give the dedup steps a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Formats the binding writes dates in, chosen per row by a key. Only formats
# that cannot be misread by an earlier format in DATE_FORMATS are used.
RENDER_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]

# planned campaign length in months by priority digit 1..5
CAMPAIGN_MONTHS = [1, 2, 3, 4, 6]

LEAD_COLUMNS = [
    "cif", "nama_program", "jenis_leads", "media_blasting", "periode_start",
    "flag_program", "wilayah", "cabang", "outlet", "segment_crs", "segment_by_aum",
    "segment_wondr", "segment_div_owner", "range_usia", "range_saldo_tab",
    "avg_aum_3_bln", "potensi_money",
]
OUTCOME_COLUMNS = ["take_up_flag", "take_up_date", "total_transaction_value"]


# (application id, path) -> (the path's state when it was listed, table)
_TABLES: dict[tuple[str, str], tuple[tuple[int, int], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table as a (lazy) DataFrame; the file listing and footer
    read happen once per session and path, not once per query."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    seen = modified(spark, path)
    if key not in _TABLES or _TABLES[key][0] != seen:
        _TABLES[key] = (seen, spark.read.parquet(path))
    return _TABLES[key][1]


def modified(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time and length of a file or folder; they change when its data do."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    return status.getModificationTime(), status.getLen()


#: The tables that the campaign model is bound to.
SOURCES = ["orders", "customer", "lineitem", "events"]


def state_of(spark: SparkSession, sf_dir: str) -> tuple:
    """Tells one content of the bound tables from another."""
    return tuple(modified(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in SOURCES)


def _render_date(d, key) -> F.Column:
    """Write DATE ``d`` as text in one of RENDER_FORMATS picked by ``key``."""
    idx = (key % F.lit(len(RENDER_FORMATS))).cast("int")
    out = None
    for i, fmt in enumerate(RENDER_FORMATS):
        branch = F.date_format(d, fmt)
        out = F.when(idx == i, branch) if out is None else out.when(idx == i, branch)
    return out


def _range_usia(acctbal) -> F.Column:
    return (F.when(acctbal < 0, "gen alpha")
             .when(acctbal < 2500, "gen z")
             .when(acctbal < 5000, "gen y")
             .when(acctbal < 7500, "gen x")
             .otherwise("baby boomer"))


def _lead_projection(o: str = "o", c: str = "c") -> list:
    od = F.to_date(F.col(f"{o}.o_orderdate"))
    start = F.trunc(od, "month")
    prio = F.col(f"{o}.o_orderpriority")
    okey = F.col(f"{o}.o_orderkey")
    return [
        F.col(f"{o}.o_custkey").cast("string").alias("cif"),
        prio.alias("nama_program"),
        F.concat(F.lit("Y"), F.year(od).cast("string")).alias("jenis_leads"),
        F.lower(F.substring(prio, 3, 100)).alias("media_blasting"),
        _render_date(start, okey).alias("periode_start"),
        F.when(F.month(od) <= 6, "PROGRAM H1").otherwise("PROGRAM H2").alias("flag_program"),
        (F.col(f"{c}.c_nationkey") % 17 + 1).cast("int").alias("wilayah"),
        (okey % 340).cast("int").alias("cabang"),
        (okey % 100).cast("int").alias("outlet"),
        F.lit(None).cast("string").alias("segment_crs"),
        F.col(f"{c}.c_mktsegment").alias("segment_by_aum"),
        F.lit(None).cast("string").alias("segment_wondr"),
        F.col(f"{o}.o_orderstatus").alias("segment_div_owner"),
        _range_usia(F.col(f"{c}.c_acctbal")).alias("range_usia"),
        F.col(f"{c}.c_acctbal").cast("double").alias("range_saldo_tab"),
        F.lit(None).cast("double").alias("avg_aum_3_bln"),
        F.col(f"{o}.o_totalprice").cast("double").alias("potensi_money"),
    ]


def leads_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").alias("o")
    c = table(spark, sf_dir, "customer").alias("c")
    return (o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey"), "inner")
             .select(*_lead_projection(), F.col("o.o_orderkey").alias("_src_orderkey")))


def monitoring_raw(spark: SparkSession, sf_dir: str, raw_gap: bool = False) -> DataFrame:
    """Outcome rows: every line item with return flag R is a take-up.

    ``raw_gap=False``: take-up date = campaign start + (partkey mod 120) days.
    ``raw_gap=True``: take-up date = the line's ship date (unrelated to the
    order date in this data, so about half the gaps are negative; used by the
    negative-take-up quality report only).
    """
    li = (table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
          .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                  "l_extendedprice", "l_shipdate").alias("l"))
    o = table(spark, sf_dir, "orders").alias("o")
    c = table(spark, sf_dir, "customer").alias("c")
    start = F.trunc(F.to_date(F.col("o.o_orderdate")), "month")
    if raw_gap:
        tud = F.to_date(F.col("l.l_shipdate"))
    else:
        tud = F.date_add(start, (F.col("l.l_partkey") % 120).cast("int"))
    return (li.join(o, F.col("l.l_orderkey") == F.col("o.o_orderkey"), "inner")
              .join(c, F.col("o.o_custkey") == F.col("c.c_custkey"), "inner")
              .select(*_lead_projection(),
                      F.lit("YES").alias("take_up_flag"),
                      _render_date(tud, F.col("l.l_linenumber")).alias("take_up_date"),
                      F.col("l.l_extendedprice").cast("double").alias("total_transaction_value"),
                      F.col("o.o_orderkey").alias("_src_orderkey"),
                      F.col("l.l_linenumber").cast("long").alias("_src_linenumber"),
                      F.col("l.l_partkey").alias("_src_partkey"),
                      F.col("l.l_suppkey").alias("_src_suppkey")))


def outcomes_raw(spark: SparkSession, sf_dir: str, raw_gap: bool = False) -> DataFrame:
    """The columns of ``monitoring_raw`` that say who converted: the lead key,
    the outcome and its lineage. None comes from the customer, so the outcome
    path joins line items with orders only."""
    li = (table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
          .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                  *(["l_shipdate"] if raw_gap else [])))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    start = F.trunc(F.to_date("o_orderdate"), "month")
    taken = F.to_date("l_shipdate") if raw_gap else F.date_add(start, (F.col("l_partkey") % 120).cast("int"))
    return (li.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "inner")
              .select(F.col("o_custkey").cast("string").alias("cif"),
                      F.col("o_orderpriority").alias("nama_program"),
                      _render_date(start, F.col("o_orderkey")).alias("periode_start"),
                      F.lit("YES").alias("take_up_flag"),
                      _render_date(taken, F.col("l_linenumber")).alias("take_up_date"),
                      F.col("l_extendedprice").cast("double").alias("total_transaction_value"),
                      F.col("o_orderkey").alias("_src_orderkey"),
                      F.col("l_linenumber").cast("long").alias("_src_linenumber"),
                      F.col("l_partkey").alias("_src_partkey"),
                      F.col("l_suppkey").alias("_src_suppkey")))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per campaign: name, planned start and end date, duration."""
    from leadflow.functions.exprs import campaign_slug
    o = table(spark, sf_dir, "orders")
    months = F.element_at(F.array(*[F.lit(m) for m in CAMPAIGN_MONTHS]),
                          F.substring("nama_program", 1, 1).cast("int"))
    base = (o.select(F.col("o_orderpriority").alias("nama_program"),
                     F.trunc(F.to_date("o_orderdate"), "month").alias("start_date"))
             .distinct())
    base = base.withColumn(
        "end_date",
        F.date_sub(F.add_months("start_date", months), 1))
    return base.select(
        campaign_slug("nama_program", "start_date").alias("campaign_id"),
        "nama_program", "start_date", "end_date",
        F.datediff("end_date", "start_date").alias("duration_days"))


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log bound to ``events``: who did what, on which page, with
    which request parameters."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("p"), (k % 5).cast("string")).alias("page_accessed"),
        F.col("event_type").alias("action"),
        F.col("props").alias("request_body"),
        F.col("event_id"),
    )
