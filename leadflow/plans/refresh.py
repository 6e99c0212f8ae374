"""Incremental refresh: some months arrive anew, every stored table follows.

The overview is kept beside an additive state, one row per roll-up key and
campaign with counts that can be subtracted. When months change, their rows of
the campaign master count minus as they were and plus as they are now; the
signed sums are merged into the state's partitions they fall in, rows that no
longer exist leave it, and those partitions of the overview are derived anew,
bitmaps included. A bitmap cannot be subtracted, a count can. The weekly
roll-up and the leads belong to one month each and are replaced by partition.

Nothing but the changed months (and the period months their buckets lie in) is
read. A refresh is staged first, next to the tables and without touching them;
publishing replaces whole partitions by what was staged, so it can be repeated
after a failure, and half a refresh is never counted twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.functions.domains import OVERVIEW_KEYS, OVERVIEW_SUMS
from leadflow.operators import distinct, rollups
from leadflow.sources import io

#: What a state row counts, each of it additive.
STATE_SUMS = ["master_rows", "total_leads", "total_take_up", "value_rows", "total_transaction_value"]


@dataclass
class Zone:
    """The stored tables under one root."""
    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    #: table -> partition columns
    LAYOUT = {"leads": ["campaign_id"], "campaigns": ["year", "month"], "weekly": ["year", "month"],
              "state": ["period_month"], "overview": ["period_month"]}


def overview_state(master: DataFrame, catalogue: DataFrame | None, numbers: DataFrame, sign: int = 1) -> DataFrame:
    """The additive state of master rows, negated with ``sign`` -1."""
    cells = rollups.overview_cells(master, catalogue).join(numbers, "campaign_id", "left")
    value = F.col("total_transaction_value").cast("decimal(24,4)")
    return cells.groupBy(*OVERVIEW_KEYS, "campaign_no").agg(
        (F.count(F.lit(1)) * sign).alias("master_rows"),
        *[(F.sum(c) * sign).alias(c) for c in ("total_leads", "total_take_up")],
        (F.count("total_transaction_value") * sign).alias("value_rows"),
        (F.coalesce(F.sum(value), F.lit(0)) * sign).cast("decimal(38,4)").alias("total_transaction_value"))


def merged_state(*states: DataFrame) -> DataFrame:
    """States added up; what cancels out is gone. With the partition column."""
    rows = reduce(DataFrame.unionByName, [s.select(*OVERVIEW_KEYS, "campaign_no", *STATE_SUMS) for s in states])
    total = rows.groupBy(*OVERVIEW_KEYS, "campaign_no").agg(
        *[F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in STATE_SUMS])
    return total.filter("master_rows > 0").withColumn("period_month", F.date_format("period_start", "yyyy-MM"))


def overview_from_state(state: DataFrame) -> DataFrame:
    """The mergeable overview of the state's partitions."""
    rolled = distinct.campaign_bits(state, OVERVIEW_KEYS, ["value_rows", *OVERVIEW_SUMS])
    value = F.when(F.col("value_rows") > 0, F.col("total_transaction_value").cast("double"))
    rolled = rolled.withColumn("total_transaction_value", value)
    return rollups.overview_columns(rolled).withColumn("period_month", F.date_format("period_start", "yyyy-MM"))


def build(spark: SparkSession, zone: Zone, enriched: DataFrame, catalogue: DataFrame | None = None) -> None:
    """All tables from scratch."""
    io.write_partitioned(enriched, zone.path("leads"), Zone.LAYOUT["leads"])
    leads = io.read_enriched_leads(spark, zone.path("leads"))
    io.write_partitioned(rollups.campaign_master(leads), zone.path("campaigns"), Zone.LAYOUT["campaigns"])
    master = io.read_campaigns(spark, zone.path("campaigns"))
    distinct.number_campaigns(master).write.mode("overwrite").parquet(f"{zone.path('numbers')}/added=build")
    io.write_partitioned(merged_state(overview_state(master, catalogue, numbers(spark, zone))),
                         zone.path("state"), Zone.LAYOUT["state"])
    io.write_partitioned(overview_from_state(spark.read.parquet(zone.path("state"))),
                         zone.path("overview"), Zone.LAYOUT["overview"])
    io.write_partitioned(rollups.regional_weekly(leads, months=True), zone.path("weekly"), Zone.LAYOUT["weekly"])


def numbers(spark: SparkSession, zone: Zone) -> DataFrame:
    return spark.read.parquet(zone.path("numbers")).select("campaign_id", "campaign_no")


def overview(spark: SparkSession, zone: Zone) -> DataFrame:
    return spark.read.parquet(zone.path("overview")).drop("period_month")


def weekly(spark: SparkSession, zone: Zone) -> DataFrame:
    return spark.read.parquet(zone.path("weekly")).drop("year", "month")


def in_months(months: list[tuple[int, int]]) -> Column:
    """A condition on the partition columns year and month."""
    return reduce(Column.__or__, [(F.col("year") == y) & (F.col("month") == m) for y, m in months], F.lit(False))


def stage(spark: SparkSession, zone: Zone, changed: DataFrame, months: list[tuple[int, int]], where: str,
          catalogue: DataFrame | None = None) -> str:
    """Prepare the refresh of ``months``, whose enriched leads are now exactly
    ``changed`` (rows of other months are ignored), under ``where``."""
    own = in_months(months)
    changed.filter(own).write.mode("overwrite").parquet(f"{where}/leads")
    leads = spark.read.parquet(f"{where}/leads")
    rollups.campaign_master(leads).write.mode("overwrite").parquet(f"{where}/campaigns")
    rollups.regional_weekly(leads, months=True).write.mode("overwrite").parquet(f"{where}/weekly")
    before = io.read_campaigns(spark, zone.path("campaigns")).filter(own)
    after = spark.read.parquet(f"{where}/campaigns")
    known = numbers(spark, zone)
    distinct.number_campaigns(after, known).write.mode("overwrite").parquet(f"{where}/numbers")
    known = known.unionByName(spark.read.parquet(f"{where}/numbers"))
    delta = overview_state(before, catalogue, known, -1).unionByName(overview_state(after, catalogue, known))
    delta.write.mode("overwrite").parquet(f"{where}/delta")
    delta = spark.read.parquet(f"{where}/delta")
    # the changed months, and the month before one whose first week begins there
    touched = sorted(r[0] for r in delta.select(F.date_format("period_start", "yyyy-MM")).distinct().collect())
    state = spark.read.parquet(zone.path("state")).filter(F.col("period_month").isin(touched))
    merged_state(state, delta).write.mode("overwrite").parquet(f"{where}/state")
    overview_from_state(spark.read.parquet(f"{where}/state")).write.mode("overwrite").parquet(f"{where}/overview")
    gone = before.select("campaign_id").distinct().join(after.select("campaign_id"), "campaign_id", "left_anti")
    plan = [("period_month", t, None) for t in touched] + [("month", str(y), str(m)) for y, m in months]
    # written last: a stage without it is not complete
    spark.createDataFrame(plan, "kind string, a string, b string").unionByName(
        gone.select(F.lit("campaign").alias("kind"), F.col("campaign_id").alias("a"), F.lit(None).cast("string").alias("b"))) \
        .write.mode("overwrite").parquet(f"{where}/plan")
    return where


def publish(spark: SparkSession, zone: Zone, where: str) -> None:
    """Replace the partitions that a complete stage names. May be repeated."""
    plan = spark.read.parquet(f"{where}/plan").collect()      # months, and campaigns of those months that are gone
    spark.read.parquet(f"{where}/numbers").write.mode("overwrite") \
        .parquet(f"{zone.path('numbers')}/added={where.rstrip('/').rsplit('/', 1)[-1]}")
    specs = {"campaign_id": [{"campaign_id": r.a} for r in plan if r.kind == "campaign"],
             "year": [{"year": r.a, "month": r.b} for r in plan if r.kind == "month"],
             "period_month": [{"period_month": r.a} for r in plan if r.kind == "period_month"]}
    for table, by in Zone.LAYOUT.items():
        rows = spark.read.parquet(f"{where}/{table}")
        if by[0] == "campaign_id":
            gone = specs["campaign_id"]
        else:
            left = {tuple(str(v) for v in r) for r in rows.select(*by).distinct().collect()}    # of the named partitions
            gone = [s for s in specs[by[0]] if tuple(s.values()) not in left]
        io.write_partitioned(rows, zone.path(table), by, "dynamic")
        for spec in gone:
            io.drop_partition(spark, zone.path(table), **spec)


def refresh(spark: SparkSession, zone: Zone, changed: DataFrame, months: list[tuple[int, int]], where: str,
            catalogue: DataFrame | None = None) -> None:
    publish(spark, zone, stage(spark, zone, changed, months, where, catalogue))
