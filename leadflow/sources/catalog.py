"""Tables declared in the session's catalogue over stored folders.

``declare_tables`` gives the product's four tables a declared schema, declared
partition columns and statistics: partitions are recovered from the folders, so
a predicate on them picks folders from the catalogue's list instead of listing
storage, and row counts and column ranges are answered without reading rows.

``store_bucketed`` writes a table in hash buckets, each sorted: a lookup by key
opens one bucket, and two tables bucketed alike join on the key without a
shuffle. ``declare_bucketed`` declares such a folder again in another session.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.session import shared_dir

# ---- fixed values (the tables' columns, as the jobs store them) ----

LEADS_COLUMNS = """
    cif STRING, nama_program STRING, jenis_leads STRING, media_blasting STRING, periode_start DATE,
    flag_program STRING, wilayah INT, cabang INT, outlet INT, segment_crs STRING, segment_by_aum STRING,
    segment_wondr STRING, segment_div_owner STRING, range_usia STRING, range_saldo_tab DOUBLE,
    avg_aum_3_bln DOUBLE, potensi_money DOUBLE, take_up_flag STRING, take_up_date DATE,
    time_to_take_up_days INT, total_transaction_value DOUBLE"""
CAMPAIGN_COLUMNS = """
    campaign_id STRING, nama_program STRING, flag_program STRING, jenis_leads STRING, media_blasting STRING,
    wilayah INT, periode_start DATE, total_leads BIGINT, total_take_up BIGINT, take_up_rate DOUBLE,
    total_transaction_value DOUBLE, avg_time_to_take_up_days DOUBLE"""
OVERVIEW_TABLE_COLUMNS = """
    period_start DATE, period_end DATE, granularity STRING, product STRING, channel STRING, region STRING,
    total_leads BIGINT, total_take_up BIGINT, take_up_rate DOUBLE, total_transaction_value DOUBLE,
    campaign_count BIGINT"""
REGIONAL_TABLE_COLUMNS = """
    campaign_id STRING, region INT, week_start DATE, leads_count BIGINT, take_up_count BIGINT,
    take_up_rate DOUBLE, avg_transaction_value DOUBLE"""

#: table -> columns, partition columns, columns with statistics of their own
TABLES = {
    "leads": (LEADS_COLUMNS, "campaign_id STRING", ["take_up_flag", "wilayah", "periode_start"]),
    "campaign": (CAMPAIGN_COLUMNS, "year INT, month INT", ["wilayah", "periode_start", "total_leads"]),
    "campaign_overview_agg": (OVERVIEW_TABLE_COLUMNS, "", ["period_start", "period_end", "product", "channel", "region"]),
    "regional_performance_agg": (REGIONAL_TABLE_COLUMNS, "", ["campaign_id", "region", "week_start"]),
}


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def use_database(spark: SparkSession, database: str) -> None:
    """Create the database, in the shared folder, if it is not there."""
    where = _quoted(f"{shared_dir(spark)}/{database}.db")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION {where}")


def declare_tables(spark: SparkSession, locations: dict[str, str], database: str = "leadflow",
                   statistics: bool = True) -> list[str]:
    """Declare the named tables over their folders, recover their partitions and
    gather statistics; returns the full names. Declaring again is a refresh."""
    use_database(spark, database)
    done = []
    for name, path in locations.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        columns, parts, measured = TABLES[name]
        full = f"{database}.{name}"
        spark.sql(f"DROP TABLE IF EXISTS {full}")          # an external table: the files stay
        partitioned = f"PARTITIONED BY ({', '.join(p.split()[0] for p in parts.split(', '))})" if parts else ""
        spark.sql(f"CREATE TABLE {full} ({columns}{', ' + parts if parts else ''}) USING parquet {partitioned} "
                  f"LOCATION {_quoted(path)}")
        if parts:
            spark.sql(f"ALTER TABLE {full} RECOVER PARTITIONS")
        if statistics:
            spark.sql(f"ANALYZE TABLE {full} COMPUTE STATISTICS FOR COLUMNS {', '.join(measured)}")
        done.append(full)
    return done


def sync_partitions(spark: SparkSession, table: str) -> None:
    """Bring the catalogue's partitions in line with the folders: new ones are
    added, those that are gone are dropped."""
    spark.sql(f"MSCK REPAIR TABLE {table} SYNC PARTITIONS")


def table_statistics(spark: SparkSession, tables: list[str]) -> DataFrame:
    """(table_name, row_count, partitions) as the catalogue knows them; no table
    is read. A table without statistics has a null count."""
    rows = []
    for t in tables:
        said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {t}").collect()}
        found = re.search(r"(\d+) rows", said.get("Statistics", ""))
        parts = spark.sql(f"SHOW PARTITIONS {t}").count() if "# Partition Information" in said else 0
        rows.append((t.split(".")[-1], int(found[1]) if found else None, parts))
    return spark.createDataFrame(rows, "table_name string, row_count long, partitions long")


def column_range(spark: SparkSession, table: str, column: str) -> dict[str, str]:
    """A column's statistics (min, max, num_nulls, distinct_count) from the catalogue."""
    return {r["info_name"]: r["info_value"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table} {column}").collect()}


# ------------------------------------------------------------ bucketed tables

def buckets_for(rows: int, each: int = 2_000_000, least: int = 8) -> int:
    """A power of two, so that tables of different sizes still bucket alike in part."""
    n = least
    while n * each < rows:
        n *= 2
    return n


def store_bucketed(df: DataFrame, name: str, path: str, key: str, order: list[str], buckets: int,
                   database: str = "leadflow") -> DataFrame:
    """Write ``df`` into ``buckets`` by ``key``, one sorted file each, and declare it."""
    spark = df.sparkSession
    use_database(spark, database)
    # the shuffle's hash is the buckets' hash, so a task writes one bucket
    (df.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(*order)
       .mode("overwrite").format("parquet").option("path", path).saveAsTable(f"{database}.{name}"))
    return spark.table(f"{database}.{name}")


def declare_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, order: list[str],
                     buckets: int, database: str = "leadflow") -> DataFrame:
    """Declare a folder that ``store_bucketed`` wrote, in a session that does not know it."""
    use_database(spark, database)
    spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    spark.sql(f"CREATE TABLE {database}.{name} ({schema}) USING parquet CLUSTERED BY ({key}) "
              f"SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION {_quoted(path)}")
    return spark.table(f"{database}.{name}")
