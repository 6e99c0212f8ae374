"""Readers and writers of the campaign tables.

Scale notes
-----------
* Raw CSV is read with an explicit schema (no inference pass) in PERMISSIVE
  mode; malformed lines keep their text in ``_corrupt_record``.
* Partitioned sinks use the ``rebalance`` hint on the partition column: one
  shuffle after which AQE coalesces small partitions (few files per
  campaign, no small-file explosion) and splits a skewed one (a campaign
  holding a third of all rows is written by several tasks, not one);
  ``maxRecordsPerFile`` caps file size.
* Readers pin partition columns to their real types; with type inference
  switched off, ``campaign_id`` stays text.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadflow.functions.domains import EXPORT_COLUMNS, LEADS_SCHEMA, MONITORING_SCHEMA

MAX_RECORDS_PER_FILE = 5_000_000
#: Row groups of a clustered table: small enough that one holds few keys.
ROW_GROUP_BYTES = 32 << 20
#: Files that a task writing a partitioned table holds open at once.
OPEN_FILES = 64


# ------------------------------------------------------------ raw CSV

def read_raw(spark: SparkSession, path: str, schema: StructType, lineage: bool = False) -> DataFrame:
    """Every row of a CSV folder; one that does not fit the schema keeps its text in
    ``_corrupt_record``. With ``lineage`` rows also carry the order of their
    arrival (``_src_*``): their file's time and name, and their place in it, so
    that of two drops the earlier file's row comes first."""
    s = StructType(schema.fields + [StructField("_corrupt_record", StringType())])
    rows = (spark.read.schema(s).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    if lineage:
        rows = rows.select("*", F.col("_metadata.file_modification_time").alias("_src_time"),
                           F.col("_metadata.file_path").alias("_src_file"),
                           F.col("_metadata.file_block_start").alias("_src_block"),
                           F.monotonically_increasing_id().alias("_src_row"))
    return rows


def malformed(schema: StructType) -> Column:
    """Whether a row of ``read_raw`` does not fit. The reader checks only fields
    that are asked for, so all are."""
    return F.when(F.hash(*schema.names) % 2 >= -1, F.col("_corrupt_record").isNotNull())


def _fitting(rows: DataFrame, schema: StructType) -> DataFrame:
    return rows.filter(~malformed(schema)).drop("_corrupt_record")


def read_leads(spark: SparkSession, path: str, lineage: bool = False) -> DataFrame:
    """Raw leads CSV folder (header, fixed 17-column schema), the rows that fit."""
    return _fitting(read_raw(spark, path, LEADS_SCHEMA, lineage), LEADS_SCHEMA)


def read_monitoring(spark: SparkSession, path: str, lineage: bool = False) -> DataFrame:
    """Raw monitoring-report CSV folder (leads columns + 3 outcome columns)."""
    return _fitting(read_raw(spark, path, MONITORING_SCHEMA, lineage), MONITORING_SCHEMA)


def read_corrupt_lines(spark: SparkSession, path: str, schema: StructType = LEADS_SCHEMA) -> DataFrame:
    """Lines the CSV reader could not fit to the schema."""
    return read_raw(spark, path, schema).filter(malformed(schema))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------ parquet

@contextmanager
def _open_files(spark: SparkSession):
    """Within, a task that writes a partitioned table holds one open file for each of
    its first folders, instead of sorting its rows by folder; rows of further
    folders are sorted as ever."""
    conf, old = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    spark.conf.set(conf, OPEN_FILES)
    try:
        yield
    finally:
        spark.conf.set(conf, old)


def write_leads_partitioned(df: DataFrame, path: str, clustered: bool = False) -> None:
    """Enriched leads, one folder per campaign; a rebuild replaces the whole
    table, so a campaign that is gone leaves no folder behind. Leads read from a
    table ``clustered`` by campaign are written as they are read: a task's
    files hold few campaigns already, so nothing is shuffled."""
    rows = df if clustered else df.hint("rebalance", "campaign_id")
    with _open_files(df.sparkSession):
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
             .partitionBy("campaign_id").parquet(path))


def write_campaigns_partitioned(df: DataFrame, path: str) -> None:
    """Campaign master by year/month, rebuilt as a whole; see
    ``replace_months`` for a run over some months only."""
    _write_months(df, path, "static")


def replace_months(df: DataFrame, path: str) -> None:
    """S9 incrementally: only the months that ``df`` holds are replaced."""
    _write_months(df, path, "dynamic")


def _write_months(df: DataFrame, path: str, mode: str) -> None:
    write_partitioned(df, path, ["year", "month"], mode)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "static", distinct: tuple[str, ...] = ()) -> None:
    """``df`` in folders by ``by``: the whole table (``static``), or only the
    partitions that ``df`` holds (``dynamic``). Columns named ``distinct`` hardly
    repeat a value within a folder: their files try no dictionary."""
    with _open_files(df.sparkSession):
        (df.hint("rebalance", *by)
           .write.mode("overwrite").option("partitionOverwriteMode", mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
           .options(**{f"parquet.enable.dictionary#{c}": "false" for c in distinct})
           .partitionBy(*by).parquet(path))


def write_clustered(df: DataFrame, path: str, by: list[str]) -> None:
    """``df`` sorted into ranges of ``by``, with a bloom filter on the first column:
    a scan for some of its values skips files, row groups and pages. The other
    columns of ``by`` spread a hot value over several tasks and files."""
    (df.repartitionByRange(*by).sortWithinPartitions(*by)
       .write.mode("overwrite").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
       .option(f"parquet.bloom.filter.enabled#{by[0]}", "true").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path))


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _folder(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none if it is not there."""
    where, fs = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _folder(spark, path)
    fs.delete(where, True)


def drop_partition(spark: SparkSession, path: str, **spec) -> None:
    """Remove one partition's folder, if it is there: an overwrite replaces only
    partitions that still have rows."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    remove(spark, "/".join([path, *[f"{k}={escape(str(v))}" for k, v in spec.items()]]))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Whole-table snapshot, overwritten each run."""
    df.write.mode("overwrite").parquet(path)


def read_campaigns(spark: SparkSession, path: str) -> DataFrame:
    """S3: campaign master with its year/month partition columns as INT."""
    df = spark.read.option("basePath", path).parquet(path)
    return df.withColumn("year", F.col("year").cast("int")) \
             .withColumn("month", F.col("month").cast("int"))


def read_enriched_leads(spark: SparkSession, path: str) -> DataFrame:
    """Enriched leads with ``campaign_id`` forced to text. Of a table split by
    status (P1) these are the clean ones; the others are not listed for reading."""
    df = spark.read.option("basePath", path).parquet(path)
    if "status" in df.columns:
        df = df.filter(F.col("status") == "clean").drop("status", "source", "raw_line")
    return df.withColumn("campaign_id", F.col("campaign_id").cast("string"))


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# ------------------------------------------------------------ JSON fixtures

def read_json_array(spark: SparkSession, path: str, schema: StructType | str,
                    multiline: bool = True) -> DataFrame:
    """JSON documents holding an array of records (``multiLine``), or
    one record per line when ``multiline=False``."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def read_json_map(spark: SparkSession, path: str, row_schema: str,
                  key_name: str = "campaign_id", lines: bool = False) -> DataFrame:
    """JSON objects keyed by campaign whose values are lists of rows, as
    rows with the key: one document per file, however it is laid out, or with
    ``lines`` one object per line. Text that does not parse is an error."""
    text = spark.read.text(path, wholetext=not lines).filter(F.trim("value") != "")
    m = F.from_json("value", f"map<string, array<struct<{row_schema}>>>", {"mode": "FAILFAST"})
    return (text.select(F.explode(m).alias(key_name, "_rows"))
                .select(key_name, F.inline("_rows")))


def write_json_map(df: DataFrame, path: str, key_name: str = "campaign_id") -> None:
    """One JSON object per row and line (``{key: [row]}``); a key's lines read
    back as all its rows, and none is gathered in one place."""
    rows = [c for c in df.columns if c != key_name]
    df.select(F.to_json(F.create_map(F.col(key_name), F.array(F.struct(*rows)))).alias("value")) \
       .write.mode("overwrite").text(path)


# ------------------------------------------------------------ export

def export_rows(master: DataFrame) -> DataFrame:
    """S12 rows: the fixed eight columns, rate as ``12.34%``."""
    shown = {"wilayah": F.col("wilayah").cast("string"),
             "take_up_rate": F.format_string("%.2f%%", F.round("take_up_rate", 2))}
    return master.select(*[shown.get(c, F.col(c)).alias(c) for c in EXPORT_COLUMNS])


def export_campaign_table(master: DataFrame, path: str, page: str, start: str, end: str,
                          filter_summary: str = "none") -> None:
    """CSV export with a provenance record. Part files of a distributed
    CSV cannot carry a leading comment line, so provenance is written as a
    one-row CSV next to the data (``_metadata/``)."""
    spark = master.sparkSession
    write_csv(export_rows(master), f"{path}/data")
    meta = spark.createDataFrame(
        [(f"Source: {page}, Period: {start} to {end}, Filters: {filter_summary}",)], "provenance string")
    meta.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/_metadata")
