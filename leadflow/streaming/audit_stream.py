"""Audit events ingested incrementally with Structured Streaming.

File source -> the batch ``audit_rows`` transform -> ``foreachBatch``. The sink
is laid out by day first::

    event_date=2024-01-05/part=b-<query>-<batch>     what one micro-batch brought for the day
    event_date=2024-01-05/part=c-<id>                a compaction of the day

A micro-batch writes its own parts and reads nothing: its cost does not depend on
how much was ingested before. Its parts are named by the query's checkpoint and
the batch id, so a retry overwrites them. Of rows with the same key (user_id,
timestamp) the reader keeps the first in a total order over all columns, so the
answer does not depend on how many files, batches or deliveries the log came in,
and there is no watermark, so no row is ever late.

Compaction keeps files and copies bounded. A day with more than ``MOST_PARTS``
parts is rewritten into one, and only then are the parts it was made of removed.
In between, readers see both, and the same rows: what the day holds never
changes, so a compaction that fails halfway needs no repair.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadflow.operators.audit import audit_rows
from leadflow.sources import io

KEY = ["user_id", "timestamp"]
#: Parts of a day after which it is compacted.
MOST_PARTS = 16


def survivors(rows: DataFrame) -> DataFrame:
    """One row per key: the first by page, action, parameters and expiry."""
    order = ["page_accessed", "action", F.array_sort(F.map_entries("request_params")).cast("string"), "expiry_timestamp"]
    w = Window.partitionBy("event_date", *KEY).orderBy(*[F.asc_nulls_last(c) if isinstance(c, str) else c.asc_nulls_last() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _stored(spark: SparkSession, sink_dir: str, schema: StructType, paths: list[str]) -> DataFrame:
    parts = StructType(list(schema.fields)) if "part" in schema.names else StructType(list(schema.fields)).add("part", "string")
    return spark.read.schema(parts).option("basePath", sink_dir).parquet(*paths)


def read_sink(spark: SparkSession, sink_dir: str, schema: StructType) -> DataFrame:
    """The ingested log; empty before the first batch."""
    if not io.exists(spark, sink_dir):
        return spark.createDataFrame([], schema)
    return survivors(_stored(spark, sink_dir, schema, [sink_dir]).drop("part"))


def _write_parts(rows: DataFrame, sink_dir: str, part: str) -> None:
    # about one file per day, however many tasks the rows come from
    (rows.hint("rebalance", "event_date").withColumn("part", F.lit(part)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("event_date", "part").parquet(sink_dir))


def append_batch(batch: DataFrame, batch_id: int, sink_dir: str, run: str, most_parts: int = MOST_PARTS) -> None:
    """Write the batch's rows as parts of their days; compact days that have too many."""
    spark = batch.sparkSession
    rows = survivors(batch).persist()
    try:
        # a batch is bounded by its files, and so are its days
        days = [r[0] for r in rows.select("event_date").distinct().collect()]
        _write_parts(rows, sink_dir, f"b-{run}-{batch_id:09d}")
    finally:
        rows.unpersist()
    full = [d for d in days if len(parts_of(spark, sink_dir, d)) > most_parts]
    if full:
        compact(spark, sink_dir, batch.schema, full)


def day_folder(sink_dir: str, day) -> str:
    return f"{sink_dir}/event_date={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"


def parts_of(spark: SparkSession, sink_dir: str, day) -> list[str]:
    """Names of a day's parts; lists that day's folder only."""
    return [n for n in io.children(spark, day_folder(sink_dir, day)) if n.startswith("part=")]


def compact(spark: SparkSession, sink_dir: str, schema: StructType, days: list) -> None:
    """Rewrite each of the days into one part of its surviving rows."""
    old = {d: parts_of(spark, sink_dir, d) for d in days}
    paths = [f"{day_folder(sink_dir, d)}/{p}" for d, parts in old.items() for p in parts]
    if not paths:
        return
    rows = survivors(_stored(spark, sink_dir, schema, paths).drop("part"))
    _write_parts(rows, sink_dir, f"c-{uuid.uuid4().hex[:16]}")
    for path in paths:
        io.remove(spark, path)


def audit_stream_query(spark: SparkSession, source_dir: str, schema: StructType,
                       sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 16):
    """Start the ingest with ``trigger(availableNow=True)``: process every
    file present now in bounded micro-batches, then stop."""
    events = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    rows = audit_rows(events).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    run = hashlib.md5(checkpoint_dir.encode()).hexdigest()[:12]
    return (rows.writeStream.foreachBatch(lambda b, i: append_batch(b, i, sink_dir, run))
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True)
            .start())


def run_audit_stream(spark: SparkSession, source_dir: str, schema: StructType,
                     sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 16) -> DataFrame:
    q = audit_stream_query(spark, source_dir, schema, sink_dir, checkpoint_dir, max_files_per_trigger)
    q.awaitTermination()
    events = spark.createDataFrame([], schema)
    out = audit_rows(events).withColumn("timestamp", F.col("timestamp").cast("timestamp")).schema
    return read_sink(spark, sink_dir, StructType(list(out)))
