"""Global row numbers without a single-task window.

Rows are sorted by range partitions and stored with their place inside their
partition; one count per partition then gives every partition its offset. The
plan holds no window at all, and the driver sees one number per partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.session import materialize

#: ``monotonically_increasing_id`` puts the partition above this many bits.
_PLACE_BITS = 33


def with_position(df: DataFrame, *order: Column, name: str = "position", first: int = 1) -> DataFrame:
    """``df`` with every row's place (from ``first``) in ``order``, which should be
    a total order; rows that tie on all of it are placed arbitrarily.

    The sorted rows are stored before they are counted: sorting twice could
    cut the ranges differently."""
    spark = df.sparkSession
    placed = materialize(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_id", _PLACE_BITS)
    counts = {r["_part"]: r["n"] for r in placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = sorted(counts)
    starts = accumulate((counts[p] for p in parts), initial=first)
    offsets = spark.createDataFrame([(p, s) for p, s in zip(parts, starts)], "_part long, _start long")
    return (placed.withColumn("_part", part).join(offsets, "_part", "left")
            .withColumn(name, F.col("_start") + F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1))
            .select(*df.columns, name))
