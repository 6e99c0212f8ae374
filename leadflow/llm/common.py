"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadflow.session import scratch_path as _scratch_path

__all__ = ["materialize", "scratch_path", "prepare", "table", "prefix_sums", "salts", "free_name", "Scratch", "release"]

#: Rows per Arrow batch handed to Python: whole texts can be long, so batches
#: are kept small enough that a batch of long texts still fits in memory.
ARROW_ROWS = 512


class Scratch:
    """The tables that the operators of one job store on their way, so that the job
    can remove them once its own result is stored.

        scratch = Scratch()
        with scratch:
            out = operator(...)
        out.write.parquet(path)
        scratch.remove(spark)
    """

    _open: list["Scratch"] = []

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> "Scratch":
        Scratch._open.append(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.remove(self)

    def remove(self, spark: SparkSession, keep: DataFrame | None = None) -> None:
        """Remove the tables, but for those that ``keep`` is still read from."""
        if not self.paths:
            return
        read = keep.inputFiles() if keep is not None else []
        left = []
        for path in self.paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
            inside = fs.makeQualified(where).toUri().getPath() + "/"
            if any(inside in f for f in read):
                left.append(path)
            else:
                fs.delete(where, True)
        self.paths = left


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new location under the shared folder; see ``Scratch``."""
    path = _scratch_path(spark, name)
    for scratch in Scratch._open:
        scratch.paths.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the shared folder and read back, so that its lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Frees the shuffle files of frames that are not used any more. Spark deletes them
    once the driver's garbage collector finds their plans, which may take half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, whatever session they are given."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def salts(rows: int) -> int:
    """Number of buckets that bounds both the rows of a bucket and the number
    of buckets of a key by about the square root of the table."""
    return max(1, math.isqrt(max(0, rows)))


def prefix_sums(df: DataFrame, key: str, bucket: str, order: list[Column],
                sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums of ``sums`` per ``key`` in the order of
    (``bucket``, ``order``), without ever sorting one key in one task.

    Rows are windowed per (key, bucket); the buckets' totals are windowed per
    key, and both sides meet on (key, bucket), the partitioning the first
    window already has. A null key is a key of its own.
    """
    w = W.partitionBy(key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_l_{n}")
                             for n, c in sums.items()])
    wk = W.partitionBy("_key").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = (df.groupBy(F.col(key).alias("_key"), F.col(bucket).alias("_bucket"))
              .agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
              .select("_key", "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(wk), F.lit(0))
                                           .alias(f"_o_{n}") for n in sums]))
    joined = local.join(totals, F.col(key).eqNullSafe(F.col("_key"))
                        & (F.col(bucket) == F.col("_bucket")))
    return joined.select(*df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n)
                                        for n in sums])
