"""Session settings and the shared folder used to cut lineage.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names
(HDFS / object store); we only pick our own folder when the session has
none, which is the case in local tests.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session should carry. Shuffle partitions are left to the
# caller: on a cluster size them to ~128-256 MB per partition at the target
# scale and let AQE coalesce the small ones.
BASE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # campaign_id is a partition column holding text such as 1-URGENT_1997-01-01;
    # never let partition discovery turn it into a number or a date.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # dedup keeps the last value when two request-parameter maps share a key
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # no Python call-site capture per function call (it only enriches error
    # messages and costs several JVM round trips per expression built)
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "leadflow", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the SQL settings our operators rely on for any session handed to us."""
    for k in ("spark.sql.session.timeZone",
              "spark.sql.sources.partitionColumnTypeInference.enabled",
              "spark.sql.sources.partitionOverwriteMode",
              "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(k, BASE_CONF[k])


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read: ``spark.checkpoint.dir`` if the cluster
    names one, else a fresh local folder (tests and single-node runs only)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on {master}")
        d = tempfile.mkdtemp(prefix="leadflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique location under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage at a stage boundary so that a lost executor only re-runs the
    work after this point, and so two downstream sinks do not recompute the
    same plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
