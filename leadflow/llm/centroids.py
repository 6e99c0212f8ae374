"""Centroid clustering with an incremental distance matrix, all in integers.

Every vector keeps its exact dot products with all centroids. After a round,
each centroid differs from the last one in some components only; a vector's
product with it changes by those components times their changes, so nothing is
computed afresh. With the vector's squared length x.x and the centroid's c.c,

    |x - c|^2 = x.x - 2 x.c + c.c

is exact, and the nearest centroid is the first of the smallest. The state
(vector, products, cluster) is written after each round, so a lost executor
repeats no earlier round, and is read by one pass per round: no shuffle but the
clusters' component sums, one row per task, cluster and component chunk.

The driver holds the centroids only (``CLUSTERS`` x 64 integers).

Defined results: a vector takes part if it has exactly ``WIDTH`` components,
none null or non-finite, and all below ``LIMIT`` in magnitude once scaled
(beyond it, squared distances would not fit a long); others have no row. Equal
vectors get equal results; rows with the same vec_id are vectors of their own;
seeds are ordered by hash, then components, a null vec_id last; with fewer
vectors than ``CLUSTERS`` there are fewer centroids; an empty cluster keeps its
centroid and ties go to the smaller number; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import materialize, prepare, table
from leadflow.llm.textops import tidy

WIDTH, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: 64 * (2 * LIMIT)**2 stays below 2**63.
LIMIT = 1 << 27
_STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): the vectors that take part, as integers."""
    v = F.col(embedding).cast("array<double>")
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("_v"))
            .filter((F.size("_v") == WIDTH) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE >= LIMIT)))
            .select("vec_id", F.transform("_v", lambda x: F.floor(x * SCALE).cast("int")).alias("x")))


def seeds(ints: DataFrame, count: int = CLUSTERS) -> np.ndarray:
    """The first centroids: the vectors with the smallest hashes of their ids."""
    first = (ints.withColumn("_h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
             .orderBy(F.asc_nulls_last("_h"), "x").limit(count).select("x").collect())
    return np.array([r["x"] for r in first], np.int64).reshape(-1, WIDTH)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.int64)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, w = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(x.reshape(-1), kind))


def assigned(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """The state after the centroids went from ``old`` to ``new``."""
    change = new - old
    moved = [np.flatnonzero(c) for c in change]
    length = (new * new).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, dots = _matrix(batch.column(1)), _matrix(batch.column(2))
            for k, at in enumerate(moved):
                if len(at):
                    dots[:, k] += x[:, at] @ change[k, at]
            far = (x * x).sum(axis=1)[:, None] - 2 * dots + length[None, :]
            best = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(dots, pa.int64()), pa.array(best, pa.int32()),
                 pa.array(far[np.arange(len(far)), best])], [c.split()[0] for c in _STATE.split(", ")])

    return state.select("vec_id", "x", "dots").mapInArrow(tidy(run), _STATE)


def moved_centroids(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes the floored mean of its vectors."""
    count = len(old)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = np.zeros(count, np.int64), np.zeros((count, WIDTH), np.int64)
        for batch in batches:
            if batch.num_rows:
                c = batch.column(1).to_numpy()
                size += np.bincount(c, minlength=count)
                np.add.at(total, c, _matrix(batch.column(0)))
        used = np.flatnonzero(size)
        if len(used):
            place = np.tile(np.arange(WIDTH + 1, dtype=np.int32), len(used))
            sums = np.concatenate([size[used][:, None], total[used]], axis=1).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, WIDTH + 1), pa.int32()), pa.array(place), pa.array(sums)],
                                             ["cluster", "place", "total"])

    # at most CLUSTERS x (WIDTH + 1) rows; decimals cannot overflow
    sums = (state.select("x", "cluster").mapInArrow(run, "cluster int, place int, total long")
            .groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    by = {(r["cluster"], r["place"]): int(r["total"]) for r in sums}
    new = old.copy()
    for k in range(count):
        if by.get((k, 0)):
            new[k] = [by[k, p + 1] // by[k, 0] for p in range(WIDTH)]
    return new


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    ints = scaled(vectors)
    centroids = seeds(ints, clusters)
    if not len(centroids):
        return ints.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    state = ints.withColumn("dots", F.array_repeat(F.lit(0).cast("long"), len(centroids)))
    before = np.zeros_like(centroids)
    for _ in range(rounds):
        state = materialize(assigned(state, before, centroids), "centroid-state")
        before, centroids = centroids, moved_centroids(state, centroids)
    state = materialize(assigned(state, before, centroids), "centroid-state")
    # one row per cluster
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def of_cluster(values: list) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)

    return state.select("vec_id", "cluster", "distance",
                        of_cluster([inertia.get(k, 0) for k in range(len(centroids))]).cast("long").alias("cluster_inertia"),
                        F.lit(sum(inertia.values())).cast("long").alias("inertia"), of_cluster(digest).alias("centroid_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(prepare(spark), sf_dir, "embeddings"))


def _rounds_sql() -> str:
    """The rounds as common table expressions: a_r assigns, c_r are the centroids."""
    nearest = """a{r} AS (
  SELECT id, vec_id, x, cluster, distance FROM (
    SELECT v.id, v.vec_id, v.x, c.k AS cluster,
           list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.x, c.x)])::BIGINT AS distance
    FROM kept v, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)"""
    moved = """c{n} AS (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(floor_mean ORDER BY p) AS x FROM (
      SELECT cluster, p, (sum(y) - (sum(y) % count(*) + count(*)) % count(*))::BIGINT // count(*) AS floor_mean
      FROM (SELECT cluster, unnest(x) AS y, generate_subscripts(x, 1) AS p FROM a{r}) GROUP BY cluster, p)
    GROUP BY cluster) m ON m.cluster = c.k)"""
    parts = []
    for r in range(ROUNDS):
        parts += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    return ",\n".join([*parts, nearest.format(r=ROUNDS)])


CENTROID_SQL = f"""WITH kept AS (
  SELECT row_number() OVER () AS id, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS x
  FROM embeddings
  WHERE len(embedding) = {WIDTH} AND list_count(embedding) = {WIDTH} AND len([x FOR x IN embedding IF isfinite(x)]) = {WIDTH}),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS k, x FROM kept QUALIFY k < {CLUSTERS}),
{_rounds_sql()},
sums AS (SELECT cluster, sum(distance)::BIGINT AS s FROM a{ROUNDS} GROUP BY cluster)
SELECT a.vec_id, a.cluster::INTEGER AS cluster, a.distance, s.s AS cluster_inertia,
       (SELECT sum(s)::BIGINT FROM sums) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN sums s USING (cluster) JOIN c{ROUNDS} c ON c.k = a.cluster"""
