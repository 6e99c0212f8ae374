"""Approximate nearest neighbours by learned partitions.

1. On a bounded sample of the vectors (``SAMPLE`` rows with the smallest hash)
   the exact graph of nearest neighbours is built and cut into partitions of
   equal size that keep neighbours together: recursive halving along the main
   direction, then moves of vectors to the partition that holds most of their
   neighbours, as long as sizes stay within ``SLACK`` of each other.
2. A small classifier (one hidden layer) learns each sampled vector's
   distribution of its neighbours' partitions.
3. Every vector is filed under its most probable partition. A query goes to its
   most probable ones until their probabilities reach a sum, and is compared
   there, in double precision, with all their vectors. The sum is set on an
   eighth of the sample kept back from the fit: the smallest at which the probed
   partitions hold ``TARGET`` of the true neighbours. Clustered vectors need few
   partitions, vectors without structure most of them.

A query looks at as many partitions as it takes to hold k + 1 vectors, and at
all of them if it still has too few answers. Partitions are read in blocks of
about ``BLOCK`` vectors and their queries in blocks of about ``ASKED``, both dealt
by a hash of the id, so neither a large partition, nor thousands of equal
vectors, nor many queries are one task: a query's best are found per block, then
overall. Only the sample (bounded) reaches the driver; the model is sent to the
tasks.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of different lengths are not compared, each
length is searched for itself; a null id takes no part; of several vectors with
a query's id the smallest asks; rows with a query's own id are not its
candidates; repeated candidates with the same id and distance count once; ties
go to the smaller id; other columns are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm.common import materialize, prepare, table

#: Sampled vectors per partition, and the range of the partitions' number, which
#: grows with the root of the table; so 65,536 vectors are sampled at most.
PER_PARTITION = 256
PARTITIONS = (16, 256)
SAMPLE = PER_PARTITION * PARTITIONS[1]
#: Share of the true neighbours that the probed partitions hold, on sampled
#: vectors kept back from the fit.
TARGET = 0.96
NEIGHBOURS = 10
SLACK = 1.05
BLOCK = 4096
#: Queries that a task compares with a block.
ASKED = 1024
EVERY = 100


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .filter(F.exists("v", lambda x: x != 0)))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width or 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, good enough to choose candidates."""
    return np.maximum((q * q).sum(1)[:, None] - 2 * q @ x.T + (x * x).sum(1)[None, :], 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        d = distances(x[lo:lo + 1024], x)
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo:lo + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Partition number per vector; sizes differ by ``SLACK`` at most."""
    n = len(x)
    label = np.zeros(n, np.int64)
    width = 1
    while width < parts:
        for p in range(width):
            own = np.flatnonzero(label == p)
            if len(own) < 2:
                continue
            c = x[own] - x[own].mean(axis=0)
            axis = np.ones(c.shape[1])
            for _ in range(20):
                axis = c.T @ (c @ axis)
                axis /= max(np.linalg.norm(axis), 1e-30)
            order = np.argsort(c @ axis, kind="stable")
            label[own[order[len(own) // 2:]]] = p + width
        width *= 2
    most = int(np.ceil(SLACK * n / parts))
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), graph.shape[1]), label[graph].reshape(-1)), 1)
        np.add.at(votes, (graph.reshape(-1), np.repeat(label, graph.shape[1])), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable")[:int((gain > 0).sum())]:
            if size[best[i]] < most:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """Probabilities of partitions: one hidden layer and a softmax."""
    centre: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def probed(self, x: np.ndarray, held: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """Per vector the partitions to look at, the most probable first; as many
        more as it takes for them to hold ``least`` vectors, partition p ``held[p]``."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        upto = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        many = (upto < self.mass).sum(axis=1) + 1
        if held is not None:
            many = np.maximum(many, (np.cumsum(held[order], axis=1) < least).sum(axis=1) + 1)
        return [o[:m].astype(np.int32) for o, m in zip(order, np.minimum(many, p.shape[1]))]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 60, seed: int = 7) -> Router:
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(axis=0), float(max(x.std(), 1e-12))
    d, p = x.shape[1], target.shape[1]
    params = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, p)), np.zeros(p)]
    m1 = [np.zeros_like(w) for w in params]
    m2 = [np.zeros_like(w) for w in params]
    z = (x - centre) / scale
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 256):
            rows = order[lo:lo + 256]
            a, t = z[rows], target[rows]
            pre = a @ params[0] + params[1]
            h = np.maximum(pre, 0)
            o = h @ params[2] + params[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            e = (o / o.sum(axis=1, keepdims=True) - t) / len(rows)
            back = (e @ params[2].T) * (pre > 0)
            step += 1
            for k, g in enumerate((a.T @ back, back.sum(axis=0), h.T @ e, e.sum(axis=0))):
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                params[k] -= 0.003 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return Router(centre, scale, *params)


def partitions_for(rows: int) -> int:
    """A power of two near a sixteenth of the root of the table."""
    parts = PARTITIONS[0]
    while parts < PARTITIONS[1] and 16 * parts < rows ** 0.5:
        parts *= 2
    return parts


def fit_router(vectors: DataFrame, parts: int = PARTITIONS[0], sample: int = PER_PARTITION * PARTITIONS[0]) -> Router | None:
    """The learned part, on at most ``sample`` vectors; None without vectors."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    if not some.num_rows:
        return None
    width = len(some["v"][0])
    x = np.array([r for r in some["v"].to_pylist() if len(r) == width])
    # copies of one vector say nothing about the others
    x = np.unique(x, axis=0)
    x = x[np.random.default_rng(11).permutation(len(x))]
    kept, x = x[:len(x) // 8], x[len(x) // 8:]
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return Router(x[0], 1.0, np.zeros((width, 1)), np.zeros(1), np.zeros((1, parts)), np.zeros(parts))
    graph = neighbour_graph(x, k)
    label = balanced_partition(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), k), label[graph].reshape(-1)), 1 / (k + 1))
    target[np.arange(len(x)), label] += 1 / (k + 1)
    router = train_router(x, target)
    if len(kept):
        filed = router.probabilities(x).argmax(axis=1)
        p = router.probabilities(kept)
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        ahead = np.empty_like(before)
        np.put_along_axis(ahead, order, before, axis=1)
        near = np.argpartition(distances(kept, x), k - 1, axis=1)[:, :k]
        # a neighbour is found if the probabilities ahead of its partition stay under the sum
        need = np.sort(np.take_along_axis(ahead, filed[near], axis=1).reshape(-1))
        router.mass = float(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1e-12
    return router


def search(vectors: DataFrame, every: int = EVERY, k: int = NEIGHBOURS,
           parts: int | None = None, sample: int | None = None) -> DataFrame:
    """The k nearest vectors found for every vector whose id is divisible by ``every``."""
    stored = materialize(usable(vectors).dropDuplicates(["vec_id", "v"]), "neighbour-vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in stored.groupBy(F.size("v").alias("width")).count().orderBy("width").collect():    # in most tables one
        n = parts or partitions_for(row["count"])
        out = out.union(_search(stored.filter(F.size("v") == row["width"]), every, k, n, sample or PER_PARTITION * n))
    return out


def _search(fitting: DataFrame, every: int, k: int, parts: int, sample: int) -> DataFrame:
    """``search`` among vectors of one length."""
    router = fit_router(fitting, parts, sample)
    width = len(router.centre)

    def file(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1), width)
                top = router.probed(x, held, k + 1) if asks else list(router.probabilities(x).argmax(axis=1)[:, None].astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(top, pa.list_(pa.int32()))],
                                                 ["vec_id", "v", "parts"])
        return run

    filed = "vec_id long, v array<double>, parts array<int>"
    index = materialize(fitting.mapInArrow(file(False), filed).select("vec_id", "v", F.col("parts")[0].alias("part")), "neighbour-index")
    # one row per partition
    sizes = index.groupBy("part").agg(F.count("*").alias("n"), F.approx_count_distinct("vec_id").alias("ids")).collect()
    held = np.zeros(parts, np.int64)
    for r in sizes:
        held[r["part"]] = r["ids"] * 9 // 10        # the count of ids is near, not exact

    def per_part(values: dict[int, int]) -> F.Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("part")), F.lit(1)) if values else F.lit(1)

    blocks = per_part({r["part"]: -(-r["n"] // BLOCK) for r in sizes}).cast("int")
    # of several vectors with a query's id the smallest asks
    queries = fitting.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    schema = "query_id long, vec_id long, score double"

    def compare(t: pa.Table) -> pa.Table:
        ask = t["asks"].to_numpy()
        ids, x = t["vec_id"].to_numpy(), matrix(t["v"], width)
        qi, q, ci, c = ids[ask], x[ask], ids[~ask], x[~ask]
        out: list[tuple[int, int, float]] = []
        for lo in range(0, len(qi), 256):
            if not len(ci):
                break
            d = distances(q[lo:lo + 256], c)
            for r in range(len(d)):
                one = np.where(ci == qi[lo + r], np.inf, d[r])
                if len(one) > k:
                    # all within rounding of the k-th, so ties are settled exactly
                    bound = np.partition(one, k - 1)[k - 1]
                    near = np.flatnonzero(one <= bound + 1e-9 * (1 + bound))
                else:
                    near = np.flatnonzero(np.isfinite(one))
                near = near[np.isfinite(one[near])]
                exact = np.sqrt(((c[near] - q[lo + r]) ** 2).sum(axis=1))
                best = np.lexsort((ci[near], exact))[:k]
                out += [(int(qi[lo + r]), int(ci[near[b]]), float(exact[b])) for b in best]
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()),
                         "score": pa.array([o[2] for o in out], pa.float64())})

    def answers(asked: DataFrame) -> DataFrame:
        """The k best of rows (vec_id, v, part): queries with a partition to look at.
        A partition's queries are cut into blocks like its vectors, and a block of
        one meets a block of the other."""
        asked = materialize(asked, "neighbour-asked")
        turns = per_part({r["part"]: -(-r["count"] // ASKED) for r in asked.groupBy("part").count().collect()}).cast("int")
        block = F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block")
        turn = F.pmod(F.xxhash64("vec_id", F.lit("turn")), turns).cast("int").alias("turn")
        candidates = index.select(F.lit(False).alias("asks"), "part", block, F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), "vec_id", "v")
        asking = asked.select(F.lit(True).alias("asks"), "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), turn, "vec_id", "v")
        found = (candidates.union(asking).groupBy("part", "block", "turn").applyInArrow(compare, schema)
                 .dropDuplicates(["query_id", "vec_id", "score"]))
        w = W.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return materialize(ranked.select("query_id", "rank", "vec_id", "score"), "neighbour-found")

    first = answers(queries.mapInArrow(file(True), filed).select("vec_id", "v", F.explode("parts").alias("part")))
    full = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = queries.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return first
    # copies of an id can leave a query short of candidates: it looks at all partitions
    every_part = F.array(*[F.lit(r["part"]) for r in sizes])
    rest = answers(short.select("vec_id", "v", F.explode(every_part).alias("part")))
    return first.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").union(rest)


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(prepare(spark), sf_dir, "embeddings"))
