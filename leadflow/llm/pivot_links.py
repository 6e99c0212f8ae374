"""Near-duplicate vectors: a pivot-permutation index.

1. Equal vectors are one class. Reference points (pivots) are classes from a
   bounded sample, none within the threshold of another, so that a crowd of
   near copies holds one of them and not a third.
2. A class is described by its ``LIST`` nearest pivots, nearest first. Two
   vectors are candidates if they share ``SHARED`` of them. At cosine 0.9 in 64
   dimensions of noise, the worst case, 99.9 % of the pairs do (README).
3. Inverted lists: a class is filed under its pivots (or, so that lists stay
   near ``LONG`` at any size of the table, under its pairs or triples of them).
   Any two candidates meet in several lists, and the list of their lowest common
   pivots owns them; as ``SHARED`` are common, a class need not be filed under
   its highest ones. Every choice of the width yields the same candidates.
4. A list is cut into blocks of ``BLOCK`` classes and a task compares two blocks.
   It counts shared pivots as a product of incidence matrices, verifies the owned
   candidates by cosine in double precision, and hands back each class's number of
   links and just enough links to join what is linked. So pairs never leave a
   task, however large a crowd, and none is dropped.
5. Links give components by repeated joins.

Only the sample (``PIVOTS`` x ``SPARE`` classes at most) reaches the driver, and
only pivots are sent to the tasks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are kept; vectors of different lengths never
link (pivots of all but the most frequent length are seeded random directions);
rows are vectors of their own, so a repeated row links with its copies; a row
with a null id counts as a link but names no component: alone, its component is
null and it is kept; other columns are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, fsum, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm.common import materialize, prepare, table
from leadflow.llm.components import connected_components

COSINE = 0.9
#: Most pivots; as many classes as this times SPARE are sampled for them.
PIVOTS, SPARE = 4096, 4
#: Pivots that describe a vector, and how many a candidate shares.
LIST, SHARED = 16, 3
#: Mean length of a list above which classes are filed under more pivots at once.
LONG = 8192
#: Classes of a list that a task reads on either side.
BLOCK = 1024


def usable(v) -> F.Column:
    """Whether a vector can have a direction."""
    return F.coalesce(v.isNotNull() & (F.size(v) > 0)
                      & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    return [column[k].values.to_numpy(zero_copy_only=False) for k in range(len(column))]


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest component is scaled to 1 first, so nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int, cosine: float = COSINE) -> np.ndarray:
    """Rows of ``sample``, in order, each unlike those before it; then, if these
    are too few to describe a vector, some of the others."""
    nearest = np.full(len(sample), -2.0)
    taken = []
    for i in range(len(sample)):
        if nearest[i] < cosine:
            taken.append(i)
            if len(taken) == most:
                break
            nearest = np.maximum(nearest, sample @ sample[i])
    rest = np.setdiff1d(np.arange(len(sample)), taken)
    return sample[taken + rest[:max(0, min(LIST, most) - len(taken))].tolist()]


def pivots_for(width: int, known: np.ndarray) -> np.ndarray:
    if width == known.shape[1]:
        return known
    some = np.random.default_rng(width).normal(size=(max(LIST, len(known)), width))
    return directions(some)


def described(classes: DataFrame, known: np.ndarray) -> DataFrame:
    """(id, copies, z, pivots): unit vectors and their nearest pivots, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = rows_of(batch.column(2))
            widths = np.array([len(v) for v in vectors])
            for w in np.unique(widths).tolist():
                own = np.flatnonzero(widths == w)
                z = directions(np.array([vectors[k] for k in own]))
                if w not in made:
                    made[w] = pivots_for(w, known)
                near = z @ made[w].T
                m = min(LIST, near.shape[1])
                part = np.argpartition(-near, m - 1, axis=1)[:, :m]
                order = np.lexsort((part, -np.take_along_axis(near, part, axis=1)), axis=1)
                top = np.take_along_axis(part, order, axis=1).astype(np.int32)
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at),
                     pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * w, z.reshape(-1)),
                     pa.ListArray.from_arrays(np.arange(len(own) + 1, dtype=np.int32) * m, top.reshape(-1))],
                    ["id", "copies", "z", "pivots"])

    return classes.mapInArrow(run, "id long, copies long, z array<double>, pivots array<int>")


def filed(index: DataFrame, wide: int, shared: int) -> DataFrame:
    """The inverted lists: (width, list, id), a list named by its ``wide`` pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, widths, pivots = batch.column(0).to_numpy(), batch.column(1).to_numpy(), rows_of(batch.column(2))
            many = np.array([len(p) for p in pivots])
            for m in np.unique(many).tolist():
                own = np.flatnonzero(many == m)
                low = np.sort(np.array([pivots[k] for k in own]), axis=1)[:, :m - shared + wide].astype(np.int64)
                names = low[:, np.array(list(combinations(range(low.shape[1]), wide)), np.int64).reshape(-1, wide)]
                name = names[:, :, 0]
                for c in range(1, wide):
                    name = (name << 13) | names[:, :, c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(widths[own], name.shape[1]).astype(np.int32)), pa.array(name.reshape(-1)),
                     pa.array(np.repeat(ids[own], name.shape[1]))], ["width", "list", "id"])

    return (index.select("id", F.size("z").alias("width"), "pivots")
            .mapInArrow(run, "width int, list long, id long"))


def _last(name: int, wide: int) -> int:
    return name & ((1 << 13) - 1) if wide > 1 else name


def compare_blocks(zl, zr, pl, pr, same: bool, last: int, wide: int, shared: int, cosine: float) -> np.ndarray:
    """Which of left x right are linked candidates that this list owns."""
    cols, inverse = np.unique(np.concatenate([pl, pr]), return_inverse=True)
    there = np.zeros((len(pl) + len(pr), len(cols)), np.float32)
    np.put_along_axis(there, inverse.reshape(there.shape[0], -1), 1, axis=1)
    left, right = there[:len(pl)], there[len(pl):]
    low = cols <= last
    owned = left[:, low] @ right[:, low].T == wide
    owned &= left @ right.T >= shared
    if same:
        owned &= np.triu(np.ones(owned.shape, bool), 1)
    if not owned.any():
        return owned
    cos = zl @ zr.T
    ok = owned & (cos >= cosine)
    for x, y in zip(*np.nonzero(owned & (np.abs(cos - cosine) < 1e-12))):
        ok[x, y] = fsum((zl[x] * zr[y]).tolist()) >= cosine
    return ok


def _spanning(n: int, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of the pairs that join something not yet joined."""
    root = np.arange(n)

    def top(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        p, q = top(i), top(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append(k)
    return out


def links(index: DataFrame, wide: int, shared: int, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Rows (id, n, null): ``id`` has n more links; rows (id, 0, other): a link."""
    lists = materialize(filed(index, wide, shared), "pivot-lists")
    sizes = (lists.groupBy("width", "list").agg(F.count("*").alias("_n")).filter("_n > 1")
             .select("width", "list", F.ceil(F.col("_n") / block).cast("int").alias("blocks")))
    placed = (lists.join(sizes, ["width", "list"])
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .select("width", "list", "block", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other"))
              .select("width", "list", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "id"))
    rows = placed.join(index, "id")

    def compare(t: pa.Table) -> pa.Table:
        ids, copies, at = (t[c].to_numpy() for c in ("id", "copies", "block"))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        z, p = (np.array(rows_of(t[c].combine_chunks())) for c in ("z", "pivots"))
        left = np.flatnonzero(at == i)
        right = left if i == j else np.flatnonzero(at == j)
        ok = compare_blocks(z[left], z[right], p[left], p[right], i == j, _last(t["list"][0].as_py(), wide), wide, shared, cosine)
        x, y = np.nonzero(ok)
        x, y = left[x], right[y]
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, x, copies[y])
        np.add.at(n, y, copies[x])
        some = np.flatnonzero(n)
        joins = _spanning(len(ids), x, y)
        return pa.table({"id": pa.array(np.concatenate([ids[some], ids[x[joins]]])),
                         "n": pa.array(np.concatenate([n[some], np.zeros(len(joins), np.int64)])),
                         "other": pa.array([None] * len(some) + ids[y[joins]].tolist(), pa.int64())})

    return rows.groupBy("width", "list", "i", "j").applyInArrow(compare, "id long, n long, other long")


def width_of_lists(classes: int, pivots: int, shared: int) -> int:
    """Pivots per list, so that the mean list stays near ``LONG``."""
    m = min(LIST, pivots)
    for wide in range(1, shared):
        if classes * comb(m - shared + wide, wide) <= LONG * comb(pivots, wide):
            return wide
    return shared


def link_report(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding",
                wide: int | None = None, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``."""
    rows = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("_v"))
            .withColumn("_v", F.when(usable(F.col("_v")), F.col("_v"))))
    # a class is told by its smallest vec_id, which may be shared (repeated ids) or null, so it gets a number of its own
    classes = materialize(rows.filter("_v IS NOT NULL").groupBy("_v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                          .withColumn("id", F.monotonically_increasing_id()), "pivot-classes")
    n = classes.count()
    width = classes.groupBy(F.size("_v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is not None:
        most = min(PIVOTS, max(128, 4 * isqrt(n)))
        sample = (classes.filter(F.size("_v") == width["w"]).orderBy(F.xxhash64("_v"), "rep").limit(most * SPARE).select("_v").toArrow())
        known = choose_pivots(directions(np.array(rows_of(sample["_v"].combine_chunks()))), most, cosine)
        shared = min(SHARED, len(known))
        index = materialize(described(classes.select("id", "copies", "_v"), known), "pivot-index")
        found = materialize(links(index, wide or width_of_lists(n, len(known), shared), shared, cosine, block), "pivot-links")
        counts = found.groupBy("id").agg(F.sum("n").alias("n"))
        joined = connected_components(found.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
        named = (classes.select("id", "_v", "rep", "copies").join(counts, "id", "left").join(joined, "id", "left")
                 .withColumn("comp", F.coalesce("comp", "id")))
        first = named.groupBy("comp").agg(F.min("rep").alias("component"))
        done = named.join(first, "comp").select(F.col("_v").alias("_w"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component")
    else:
        done = classes.select(F.col("_v").alias("_w"), F.col("copies").alias("n"), F.col("rep").alias("component"))
    out = rows.join(done, F.col("_v") == F.col("_w"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op11_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_report(table(prepare(spark), sf_dir, "embeddings"))
