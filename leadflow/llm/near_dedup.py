"""Near-duplicate documents: one-permutation MinHash with optimal densification,
banded buckets, star-shaped candidate edges, links confirmed on full sets.

1. Every text's distinct 5-word shingles are hashed once. The hash's upper bits
   choose one of ``BINS`` bins, whose minimum is the signature's entry; an empty
   bin copies the bin that a fixed sequence of hash probes finds first, the same
   for all texts. ``ROWS`` entries make a band. With 42 bands of 6 rows, two
   sets of similarity 0.85 miss each other in every band with probability 2e-9.
2. Texts with the same set are one class, stood for by its smallest doc_id.
3. In each bucket, the centre is its smallest id. A first round confirms one edge
   per id, to its smallest centre, on the full sets; links give components. A
   second round confirms the edges to centres in other components. So edges grow
   with the members of buckets, not their square, and most are never looked at.
4. Only connectivity matters, and two texts that are linked share a bucket. A
   bucket whose members lie in one component is settled. In the others, members
   are dealt to blocks of about ``BLOCK`` shingles and blocks are compared with
   each other. A task holds two blocks; it counts the shared shingles of all its
   pairs at once and hands back only the links that join components. So no link
   inside a bucket is lost, no candidate list grows with the square of a group,
   nothing is capped.

Defined results: null or empty text (or white space only) has no shingles, is
linked with nothing and kept; a null doc_id has no component and is kept; rows
with the same doc_id are one node; other columns are not read, whatever their
names; an empty table gives no rows. ``keep_one`` goes by rows instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm import textops as T
from leadflow.llm.common import free_name, materialize, prepare, table
from leadflow.llm.components import connected_components
from leadflow.llm.shingles import shingle_sets

BINS, ROWS, BANDS = 256, 6, 42
PERCENT = 85
#: Shingles of a block of an unsettled bucket, and columns of a task's grid.
BLOCK = 1 << 16
COLUMNS = 4096
_SHIFT = np.uint64(64 - 8)
_MIX = np.uint64(0xA0761D6478BD642F)


def _probes(attempt: int) -> np.ndarray:
    """The bin that each bin looks at in this attempt."""
    with np.errstate(over="ignore"):
        x = np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt) * _MIX
    return (T.mix(x) >> _SHIFT).astype(np.int64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One key per band for every non-empty set, as signed 64-bit numbers."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, u in enumerate(sets):
        bins = (u >> _SHIFT).astype(np.int64)
        first = np.concatenate(([True], bins[1:] != bins[:-1]))
        sig[i, bins[first]] = u[first]
        full[i, bins[first]] = True
    own, done = full.copy(), full.copy()
    attempt = 0
    while not done.all():
        rows = np.flatnonzero(~done.all(axis=1))
        attempt += 1
        look = _probes(attempt)
        hit = ~done[rows] & own[rows][:, look]
        r, b = np.nonzero(hit)
        sig[rows[r], b] = sig[rows[r], look[b]]
        done[rows[r], b] = True
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(sets), BANDS)).copy()
    for k in range(ROWS):
        key = T.mix(key * _MIX + sig[:, k:ROWS * BANDS:ROWS])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set (h1, h2) and its bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(1))
            for i, j in T.slices(offsets):
                sets = list(shingle_sets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                size = np.array([len(s) for s in sets], np.int64)
                names = np.array([(xxhash.xxh3_64_intdigest(s, 1), xxhash.xxh3_64_intdigest(s, 2))
                                  for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
                some = np.flatnonzero(size)
                keys = band_keys([sets[k] for k in some])
                upto = np.zeros(len(sets) + 1, np.int32)
                np.cumsum(np.where(size > 0, BANDS, 0), out=upto[1:])
                bands = pa.ListArray.from_arrays(pa.array(upto), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size),
                     pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), bands],
                    ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(T.tidy(run), "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"))


def full_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): the distinct shingle hashes of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(1))
            for i, j in T.slices(offsets, 2 << 20):
                sets = list(shingle_sets(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                upto = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=upto[1:])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(upto), pa.array(flat))],
                    ["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")) \
        .mapInArrow(T.tidy(run), "id long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    sa = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(sb, "b").join(sa, "a")
            .filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each left set shares with each right set, a slice of the
    common elements at a time."""
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))

    def cells(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
        hit = common[at] == flat if len(common) else np.zeros(len(flat), bool)
        column, row = at[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(column, kind="stable")
        return column[order], row[order]

    (lc, lr), (rc, rr) = cells(left), cells(right)
    out = np.zeros((len(left), len(right)), np.float64)
    for lo in range(0, len(common), COLUMNS):
        grids = []
        for c, r, n in ((lc, lr, len(left)), (rc, rr, len(right))):
            i, j = np.searchsorted(c, [lo, lo + COLUMNS])
            grid = np.zeros((n, min(COLUMNS, len(common) - lo)), np.float32)
            grid[r[i:j], c[i:j] - lo] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out.astype(np.int64)


def _joining_links(comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (x, y) of places, x of side 0 and y of side 1, that link different
    components; no more than it takes to join those that can be joined."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    shared = _shared_counts([sets[k] for k in left], [sets[k] for k in right])
    size = np.array([len(s) for s in sets])
    union = size[left][:, None] + size[right][None, :] - shared
    x, y = np.nonzero((100 * shared >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    out = []
    for i, j in zip(left[x].tolist(), right[y].tolist()):
        p, q = top(int(comp[i])), top(int(comp[j]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, n, comp, centre, centre_comp, members, shingle_sum) of the buckets
    whose members lie in different components."""
    laid = buckets.join(labels, "id")
    per = laid.groupBy("key").agg(
        F.min(F.struct("id", "comp")).alias("_c"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"),
        F.count("*").alias("members"), F.sum("n").alias("shingle_sum")).filter("_lo < _hi")
    return laid.join(per, "key").select("key", "id", "n", "comp", F.col("_c.id").alias("centre"), F.col("_c.comp").alias("centre_comp"),
                                        "members", "shingle_sum")


def links_between(open_: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between components inside the rows of ``unsettled``."""
    blocks = F.ceil(F.col("shingle_sum") / block).cast("int")
    placed = (open_.filter("members > 2")        # the only pair of two has been compared
              .withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
              .select("key", "id", "comp", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
              .select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "id", "comp"))
    # a pair of blocks that lies in one component has nothing to join
    some = placed.groupBy("key", "i", "j").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo < _hi").drop("_lo", "_hi")
    rows = placed.join(some, ["key", "i", "j"]).join(sets, "id").select("key", "i", "j", "block", "id", "comp", "shingles")

    def compare(t: pa.Table) -> pa.Table:
        ids, comp, at = (t[c].to_numpy() for c in ("id", "comp", "block"))
        column = t["shingles"].combine_chunks()
        sets = [column[k].values.to_numpy() for k in range(len(column))]
        places = np.concatenate([np.flatnonzero(at == t[c][0].as_py()) for c in ("i", "j")])
        side = np.repeat([0, 1], [(at == t[c][0].as_py()).sum() for c in ("i", "j")])
        if not 0 < side.sum() < len(side):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        found = np.array(_joining_links(comp[places], side, [sets[k] for k in places], percent), np.int64).reshape(-1, 2)
        a, b = ids[places[found[:, 0]]], ids[places[found[:, 1]]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _labelled(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) of all ``ids``; those without links are alone."""
    return materialize(ids.join(connected_components(links), "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "near-labels")


def near_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    signed = materialize(signatures(docs), "near-signatures")
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = (known.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
            .select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key")))
    # buckets of two different ids or more; centre: the smallest
    shared = (reps.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("_last"))
              .filter("centre < _last"))
    buckets = materialize(reps.join(shared.drop("_last"), "key"), "near-buckets")
    ids = materialize(buckets.select("id").distinct(), "near-members")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialize(full_sets(texts.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")), "near-sets")
    first = buckets.filter("id > centre").groupBy(F.col("id").alias("b")).agg(F.min("centre").alias("a"))
    links = materialize(confirmed(first.select("a", "b"), sets, percent), "near-links")
    labels = _labelled(ids, links)
    open_ = unsettled(buckets.drop("centre"), labels)
    second = (open_.filter("comp <> centre_comp").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
              .join(first, ["a", "b"], "left_anti"))
    links = materialize(links.union(confirmed(second, sets, percent)), "near-links")
    labels = _labelled(ids, links)
    more = materialize(links_between(unsettled(buckets.drop("centre"), labels), sets, percent), "near-links")
    if not more.isEmpty():
        labels = _labelled(ids, links.union(more))

    named = classes.join(labels, classes["rep"] == labels["id"], "left") \
        .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("comp", "rep").alias("_comp"))
    out = signed.drop("bands").join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
                                    & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("_comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with exactly one row of each near-duplicate group: the smallest
    doc_id (null last), then the first row. Rows are told apart by an id of
    their own, so repeated rows and null ids are members like any other."""
    keep, row = docs.columns, free_name(docs, "_near_row")
    docs = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "near-docs")
    found = near_classes(docs.select(F.col(row).alias("doc_id"), "text"), percent)
    ids = docs.select(F.col(row).alias("_own"), F.col("doc_id").cast("long").alias("_id"))
    stay = (found.select(F.col("doc_id").alias("_row"), "component_id").join(ids, F.col("_row") == F.col("_own"))
            .groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first"))
            .select(F.col("first._row").alias("_stay")))
    return docs.join(stay, docs[row] == stay["_stay"], "left_semi").select(*keep)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(prepare(spark), sf_dir, "documents"))
