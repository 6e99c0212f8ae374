"""Ranked lexical search: K2-treaps over term-document grids.

1. One pass counts the documents with terms, N, and all terms, L.
2. The index: documents are taken in shards of about ``SHARD`` bytes of text. A
   shard's grid has a row per term, the frequent ones first, and a column per
   document; a cell holds the term's impact on the document's score before its
   weight. The grid is written as a K2-treap (``k2treap``) beside the shard's
   doc_ids, terms and their document counts. All terms are indexed.
3. Items are taken in blocks of at most ``ITEMS`` items and ``TERMS`` terms,
   which are sent to the tasks. The terms' document counts are summed over the
   shards, which gives the weights.
4. In a shard, an item's rows descend together, best first, over ranges of
   documents. A task carries an item's best scores from shard to shard as the
   bound below which ranges are not looked at. The tasks' best are ranked at the
   end. Only the shards' best ever move; the index is read where it lies.

Terms are told apart by 64 bits of hash (``textops.chunk_hash``; of terms of up
to eight bytes no two have the same).

Defined results: null text, empty text or text without terms has no terms and
is not found; an item without terms has no rows; rows are documents, and items,
of their own, so repeated rows are ranked each; equal scores go by doc_id, null
last; a very long text is a shard of its own, read in pieces cut between terms;
other columns are not read, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm import textops as T
from leadflow.llm.common import materialize, prepare, table
from leadflow.llm.k2treap import Treap

#: Bytes of text of a shard, and of a piece that is cut into terms at once.
SHARD = 8 << 20
ITEMS, TERMS = 1024, 1 << 20
BEST = 50
#: [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]
APART = np.zeros(256, bool)
APART[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_INDEX = "docs array<long>, terms array<long>, df array<int>, grid binary"
_FOUND = "item long, item_id long, doc_id long, score long"


def pieces(buf: np.ndarray, offsets: np.ndarray, size: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, owners): texts longer than ``size`` cut between terms."""
    out, owner = [0], []
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a > size:
            cut, look = a + size, 1 << 12
            while cut < b and not APART[buf[cut]]:
                gap = np.flatnonzero(APART[buf[cut:min(b, cut + look)]])
                cut = cut + int(gap[0]) if len(gap) else min(b, cut + look)
                look *= 2
            if cut == b:
                break
            out.append(cut)
            owner.append(t)
            a = cut
        out.append(b)
        owner.append(t)
    return np.array(out, np.int64), np.array(owner, np.int64)


def term_counts(buf: np.ndarray, offsets: np.ndarray, size: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, tf) of every different term of every text, by term, then text."""
    cut, owner = pieces(buf, offsets, size)
    found = []
    for i, j in T.slices(cut, size):
        part = T.LOWER[buf[cut[i]:cut[j]]]
        starts, ends = T.words(part, cut[i:j + 1] - cut[i], APART)
        text = owner[i:j][np.repeat(np.arange(j - i), T.counts_per_text(starts, cut[i:j + 1] - cut[i]))]
        term = T.chunk_hash(part, starts, ends)
        order = np.lexsort((text, term))
        text, term = text[order], term[order]
        at = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])))) if len(term) else np.zeros(0, np.int64)
        found.append((text[at], term[at], np.diff(np.append(at, len(term)))))
    text, term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    if len(found) > 1:
        order = np.lexsort((text, term))
        text, term, tf = text[order], term[order], tf[order]
        at = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (text[1:] != text[:-1]))))
        text, term, tf = text[at], term[at], np.add.reduceat(tf, at)
    return text, term, tf


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(N, L): documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(0))
            for i, j in T.slices(offsets):
                starts, _ = T.words(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], APART)
                each = T.counts_per_text(starts, offsets[i:j + 1] - offsets[i])
                n, total = n + int((each > 0).sum()), total + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    row = docs.select(F.col("text").cast("string")).mapInArrow(T.tidy(run), "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def _shard(ids: list, texts: list[tuple[np.ndarray, np.ndarray]], n: int, total: int) -> pa.RecordBatch | None:
    buf = np.concatenate([b for b, _ in texts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in texts]))])
    col, term, tf = term_counts(buf, offsets)
    if not len(term):
        return None
    names, row = np.unique(term, return_inverse=True)
    df = np.bincount(row)
    order = np.argsort(-df, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    length = np.bincount(col, tf, len(ids)).astype(np.int64)
    m = 50 + (50 * length * n) // total
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[col])
    grid = Treap.build(place[row], col, impact, max(len(names), len(ids)))
    return pa.RecordBatch.from_arrays(
        [pa.array([ids], pa.list_(pa.int64())), pa.array([names[order].view(np.int64)], pa.list_(pa.int64())),
         pa.array([df[order].astype(np.int32)], pa.list_(pa.int32())), pa.array([grid], pa.binary())], ["docs", "terms", "df", "grid"])


def build_index(docs: DataFrame, n: int, total: int, shard: int = SHARD) -> DataFrame:
    """The stored index, a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(1))
            own = batch.column(0).to_pylist()
            for i, j in T.slices(offsets, shard):
                size = int(offsets[j] - offsets[i])
                if ids and held + size > shard:
                    made = _shard(ids, texts, n, total)
                    if made is not None:
                        yield made
                    ids, texts, held = [], [], 0
                ids += own[i:j]
                texts.append((buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                held += size
        if ids:
            made = _shard(ids, texts, n, total)
            if made is not None:
                yield made

    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(T.tidy(run), _INDEX)
    return materialize(made, "search-index")


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the different terms of every item that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(2))
            text, term, _ = term_counts(buf, offsets)
            order = np.argsort(text, kind="stable")
            upto = np.searchsorted(text[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(term[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["item", "item_id", "terms"])

    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), F.col("text").cast("string"))
    return materialize(numbered.mapInArrow(T.tidy(run), "item long, item_id long, terms array<long>").filter(F.size("terms") > 0), "search-items")


def blocks_of(items: DataFrame, most: int = ITEMS, terms: int = TERMS) -> Iterator[list[tuple[int, int, np.ndarray]]]:
    """Items in blocks that fit into a task beside a shard."""
    block: list = []
    held = 0
    for row in items.toLocalIterator():
        t = np.array(row["terms"], np.int64).view(np.uint64)
        if block and (len(block) == most or held + len(t) > terms):
            yield block
            block, held = [], 0
        block.append((row["item"], row["item_id"], t))
        held += len(t)
    if block:
        yield block


def weights_of(index: DataFrame, known: np.ndarray, n: int) -> np.ndarray:
    """The weights of the ascending terms ``known``; 0 for those of no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            term = batch.column(0).flatten().to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(known, term), len(known) - 1)
            hit = known[at] == term
            np.add.at(total, at[hit], batch.column(1).flatten().to_numpy()[hit])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["place", "df"])

    weight = np.zeros(len(known), np.int64)
    # one row per term of the block
    for r in index.select("terms", "df").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toLocalIterator():
        weight[r["place"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
    return weight


def search_block(index: DataFrame, block: list[tuple[int, int, np.ndarray]], n: int, k: int = BEST) -> DataFrame:
    """(item, item_id, doc_id, score): each task's best for the items of a block."""
    known = np.unique(np.concatenate([t for _, _, t in block]))
    weight = weights_of(index, known, n)
    asked = [np.searchsorted(known, t) for _, _, t in block]
    asked = [a[weight[a] > 0] for a in asked]
    names = [(item, item_id) for item, item_id, _ in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * len(asked)   # scores, ids, id is null
        for batch in batches:
            for s in range(batch.num_rows):
                docs = batch.column(0)[s].values
                null = docs.is_null().to_numpy(zero_copy_only=False)
                docs = docs.fill_null(0).to_numpy()
                terms = batch.column(1)[s].values.to_numpy().view(np.uint64)
                order = np.argsort(terms)
                at = np.minimum(np.searchsorted(terms, known, sorter=order), len(terms) - 1)
                row = np.where(terms[order[at]] == known, order[at], -1)
                grid = Treap.read(batch.column(3)[s].as_py())
                for q, a in enumerate(asked):
                    here = a[row[a] >= 0]
                    if not len(here):
                        continue
                    had = best[q]
                    cols, scores = grid.best_columns(row[here], weight[here], k, int(had[0][-1]) if len(had[0]) == k else 0)
                    if len(cols):
                        scores, ids, none = (np.concatenate(x) for x in zip(had, (scores, docs[cols], null[cols])))
                        top = np.lexsort((ids, none, -scores))[:k]
                        best[q] = (scores[top], ids[top], none[top])
        for (item, item_id), (scores, ids, none) in zip(names, best):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), item)), pa.array([item_id] * len(scores), pa.int64()),
                     pa.array(ids, mask=none), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(T.tidy(run), _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every item."""
    n, total = corpus_size(docs)
    found = items.sparkSession.createDataFrame([], _FOUND)
    if total:
        index = build_index(docs, n, total, shard)
        for block in blocks_of(item_terms(items)):
            found = found.union(materialize(search_block(index, block, n, k), "search-found"))
    w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def op12_k2treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = (r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")

SEARCH_SQL = f"""WITH d AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
b AS (SELECT row_number() OVER () AS b, item_id, text FROM benchmark),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, {_TERMS} AS term FROM d) GROUP BY d, term),
len AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
corpus AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM len),
weight AS (
  SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, corpus c GROUP BY term, c.n),
asked AS (SELECT DISTINCT b, {_TERMS} AS term FROM b),
m AS (SELECT d, 50 + (50 * len.n * c.n) // c.l AS m FROM len, corpus c),
score AS (
  SELECT b, d, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (d) GROUP BY b, d),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM score JOIN d USING (d) JOIN b USING (b) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {BEST}"""
