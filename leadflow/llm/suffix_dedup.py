"""Removal of repeated byte strings by suffix arrays of content shards.

Every byte covered by a ``WIDTH``-byte string that also starts anywhere else,
in any document, goes. Equal strings must meet in one shard, whichever
documents they come from:

1. A string's *gram* is the smallest hash among its ``GRAM``-byte parts, a
   function of its bytes alone. Strings that start next to each other mostly
   share it, so a text is a sequence of runs, one gram each. A gram that occurs
   once in the corpus cannot belong to a repeated string: only runs of the
   others go on, cut out as segments.
2. Segments are dealt to shards by gram, each different one once. One that has
   copies repeats as a whole; it stands in the shard for the others to meet.
3. A shard's suffix array is induced and its permuted common prefixes computed
   (``suffixes``). A string repeats if it shares ``WIDTH`` bytes with its
   neighbour in the array.
4. Repeated starts go back to every copy of their segment, and per text the
   covered bytes are removed.

A gram in very many different segments (a common line shorter than ``WIDTH``),
or in long ones (filler with a short period has one gram throughout), is split
by content instead: its strings are counted by a 128-bit hash, which keeps any
one task small and is exact for them as well (``SHARD_SEGMENTS``,
``GRAM_BYTES``). Equal texts are handled once.

Defined results: null or empty text, or one under ``WIDTH`` bytes, stays whole;
a null doc_id is an id like any other; repeated rows are copies of each other,
so from ``WIDTH`` bytes on they go entirely; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm import textops as T
from leadflow.llm.common import Scratch, free_name, materialize, prepare, release, table
from leadflow.llm.suffixes import permuted_common_prefixes, suffix_array

WIDTH = 200
GRAM = 40
#: Different segments of one gram up to which they are sorted in one shard.
SHARD_SEGMENTS = 2000
#: Bytes of segments per suffix array.
SHARD_BYTES = 1 << 20
#: Bytes of one gram's different segments up to which they are sorted in one shard.
GRAM_BYTES = 2 << 20
#: Starts whose strings are counted at once.
COUNTED = 1 << 20
#: Stands between segments; no UTF-8 text holds this byte.
_BETWEEN = 0xFF
_NO_ID = -(1 << 63)


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``w`` consecutive elements."""
    n = len(x)
    ufunc = np.minimum if least else np.maximum
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if least else np.uint64(0)
    size = -(-n // w) * w
    padded = np.full(size, fill, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = ufunc.accumulate(rows, axis=1).reshape(-1)
    back = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return ufunc(back[:n - w + 1], ahead[w - 1:n])


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each GRAM-byte part, each WIDTH-byte string's gram, whether it lies in one text)."""
    n = len(buf)
    if n < WIDTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    at = np.arange(n - GRAM + 1)
    part = T.span_hash(T.prefix_hash(buf), at, at + GRAM)
    low = _sliding(part, WIDTH - GRAM + 1, True)
    end = offsets[np.searchsorted(offsets, np.arange(len(low)), "right")]
    return part, low, np.arange(len(low)) + WIDTH <= end


def anchors(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all grams, and their hashes."""
    part, low, whole = grams(buf, offsets)
    if not len(low):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = WIDTH - GRAM + 1
    pad = np.zeros(w - 1, np.uint64)
    high = _sliding(np.concatenate([pad, np.where(whole, low, 0), pad]), w, False)
    at = np.flatnonzero((high == part) & (high > 0))
    return at, part[at]


def runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that share a gram: (first start, last start, gram)."""
    _, low, whole = grams(buf, offsets)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    change = np.concatenate(([True], (low[1:] != low[:-1]) | (whole[1:] != whole[:-1])))
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(low)) - 1
    keep = whole[first]
    return first[keep], last[keep], low[first[keep]]


def _ranges(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [a, b) of true elements."""
    step = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def repeated_starts(segments: list[bytes], twice: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, lo, hi): the ranges of starts whose string repeats in the
    shard, by segment; ``twice``: there are more copies of this segment."""
    text = np.frombuffer(b"".join([p for s in segments for p in (s, b"\xff")]), np.uint8)
    size = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
    sa = suffix_array(text)
    before, common = permuted_common_prefixes(text, sa)
    stop = np.flatnonzero(text == _BETWEEN)
    room = np.repeat(stop, np.diff(np.concatenate(([-1], stop)))) - np.arange(len(text))
    hit = np.flatnonzero((common >= WIDTH) & (room >= WIDTH))
    mark = np.repeat(np.array(twice, bool), size)
    mark[hit] = True
    mark[before[hit]] = True
    mark &= room >= WIDTH
    # no range runs over a segment's end: its last starts have no room
    lo, hi = _ranges(mark)
    place = np.cumsum(size) - size
    owner = np.searchsorted(place, lo, "right") - 1
    return owner, lo - place[owner], hi - place[owner]


def _anchor_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(0))
            for i, j in T.slices(offsets, 1 << 20):
                own = offsets[i:j + 1] - offsets[i]
                at, name = anchors(buf[offsets[i]:offsets[j]], own)
                # two of a gram in a row say as much as a whole region of it
                text = np.searchsorted(own, at, "right")
                more = (name[2:] == name[:-2]) & (name[2:] == name[1:-1]) & (text[2:] == text[:-2])
                few = np.concatenate((np.ones(min(2, len(at)), bool), ~more))
                at, name = at[few], name[few]
                upto = np.searchsorted(at, own).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(name.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(i, j - i) for k in range(1, 6)] + [lists],
                    ["doc_id", "name", "text_id", "n_bytes", "sha256", "grams"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(text.alias("text"), F.col("doc_id").cast("long"), F.unhex(F.md5(text)).alias("name"),
                       F.xxhash64(text).alias("text_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text, 256).alias("sha256")) \
        .mapInArrow(T.tidy(run), "doc_id long, name binary, text_id long, n_bytes long, sha256 string, grams array<long>")


def _segments(texts: DataFrame) -> DataFrame:
    """The segments of the runs whose gram is in the text's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(0))
            names, copies = batch.column(1), batch.column(2)
            wanted = batch.column(3)
            upto = wanted.offsets.to_numpy()
            flat = wanted.values.to_numpy().view(np.uint64)
            for i, j in T.slices(offsets, 1 << 20):
                own = buf[offsets[i]:offsets[j]]
                at = offsets[i:j + 1] - offsets[i]
                first, last, gram = runs(own, at)
                text = np.searchsorted(at, first, "right") - 1
                edge = np.searchsorted(text, np.arange(j - i + 1)).tolist()
                keep = np.concatenate([np.isin(gram[edge[d]:edge[d + 1]], flat[upto[i + d]:upto[i + d + 1]])
                                       for d in range(j - i)])
                first, last, gram, text = first[keep], last[keep], gram[keep], text[keep]
                raw = own.tobytes()
                segs = [raw[a:b + WIDTH] for a, b in zip(first.tolist(), last.tolist())]
                row = pa.array(text + i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array([hashlib.md5(s).digest() for s in segs], pa.binary()),
                     names.take(row), pa.array(first - at[text]), copies.take(row), pa.array(segs, pa.binary())],
                    ["gram", "seg", "name", "start", "copies", "bytes"])

    return texts.select("text", "name", "copies", "grams").mapInArrow(
        T.tidy(run), "gram long, seg binary, name binary, start long, copies long, bytes binary")


_FOUND = "gram long, seg binary, lo array<long>, hi array<long>"


def _sorted_shards(segments: DataFrame) -> DataFrame:
    """Ranges of repeated starts per different segment, by suffix arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            owner, lo, hi = repeated_starts([w[3] for w in wait], [w[2] > 1 for w in wait])
            some, first = np.unique(owner, return_index=True)
            upto = pa.array(np.append(first, len(owner)).astype(np.int32))
            return pa.RecordBatch.from_arrays(
                [pa.array([wait[k][0] for k in some], pa.int64()), pa.array([wait[k][1] for k in some], pa.binary()),
                 pa.ListArray.from_arrays(upto, pa.array(lo)), pa.ListArray.from_arrays(upto, pa.array(hi))],
                ["gram", "seg", "lo", "hi"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                # a gram's segments stay together
                if size >= SHARD_BYTES and row[0] != wait[-1][0]:
                    yield flush()
                    wait, size = [], 0
                wait.append(row)
                size += len(row[3])
        if wait:
            yield flush()

    return (segments.select("gram", "seg", "copies", "bytes").repartition("gram").sortWithinPartitions("gram")
            .mapInArrow(T.tidy(run), _FOUND))


def _windows(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, a, b): bytes a to b of the segments i to j; of a long segment's
    many windows, each has its own starts."""
    for i, j in T.slices(offsets, COUNTED):
        if j > i + 1 or offsets[j] - offsets[i] <= COUNTED:
            yield i, j, int(offsets[i]), int(offsets[j])
        else:
            for a in range(int(offsets[i]), int(offsets[j]) - WIDTH + 1, COUNTED):
                yield i, j, a, min(a + COUNTED + WIDTH - 1, int(offsets[j]))


def counted(own: np.ndarray, row: np.ndarray, a: np.ndarray, copies: np.ndarray) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, number, hashes): what to count for the strings that start
    at ``a``, of segments ``row`` with ``copies``. A string seen once has its
    one start. One that is seen more often is named once, with number 2 and
    no start; the ranges of such starts follow with the name of their first."""
    h = np.stack([T.span_hash(T.prefix_hash(own, k), a, a + WIDTH, k).view(np.int64) for k in (0, 1)])
    order = np.lexsort(h)
    new = np.concatenate(([True], (h[:, order[1:]] != h[:, order[:-1]]).any(axis=0)))
    name = np.cumsum(new) - 1
    often = np.bincount(name, copies[order]) > 1
    mark = np.zeros(len(a), bool)
    mark[order] = often[name]
    once, named = np.flatnonzero(~mark), order[new][often]
    edge = row[1:] != row[:-1]
    lo = np.flatnonzero(mark & np.concatenate(([True], edge | ~mark[:-1])))
    hi = np.flatnonzero(mark & np.concatenate((edge | ~mark[1:], [True]))) + 1
    place = np.concatenate((once, named, lo))
    kinds = [len(once), len(named), len(lo)]
    length = np.concatenate((np.ones(kinds[0], np.int64), np.zeros(kinds[1], np.int64), hi - lo))
    return place, length, np.repeat([1, 2, 0], kinds), h[:, place]


def _counted_strings(segments: DataFrame) -> DataFrame:
    """The same for grams with too many or too long segments: string by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(3))
            gram = batch.column(0).to_numpy()
            copies = batch.column(2).to_numpy()
            seg = batch.column(1)
            for i, j, first, last in _windows(offsets):
                begin = np.maximum(offsets[i:j], first)
                count = np.maximum(np.minimum(offsets[i + 1:j + 1], last) - begin - WIDTH + 1, 0)
                row = np.repeat(np.arange(i, j), count)
                if not len(row):
                    continue
                a = begin[row - i] - first + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                place, length, number, h = counted(buf[first:last], row, a, copies[row])
                row, lo = row[place], (a + first - offsets[row])[place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[0]), pa.array(h[1]), pa.array(gram[row]), seg.take(pa.array(row)),
                     pa.array(lo), pa.array(lo + length), pa.array(number)], ["h0", "h1", "gram", "seg", "lo", "hi", "copies"])

    strings = segments.select("gram", "seg", "copies", "bytes").mapInArrow(
        T.tidy(run), "h0 long, h1 long, gram long, seg binary, lo long, hi long, copies long")
    many = (strings.groupBy("h0", "h1").agg(F.sum("copies").alias("_n")).filter("_n > 1").drop("_n"))
    return (strings.filter("lo < hi").join(many, ["h0", "h1"]).groupBy("gram", "seg")
            .agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
            .select("gram", "seg", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi")))


def removed_texts(docs: DataFrame, with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(all rows: doc_id, name, n_bytes, sha256; texts that lose bytes: name,
    n_removed, n_spans, kept_sha256, kept). ``name`` tells texts apart. What a
    step stored for the next one only goes with that one."""
    spark, soon = docs.sparkSession, Scratch()
    rows = materialize(_anchor_rows(docs), "suffix-anchors")
    places = rows.select("text_id", F.explode("grams").alias("gram"))
    shared = places.groupBy("gram").agg(F.count("*").alias("_n")).filter("_n > 1").select("gram")
    wanted = places.join(shared, "gram").groupBy("text_id").agg(F.collect_set("gram").alias("grams"))
    # a text is read at the smallest id that has it
    whole = (rows.groupBy("text_id", "name").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("rep"),
                                                  F.count("*").alias("copies")))
    with soon:
        wanted = materialize(whole.join(wanted, "text_id"), "suffix-wanted")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("rep"), text.alias("text"))
    texts = (source.join(wanted, "rep").filter(F.unhex(F.md5("text")) == F.col("name"))
             .select(F.monotonically_increasing_id().alias("row"), "name", "copies", "grams", "text"))
    texts = materialize(texts, "suffix-texts")
    soon.remove(spark)
    del places, shared, whole, wanted, source
    release(spark)

    cut = materialize(_segments(texts).withColumn("size", F.octet_length("bytes").cast("long")), "suffix-segments")
    pick = F.xxhash64("name", "start")
    kinds = cut.groupBy("gram", "seg").agg(F.sum(F.least("copies", F.lit(2))).alias("copies"), F.min(pick).alias("pick"),
                                          F.max("size").alias("size"))
    with soon:
        kinds = materialize(kinds, "suffix-kinds")
    per_gram = kinds.groupBy("gram").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    small = (F.col("n") <= SHARD_SEGMENTS) & (F.col("size") <= GRAM_BYTES)
    calm = kinds.join(per_gram.filter(small).select("gram"), "gram", "left_semi")
    busy = per_gram.filter(~small).select("gram")

    def one_of_each(kind: DataFrame) -> DataFrame:
        k = kind.select(F.col("gram").alias("_g"), F.col("seg").alias("_s"), F.col("copies").alias("_c"), "pick")
        return (cut.drop("copies").join(k, (F.col("gram") == F.col("_g")) & (F.col("seg") == F.col("_s"))
                                        & (pick == F.col("pick")))
                .select("gram", "seg", F.col("_c").alias("copies"), "bytes"))

    found = _sorted_shards(one_of_each(calm))
    if not busy.isEmpty():
        found = found.union(_counted_strings(one_of_each(kinds.join(busy, "gram", "left_semi"))))
    found = materialize(found, "suffix-found")
    soon.remove(spark)
    del kinds, per_gram, calm, busy
    release(spark)

    # of rows with one text, the first stored is read
    once = texts.groupBy("name").agg(F.min("row").alias("first"))
    spans = (cut.select("gram", "seg", "name", "start").join(found, ["gram", "seg"])
             .select("name", F.explode(F.arrays_zip("lo", "hi")).alias("r"), "start")
             .groupBy("name").agg(F.collect_list(F.struct(
                 (F.col("start") + F.col("r.lo")).alias("a"),
                 (F.col("start") + F.col("r.hi") + (WIDTH - 1)).alias("b"))).alias("spans")))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(1))
            lists = batch.column(2)
            out: list[tuple] = []
            for d in range(batch.num_rows):
                own = buf[offsets[d]:offsets[d + 1]]
                s = lists[d].values
                step = np.zeros(len(own) + 1, np.int32)
                np.add.at(step, s.field(0).to_numpy(), 1)
                np.add.at(step, s.field(1).to_numpy(), -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = own[~gone].tobytes()
                out.append((int(gone.sum()), len(_ranges(gone)[0]), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "ignore") if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.string())],
                ["name", "n_removed", "n_spans", "kept_sha256", "kept"])

    stripped = (texts.select("name", "row", "text").join(spans.join(once, "name"), "name").filter("row = first")
                .select("name", "text", "spans")
                .mapInArrow(T.tidy(strip), "name binary, n_removed long, n_spans long, kept_sha256 string, kept string"))
    return rows.select("doc_id", "name", "n_bytes", "sha256"), stripped


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows, stripped = removed_texts(docs)
    zero = F.lit(0).cast("long")
    return (rows.join(stripped.drop("kept"), "name", "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
                    F.coalesce("n_spans", zero).alias("n_spans"),
                    F.coalesce("kept_sha256", "sha256").alias("kept_sha256")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (a character cut
    by a span's edge goes as a whole) and ``n_chars``, if there, brought up to date."""
    _, stripped = removed_texts(docs, with_text=True)
    name, kept = free_name(docs, "_name"), free_name(docs, "_kept")
    lost = stripped.select(F.col("name").alias(name), F.col("kept").alias(kept))
    out = docs.join(lost, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))) == F.col(name), "left")
    out = out.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(prepare(spark), sf_dir, "documents"))
