"""Best-two-fit packing of tokenized documents into sequences.

A sequence is filled greedily, the longest fitting document first. Then its
smallest document makes room for the two unpacked documents that together fill
the expanded gap most tightly, as long as that tightens it.

Lengths are whole numbers up to the capacity, so documents of one length are
interchangeable: the plan works on the histogram of lengths (at most
``capacity`` rows, whatever the corpus holds), and every sequence it forms is
repeated as often as the counts allow. Documents then take their places by
their rank within their length, which is a salted prefix sum, so that a length
shared by a third of all documents is no single task.

Defined results: null or empty text has only its end id; a null doc_id is kept
and packed like any other; repeated rows are packed each; a length of 0 takes
no room and stands at offset 0 of sequence 0; other columns of the input are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadflow.llm import textops as T
from leadflow.llm.common import materialize, prefix_sums, prepare, salts, table
from leadflow.llm.encoder import Encoder, vocabulary

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text and its end id, cut only where longer than
    ``capacity``: one row per piece, with the ids themselves if asked for."""
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary_path)
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(1))
            doc_ids = batch.column(0)
            for i, j in T.slices(offsets):
                own = offsets[i:j + 1] - offsets[i]
                ids, at = encoder.encode(buf[offsets[i]:offsets[j]], own)
                out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}
                for d in range(j - i):
                    text = np.append(ids[at[d]:at[d + 1]], np.uint32(end_id)).astype("<u4")
                    for p, lo in enumerate(range(0, len(text), capacity)):
                        part = text[lo:lo + capacity]
                        out["row"].append(i + d)
                        out["piece"].append(p)
                        out["start"].append(lo)
                        out["length"].append(len(part))
                        out["crc"].append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                cols = [doc_ids.take(pa.array(out["row"], pa.int64())).cast(pa.int64()),
                        pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                        pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(out["ids"], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(T.tidy(run), schema)


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Places for every count of the histogram ``counts[length]``.

    Each row gives ``m * t`` documents of ``length``, from rank ``first`` on,
    their places: t in each of m sequences from ``base`` on, at ``offset``.
    """
    left = np.array(counts, dtype=np.int64)
    left[0] = 0
    size = np.arange(capacity + 1)
    seen = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0

    def below() -> np.ndarray:
        """The largest length still there, up to each length; 0: none."""
        return np.maximum.accumulate(np.where(left > 0, size, 0))

    while True:
        fit = below()
        if not fit[capacity]:
            break
        used: dict[int, int] = {}
        start = left.copy()

        def take(length: int) -> None:
            nonlocal fit
            left[length] -= 1
            used[length] = used.get(length, 0) + 1
            if not left[length]:
                fit = below()

        gap = capacity
        while gap and fit[gap]:
            length = int(fit[gap])
            take(length)
            gap -= length
        while gap and used:
            small = min(used)
            room = gap + small
            firsts = np.flatnonzero(left[:room] > 0)
            if not len(firsts):
                break
            seconds = fit[room - firsts]
            # a pair of equal lengths needs two of them: else the next shorter one
            lone = (seconds == firsts) & (left[firsts] < 2)
            seconds = np.where(lone, fit[np.maximum(firsts - 1, 0)], seconds)
            total = np.where(seconds > 0, firsts + seconds, 0)
            best = int(np.argmax(total))
            if total[best] <= small:
                break
            used[small] -= 1
            left[small] += 1
            if not used[small]:
                del used[small]
            fit = below()
            take(int(firsts[best]))
            take(int(seconds[best]))
            gap = room - int(total[best])
        m = min(int(start[k]) // t for k, t in used.items())
        left[:] = start
        offset = 0
        for k in sorted(used, reverse=True):
            t = used[k]
            rows.append((k, int(seen[k]), t, base, offset))
            seen[k] += m * t
            left[k] -= m * t
            offset += k * t
        base += m
    table_ = np.array(rows, dtype=np.int64).reshape(-1, 5)
    order = np.lexsort((table_[:, 1], table_[:, 0]))
    names = ("length", "first", "t", "base", "offset")
    return {n: table_[order, i] for i, n in enumerate(names)} | {"sequences": np.array([base])}


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length",
         order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every row of ``pieces``.

    Works for any table with a whole-number length column; a null length counts
    as 0, and a length above the capacity is an error. The input is read three
    times, so a costly one should be a stored table.
    """
    taken = {"sequence_id", "offset"} & set(pieces.columns)
    if taken:
        raise ValueError(f"pack() adds columns that are there already: {sorted(taken)}")
    rows = pieces.withColumn("_len", F.coalesce(F.col(length).cast("long"), F.lit(0)))
    # at most capacity + 1 rows reach the driver, whatever the table holds
    found = (rows.groupBy(F.least(F.col("_len"), F.lit(capacity + 1)).alias("_len"))
             .count().collect())
    counts = np.zeros(capacity + 2, np.int64)
    for r in found:
        if r["_len"] < 0:
            raise ValueError("negative length")
        counts[r["_len"]] += r["count"]
    if counts[capacity + 1]:
        raise ValueError(f"{counts[capacity + 1]} rows are longer than {capacity}")
    places = plan(counts[:capacity + 1], capacity)
    key = (places["length"] << 44) + places["first"]

    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts(int(counts.sum())))))
    ranked = prefix_sums(salted, "_len", "_salt", [F.col(c) for c in order], {"_rank": F.lit(1)})
    names = ranked.columns
    schema = StructType(list(ranked.schema)).add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(names.index("_len")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (size << 44) + rank, "right") - 1
            real = size > 0
            seq = np.zeros(len(size), np.int64)
            off = np.zeros(len(size), np.int64)
            if real.any():
                a, r, s = at[real], rank[real], size[real]
                turn = r - places["first"][a]
                seq[real] = places["base"][a] + turn // places["t"][a]
                off[real] = places["offset"][a] + (turn % places["t"][a]) * s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seq), pa.array(off)],
                                             [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(T.tidy(run), schema).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their sequences; ids are left out, their
    checksum stands for them."""
    pieces = materialize(token_pieces(docs, vocabulary(VOCABULARY), capacity), "packing-pieces")
    return pack(pieces, capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(prepare(spark), table(spark, sf_dir, "documents"))
