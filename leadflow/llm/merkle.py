"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is cut into paragraphs (lines, with their line feeds), a paragraph into
pieces: a piece ends after a word whose hash is divisible by ``PIECE_WORDS``,
so an edit moves no cut but those next to it. Pieces cover every byte. A run
of paragraphs up to one whose hash is divisible by ``SECTION_PARAGRAPHS`` is a
section. A section's digest is taken over its paragraphs' bytes, the root over
the sections. The fingerprint writes the tree down::

    root|section:paragraph,paragraph,...|section:...

where a paragraph is the base64 of its pieces' 32-bit hashes. Equal roots mean
equal texts; otherwise only branches that differ are followed.

Defined results: null text is empty, and an empty text has a root over no
sections and likeness 0 to any other text; a null doc_id comes after all
others; rows with the same doc_id are ordered by text; the only row is its own
next document; other columns are not read, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.llm import textops as T
from leadflow.llm.common import prepare, table

PIECE_WORDS = 8
SECTION_PARAGRAPHS = 4
_NO_ID = -(1 << 63)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of every text of a batch."""
    col = pa.array(texts, pa.large_string())
    buf, offsets = T.column_bytes(col)
    if not len(buf):
        return [_written([]) for _ in texts]
    a, b = T.words(buf, offsets)
    ends = T.chunk_hash(buf, a, b) % np.uint64(PIECE_WORDS) == 0
    mark = np.zeros(len(buf) + 1, bool)
    mark[offsets] = True
    feed = np.flatnonzero(buf == 0x0A) + 1
    mark[feed] = True
    mark[a[1:][ends[:-1]]] = True
    cut = np.flatnonzero(mark)
    piece = T.chunk_hash(buf, cut[:-1], cut[1:])
    # a paragraph begins where a text or, after a line feed, a line does
    line = np.zeros(len(buf) + 1, bool)
    line[offsets] = True
    line[feed] = True
    starts = np.flatnonzero(line[cut[:-1]])
    para = T.mix(np.add.reduceat(piece, starts))
    stop = para % np.uint64(SECTION_PARAGRAPHS) == 0
    short, raw = piece.astype("<u4").tobytes(), buf.tobytes()
    edge = np.append(cut[starts], len(buf)).tolist()
    bounds = np.append(starts, len(piece)).tolist()
    text_of = np.searchsorted(offsets, cut[starts], "right") - 1
    per_text = np.searchsorted(text_of, np.arange(len(texts) + 1)).tolist()
    stops = stop.tolist()
    out = []
    for t in range(len(texts)):
        sections: list[tuple[list[str], list[bytes]]] = []
        fresh = True
        for p in range(per_text[t], per_text[t + 1]):
            if fresh:
                sections.append(([], []))
            sections[-1][1].append(raw[edge[p]:edge[p + 1]])
            sections[-1][0].append(base64.b64encode(short[4 * bounds[p]:4 * bounds[p + 1]]).decode().rstrip("="))
            fresh = stops[p]
        out.append(_written(sections))
    return out


def _written(sections: list[tuple[list[str], list[bytes]]]) -> str:
    """The digests are taken over the paragraphs' bytes; the pieces' hashes that the
    string shows only measure likeness."""
    parts, digests = [], []
    for shown, whole in sections:
        inner = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in whole)
        digest = hashlib.blake2b(inner, digest_size=16)
        digests.append(digest.digest())
        parts.append(f"{digest.hexdigest()[:12]}:{','.join(shown)}")
    root = hashlib.blake2b(b"".join(digests), digest_size=16).hexdigest()
    return "|".join([root, *parts])


def _pieces(paragraph: str) -> list[bytes]:
    raw = base64.b64decode(paragraph + "=" * (-len(paragraph) % 4))
    return [raw[i:i + 4] for i in range(0, len(raw), 4)]


def _size(paragraph: str) -> int:
    return len(paragraph) * 3 // 16


def _differing(a: list[str], b: list[str]) -> tuple[list[str], list[str], list[str]]:
    """What both lists hold, what only a holds, what only b holds; copies count."""
    ca, cb = Counter(a), Counter(b)
    return list((ca & cb).elements()), list((ca - cb).elements()), list((cb - ca).elements())


def _paragraphs(sections: list[str]) -> list[str]:
    return [p for s in sections for p in s[13:].split(",")]


def likeness(a: str, b: str) -> float:
    """Share of pieces that two fingerprints have in common, 0 to 1."""
    if a[:32] == b[:32]:
        return 1.0
    same, left, right = _differing(a.split("|")[1:], b.split("|")[1:])
    common = sum(map(_size, _paragraphs(same)))
    only_a, only_b = _paragraphs(left), _paragraphs(right)
    total = 2 * common + sum(map(_size, only_a)) + sum(map(_size, only_b))
    same, left, right = _differing(only_a, only_b)
    common += sum(map(_size, same))
    pa_, pb = Counter(), Counter()
    for p in left:
        pa_.update(_pieces(p))
    for p in right:
        pb.update(_pieces(p))
    common += sum((pa_ & pb).values())
    return 2 * common / total if total else 0.0


def edits(a: str, b: str) -> list[tuple[int, int, int]]:
    """(section, paragraph, piece) of the pieces of ``a`` that ``b`` does not hold,
    found by following only the branches that differ."""
    if a[:32] == b[:32]:
        return []
    theirs = b.split("|")[1:]
    known_sections = Counter(theirs)
    known_paragraphs = Counter(_paragraphs(theirs))
    known_pieces = Counter(x for p in _paragraphs(theirs) for x in _pieces(p))
    out = []
    for i, s in enumerate(a.split("|")[1:]):
        if known_sections[s]:
            continue
        for j, p in enumerate(s[13:].split(",")):
            if known_paragraphs[p]:
                continue
            out += [(i, j, k) for k, x in enumerate(_pieces(p)) if not known_pieces[x]]
    return out


def edited(text: str, after: str) -> str:
    """The last third of ``text`` replaced by as much of the beginning of ``after``."""
    k = len(text) // 3
    return text[:len(text) - k] + after[:k]


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, guest, doc_id, text), laid out so that a partition read in order
    has every document before the next one of descending doc_id; its last
    neighbour, which lies in another partition, is there as a guest."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # one number per partition comes to the driver
    row = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("q"), F.max("doc_id").alias("top")).first()
    bounds = np.array(sorted({*(row["q"] or []), *([row["top"]] if row["top"] is not None else [])}) or [0], np.int64)
    parts = len(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            bucket = np.searchsorted(bounds, ids, "left")
            last = np.flatnonzero(bounds[np.minimum(bucket, parts - 1)] == ids)
            keep = pa.array(np.concatenate([np.arange(len(ids)), last]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([bucket, (bucket[last] + 1) % parts]).astype(np.int32)),
                 pa.array(np.concatenate([np.zeros(len(ids), bool), np.ones(len(last), bool)])),
                 batch.column(0).take(keep), batch.column(1).take(keep)], ["bucket", "guest", "doc_id", "text"])

    return (rows.mapInArrow(T.tidy(deal), "bucket int, guest boolean, doc_id long, text string")
            .repartitionById(parts, "bucket").sortWithinPartitions("bucket", "guest", F.desc("doc_id"), "text"))


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
           "edited_fingerprint string, near_edited double, near_next double")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, str, str] | None = None   # id, text and fingerprint of the row whose next one is still to come
        for batch in batches:
            ids, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            guest = batch.column(1).to_pylist()
            marks = fingerprints(texts)
            rows = list(zip(ids, texts, marks))
            pairs = []
            for row, g in zip(rows, guest):
                if waiting is not None:
                    pairs.append((waiting, row))
                waiting = None if g else row
            if not pairs:
                continue
            changed = [edited(a[1], b[1]) for a, b in pairs]
            new = fingerprints(changed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([None if a[0] == _NO_ID else a[0] for a, _ in pairs], pa.int64()),
                 pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                 pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                 pa.array([a[2] for a, _ in pairs]), pa.array(new),
                 pa.array([likeness(a[2], f) for (a, _), f in zip(pairs, new)]),
                 pa.array([likeness(a[2], b[2]) for a, b in pairs])],
                [c.split()[0] for c in _RESULT.split(", ")])

    return with_next(docs).mapInArrow(T.tidy(run), _RESULT)


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(prepare(spark), sf_dir, "documents"))
