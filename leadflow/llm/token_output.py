"""Token-id output: documents in ascending doc_id order, encoded and written as
files of shuffled planes (``planefile``), one file per range of doc_ids.

Texts are dealt by ranges of doc_id and encoded where they arrive, so ids are
never shuffled. Each task writes one file and hands back one row about it; the
place of a file's first id is a running sum over those rows. A task that is
run again writes the same file again.

Defined results: null or empty text has only its end id; a null doc_id comes
first; rows with the same doc_id are ordered by text; other columns are not
read, whatever their names; an empty table gives no files and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm import textops as T
from leadflow.llm.common import materialize, prepare, scratch_path, table
from leadflow.llm.encoder import Encoder, vocabulary
from leadflow.llm.planefile import BLOCK_IDS, Reader, Writer, open_store

END_ID = 0
VOCABULARY = "byte_bpe_50k.json"


def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str, end_id: int = END_ID,
                      bits: bool = False, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the files and returns their list: file, path, n_docs, n_ids, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task = TaskContext.get()
        part = task.partitionId()
        path = f"{folder}/part-{part:06d}.planes"
        writer, encoder = None, Encoder.of(vocabulary_path)
        for batch in batches:
            buf, offsets = T.column_bytes(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for i, j in T.slices(offsets):
                if writer is None:
                    fs, local = open_store(folder)
                    fs.create_dir(local, recursive=True)
                    writer = Writer(path, f"try{task.taskAttemptId()}", bits, block_ids)
                ids, at = encoder.encode(buf[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                writer.add(doc_ids[i:j], (np.diff(at) + 1).tolist(), ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([path]),
                 pa.array([len(writer.doc_ids)], pa.int64()), pa.array([writer.total], pa.int64())],
                ["file", "path", "n_docs", "n_ids"])

    dealt = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    files = materialize(dealt.mapInArrow(T.tidy(run), "file int, path string, n_docs long, n_ids long"), "token-files")
    # a row per file, a few hundred bytes for a file of many megabytes
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the files: its first id's place, its number of ids and their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(path)
                rows = list(reader.documents())
                reader.close()
                size = np.array([r[1] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array(start + np.cumsum(size) - size),
                     pa.array(size), pa.array([r[2] for r in rows], pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, files.count())
    return (files.select("path", "start", "file").repartitionById(n, F.col("file").cast("int") % F.lit(n))
            .select("path", "start").mapInArrow(T.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op5_bit_plane_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = scratch_path(spark, "planes")
    files = write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary(VOCABULARY))
    return read_token_files(files)
