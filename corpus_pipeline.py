"""Corpus pipeline: five stages, each over all that its predecessor kept.

toxicity               documents that the classifier rejects go
minhash_near_dedup     one document of each near-duplicate group stays
suffix_array_dedup     repeated byte strings are cut out of the texts
source_mixing          documents are drawn, up to twice, towards the sources' targets
best_fit_packing       token pieces of the drawn documents are packed into sequences

The first four return the columns of ``documents``, whatever others there are
and whatever their names. A document that the mix draws twice is there twice; a
document cut at a source's target keeps its first words. Null and empty texts
pass the first three stages and are never drawn; repeated rows and rows with a
null doc_id are rows like any other; an empty table gives no rows.

A stage's frame is written before the next stage is called. The tables that a
stage stored on its way are removed then, and its shuffle files freed: when the next
stage starts, as far as its input is not still read from them.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from leadflow.llm.common import Scratch, materialize, prepare, release, table
from leadflow.llm.mixing import mixed_documents
from leadflow.llm.near_dedup import keep_one
from leadflow.llm.packing import pack_documents
from leadflow.llm.suffix_dedup import without_repeats
from leadflow.llm.toxicity import without_toxic


#: (application, input folder) -> what the stages so far have left behind
_LEFT: dict[tuple[str, str], list[Scratch]] = {}


def _stage(work):
    """A stage that first removes what the stages before it left behind."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        left = _LEFT.setdefault((spark.sparkContext.applicationId, sf_dir), [])
        for scratch in left:
            scratch.remove(spark, docs)
        left[:] = [s for s in left if s.paths] + [Scratch()]
        release(spark)
        with left[-1]:
            return work(prepare(spark), docs, sf_dir)

    return run


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


@_stage
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(spark, docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage learns a model; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = Scratch()
    for name, stage in STAGES:
        stored = Scratch()
        rows = stage(spark, docs, sf_dir)
        with stored:
            docs = materialize(rows, f"pipeline-{name}")
        before.remove(spark)        # the stage's input, now that its output is stored
        before = stored
    return docs
