"""A training corpus from raw documents: toxic ones go, then exact copies, near copies and repeated passages; the rest is packed.

All stages but the last take and return the columns of ``documents``. Each works on all that its predecessor kept. Stages set the session's
``spark.sql.execution.arrow.maxBytesPerBatch``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossia.llm import exact_dedup, jaccard_join, packing, substring, toxicity
from dossia.llm.common import read, stored
from dossia.llm.langid import held_out
from dossia.llm.queries import vocabulary


#: Bytes of a batch that goes to a Python worker. Workers live through all stages and keep what a batch once took, beside what the operators hold.
BATCH_BYTES = 4 << 20


def _small_batches(stage: Callable) -> Callable:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one column beside its id and text, so that no name of a stage's own meets one of docs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


@_small_batches
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic; it learns from three quarters of the labelled documents.

    Null texts count as empty; repeated rows go or stay together. Without labels of both classes all score alike; an empty table stays empty.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id"), 4, 2))
    model = toxicity.fit(toxicity.labelled_texts(docs, labels), label_col="label", id_col="_id")
    scored = toxicity.score_texts(_whole(docs).select("row", "text"), model, keep_text=False)
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


@_small_batches
def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays; null texts are empty ones. See ``exact_dedup.drop_exact_copies`` for repeated rows and missing ids."""
    return exact_dedup.drop_exact_copies(docs)


@_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.75 or more over shingles of five words the one with the smallest id stays.

    Null and empty texts link with nothing and stay. See ``jaccard_join.drop_near_copies`` for repeated rows and missing ids.
    """
    return jaccard_join.drop_near_copies(docs)


@_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows of 20 words that also start earlier go; texts without any, null ones too, stay as they are.

    n_chars, where docs has it, is counted again for texts that changed. See ``substring.substring_dedup`` for repeated rows and missing ids.
    """
    done = substring.substring_dedup(_whole(docs))
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


@_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents and their places in sequences of 1024 tokens. A null or empty text is its end alone; repeated rows are packed each."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: SQL can't express the classifier, the tokens or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
