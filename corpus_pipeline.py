"""Documents to packed sequences: quality, near-duplicates, repeated passages, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner
writes it as Parquet and reads it again as the next stage's ``docs``. All but
the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenfold.llm import mixing, packing, quality, repeats, simhash
from tokenfold.llm.common import table
from tokenfold.session import drop_folder, shared_folder

#: Lowest quality score that stays.
LEAST_QUALITY = 0.7


def _recounted(docs: DataFrame) -> DataFrame:
    """Character counts that follow changed texts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network rejects go; it learns from the labels outside its held-out part."""
    network = quality.train(docs, table(spark, sf_dir, "labels"), ~quality.held_out(F.col("doc_id"), 4, 2))
    judged = quality.scored(docs, network, name="_pipeline_score")
    return judged.where(F.col("_pipeline_score") >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go from all documents."""
    return _recounted(repeats.without_repeats(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document, with the words that it takes."""
    return _recounted(mixing.mixed_texts(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing),
]

#: The stages score, hash and tokenize in ways that SQL has no words for; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows stand as Parquet in the shared folder."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
