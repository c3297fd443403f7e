"""From raw documents to a training mix in five stages, each a corpus operator over all that its predecessor kept.

Every stage's result is written as Parquet under the shared folder and read again, so a lost executor costs one stage's
tasks and no lineage grows. All stages but the last return the columns of documents; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm._common import materialise
from sparkfolio.llm.decontaminate import decontaminated
from sparkfolio.llm.language_id import is_held_out, keep_identified, learnt
from sparkfolio.llm.line_dedup import drop_boilerplate
from sparkfolio.llm.mixing import drawn_documents
from sparkfolio.llm.near_copies import one_of_each


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the model learns from the labelled ones outside the held-out fold."""
    return keep_identified(docs, learnt(docs.where(~is_held_out())))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the boilerplate lines of its source; n_chars follows the text."""
    out = drop_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8 or more, verified on the shingles."""
    return one_of_each(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how many of their words it takes; rows without doc_id can't be named and go. A
    column that documents have already is added as mix_<name>."""
    return drawn_documents(docs.where("doc_id IS NOT NULL"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: The first stage is a trained model and others are iterative: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{k}")
    return docs
