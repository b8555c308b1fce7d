"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage reads what the one before it wrote.  All but the last return the
columns of documents; the last returns the tokens and the decoded text of what is
left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm import decontamination, line_dedup, sentencepiece_bpe, simhash, toxicity
from framewalk.llm.common import Workspace, release, table

MODEL = "piece_bpe_32k.model"


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; the classifier is fitted on labelled rows among them."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate across sites; n_chars is that of the text left."""
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least id."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no test item is found."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and digests of the ids and of the decoded text."""
    import public_tokenizers

    made = sentencepiece_bpe.encode_decode(docs, public_tokenizers.path(MODEL))
    return sentencepiece_bpe.digests(made)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece", tokens_stage),
]

#: Trained trees, XXH64 and the tokenizer cannot be put in SQL; tests hold run() against plain versions stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next; tables that none reads any more are removed."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    before = list(Workspace.made)
    for k, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), str(k))
        release(*before)
        if k:
            work.drop(str(k - 1))
    return docs
