"""A corpus pipeline: each stage is one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.llm import lines, mixing, pieces, quality, simhash
from contentlens.llm.common import free, materialise, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  A null text is judged like an empty one; each of repeated rows is judged by itself."""
    score, predicted = free(docs, "score"), free(docs, "predicted")
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), score=score, predicted=predicted)
    return scored.where(F.col(predicted) == 1).drop(score, predicted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources share stay at their first place only.  Null and empty texts, and rows with a null id, stay as they are; of tied places the first by id, then by number of the line."""
    removed = free(docs, "n_removed")
    return lines.dedup_lines(docs, removed=removed).drop(removed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the least by id, nulls last, then by a hash of id and text.  Texts without words, null ones among them, are one class; repeated rows leave one."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; an id repeats when its words are taken again.  Texts without words, null ones among them, have nothing to take; repeated rows count each."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text, as ids or, where documents have such a column, under that name with an underscore.  A null text has null ids, an empty one none."""
    return pieces.encode(docs, out=free(docs, "ids"))


STAGES = [
    ("quality_filter", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]

#: Hashes, learned scores and token ids are beyond SQL: tests hold run() against its stages, and each stage against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
