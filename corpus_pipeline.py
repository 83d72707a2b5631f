"""A corpus pipeline of five stages over ``documents``; each stage is one operator at work on what the one before kept.

``run`` writes every stage's rows as Parquet below ``spark.checkpoint.dir`` and reads them back as the next one's input.

Nulls, empties, repeats, in every stage: each row is a document of its own, whatever its id. Null and empty texts fail the line rules
and go. Rows with a null id or with ids that others have too are judged like all; near-duplicates among them keep one row (the smallest
id, null ids last, ties by hash of text and row), a repeated passage stays in the first row (null ids first, then ids, ties by hash of
the text). Equal rows are near-duplicates of each other, so one stays. An empty table stays empty. Further columns
pass through, whatever their names, up to packing, which returns columns of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import line_rules, packing, quality_mil, simhash_anchor, substring_debruijn
from auditframe.llm.queries import learned_quality, table
from auditframe.llm.ship import ship
from auditframe.session import materialize


def _with_text(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The columns of documents, with another text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return rows.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop bad lines; documents that the rules reject go."""
    return _with_text(line_rules.clean_lines(docs).where("kept"), "clean_text", docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go; the labels belong to the raw texts, so those are learned from."""
    ship(spark)
    raw = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_mil.score(docs, learned_quality(spark, raw, sf_dir)).where("predicted = 1").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    ship(spark)
    return simhash_anchor.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows go; every document stays, perhaps with less text."""
    ship(spark)
    return _with_text(substring_debruijn.remove_repeats(docs), "kept_text", docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs, remembered=200_000)  # beside the idle workers of earlier stages


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SQL cannot express the trained classifier, the fingerprints or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
