"""Document analytics: people and manual steps that operations depend on.

Documents are rows with one path each and a ``content`` text; ``order`` names a
non-negative integer column that fixes the reading order (by default the order
is by path).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import sort_key, title_case
from auditframe.functions.paths import file_name
from auditframe.functions.text import WORDS, folded, match_contexts
from auditframe.operators.common import first_per_group
from auditframe.operators.risk import evidence_item, risk_rows
from auditframe.session import materialize


def corpus_metrics(docs: DataFrame) -> DataFrame:
    """Document count and total characters."""
    return docs.agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("total_chars"),
    )


def _reading_order(order: str | None) -> Column:
    return F.col("path") if order is None else sort_key(F.col(order))


def _all_matches(content: Column, patterns: Sequence[str], width: int, group: int) -> Column:
    """Matches of every pattern as ``array<struct<ord, n, found, context>>``; expects the folded text in ``_lower``."""
    flagged = [WORDS + p for p in patterns]
    return match_contexts(content, flagged, width, group, vocab.SHORTEST_DOCUMENT_MATCH, F.col("_lower"))


def person_mentions(docs: DataFrame, order: str | None = None) -> DataFrame:
    """One row per mention of a person: person, path, doc_key, ord, n, context."""
    return (
        docs.withColumn("_lower", folded(F.col("content"))).select(
            "path",
            _reading_order(order).alias("doc_key"),
            F.explode(_all_matches(F.col("content"), vocab.TRIBAL_PATTERNS, 100, 1)).alias("m"),
        )
        .select(F.lower("m.found").alias("person"), "path", "doc_key", "m.ord", "m.n", "m.context")
    )


def tribal_knowledge(docs: DataFrame, order: str | None = None) -> DataFrame:
    """A risk per person named at least twice as the one to ask.

    The corpus is scanned once: its mentions, a small share of it, are written
    out and feed both the counts and the evidence.
    """
    return tribal_risks(materialize(person_mentions(docs, order), "mentions"))


def tribal_risks(mentions: DataFrame) -> DataFrame:
    """Risks from a table of :func:`person_mentions`.

    Counts go through (person, path) first, and evidence keeps three rows per
    person before the shuffle, so no person's mentions meet in one task.
    """
    place = F.struct("doc_key", "ord", "n")
    per_file = mentions.groupBy("person", "path").agg(F.count("*").alias("hits"), F.min(place).alias("first"))
    people = (
        per_file.groupBy("person")
        .agg(F.sum("hits").alias("mentions"), F.count("*").alias("files"), F.min("first").alias("first"))
        .where(F.col("mentions") >= 2)
    )
    shown = (
        first_per_group(mentions, ["person"], [F.col("doc_key"), F.col("ord"), F.col("n")], 3)
        .groupBy("person")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "path", "context"))).alias("shown"))
    )
    person = title_case(F.col("person"))
    text = F.format_string(
        'Person "%s" is mentioned %d times across %d document(s) as a knowledge source. '
        "This indicates tribal knowledge dependency.",
        person,
        F.col("mentions"),
        F.col("files"),
    )
    return risk_rows(
        people.join(shown, "person"),
        detector="tribal",
        item_key=F.concat_ws(
            "/", F.col("first.doc_key"), sort_key(F.col("first.ord"), F.col("first.n"))
        ),
        title=F.concat(F.lit("Tribal Knowledge: "), person),
        description=text,
        severity=F.when(F.col("mentions") >= 5, "HIGH").otherwise("MEDIUM"),
        category="tribal_knowledge",
        confidence="medium",
        mitigation=F.concat(F.lit("Document expertise of "), person, F.lit(" in formal documentation")),
        evidence=F.transform("shown", lambda s: evidence_item("document", s["path"], s["context"])),
        attrs={"person_name": person, "mention_count": F.col("mentions"), "file_count": F.col("files")},
    )


def tribal_files(mentions: DataFrame) -> DataFrame:
    """The files behind each person: person, path."""
    return mentions.select("person", "path").distinct()


def manual_operations(docs: DataFrame, order: str | None = None) -> DataFrame:
    """A risk per document that describes at least two manual steps.

    All hits of a document sit in its own row, so this is a plain projection.
    """
    hits = (
        docs.withColumn("_lower", folded(F.col("content"))).select(
            "path",
            _reading_order(order).alias("doc_key"),
            F.explode(F.array(_all_matches(F.col("content"), vocab.MANUAL_PATTERNS, 150, 0))).alias("hits"),
        )
        .where(F.size("hits") >= 2)
    )
    return risk_rows(
        hits,
        detector="manual",
        item_key=F.col("doc_key"),
        title=F.concat(F.lit("Manual Operations in "), file_name(F.col("path"))),
        description=F.format_string(
            "Document contains %d manual operation(s). Manual processes are error-prone and not scalable.",
            F.size("hits"),
        ),
        severity=F.lit("MEDIUM"),
        category="manual_ops",
        confidence="medium",
        mitigation=F.lit("Automate these operations with scripts or CI/CD"),
        evidence=F.transform(
            F.slice("hits", 1, 3), lambda m: evidence_item("document", F.col("path"), m["context"])
        ),
        attrs={"operation_count": F.size("hits")},
    )
