"""The risk register: one row shape for all detectors, scoring and ranking.

Columns: detector_ord, item_key, title, description, severity, category,
confidence, mitigation, evidence ``array<struct<type, path, details>>`` (at most
three items) and attrs ``map<string, string>``. ``detector_ord`` and
``item_key`` keep the order in which risks are found.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import fixed, lookup
from auditframe.functions.paths import is_code_file
from auditframe.functions.scoring import risk_score, severity_order
from auditframe.operators.common import count_where, one_row

# Order in which the detectors report.
DETECTORS = ("spof", "tribal", "manual", "security", "documentation", "database")


def evidence_item(kind: str, path: Column, details: Column) -> Column:
    """One piece of evidence."""
    return F.struct(F.lit(kind).alias("type"), path.alias("path"), details.alias("details"))


def risk_rows(
    df: DataFrame,
    detector: str,
    item_key: Column,
    title: Column,
    description: Column,
    severity: Column,
    category: str,
    confidence: str,
    mitigation: Column,
    evidence: Column,
    attrs: Mapping[str, Column],
) -> DataFrame:
    """Project a detector's findings to the common risk shape."""
    pairs = [part for k, v in attrs.items() for part in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(DETECTORS.index(detector)).alias("detector_ord"),
        item_key.cast("string").alias("item_key"),
        title.alias("title"),
        description.alias("description"),
        severity.alias("severity"),
        F.lit(category).alias("category"),
        F.lit(confidence).alias("confidence"),
        mitigation.cast("string").alias("mitigation"),
        evidence.alias("evidence"),
        F.create_map(*pairs).alias("attrs"),
    )


def spof_risks(spofs: DataFrame) -> DataFrame:
    """A risk per single point of failure of the dependency graph.

    Expects node_id, node_name, betweenness_centrality and risk_level, and
    counts dependents when a ``dependent_count`` column is there.
    """
    central = fixed(F.col("betweenness_centrality"), 3)
    attrs = {"node_id": F.col("node_id"), "betweenness_centrality": central}
    if "dependent_count" in spofs.columns:
        attrs["dependent_count"] = F.col("dependent_count")
    rank = F.lpad(F.format_string("%.12f", 2.0 - F.col("betweenness_centrality")), 20, "0")
    return risk_rows(
        spofs,
        detector="spof",
        item_key=F.concat_ws("/", rank, F.col("node_id")),
        title=F.concat(F.lit("SPOF: "), F.coalesce("node_name", F.lit("Unknown"))),
        description=F.format_string(
            'Component "%s" is a single point of failure. It has high centrality (%s) '
            "and is critical to system operation.",
            F.coalesce("node_name", F.lit("Unknown")),
            central,
        ),
        severity=lookup(F.col("risk_level"), vocab.SPOF_SEVERITY, F.lit("MEDIUM")),
        category="spof",
        confidence="high",
        mitigation=F.lit(None),
        evidence=F.array(
            evidence_item("topology", F.lit("topology.json"), F.concat(F.lit("Betweenness centrality: "), central))
        ),
        attrs=attrs,
    )


def documentation_gap(files: DataFrame, docs: DataFrame) -> DataFrame:
    """One HIGH risk when there is less than one document per ten code files."""
    counted = one_row(
        files.agg(count_where(is_code_file(F.col("path"))).alias("code_files")),
        docs.agg(F.count("*").alias("doc_files")),
    )
    ratio = F.col("doc_files") / F.col("code_files")
    gap = counted.where(F.col("code_files") > 0).withColumn("ratio", ratio).where(F.col("ratio") < 0.1)
    return risk_rows(
        gap,
        detector="documentation",
        item_key=F.lit("0"),
        title=F.lit("Insufficient Documentation"),
        description=F.format_string(
            "Found only %d documentation file(s) for %d code files. Documentation coverage is %s%%. "
            "This makes the system harder to maintain and onboard new team members.",
            F.col("doc_files"),
            F.col("code_files"),
            fixed(F.col("ratio") * 100, 1),
        ),
        severity=F.lit("HIGH"),
        category="documentation",
        confidence="high",
        mitigation=F.lit("Create README files, architecture docs, and inline code comments"),
        evidence=F.array(
            evidence_item(
                "repository",
                F.lit("repository.json"),
                F.format_string("%d code files, %d docs", F.col("code_files"), F.col("doc_files")),
            )
        ),
        attrs={
            "code_file_count": F.col("code_files"),
            "doc_file_count": F.col("doc_files"),
            "doc_ratio": F.col("ratio"),
        },
    )


def risk_register(*detected: DataFrame) -> DataFrame:
    """All detectors' risks in one table, each with its score."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), detected)
    return score_risks(stacked)


def score_risks(risks: DataFrame) -> DataFrame:
    """Add ``risk_score``: severity weight times confidence weight."""
    severity = F.coalesce("severity", F.lit("MEDIUM"))
    confidence = F.coalesce("confidence", F.lit("medium"))
    return risks.withColumn("risk_score", risk_score(severity, confidence))


def rank_risks(risks: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` highest-scored risks of the whole register."""
    found = [F.col("detector_ord"), F.col("item_key")]
    severity = severity_order(F.coalesce("severity", F.lit("MEDIUM")))
    return risks.orderBy(F.desc("risk_score"), severity, *found).limit(k)


def risk_summary(risks: DataFrame) -> DataFrame:
    """Number of risks in all and per severity, as one row."""
    return risks.agg(
        F.count("*").alias("total_risks"),
        *[count_where(F.col("severity") == s).alias(f"{s.lower()}_count") for s in vocab.SEVERITY_ORDER],
    )


def risks_by_category(risks: DataFrame) -> DataFrame:
    """Number of risks per category."""
    return risks.groupBy("category").agg(F.count("*").alias("risk_count"))
