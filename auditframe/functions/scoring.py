"""Severity, priority and effort lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import lookup


def risk_score(severity: Column, confidence: Column) -> Column:
    """Severity weight times confidence weight; unknown values weigh 4 and 0.7."""
    return lookup(severity, vocab.SEVERITY_WEIGHT, F.lit(4.0)) * lookup(
        confidence, vocab.CONFIDENCE_WEIGHT, F.lit(0.7)
    )


def severity_order(severity: Column) -> Column:
    """0 for CRITICAL up to 3 for LOW; unknown counts as MEDIUM."""
    return lookup(severity, vocab.SEVERITY_ORDER, F.lit(2))


def priority(source: Column, severity: Column) -> Column:
    """Recommendation priority; a CRITICAL risk gets two extra points."""
    extra = F.when((source == "risk") & (severity == "CRITICAL"), 2).otherwise(0)
    return lookup(severity, vocab.PRIORITY_SCORE, F.lit(4)) + extra


def estimate_effort(category: Column) -> Column:
    """Effort to mitigate a risk of the given category."""
    return lookup(category, vocab.CATEGORY_EFFORT, F.lit("MEDIUM"))
