"""Functions over the text of single SQL statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import all_groups, first_group


def normalize_query(query: Column) -> Column:
    """Statement text with literals replaced by ``?``: the pattern it belongs to.

    Only single-quoted strings and stand-alone integers count as literals.
    """
    text = F.coalesce(query, F.lit(""))
    text = F.regexp_replace(text, r"'[^']*'", "'?'")
    text = F.regexp_replace(text, r"(?U)\b\d+\b", "?")
    text = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.upper(F.trim(text))


def extract_table(query: Column) -> Column:
    """Lower-cased name after the first FROM, else INTO, else UPDATE."""
    text = F.upper(query)
    return F.lower(
        F.coalesce(
            first_group(text, "(?U)" + vocab.TABLE_AFTER_FROM),
            first_group(text, "(?U)" + vocab.TABLE_AFTER_INTO),
            first_group(text, "(?U)" + vocab.TABLE_AFTER_UPDATE),
        )
    )


def extract_where_columns(query: Column) -> Column:
    """Lower-cased names compared in the WHERE clause, in order, with repeats."""
    clause = F.regexp_extract(query, r"(?idU)WHERE\s+(.+?)(?:GROUP BY|ORDER BY|LIMIT|;|$)", 1)
    names = all_groups(clause, r"(?iU)(\w+)\s*(?:=|IN|>|<|>=|<=|!=|<>)")
    return F.filter(F.transform(names, F.lower), lambda n: ~n.isin("and", "or", "not"))


def classify_impact(total_cost_ms: Column) -> Column:
    """HIGH, MEDIUM or LOW by the unrounded total cost."""
    return (
        F.when(total_cost_ms > vocab.IMPACT_HIGH_MS, "HIGH")
        .when(total_cost_ms > vocab.IMPACT_MEDIUM_MS, "MEDIUM")
        .otherwise("LOW")
    )


def query_type(query: Column, keywords: Sequence[str] = vocab.LOG_QUERY_TYPES, mode: str = "prefix",
               default: str | None = "OTHER") -> Column:
    """Statement class by leading keyword, or by the first keyword contained."""
    other = F.lit(default).cast("string")
    if mode == "prefix":
        head = first_group(query, rf"(?iU)\A[\s\x1c-\x1f]*({'|'.join(keywords)})")
        return F.coalesce(F.upper(head), other)
    if mode == "contains":
        text = F.upper(query)
        found = [F.when(F.contains(text, F.lit(word)), word) for word in keywords]
        return F.coalesce(*found, other)
    raise ValueError(f"unknown mode: {mode}")
