"""Security issues in source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import lookup, sort_key
from auditframe.functions.paths import file_name, is_code_file
from auditframe.functions.text import WORDS, context, folded, may_match
from auditframe.operators.risk import evidence_item, risk_rows

_TYPES = tuple(vocab.SECURITY_PATTERNS)


def _first_hit(content: Column, lower: Column, ord_: int, patterns: tuple[str, ...]) -> Column:
    """Which pattern of one issue type matches first in the list, and how often.

    Later patterns are not evaluated once an earlier one has matched, nor those whose words the ``lower`` text lacks.
    """
    hit = F.lit(None)
    for i, p in reversed(tuple(enumerate(patterns))):
        regex = F.lit(WORDS + p)
        found = F.struct(
            F.lit(ord_).alias("type_ord"),
            F.lit(i).alias("pattern_ord"),
            F.regexp_count(content, regex).alias("hits"),
        )
        hit = F.when(may_match(lower, p) & F.rlike(content, regex), found).otherwise(hit)
    return hit


def security_findings(files: DataFrame) -> DataFrame:
    """One row per code file and issue type: path, type_ord, pattern_ord, hits, position.

    Every file is judged in its own row; nothing is shuffled.
    """
    content = F.col("content")
    hits = F.array_compact(
        F.array(*[_first_hit(content, F.col("_lower"), i, vocab.SECURITY_PATTERNS[t]) for i, t in enumerate(_TYPES)])
    )
    # Exploding a finished column that may be empty evaluates the patterns once and in compiled code.
    found = (
        files.where(is_code_file(F.col("path")) & (F.length("content") > 0))
        .withColumn("_lower", folded(content))
        .withColumn("_hits", hits)
        .select(*files.columns, F.explode_outer("_hits").alias("hit"))
        .where(F.col("hit").isNotNull())
    )
    position = F.lit(None)
    for i, t in enumerate(_TYPES):
        for j, p in enumerate(vocab.SECURITY_PATTERNS[t]):
            chosen = (F.col("hit.type_ord") == i) & (F.col("hit.pattern_ord") == j)
            first_gap = F.length(F.get(F.split(content, WORDS + p, 2), F.lit(0)))
            position = F.when(chosen, first_gap).otherwise(position)
    return found.select(
        *files.columns,
        F.get(F.array(*[F.lit(t) for t in _TYPES]), F.col("hit.type_ord")).alias("issue_type"),
        "hit.type_ord",
        "hit.pattern_ord",
        F.col("hit.hits").alias("hits"),
        position.alias("position"),
    )


def security_issues(files: DataFrame, order: str | None = None) -> DataFrame:
    """A risk per code file and issue type; the first matching pattern counts."""
    found = security_findings(files)
    words = F.replace(F.col("issue_type"), F.lit("_"), F.lit(" "))
    file_key = F.col("path") if order is None else sort_key(F.col(order))
    return risk_rows(
        found,
        detector="security",
        item_key=F.concat_ws("/", file_key, F.col("type_ord")),
        title=F.concat(F.lit("Security: "), F.initcap(words), F.lit(" in "), file_name(F.col("path"))),
        description=F.format_string(
            "Found %d instance(s) of %s in %s. This is a security vulnerability.", F.col("hits"), words, F.col("path")
        ),
        severity=lookup(F.col("issue_type"), vocab.SECURITY_SEVERITY, F.lit("HIGH")),
        category="security",
        confidence="high",
        mitigation=lookup(
            F.col("issue_type"), vocab.SECURITY_MITIGATION, F.lit("Review and remediate security issue")
        ),
        evidence=F.array(
            evidence_item("code", F.col("path"), context(F.col("content"), F.col("position"), 80))
        ),
        attrs={"issue_type": F.col("issue_type"), "occurrence_count": F.col("hits")},
    )
