"""Schema analytics over the flat schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.operators.common import one_row
from auditframe.operators.risk import evidence_item, risk_rows


def schema_metrics(tables: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """Number of tables, columns and schema-level indexes."""
    return one_row(
        tables.agg(F.count("*").alias("total_tables")),
        columns.agg(F.count("*").alias("total_columns")),
        indexes.where(F.col("level") == "schema").agg(F.count("*").alias("total_indexes")),
    )


def unindexed_tables(tables: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables that no index of either level covers: seq, table, and dump where both inputs have it.

    A table is covered by indexes of its own dump only; drop the column for a
    view that merges the dumps.
    """
    dump = ["dump"] if "dump" in tables.columns and "dump" in indexes.columns else []
    covered = indexes.select(*dump, F.lower("table").alias("key")).distinct()
    keyed = tables.select(*dump, "seq", "table", F.lower("table").alias("key"))
    return keyed.join(covered, [*dump, "key"], "left_anti").select("seq", "table", *dump)


def unindexed_risk(unindexed: DataFrame) -> DataFrame:
    """One MEDIUM risk when any table has no index.

    The row carries the count and the first five names; the complete list stays
    in the :func:`unindexed_tables` relation instead of growing one cell.
    """
    names = (
        unindexed.orderBy("seq", "table")
        .limit(5)
        .agg(F.sort_array(F.collect_list(F.struct("seq", "table"))).alias("first"))
        .select(F.array_join("first.table", ", ").alias("names"))
    )
    total = one_row(unindexed.agg(F.count("*").alias("n")), names).where(F.col("n") > 0)
    return risk_rows(
        total,
        detector="database",
        item_key=F.lit("0"),
        title=F.lit("Tables Without Indexes"),
        description=F.format_string(
            "Found %d table(s) without any indexes: %s. This can lead to slow query performance.",
            F.col("n"),
            F.col("names"),
        ),
        severity=F.lit("MEDIUM"),
        category="operational",
        confidence="high",
        mitigation=F.lit("Add appropriate indexes based on query patterns"),
        evidence=F.array(
            evidence_item("database", F.lit("database.json"), F.concat(F.lit("Unindexed tables: "), "names"))
        ),
        attrs={"table_count": F.col("n")},
    )
