"""Query-log analytics: pattern statistics, cost drivers, index advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import round_exact
from auditframe.functions.sqltext import (
    classify_impact,
    extract_table,
    extract_where_columns,
    normalize_query,
    query_type,
)
from auditframe.operators.common import count_where, one_row
from auditframe.operators.totals import counted, counted_if, exact_totals


def query_stats(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Executions per statement pattern, with the first statement as example.

    ``by`` names further columns that tell patterns apart, such as ``database``.

    Partial aggregates are shuffled; the hot pattern of a skewed log shrinks
    to a few rows per task before. Total durations are exact sums, rounded once.
    """
    rows = log.select(
        *by,
        normalize_query(F.col("query")).alias("pattern"),
        F.coalesce("query", F.lit("")).alias("query"),
        "seq",
        F.coalesce("duration_ms", F.lit(0.0)).alias("duration_ms"),
    )
    first = F.min(F.struct("seq", "query"))
    stats = exact_totals(rows, ["pattern", *by], "duration_ms", "total_duration_ms", {
        "first": (first, F.min),
        "execution_count": counted(),
        "min_duration_ms": (F.min("duration_ms"), F.min),
        "max_duration_ms": (F.max("duration_ms"), F.max),
    })
    return stats.select(
        "pattern", *by, F.col("first.query").alias("example_query"), F.col("first.seq").alias("first_seq"), "execution_count",
        "total_duration_ms", "min_duration_ms", "max_duration_ms", (F.col("total_duration_ms") / F.col("execution_count")).alias("avg_duration_ms"))


def cost_drivers(stats: DataFrame) -> DataFrame:
    """Pattern statistics with total cost, impact class and table."""
    total = F.col("avg_duration_ms") * F.col("execution_count")
    return stats.select(
        F.col("pattern").alias("query_pattern"),
        "example_query",
        extract_table(F.col("example_query")).alias("table"),
        "execution_count",
        round_exact(F.col("avg_duration_ms"), 2).alias("avg_duration_ms"),
        round_exact(F.col("min_duration_ms"), 2).alias("min_duration_ms"),
        round_exact(F.col("max_duration_ms"), 2).alias("max_duration_ms"),
        round_exact(total, 2).alias("total_cost_ms"),
        classify_impact(total).alias("impact"),
        "first_seq",
        *[c for c in ("database",) if c in stats.columns],
    )


def top_cost_drivers(drivers: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` costliest drivers; ties keep first-seen order."""
    return drivers.orderBy(F.desc("total_cost_ms"), "first_seq").limit(k)


def cost_summary(stats: DataFrame, top_drivers: DataFrame) -> DataFrame:
    """Query and pattern counts over all patterns, costs over the top drivers. A pattern of several databases counts once."""
    patterns = F.count("*") if "database" not in stats.columns else F.count_distinct("pattern")
    overall = stats.agg(
        F.coalesce(F.sum("execution_count"), F.lit(0)).alias("total_queries_analyzed"),
        patterns.alias("unique_query_patterns"),
    )
    top = top_drivers.agg(
        round_exact(F.coalesce(F.sum("total_cost_ms"), F.lit(0.0)), 2).alias("total_cost_ms"),
        count_where(F.col("impact") == "HIGH").alias("high_impact_count"),
        count_where(F.col("impact") == "MEDIUM").alias("medium_impact_count"),
        count_where(F.col("impact") == "LOW").alias("low_impact_count"),
    )
    return one_row(overall, top)


def cost_totals(drivers: DataFrame) -> DataFrame:
    """Total cost and patterns per impact class over all drivers, as one row."""
    counts = {f"{i.lower()}_impact_count": counted_if(F.col("impact") == i) for i in ("HIGH", "MEDIUM", "LOW")}
    totals = exact_totals(drivers, [], "total_cost_ms", "total_cost_ms", counts)
    return totals.withColumn("total_cost_ms", round_exact(F.coalesce("total_cost_ms", F.lit(0.0)), 2))


def workload_profile(log: DataFrame) -> DataFrame:
    """Totals, mean duration and a count per statement type, as one row."""
    kinds = (*vocab.LOG_QUERY_TYPES, "OTHER")
    counts = {f"{k.lower()}_count": counted_if(F.col("kind") == k) for k in kinds}
    rows = log.select("duration_ms", query_type(F.col("query")).alias("kind"))
    totals = exact_totals(rows, [], "duration_ms", "total_duration_ms", {"total_queries": counted(), **counts})
    totals = totals.withColumn("total_duration_ms", F.coalesce("total_duration_ms", F.lit(0.0)))
    return totals.select(
        "total_queries", "total_duration_ms", *counts,
        F.when(F.col("total_queries") > 0, F.col("total_duration_ms") / F.col("total_queries")).otherwise(0.0).alias("avg_duration_ms"))


def slowest_queries(log: DataFrame, k: int = 10, width: int = 100) -> DataFrame:
    """The ``k`` slowest statements with their time, if the log has it; long texts are cut to ``width`` characters."""
    ts = [c for c in ("ts",) if c in log.columns]
    top = log.select("seq", *ts, "query", "duration_ms").orderBy(F.desc("duration_ms"), "seq").limit(k)
    cut = F.when(
        F.length("query") > width, F.concat(F.left("query", F.lit(width)), F.lit("..."))
    ).otherwise(F.col("query"))
    return top.select("seq", cut.alias("query"), "duration_ms", *ts)


def log_metrics(log: DataFrame) -> DataFrame:
    """Total and distinct statements."""
    return log.agg(F.count("*").alias("total_queries"), F.count_distinct("query").alias("unique_queries"))


def indexed_columns(schema_indexes: DataFrame, include_schema_level: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Distinct indexed columns per table, both lower-cased; one row per table and value of ``by``."""
    indexes = schema_indexes if include_schema_level else schema_indexes.where(F.col("level") == "table")
    return (
        indexes.select(*by, F.lower("table").alias("table"), F.explode("columns").alias("column"))
        .groupBy("table", *by)
        .agg(F.collect_set(F.lower("column")).alias("indexed_columns"))
    )


def _indexes_of(drivers: DataFrame, schema_indexes: DataFrame, include_schema_level: bool, tables: DataFrame | None) -> DataFrame:
    """Drivers with the indexed columns of their table: those of their own database if it has the table, else of all."""
    joined = drivers.join(indexed_columns(schema_indexes, include_schema_level), "table", "left")
    if "database" not in drivers.columns or "database" not in schema_indexes.columns:
        return joined
    own = indexed_columns(schema_indexes, include_schema_level, ["database"]).withColumnRenamed("indexed_columns", "own_columns")
    known = schema_indexes.select("database", "table")
    if tables is not None:
        known = known.unionByName(tables.select("database", "table"))
    known = known.select("database", F.lower("table").alias("table")).distinct().withColumn("is_own", F.lit(True))
    of_database = known.join(own, ["database", "table"], "left")
    joined = joined.join(of_database, ["database", "table"], "left")
    return joined.withColumn("indexed_columns", F.when(F.col("is_own"), F.col("own_columns")).otherwise(F.col("indexed_columns")))


def missing_indexes(drivers: DataFrame, schema_indexes: DataFrame, include_schema_level: bool = False, tables: DataFrame | None = None) -> DataFrame:
    """Drivers with the WHERE columns their table has no index on, and advice.

    A table's indexed columns form one small array, so each driver needs
    an equi-join and a set test instead of a row per column. Where drivers and
    indexes both name their database, a driver's table is that of its own database if it has one (``tables`` also
    names those without any index), else the tables of that name in all databases count together.
    """
    joined = _indexes_of(drivers, schema_indexes, include_schema_level, tables).withColumn("where_columns", extract_where_columns(F.col("example_query")))
    none = F.array().cast("array<string>")
    indexed = F.coalesce("indexed_columns", none)
    missing = F.when(
        F.col("table").isNull(), none
    ).otherwise(F.filter("where_columns", lambda c: ~F.array_contains(indexed, c)))
    advised = joined.withColumn("missing_indexes", missing)
    single = F.concat(F.lit("Consider adding index on "), "table", F.lit("."), F.get("missing_indexes", F.lit(0)))
    several = F.concat(
        F.lit("Consider adding composite index on "), "table", F.lit("("), F.array_join("missing_indexes", ", "), F.lit(")")
    )
    advice = (
        F.when(F.size("missing_indexes") == 1, F.array(single))
        .when(F.size("missing_indexes") > 1, F.array(several))
        .otherwise(none)
    )
    return advised.select(*drivers.columns, "missing_indexes", advice.alias("recommendations"))


def table_components(edges: DataFrame) -> DataFrame:
    """Modules using each table, from ``uses`` edges: table (lower-cased), component."""
    return (
        edges.where((F.col("type") == "uses") & F.startswith("dst", F.lit("table:")) & F.startswith("src", F.lit("module:")))
        .select(
            F.lower(F.substring("dst", 7, 2147483647)).alias("table"),
            F.substring("src", 8, 2147483647).alias("component"),
        )
        .distinct()
    )


def component_counts(drivers: DataFrame, edges: DataFrame) -> DataFrame:
    """All drivers with the number of modules using their table."""
    counts = table_components(edges).groupBy("table").agg(F.count("*").alias("component_count"))
    return drivers.join(counts, "table", "left").select(
        *drivers.columns, F.coalesce("component_count", F.lit(0)).cast("bigint").alias("component_count")
    )


def affected_components(drivers: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per driver and module using its table.

    Meant for the ranked drivers; a hot table's module list stays rows, it is
    never packed into one array.
    """
    return drivers.join(table_components(edges), "table").select(*drivers.columns, "component")
