"""Query logs: JSON and plain-text files to ``query_log`` rows.

Columns: seq, ts, query, duration_ms, rows_affected, database, user.
``seq`` (file path, first byte of the split, number within it) follows log order
wherever Spark places the splits; it serves to break ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import first_group, strip
from auditframe.sources.json_arrays import json_objects

COLUMNS = ("seq", "ts", "query", "duration_ms", "rows_affected", "database", "user")

_JSON_FIELDS = (
    "query STRING, timestamp STRING, duration_ms STRING, rows_affected STRING, database STRING, user STRING, _corrupt STRING"
)


def _place() -> Column:
    """Where a record lies; compares in log order."""
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def scan_query_log_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Read JSON logs: one object per line, or with ``lines=False`` one array or object per file.

    Large files are split either way.
    A record whose timestamp or duration is present but cannot be parsed is
    left out and found in :func:`query_log_rejects`; a missing duration is 0
    and a missing timestamp stays NULL.
    """
    typed, readable = _typed_json(spark, path, lines)
    return typed.where(readable).select(*COLUMNS)


def query_log_rejects(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Records that :func:`scan_query_log_json` leaves out: seq, reason, record."""
    typed, readable = _typed_json(spark, path, lines)
    rest = F.to_json(F.struct("query", F.col("_ts").alias("timestamp"), F.col("_duration").alias("duration_ms"), F.col("_rows").alias("rows_affected")))
    reason = F.when(F.col("_corrupt").isNotNull(), "not JSON").otherwise("unreadable value")
    return typed.where(~readable).select("seq", reason.alias("reason"), F.coalesce("_corrupt", rest).alias("record"))


def _typed_json(spark: SparkSession, path: str, lines: bool) -> tuple[DataFrame, Column]:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    if lines:
        raw = spark.read.schema(_JSON_FIELDS).options(**options).json(path).select("*", _place().alias("seq"))
    else:
        raw = json_objects(spark, path).select("seq", F.from_json("value", _JSON_FIELDS, options).alias("o")).select("seq", "o.*")
    typed = raw.select(
        "seq",
        F.col("timestamp").try_cast("timestamp").alias("ts"),
        F.coalesce("query", F.lit("")).alias("query"),
        F.coalesce("duration_ms", F.lit("0")).try_cast("double").alias("duration_ms"),
        F.col("rows_affected").try_cast("bigint").alias("rows_affected"),
        "database",
        "user",
        F.col("timestamp").alias("_ts"),
        F.col("rows_affected").alias("_rows"),
        F.col("duration_ms").alias("_duration"),
        "_corrupt",
    )
    readable = (
        F.col("_corrupt").isNull()
        & F.col("duration_ms").isNotNull()
        & (F.col("_ts").isNull() | F.col("ts").isNotNull())
        & (F.col("_rows").isNull() | F.col("rows_affected").isNotNull())
    )
    return typed, readable


def scan_query_log_text(spark: SparkSession, path: str, fmt: str = "tagged") -> DataFrame:
    """Read plain-text logs.

    ``fmt="tagged"`` reads ``2024-01-01 12:00:00 [INFO] Query: ...; Duration: 123ms``,
    ``fmt="pipe"`` reads ``2024-01-01 12:00:00 | SELECT ... | 123ms``.
    """
    return parse_text_lines(spark.read.text(path).select("value", _place().alias("seq")), fmt)


def parse_text_lines(lines: DataFrame, fmt: str = "tagged") -> DataFrame:
    """Turn a table with one log line per row (columns ``value`` and ``seq``) into events."""
    line = F.col("value")
    if fmt == "tagged":
        stamp = first_group(line, "(?dU)" + vocab.TEXT_LOG_TIMESTAMP)
        query = strip(first_group(line, "(?dU)" + vocab.TEXT_LOG_QUERY))
        duration = first_group(line, "(?dU)" + vocab.TEXT_LOG_DURATION)
    elif fmt == "pipe":
        shape = r"(?d)^\s*([^|]+?)\s*\|\s*(.+?)\s*\|\s*(\d+(?:\.\d+)?)\s*ms\s*$"
        stamp, query, duration = (first_group(line, shape, g) for g in (1, 2, 3))
    else:
        raise ValueError(f"unknown log format: {fmt}")
    return lines.select(
        "seq",
        stamp.try_cast("timestamp").alias("ts"),
        query.alias("query"),
        F.coalesce(duration.try_cast("double"), F.lit(0.0)).alias("duration_ms"),
        F.lit(None).cast("bigint").alias("rows_affected"),
        F.lit(None).cast("string").alias("database"),
        F.lit(None).cast("string").alias("user"),
    ).where(F.col("query").isNotNull())


def redact_query_log(log: DataFrame, patterns=None) -> DataFrame:
    """Redact statement text and user names."""
    from auditframe.functions.text import redact

    return log.withColumns({c: redact(F.col(c), patterns) for c in ("query", "user")})
