"""Column pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = "[ \\t-\\r]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def text_hash() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64("text").alias("th")


def sample_rows(texts: DataFrame, candidates: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """``limit`` rows at most (of each value of ``by``) of ``texts(id, text)``, with what ``candidates(id, th, ...)`` says of them.

    Taken are the candidates with the smallest hash of the id, ties by hash of the text. Rows are bounded, not ids: equal rows
    come once, with the number of them that were taken as ``copies``. What is broadcast has ``limit`` rows at most.
    """
    order = [F.xxhash64("id"), F.col("id"), F.col("th")]
    if by is None:
        taken = candidates.orderBy(*order).limit(limit)
    else:
        taken = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit).drop("rank")
    keys = taken.columns
    taken = taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).withColumnsRenamed({"id": "taken_id", "th": "taken_th"})
    rows = texts.select("id", "text", text_hash()).join(F.broadcast(taken), F.col("id").eqNullSafe(F.col("taken_id")) & (F.col("th") == F.col("taken_th")))
    return rows.dropDuplicates(keys).drop("taken_id", "taken_th", "th")


def numbered(columns: list[str]) -> dict[str, str]:
    """Names that clash with nothing for the columns that pass through."""
    return {c: f"in_{k}" for k, c in enumerate(columns)}
