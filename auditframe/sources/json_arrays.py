"""Objects of JSON files that are one array each, read by many tasks.

A file is split wherever Spark splits files, and its parts end at closing braces, so even an array on a single line is many small
rows. What a part means depends on what lies before it: whether it begins inside a string (the quotes so far are odd in number),
how deep it begins (opening less closing braces outside strings), and how many objects are complete. These are three running sums,
taken within each split and carried from split to split of a file; only sums of splits meet in one place. Parts with one
object number are joined to the object's text.

The parts are written once, so that every pass sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditframe.session import materialize

_SPLIT = ("path", "block")


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all earlier parts of the file as ``name``."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy(*_SPLIT).agg(F.sum(value).alias("_sum")).select(*_SPLIT, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    within = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(splits, [*_SPLIT])
    return summed.withColumn(name, F.col(name) + F.col("_carry")).drop("_carry")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row per object of the arrays (or single objects) in the files of ``path``: seq (its place) and value (its text)."""
    parts = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")
    parts = materialize(parts, "json-parts")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    parts = _running(parts.withColumn("quotes", _count(plain, '"')), "quotes", "quotes_before")
    inside, inside_after = F.col("quotes_before") % 2 == 1, (F.col("quotes_before") + F.col("quotes")) % 2 == 1
    outside = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), plain), '"[^"]*+(?:"|$)', "")
    parts = parts.withColumns({"opens": _count(outside, "{"), "closes": F.when(inside_after, 0).otherwise(1)}).withColumn("net", F.col("opens") - F.col("closes"))
    parts = _running(parts, "net", "depth")
    ends = (F.col("closes") == 1) & (F.col("depth") + F.col("opens") == 1)
    parts = _running(parts.withColumn("ends", ends.cast("int")), "ends", "number").select("path", "number", "block", "row", "value", "ends")
    place = F.struct("block", "row", "value")
    objects = parts.groupBy("path", "number").agg(F.sort_array(F.collect_list(place)).alias("parts"), F.max("ends").alias("complete")).where("complete = 1")
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}"))
    first = F.get("parts", F.lit(0))
    return objects.select(
        F.struct("path", first["block"].alias("block"), first["row"].alias("row")).alias("seq"),
        F.regexp_replace(text, r"^[^{]*+", "").alias("value"))
