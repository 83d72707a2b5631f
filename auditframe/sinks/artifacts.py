"""Analysis tables on shared storage: data, sources and metrics per engagement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIDENCE_LEVELS = ("high", "medium", "low")


def write_artifact(
    data: DataFrame,
    root: str,
    name: str,
    engagement_id: str,
    confidence: str = "high",
    sources: DataFrame | None = None,
    metrics: DataFrame | None = None,
    fmt: str = "parquet",
) -> str:
    """Write one analysis below ``root`` and return its path.

    The data table is partitioned by engagement; sources and metrics go to
    tables beside it. Writing an engagement again replaces its partition alone.
    """
    if confidence not in CONFIDENCE_LEVELS:
        raise ValueError(f"unknown confidence: {confidence}")
    base = f"{root.rstrip('/')}/{name}"

    def put(df: DataFrame, path: str) -> None:
        tagged = df.withColumn("engagement_id", F.lit(engagement_id))
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("engagement_id").format(fmt).save(path)

    put(data.withColumn("confidence", F.lit(confidence)), base)
    if sources is not None:
        put(sources, f"{base}_sources")
    if metrics is not None:
        put(metrics, f"{base}_metrics")
    return base


def read_artifact(spark: SparkSession, root: str, name: str, engagement_id: str | None = None,
                  fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read an analysis back; naming the engagement prunes to its partition."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    table = reader.load(f"{root.rstrip('/')}/{name}")
    return table if engagement_id is None else table.where(F.col("engagement_id") == engagement_id)
