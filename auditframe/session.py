"""Session defaults and the shared scratch area used to cut long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_scratch: dict[str, str] = {}


def build_session(app_name: str = "auditframe", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster bring your own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Only a local-mode session may leave it unset; it then gets a temporary
    folder, because driver and executors are one machine there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_scratch:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _local_scratch[app_id] = tempfile.mkdtemp(prefix="auditframe-")
    return _local_scratch[app_id]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/auditframe-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Used where a result feeds several branches or the next round of an
    iteration: the written table survives the loss of executors, and its file
    sizes give the planner exact statistics for choosing join strategies.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_measured(df: DataFrame, label: str = "table", **measures: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize` plus aggregates of the rows, taken while writing."""
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), label)
    return table, seen.get


def materialize_counted(df: DataFrame, label: str = "table") -> tuple[DataFrame, int]:
    """:func:`materialize` plus the number of rows, counted while writing."""
    table, seen = materialize_measured(df, label, rows=F.count(F.lit(1)))
    return table, seen["rows"]
