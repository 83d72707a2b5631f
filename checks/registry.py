"""How a query and its SQL counterpart are registered."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.operators import code, query_log
from checks.views import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {name: ((), sql) for name, sql in VIEWS.items()}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def cte(name: str, *needs: str, sql: str) -> None:
    """Name a piece of oracle SQL that may build on others."""
    CTES[name] = (needs, sql)


def _with(needs: tuple[str, ...], body: str, recursive: bool) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in CTES[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{'' if body.startswith(',') else chr(10)}{body}"


def check(name: str, *needs: str, sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` is its oracle over the CTEs in ``needs``."""
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = _with(needs, sql, recursive)
        return build

    return register


def _names(word: str, text: str) -> bool:
    return re.search(rf"\b{word}\b", text) is not None


class Tables:
    """The given tables and the audit inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run Spark SQL over the given tables and the derived views."""
        used = [v for v in VIEWS if _names(v, text)]
        for name in BASE_TABLES:
            if any(_names(name, t) for t in [text, *(VIEWS[v] for v in used)]):
                self.base(name).createOrReplaceTempView(name)
        for v in used:
            self.spark.sql(VIEWS[v]).createOrReplaceTempView(v)
        return self.spark.sql(text)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    @cached_property
    def log(self) -> DataFrame:
        return self.view("v_query_log").withColumnRenamed("user_name", "user")

    @cached_property
    def stats(self) -> DataFrame:
        return query_log.query_stats(self.log)

    @cached_property
    def drivers(self) -> DataFrame:
        return query_log.cost_drivers(self.stats)

    @cached_property
    def docs(self) -> DataFrame:
        return self.view("v_docs")

    @cached_property
    def files(self) -> DataFrame:
        return self.view("v_files")

    @cached_property
    def code_sql(self) -> DataFrame:
        return code.code_sql(self.files)

    @cached_property
    def schema_tables(self) -> DataFrame:
        return self.view("v_tables").select(
            "seq", F.col("table_name").alias("table"), F.lit(4).cast("bigint").alias("n_columns"), F.lit(0).cast("bigint").alias("n_indexes")
        )

    @cached_property
    def schema_indexes(self) -> DataFrame:
        return (
            self.view("v_schema")
            .where("indexed")
            .select(
                F.col("table_name").alias("table"),
                F.concat(F.lit("ix_"), "table_name").alias("index"),
                F.array("column_name").alias("columns"),
                F.lit(False).alias("unique"),
                F.lit("table").alias("level"),
            )
        )

    @cached_property
    def schema_columns(self) -> DataFrame:
        return self.view("v_columns").withColumnRenamed("table_name", "table").withColumnRenamed("column_name", "column")

    @cached_property
    def edges(self) -> DataFrame:
        return self.view("v_edges")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.view("v_nodes")
