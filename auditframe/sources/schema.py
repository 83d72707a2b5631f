"""Database schema dumps (JSON exports or DDL scripts) and their flat children.

A dump is one row: dump, database_name, tables, indexes, relationships,
total_tables, total_columns. The child functions explode it to flat tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import all_groups, first_group
from auditframe.sources.json_arrays import json_objects

_COLUMN = "STRUCT<name: STRING, type: STRING, foreign_key: STRUCT<table: STRING, column: STRING>>"
_TABLE_INDEX = "STRUCT<name: STRING, columns: ARRAY<STRING>, unique: BOOLEAN>"
_TABLE = f"STRUCT<name: STRING, columns: ARRAY<{_COLUMN}>, indexes: ARRAY<{_TABLE_INDEX}>, row_count: BIGINT>"
_INDEX = "STRUCT<name: STRING, table: STRING, columns: ARRAY<STRING>, unique: BOOLEAN>"
_RELATION = "STRUCT<from_table: STRING, to_table: STRING, type: STRING>"
_JSON_FIELDS = (
    f"database_name STRING, name STRING, tables ARRAY<{_TABLE}>, indexes ARRAY<{_INDEX}>, "
    f"relationships ARRAY<{_RELATION}>, total_tables BIGINT, total_columns BIGINT"
)


def _count_columns(tables: Column) -> Column:
    return F.aggregate(
        tables,
        F.lit(0).cast("bigint"),
        lambda n, t: n + F.coalesce(F.array_size(t["columns"]).cast("bigint"), F.lit(0).cast("bigint")),
    )


def scan_schema_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Read JSON schema exports: one dump per line, or one dump or array of dumps per file. Large files are split either way.

    Totals come from the file when it names its database, else they are counted.
    """
    if lines:
        raw = spark.read.schema(_JSON_FIELDS).json(path).select("*", F.col("_metadata.file_path").alias("dump"))
    else:
        found = json_objects(spark, path)
        # Dumps of one array are told apart by their place in it.
        several = F.count(F.lit(1)).over(Window.partitionBy("seq.path")) > 1
        place = F.concat_ws("#", "seq.path", F.when(several, F.concat_ws(".", F.col("seq.block").cast("string"), F.col("seq.row").cast("string"))))
        raw = found.select(place.alias("dump"), F.from_json("value", _JSON_FIELDS).alias("o")).select("dump", "o.*")
    tables = F.coalesce("tables", F.array().cast(f"array<{_TABLE}>"))
    named = F.col("database_name").isNotNull()
    return raw.select(
        "dump",
        F.coalesce("database_name", "name", F.lit("unknown")).alias("database_name"),
        tables.alias("tables"),
        F.coalesce("indexes", F.array().cast(f"array<{_INDEX}>")).alias("indexes"),
        F.coalesce("relationships", F.array().cast(f"array<{_RELATION}>")).alias("relationships"),
        F.when(named, F.col("total_tables")).otherwise(F.size(tables)).cast("bigint").alias("total_tables"),
        F.when(named, F.col("total_columns")).otherwise(_count_columns(tables)).cast("bigint").alias("total_columns"),
    )


#: What a statement may hold without ending: literals, quoted names, comments, dollar-quoted bodies.
_QUOTED = r"""'(?:''|\\'|[^'])*+'|"(?:""|\\"|[^"])*+"|`[^`]*+`|--[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"""
_DOLLAR = r"\$(\w*+)\$(?:(?!\$\1\$)[\s\S])*+\$\1\$"
#: Brackets are followed so deep; a bracket that never closes is a sign like others.
_DEPTH = 16


def _statement_pattern() -> str:
    """Everything up to a semicolon outside quotes, comments and brackets. Possessive throughout, so it neither backtracks nor recurses."""
    inner = ""
    for _ in range(_DEPTH):
        inner = rf"\((?:[^()'\"`/-]++|{_QUOTED}{inner and '|' + inner}|[/-])*+\)"
    return rf"(?U)(?:[^;()'\"`/$-]++|{_DOLLAR}|{_QUOTED}|{inner}|[^;])++"


def statements(ddl: Column) -> Column:
    """The statements of a script, as written, without their semicolons."""
    return all_groups(ddl, _statement_pattern(), 0)


def scan_schema_ddl(dumps: DataFrame, ddl: str = "ddl", dump: str = "dump") -> DataFrame:
    """Parse a table of DDL scripts, one script per row, into schema dumps."""
    created = F.filter(
        statements(F.col(ddl)),
        lambda s: F.rlike(
            F.regexp_replace(s, r"(?s)--[^\n]*|/\*.*?\*/", " "), F.lit(r"(?iU)\A\s*CREATE\b")
        ),
    )

    def table(s: Column) -> Column:
        columns = F.zip_with(
            all_groups(s, "(?iU)" + vocab.DDL_COLUMN, 1),
            all_groups(s, "(?iU)" + vocab.DDL_COLUMN, 2),
            lambda name, kind: F.struct(
                name.alias("name"),
                F.upper(kind).alias("type"),
                F.lit(None).cast("struct<table: string, column: string>").alias("foreign_key"),
            ),
        )
        return F.struct(
            first_group(s, "(?iU)" + vocab.DDL_TABLE).alias("name"),
            columns.alias("columns"),
            F.array().cast(f"array<{_TABLE_INDEX}>").alias("indexes"),
            F.lit(None).cast("bigint").alias("row_count"),
        )

    def index(s: Column) -> Column:
        return F.struct(
            first_group(s, "(?iU)" + vocab.DDL_INDEX, 1).alias("name"),
            first_group(s, "(?iU)" + vocab.DDL_INDEX, 2).alias("table"),
            F.array().cast("array<string>").alias("columns"),
            F.contains(F.upper(s), F.lit("UNIQUE")).alias("unique"),
        )

    def mentions(s: Column, word: str) -> Column:
        return F.contains(F.upper(s), F.lit(word))

    parsed = dumps.select(F.col(dump).alias("dump"), created.alias("s")).select(
        "dump",
        F.filter(
            F.transform(F.filter("s", lambda s: mentions(s, "TABLE")), table), lambda t: t["name"].isNotNull()
        ).alias("tables"),
        F.filter(
            F.transform(F.filter("s", lambda s: ~mentions(s, "TABLE") & mentions(s, "INDEX")), index),
            lambda i: i["name"].isNotNull(),
        ).alias("indexes"),
    )
    return parsed.select(
        "dump",
        F.lit("imported_schema").alias("database_name"),
        "tables",
        "indexes",
        F.array().cast(f"array<{_RELATION}>").alias("relationships"),
        F.size("tables").cast("bigint").alias("total_tables"),
        _count_columns(F.col("tables")).alias("total_columns"),
    )


def schema_tables(dumps: DataFrame) -> DataFrame:
    """One row per table: dump, database, seq, table, row_count, n_columns, n_indexes."""
    exploded = dumps.select("dump", F.col("database_name").alias("database"), F.posexplode("tables").alias("seq", "t"))
    return exploded.select(
        "dump",
        "database",
        F.col("seq").cast("bigint").alias("seq"),
        F.col("t.name").alias("table"),
        F.col("t.row_count").alias("row_count"),
        F.coalesce(F.array_size("t.columns"), F.lit(0)).cast("bigint").alias("n_columns"),
        F.coalesce(F.array_size("t.indexes"), F.lit(0)).cast("bigint").alias("n_indexes"),
    )


def schema_columns(dumps: DataFrame) -> DataFrame:
    """One row per column: dump, database, table, column, type, fk_table, fk_column, seq."""
    return (
        dumps.select("dump", F.col("database_name").alias("database"), F.explode("tables").alias("t"))
        .select("dump", "database", F.col("t.name").alias("table"), F.posexplode("t.columns").alias("seq", "c"))
        .select(
            "dump",
            "database",
            "table",
            F.col("c.name").alias("column"),
            F.col("c.type").alias("type"),
            F.col("c.foreign_key.table").alias("fk_table"),
            F.col("c.foreign_key.column").alias("fk_column"),
            F.col("seq").cast("bigint").alias("seq"),
        )
    )


def schema_indexes(dumps: DataFrame) -> DataFrame:
    """One row per index: dump, database, table, index, columns, unique, level (table or schema)."""
    named = dumps.withColumn("database", F.col("database_name"))
    of_tables = (
        named.select("dump", "database", F.explode("tables").alias("t"))
        .select("dump", "database", F.col("t.name").alias("table"), F.explode("t.indexes").alias("i"))
        .select("dump", "database", "table", F.col("i.name").alias("index"), "i.columns", "i.unique", F.lit("table").alias("level"))
    )
    of_schema = named.select("dump", "database", F.explode("indexes").alias("i")).select(
        "dump",
        "database",
        F.col("i.table").alias("table"),
        F.col("i.name").alias("index"),
        "i.columns",
        "i.unique",
        F.lit("schema").alias("level"),
    )
    return of_tables.unionByName(of_schema)
