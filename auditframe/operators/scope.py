"""Names of tables and what they stand for when several databases use them.

A table belongs to a dump and, through it, to a database. Its node is ``table:<name>`` while one dump alone
has the name, ``table:<database>.<name>`` when one dump of that database has it, and
``table:<dump>.<name>`` otherwise. A name used inside a dump means that dump's table, else that of its database
if one dump of it has the name, else the only table of that name; a name that stays open is a node of its own,
``table:<name>``. Names meet in lower case.

Every step joins on whole keys and takes candidates only where they are unique, so a name that very many dumps
share never multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_scoped(df: DataFrame) -> bool:
    """Whether rows name their dump and database."""
    return {"dump", "database"} <= set(df.columns)


def node_of(table: Column) -> Column:
    return F.concat(F.lit("table:"), table)


def table_ids(tables: DataFrame) -> DataFrame:
    """The node of every table: dump, database, table, key, id."""
    keyed = tables.select("dump", "database", "table", F.lower("table").alias("key")).distinct()
    # One row per dump that has the name, then per database, then per name.
    dumps = keyed.groupBy("key", "database", "dump").agg(F.lit(1).cast("bigint").alias("one"))
    databases = dumps.groupBy("key", "database").agg(F.sum("one").alias("in_database"))
    names = databases.groupBy("key").agg(F.sum("in_database").alias("in_all"))
    databases = databases.withColumnsRenamed({"key": "_key", "database": "_database"})
    joined = keyed.join(databases, (F.col("key") == F.col("_key")) & F.col("database").eqNullSafe(F.col("_database"))).join(names, "key")
    scope = F.when(F.col("in_database") == 1, F.coalesce("database", F.lit(""))).otherwise(F.coalesce("dump", F.lit("")))
    name = F.when(F.col("in_all") == 1, F.col("table")).otherwise(F.concat(scope, F.lit("."), "table"))
    return joined.select("dump", "database", "table", "key", node_of(name).alias("id"))


def _only(ids: DataFrame, *keys: str) -> DataFrame:
    """The id that each key has where it has one only."""
    return ids.groupBy(*keys).agg(F.min("id").alias("id"), F.max("id").alias("last")).where(F.col("id") == F.col("last")).drop("last")


def resolved(names: DataFrame, ids: DataFrame, name: str, into: str) -> DataFrame:
    """``names`` (with dump and database) with the node that the column ``name`` means in ``into``."""
    rows = names.withColumn("_key", F.lower(name))
    steps = []
    for k, keys in enumerate((("key", "dump"), ("key", "database"), ("key",))):
        found = _only(ids, *keys).withColumnsRenamed({"id": f"_id{k}", **{c: f"_{c}{k}" for c in keys}})
        match = [F.col("_key") == F.col(f"_key{k}")] + [F.col(c).eqNullSafe(F.col(f"_{c}{k}")) for c in keys if c != "key"]
        condition = match[0]
        for m in match[1:]:
            condition = condition & m
        rows = rows.join(found, condition, "left").drop(*[f"_{c}{k}" for c in keys])
        steps.append(f"_id{k}")
    return rows.withColumn(into, F.coalesce(*steps, node_of(F.col(name)))).drop("_key", *steps)
