"""Readers and writers: derived inputs are written to the scratch folder and read back."""

from pyspark.sql import functions as F

from auditframe.operators import documents, schema
from auditframe.session import scratch_path
from auditframe.sinks.artifacts import read_artifact, write_artifact
from auditframe.sources.files import scan_documents, scan_source_files
from auditframe.sources import schema as schema_source
from auditframe.sources.query_log import scan_query_log_json, scan_query_log_text
from checks.registry import check, cte

@check("S1_scan_query_log_json", sql="""
SELECT 'q' || event_id AS query, CASE WHEN event_id % 10 = 3 THEN 0.0 ELSE value END AS duration_ms, event_id % 10 <> 4 AS has_ts, CASE WHEN event_id % 2 = 0 THEN user_id END AS rows_affected
FROM events WHERE event_id % 10 NOT IN (1, 2)""")
def _(t):
    path = scratch_path(t.spark, "log-json")
    t.base("events").select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query"),
        F.when(F.col("event_id") % 10 == 1, "not a time")
        .when(F.col("event_id") % 10 == 4, None)
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
        F.when(F.col("event_id") % 10 == 2, "slow")
        .when(F.col("event_id") % 10 == 3, None)
        .otherwise(F.col("value").cast("string")).alias("duration_ms"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("rows_affected"),
    ).write.json(path)
    log = scan_query_log_json(t.spark, path, lines=True)
    return log.select("query", "duration_ms", F.col("ts").isNotNull().alias("has_ts"), "rows_affected")


@check("S1_scan_query_log_array", sql="""
SELECT 'q } { ' || event_id || ' "' AS query, CASE WHEN event_id % 10 = 3 THEN 0.0 ELSE value END AS duration_ms, user_id AS rows_affected
FROM events WHERE event_id % 10 <> 2""")
def _(t):
    # A few files that are one array on one line each; the fixture gathers the records of each.
    path = scratch_path(t.spark, "log-array")
    record = F.to_json(F.struct(
        F.concat(F.lit("q } { "), F.col("event_id").cast("string"), F.lit(' "')).alias("query"), F.col("user_id").alias("rows_affected"),
        F.when(F.col("event_id") % 10 == 2, "slow").when(F.col("event_id") % 10 == 3, None).otherwise(F.col("value").cast("string")).alias("duration_ms")))
    arrays = t.base("events").groupBy((F.col("event_id") % 3).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ", "), F.lit("]")).alias("value"))
    arrays.repartition(3, "file").select("value").write.text(path)
    return scan_query_log_json(t.spark, path, lines=False).select("query", "duration_ms", "rows_affected")


@check("S2_scan_query_log_text", sql="""
SELECT 'SELECT ' || event_id AS query, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE CAST(user_id AS DOUBLE) END AS duration_ms, event_id % 5 <> 0 AS has_ts
FROM events WHERE event_id % 7 <> 0""")
def _(t):
    path = scratch_path(t.spark, "log-text")
    t.sql(
        "SELECT CASE WHEN event_id % 5 = 0 THEN '' ELSE '2024-01-01 12:00:00 ' END || '[INFO] ' || "
        "CASE WHEN event_id % 7 = 0 THEN 'Heartbeat ' ELSE 'Query: ' END || 'SELECT ' || CAST(event_id AS STRING) || '; ' || "
        "CASE WHEN event_id % 3 = 0 THEN '' ELSE 'Duration: ' || CAST(user_id AS STRING) || 'ms' END AS value FROM events"
    ).write.text(path)
    return scan_query_log_text(t.spark, path).select("query", "duration_ms", F.col("ts").isNotNull().alias("has_ts"))


@check("S2_scan_query_log_pipe", sql="""
SELECT 'SELECT a || b FROM t' || event_id AS query, CAST(user_id AS DOUBLE) AS duration_ms FROM events WHERE event_id % 7 <> 0""")
def _(t):
    path = scratch_path(t.spark, "log-pipe")
    t.sql(
        "SELECT '2024-01-01 12:00:00 | SELECT a || b FROM t' || CAST(event_id AS STRING) || "
        "CASE WHEN event_id % 7 = 0 THEN '' ELSE ' | ' || CAST(user_id AS STRING) || 'ms' END AS value FROM events"
    ).write.text(path)
    return scan_query_log_text(t.spark, path, fmt="pipe").select("query", "duration_ms")


@check("S3_scan_source_files", "v_files", sql="""
SELECT kind, CAST(sum(length(content) + 1) AS BIGINT) AS chars, CAST(sum(length(content) - length(replace(content, chr(10), '')) + 1) AS BIGINT) AS lines
FROM (SELECT content, CASE file_id % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'java' WHEN 2 THEN 'js' WHEN 3 THEN 'cs' END AS kind FROM v_files WHERE file_id % 5 <> 4) t GROUP BY kind""")
def _(t):
    # Many small files per language; PHP goes below a skipped directory.
    path = scratch_path(t.spark, "tree")
    kind = F.substring_index("path", ".", -1)
    t.files.select(F.when(kind == "php", "node_modules").otherwise(kind).alias("kind"), "content").write.option(
        "maxRecordsPerFile", 2000
    ).partitionBy("kind").text(path)
    skip = ("kind=node_modules",)
    files = scan_source_files(t.spark, path, extensions=[".txt"], skip_dirs=skip)
    return (
        files.groupBy(F.regexp_extract("path", "^kind=([a-z]+)/", 1).alias("kind"))
        .agg(
            F.sum(F.length("content")).alias("chars"),
            F.sum(F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))).alias("lines"),
        )
    )


@check("S4_scan_documents", sql="""
SELECT CAST(sum(length(text) + 1) AS BIGINT) AS total_chars, bool_and(true) AS titled FROM documents""")
def _(t):
    path = scratch_path(t.spark, "docs")
    t.base("documents").select("text").write.option("maxRecordsPerFile", 40).text(path)
    docs = scan_documents(t.spark, path)
    titled = (F.length("title") > 0) & (F.length("title") <= 100) & (F.col("type") == "txt")
    return docs.agg(F.sum(F.length("content")).alias("total_chars"), F.bool_and(titled).alias("titled"))


cte("o_prefixes", "v_tables", sql="SELECT regexp_extract(table_name, '^([a-z]+)_', 1) AS prefix, table_name, seq FROM v_tables")


def _dumps(t):
    """One JSON schema export per table family, written and scanned."""
    path = scratch_path(t.spark, "schemas")
    column = F.struct(
        F.col("column_name").alias("name"),
        F.lit("INT").alias("type"),
        F.when(F.col("column_name") == "user_id", F.struct(F.lit("users").alias("table"), F.lit("id").alias("column"))).alias("foreign_key"),
    )
    tables = t.view("v_schema").groupBy("table_name").agg(
        F.sort_array(F.collect_list(column)).alias("columns"),
        F.array_compact(F.collect_list(F.when(F.col("indexed"), F.struct(F.lit("ix").alias("name"), F.array("column_name").alias("columns"))))).alias("indexes"),
    )
    prefix = F.regexp_extract("table_name", "^([a-z]+)_", 1)
    family = tables.groupBy(prefix.alias("name")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("table_name").alias("name"), "columns", "indexes"))).alias("tables")
    )
    # Click tables name their database, with totals of their own.
    named = F.col("name") == "clicks"
    family.select(
        F.when(named, F.lit("clickdb")).alias("database_name"),
        F.when(named, F.lit(99)).alias("total_tables"),
        F.when(named, F.lit(77)).alias("total_columns"),
        "name",
        "tables",
    ).write.json(path)
    return schema_source.scan_schema_json(t.spark, path, lines=True)


@check("S5_scan_schema_json", "o_prefixes", sql="""
SELECT CASE prefix WHEN 'clicks' THEN 'clickdb' ELSE prefix END AS database_name, CASE prefix WHEN 'clicks' THEN 99 ELSE count(*) END AS total_tables, CASE prefix WHEN 'clicks' THEN 77 ELSE 4 * count(*) END AS total_columns
FROM o_prefixes GROUP BY prefix""")
def _(t):
    return _dumps(t).select("database_name", "total_tables", "total_columns")


@check("S5_schema_children", "v_schema", sql="""
SELECT table_name AS "table", column_name AS "column", CASE WHEN column_name = 'user_id' THEN 'users' END AS fk_table, indexed FROM v_schema""")
def _(t):
    dumps = _dumps(t)
    indexed = schema_source.schema_indexes(dumps).select("table", F.explode("columns").alias("column"), F.lit(True).alias("indexed"))
    return (
        schema_source.schema_columns(dumps)
        .join(indexed, ["table", "column"], "left")
        .select("table", "column", "fk_table", F.coalesce("indexed", F.lit(False)).alias("indexed"))
    )


@check("S6_scan_schema_ddl", "v_scripts", sql="""
SELECT path, 't' || file_id AS "table", 'id:INT,name:VARCHAR,made:DATE,price:DECIMAL' AS columns FROM v_scripts
UNION ALL SELECT path, regexp_extract(content, '(log_[0-9]+)', 1), 'id:INT,at:TIMESTAMP' FROM v_scripts""")
def _(t):
    dumps = schema_source.scan_schema_ddl(t.view("v_scripts"), "content", "path")
    columns = schema_source.schema_columns(dumps)
    # The pairs per table, in order; a table's columns are few.
    listed = columns.groupBy("dump", "table").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(":", "column", "type").alias("c")))).alias("cs")
    )
    return listed.select(F.col("dump").alias("path"), "table", F.array_join("cs.c", ",").alias("columns"))


@check("S6_ddl_indexes", "v_scripts", sql="""
SELECT path, 'ix' || file_id AS "index", 't' || file_id AS "table", true AS "unique" FROM v_scripts WHERE file_id % 2 = 0""")
def _(t):
    dumps = schema_source.scan_schema_ddl(t.view("v_scripts"), "content", "path")
    return schema_source.schema_indexes(dumps).select(F.col("dump").alias("path"), "index", "table", "unique")


# One script per part in which semicolons stand in a literal, a comment, a default value and a nested bracket.
cte("v_hard_scripts", sql=(_HARD_SCRIPTS := """
SELECT 'hard/' || CAST(p_partkey AS STRING) || '.sql' AS path,
       '-- first; really' || chr(10) || 'CREATE TABLE h' || CAST(p_partkey AS STRING) || ' (id INT, note VARCHAR(9) DEFAULT ' || chr(39) || 'a;' || p_brand || chr(39) || ', made DATE /* ; */, -- x;' || chr(10)
       || ' CHECK (note IN (' || chr(39) || ';' || chr(39) || ', ((' || chr(39) || ');' || chr(39) || ')))), big DECIMAL(9,2));' || chr(10)
       || CASE WHEN p_size % 2 = 0 THEN 'INSERT INTO x VALUES (' || chr(39) || '; CREATE TABLE no (a INT);' || chr(39) || ');' ELSE '' END
       || 'CREATE INDEX ih' || CAST(p_partkey AS STRING) || ' ON h' || CAST(p_partkey AS STRING) || ' (id)' AS content
FROM part"""))


@check("S6_ddl_semicolons", "v_hard_scripts", sql="""
SELECT path, 'h' || regexp_extract(path, '([0-9]+)', 1) AS "table", 'id:INT,note:VARCHAR,made:DATE,big:DECIMAL' AS columns, 'ih' || regexp_extract(path, '([0-9]+)', 1) AS indexes FROM v_hard_scripts""")
def _(t):
    dumps = schema_source.scan_schema_ddl(t.sql(_HARD_SCRIPTS), "content", "path")
    names = F.transform("indexes", lambda i: i["name"])
    return dumps.select(F.col("dump").alias("path"), F.explode("tables").alias("t"), F.array_join(names, ",").alias("indexes")).select(
        "path", F.col("t.name").alias("table"), F.array_join(F.transform("t.columns", lambda c: F.concat_ws(":", c["name"], c["type"])), ",").alias("columns"), "indexes")


@check("A8_schema_metrics", "v_scripts", sql="""
SELECT 2 * count(*) AS total_tables, 6 * count(*) AS total_columns, count(*) FILTER (file_id % 2 = 0) AS total_indexes FROM v_scripts""")
def _(t):
    dumps = schema_source.scan_schema_ddl(t.view("v_scripts"), "content", "path")
    return schema.schema_metrics(
        schema_source.schema_tables(dumps), schema_source.schema_columns(dumps), schema_source.schema_indexes(dumps)
    )


@check("S7_write_and_read_artifact", "o_drivers", sql="""
SELECT query_pattern, total_cost_ms, impact, 'high' AS confidence, 'eng-1' AS engagement_id FROM o_drivers""")
def _(t):
    root = scratch_path(t.spark, "artifacts")
    for engagement in ("eng-1", "eng-2", "eng-1"):  # a second run replaces the first
        write_artifact(t.drivers, root, "cost_drivers", engagement, metrics=documents.corpus_metrics(t.docs))
    return read_artifact(t.spark, root, "cost_drivers", "eng-1").select(
        "query_pattern", "total_cost_ms", "impact", "confidence", "engagement_id"
    )
