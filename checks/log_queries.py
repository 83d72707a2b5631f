"""Query-log operators."""

from pyspark.sql import functions as F

from auditframe.functions import columns, display, paths, scoring, sqltext
from auditframe.operators import common, query_log
from auditframe import vocab
from checks.registry import cte, check

_PATTERN = r"""upper(trim(regexp_replace(regexp_replace(regexp_replace(query, '''[^'']*''', '''?''', 'g'), '\b\d+\b', '?', 'g'), '\s+', ' ', 'g')))"""


def _table_of(col):
    return (
        f"lower(coalesce(nullif(regexp_extract(upper({col}), 'FROM\\s+(\\w+)', 1), ''), "
        f"nullif(regexp_extract(upper({col}), 'INTO\\s+(\\w+)', 1), ''), "
        f"nullif(regexp_extract(upper({col}), 'UPDATE\\s+(\\w+)', 1), '')))"
    )


def _where_of(col):
    return (
        "list_filter(list_transform(regexp_extract_all("
        f"regexp_extract({col}, '(?i)WHERE\\s+(.+?)(?:GROUP BY|ORDER BY|LIMIT|;|$)', 1), "
        "'(?i)(\\w+)\\s*(?:=|IN|>|<|>=|<=|!=|<>)', 1), lambda x: lower(x)), "
        "lambda x: x NOT IN ('and', 'or', 'not'))"
    )


def _impact(col):
    return f"CASE WHEN {col} > 10000 THEN 'HIGH' WHEN {col} > 1000 THEN 'MEDIUM' ELSE 'LOW' END"


def _r2(col):
    return f"CAST(printf('%.2f', CAST({col} AS DOUBLE)) AS DOUBLE)"


cte("o_stats", "v_query_log", sql=f"""
SELECT {_PATTERN} AS pattern, arg_min(query, seq) AS example_query, min(seq) AS first_seq, count(*) AS execution_count,
       (CAST(sum(CAST(duration_ms * 1152921504606846976.0 AS HUGEINT)) AS DOUBLE) / 1152921504606846976.0) AS total_duration_ms,
       min(duration_ms) AS min_duration_ms, max(duration_ms) AS max_duration_ms,
       (CAST(sum(CAST(duration_ms * 1152921504606846976.0 AS HUGEINT)) AS DOUBLE) / 1152921504606846976.0) / count(*) AS avg_duration_ms
FROM v_query_log GROUP BY 1""")
cte("o_drivers", "o_stats", sql=f"""
SELECT pattern AS query_pattern, example_query, {_table_of('example_query')} AS "table", execution_count,
       {_r2('avg_duration_ms')} AS avg_duration_ms, {_r2('min_duration_ms')} AS min_duration_ms,
       {_r2('max_duration_ms')} AS max_duration_ms, {_r2('total_duration_ms')} AS total_cost_ms,
       {_impact('total_duration_ms')} AS impact, first_seq
FROM o_stats""")
cte("o_top", "o_drivers", sql="SELECT * FROM o_drivers ORDER BY total_cost_ms DESC, first_seq LIMIT 10")
cte("o_indexed", "v_schema", sql="""
SELECT lower(table_name) AS "table", list(DISTINCT lower(column_name)) AS indexed_columns FROM v_schema WHERE indexed GROUP BY 1""")
cte("o_missing0", "o_drivers", "o_indexed", sql=f"""
SELECT d.*, CASE WHEN d."table" IS NULL THEN [] ELSE list_filter({_where_of('d.example_query')}, lambda c: NOT list_contains(coalesce(i.indexed_columns, []), c)) END AS missing_indexes
FROM o_drivers d LEFT JOIN o_indexed i ON d."table" = i."table" """)
cte("o_missing", "o_missing0", sql="""
SELECT *, CASE WHEN len(missing_indexes) = 1 THEN ['Consider adding index on ' || "table" || '.' || missing_indexes[1]]
               WHEN len(missing_indexes) > 1 THEN ['Consider adding composite index on ' || "table" || '(' || array_to_string(missing_indexes, ', ') || ')']
               ELSE [] END AS recommendations
FROM o_missing0""")
cte("o_components", "v_uses", sql="""
SELECT DISTINCT lower(substr(dst, 7)) AS "table", substr(src, 8) AS component FROM v_uses
WHERE type = 'uses' AND starts_with(dst, 'table:') AND starts_with(src, 'module:')""")


@check("P1_normalize_query", "v_query_log", sql=f"SELECT seq, {_PATTERN} AS pattern FROM v_query_log")
def _(t):
    return t.log.select("seq", sqltext.normalize_query(F.col("query")).alias("pattern"))


@check("P2_extract_table", "v_query_log", sql=f"SELECT seq, {_table_of('query')} AS table_name FROM v_query_log")
def _(t):
    return t.log.select("seq", sqltext.extract_table(F.col("query")).alias("table_name"))


@check("P3_extract_where_columns", "v_query_log",
       sql=f"SELECT seq, array_to_string({_where_of('query')}, '|') AS where_columns FROM v_query_log")
def _(t):
    return t.log.select("seq", F.array_join(sqltext.extract_where_columns(F.col("query")), "|").alias("where_columns"))


@check("P4_classify_impact", "v_query_log",
       sql=f"SELECT seq, {_impact('(duration_ms * 200)')} AS impact FROM v_query_log")
def _(t):
    return t.log.select("seq", sqltext.classify_impact(F.col("duration_ms") * 200).alias("impact"))


@check("P5_query_type", "v_query_log", sql="""
SELECT seq,
       coalesce(nullif(upper(regexp_extract(query, '(?i)^\\s*(SELECT|INSERT|UPDATE|DELETE)', 1)), ''), 'OTHER') AS leading,
       CASE WHEN contains(upper(user_name || query), 'SELECT') THEN 'SELECT' WHEN contains(upper(user_name || query), 'INSERT') THEN 'INSERT'
            WHEN contains(upper(user_name || query), 'UPDATE') THEN 'UPDATE' WHEN contains(upper(user_name || query), 'DELETE') THEN 'DELETE' END AS contained
FROM v_query_log""")
def _(t):
    anywhere = F.concat("user", "query")
    return t.log.select(
        "seq",
        sqltext.query_type(F.col("query")).alias("leading"),
        sqltext.query_type(anywhere, vocab.CONTAINED_TYPES, "contains", None).alias("contained"),
    )


_LANGS = " ".join(
    f"WHEN '{ext}' THEN '{name}'" for ext, name in (
        (".py", "python"), (".java", "java"), (".js", "javascript"), (".cs", "csharp"), (".php", "php"), (".sql", "sql"))
)
_INVENTORY = " ".join(
    f"WHEN '{ext}' THEN '{name}'" for ext, name in (
        (".py", "Python"), (".java", "Java"), (".js", "JavaScript"), (".cs", "C#"), (".php", "PHP"), (".sql", "SQL"), (".md", "Markdown"))
)
_GRAMMAR = " ".join(
    f"WHEN '{ext}' THEN '{name}'" for ext, name in (
        (".py", "python"), (".java", "java"), (".js", "javascript"), (".cs", "c_sharp"), (".php", "php"), (".sql", "sql"))
)
cte("o_paths", "v_files", "v_docs", "v_scripts", sql="""
SELECT path, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext
FROM (SELECT path FROM v_files UNION ALL SELECT path FROM v_docs UNION ALL SELECT path FROM v_scripts) u""")


def _all_paths(t):
    return t.files.select("path").unionByName(t.docs.select("path")).unionByName(t.view("v_scripts").select("path"))


@check("P6_detect_language", "o_paths", sql=f"""
SELECT path, CASE ext {_LANGS} ELSE 'unknown' END AS extractor, CASE ext {_INVENTORY} END AS inventory, CASE ext {_GRAMMAR} END AS grammar, CASE ext {_GRAMMAR} END AS twin
FROM o_paths""")
def _(t):
    p = F.col("path")
    return _all_paths(t).select(
        "path",
        paths.detect_language(p).alias("extractor"),
        paths.detect_language(p, vocab.INVENTORY_LANGUAGES, None).alias("inventory"),
        paths.detect_language(p, vocab.GRAMMAR_LANGUAGES, None).alias("grammar"),
        paths.detect_language(p, vocab.GRAMMAR_TWIN_LANGUAGES, None).alias("twin"),
    )


@check("P7_is_code_file", "o_paths", sql="SELECT path, ext IN ('.py', '.java', '.js', '.cs', '.php', '.sql') AS is_code FROM o_paths")
def _(t):
    return _all_paths(t).select("path", paths.is_code_file(F.col("path")).alias("is_code"))


@check("P8_effort_and_priority", "v_findings", sql="""
SELECT seq,
       CASE category WHEN 'security' THEN 'MEDIUM' WHEN 'spof' THEN 'HIGH' WHEN 'documentation' THEN 'LOW' ELSE 'MEDIUM' END AS effort,
       CASE severity WHEN 'CRITICAL' THEN 12 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 2 ELSE 4 END AS risk_priority,
       CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 WHEN 'LOW' THEN 2 ELSE 4 END AS cost_priority
FROM v_findings""")
def _(t):
    return t.view("v_findings").select(
        "seq",
        scoring.estimate_effort(F.col("category")).alias("effort"),
        scoring.priority(F.lit("risk"), F.col("severity")).alias("risk_priority"),
        scoring.priority(F.lit("cost"), F.col("severity")).alias("cost_priority"),
    )


_BYTES = "CAST(o_orderkey * o_custkey * 37 AS DOUBLE)"
_MS = "(o_totalprice * 10)"


@check("P9_display_formats", sql=f"""
SELECT o_orderkey,
       CASE WHEN b < 1024 THEN printf('%.1f', b) || ' B' WHEN b / 1024 < 1024 THEN printf('%.1f', b / 1024) || ' KB'
            WHEN b / 1048576 < 1024 THEN printf('%.1f', b / 1048576) || ' MB' ELSE printf('%.1f', b / 1073741824) || ' GB' END AS size_text,
       CASE WHEN ms < 1000 THEN printf('%.0f', ms) || 'ms' WHEN ms < 60000 THEN printf('%.1f', ms / 1000) || 's'
            WHEN ms < 3600000 THEN printf('%.1f', ms / 60000) || 'm' ELSE printf('%.1f', ms / 3600000) || 'h' END AS duration_text
FROM (SELECT o_orderkey, {_BYTES} AS b, {_MS} AS ms FROM orders) t""")
def _(t):
    return t.base("orders").select(
        "o_orderkey",
        display.format_bytes(F.col("o_orderkey") * F.col("o_custkey") * 37).alias("size_text"),
        display.format_duration(F.col("o_totalprice") * 10).alias("duration_text"),
    )


@check("A1_query_stats", "o_stats", sql=f"""
SELECT pattern, example_query, first_seq, execution_count, {_r2('total_duration_ms')} AS total_duration_ms, min_duration_ms, max_duration_ms,
       {_r2('avg_duration_ms')} AS avg_duration_ms FROM o_stats""")
def _(t):
    rounded = {c: columns.round_exact(F.col(c), 2) for c in ("total_duration_ms", "avg_duration_ms")}
    return t.stats.withColumns(rounded)


@check("A2_cost_drivers", "o_drivers", sql="SELECT * FROM o_drivers")
def _(t):
    return t.drivers


@check("K1_top_cost_drivers", "o_top", sql="SELECT query_pattern, \"table\", execution_count, total_cost_ms, impact, first_seq FROM o_top")
def _(t):
    return query_log.top_cost_drivers(t.drivers).select(
        "query_pattern", "table", "execution_count", "total_cost_ms", "impact", "first_seq"
    )


@check("A3_cost_summary", "o_stats", "o_top", sql=f"""
SELECT CAST(s.q AS BIGINT) AS total_queries_analyzed, s.p AS unique_query_patterns, {_r2('c.total')} AS total_cost_ms,
       c.h AS high_impact_count, c.m AS medium_impact_count, c.l AS low_impact_count
FROM (SELECT sum(execution_count) AS q, count(*) AS p FROM o_stats) s,
     (SELECT sum(total_cost_ms) AS total, count(*) FILTER (impact = 'HIGH') AS h, count(*) FILTER (impact = 'MEDIUM') AS m, count(*) FILTER (impact = 'LOW') AS l FROM o_top) c""")
def _(t):
    from auditframe.session import materialize

    stats = materialize(t.stats, "stats")
    return query_log.cost_summary(stats, query_log.top_cost_drivers(query_log.cost_drivers(stats)))


@check("A3_cost_totals", "o_drivers", sql=f"""
SELECT {_r2('sum(CAST(total_cost_ms AS DECIMAL(18,2)))')} AS total_cost_ms, count(*) FILTER (impact = 'HIGH') AS high_impact_count,
       count(*) FILTER (impact = 'MEDIUM') AS medium_impact_count, count(*) FILTER (impact = 'LOW') AS low_impact_count FROM o_drivers""")
def _(t):
    return query_log.cost_totals(t.drivers)


@check("A4_workload_profile", "v_query_log", sql=f"""
SELECT count(*) AS total_queries, {_r2('sum(CAST(duration_ms AS DECIMAL(18,4)))')} AS total_duration_ms, {_r2('avg(duration_ms)')} AS avg_duration_ms,
       count(*) FILTER (upper(query) LIKE 'SELECT%') AS select_count, count(*) FILTER (upper(query) LIKE 'INSERT%') AS insert_count,
       count(*) FILTER (upper(query) LIKE 'UPDATE%') AS update_count, count(*) FILTER (upper(query) LIKE 'DELETE%') AS delete_count,
       count(*) FILTER (NOT regexp_matches(upper(query), '^(SELECT|INSERT|UPDATE|DELETE)')) AS other_count
FROM v_query_log""")
def _(t):
    rounded = {c: columns.round_exact(F.col(c), 2) for c in ("total_duration_ms", "avg_duration_ms")}
    return query_log.workload_profile(t.log).withColumns(rounded)


@check("A4_slowest_queries", "v_query_log", sql="""
SELECT seq, CASE WHEN length(query) > 40 THEN left(query, 40) || '...' ELSE query END AS query, duration_ms
FROM v_query_log ORDER BY duration_ms DESC, seq LIMIT 10""")
def _(t):
    return query_log.slowest_queries(t.log, width=40).drop("ts")


@check("A6_log_metrics", "v_query_log", sql=r"""
SELECT count(*) AS total_queries, count(DISTINCT regexp_replace(query, '(?i)\b[A-Za-z0-9]{32,}\b', '[REDACTED]', 'g')) AS unique_queries FROM v_query_log""")
def _(t):
    from auditframe.sources.query_log import redact_query_log

    return query_log.log_metrics(redact_query_log(t.log))


cte("o_missing_by_database", "v_query_log", "o_indexed", sql=f"""
SELECT s.database, s.pattern AS query_pattern, s."table", s.execution_count,
       list_filter({_where_of('s.example_query')}, lambda c: NOT list_contains(CASE WHEN s.database = 'db1' THEN [] ELSE coalesce(i.indexed_columns, []) END, c)) AS missing_indexes
FROM (SELECT database, {_PATTERN} AS pattern, arg_min(query, seq) AS example_query, {_table_of('arg_min(query, seq)')} AS "table", count(*) AS execution_count FROM v_query_log GROUP BY 1, 2) s
LEFT JOIN o_indexed i ON s."table" = i."table" """)


@check("J1_missing_indexes_by_database", "o_missing_by_database", sql="""
SELECT database, query_pattern, execution_count, array_to_string(missing_indexes, '|') AS missing_indexes FROM o_missing_by_database""")
def _(t):
    # db0 has the indexes, db1 the same tables without any; db2 has no such tables, so all of that name count.
    drivers = query_log.cost_drivers(query_log.query_stats(t.log, by=["database"]))
    indexes = t.schema_indexes.withColumn("database", F.lit("db0"))
    tables = t.schema_tables.select(F.explode(F.array(F.lit("db0"), F.lit("db1"))).alias("database"), "table")
    advised = query_log.missing_indexes(drivers, indexes, tables=tables)
    return advised.select("database", "query_pattern", "execution_count", F.array_join("missing_indexes", "|").alias("missing_indexes"))


@check("J1_missing_indexes", "o_missing", sql="""
SELECT query_pattern, "table", total_cost_ms, array_to_string(missing_indexes, '|') AS missing_indexes, array_to_string(recommendations, '|') AS recommendations
FROM o_missing""")
def _(t):
    return query_log.missing_indexes(t.drivers, t.schema_indexes).select(
        "query_pattern",
        "table",
        "total_cost_ms",
        F.array_join("missing_indexes", "|").alias("missing_indexes"),
        F.array_join("recommendations", "|").alias("recommendations"),
    )


@check("J2_component_counts", "o_drivers", "o_components", sql="""
SELECT d.query_pattern, d."table", coalesce(c.n, 0) AS component_count
FROM o_drivers d LEFT JOIN (SELECT "table", count(*) AS n FROM o_components GROUP BY 1) c ON d."table" = c."table" """)
def _(t):
    return query_log.component_counts(t.drivers, t.view("v_uses")).select("query_pattern", "table", "component_count")


@check("J2_affected_components", "o_top", "o_components", sql="""
SELECT d.query_pattern, d."table", c.component FROM o_top d JOIN o_components c ON d."table" = c."table" """)
def _(t):
    top = query_log.top_cost_drivers(t.drivers)
    return query_log.affected_components(top, t.view("v_uses")).select("query_pattern", "table", "component")


@check("W1_first_per_group", "v_query_log", sql=f"""
SELECT pattern, seq FROM (SELECT {_PATTERN} AS pattern, seq, row_number() OVER (PARTITION BY {_PATTERN} ORDER BY seq) AS rn FROM v_query_log) t WHERE rn = 1""")
def _(t):
    keyed = t.log.select(sqltext.normalize_query(F.col("query")).alias("pattern"), "seq")
    return common.first_per_group(keyed, ["pattern"], [F.col("seq")]).drop("rank")
