"""Source-code operators."""

from pyspark.sql import functions as F

from auditframe.operators import code, security
from auditframe.session import scratch_path
from checks.registry import cte, check
from checks.text_queries import flat_risks

cte("o_lang", "v_files", sql="""
SELECT *, CASE file_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript' WHEN 3 THEN 'csharp' ELSE 'php' END AS language FROM v_files""")
cte("o_lines", "o_lang", sql="""
SELECT file_id, path, language, CAST(line AS INTEGER) AS line, lines[line] AS text
FROM (SELECT file_id, path, language, lines, unnest(range(1, len(lines) + 1)) AS line FROM (SELECT *, string_split(content, chr(10)) AS lines FROM o_lang) a) b""")
cte("o_imports", "o_lang", sql=r"""
SELECT path, language, 'import' AS kind, unnest(list_distinct(CASE language
  WHEN 'python' THEN regexp_extract_all(content, '(?m)^\s*import\s+([\w.]+)', 1)
  WHEN 'java' THEN regexp_extract_all(content, 'import\s+([\w.]+)\s*;', 1)
  WHEN 'javascript' THEN regexp_extract_all(content, 'require\s*\(\s*[''"]([^''"]+)[''"]\s*\)', 1)
  WHEN 'csharp' THEN regexp_extract_all(content, 'using\s+([\w.]+)\s*;', 1)
  ELSE regexp_extract_all(content, 'require_once\s+["'']([^"'']+)["'']', 1) END)) AS module
FROM o_lang""")
cte("o_sql0", "o_lines", sql=r"""
SELECT path, language, line, trim(q) AS query FROM (
  SELECT *, CASE language
    WHEN 'python' THEN coalesce(nullif(regexp_extract(text, '\.execute\s*\(\s*["''](.+?)["'']', 1), ''), nullif(regexp_extract(text, '["''](.+?)["'']', 1), ''))
    WHEN 'java' THEN nullif(regexp_extract(text, '(?i)["'']([^"'']*(?:SELECT|INSERT|UPDATE|DELETE|CREATE)[^"'']*)["'']', 1), '')
    WHEN 'csharp' THEN nullif(regexp_extract(text, '(?i)@?"([^"]*(?:SELECT|INSERT|UPDATE|DELETE)[^"]*)"', 1), '')
    WHEN 'javascript' THEN coalesce(nullif(regexp_extract(text, '(?i)["'']([^"'']*(?:SELECT|INSERT|UPDATE|DELETE)[^"'']*)["'']', 1), ''), nullif(regexp_extract(text, '(?i)`([^`]*(?:SELECT|INSERT|UPDATE|DELETE)[^`]*)`', 1), ''))
    ELSE nullif(regexp_extract(text, '(?i)["'']([^"'']*(?:SELECT|INSERT|UPDATE|DELETE)[^"'']*)["'']', 1), '') END AS q
  FROM o_lines
  WHERE regexp_matches(text, CASE language WHEN 'python' THEN '(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|FROM|WHERE|JOIN)\b' WHEN 'java' THEN '(?i)(SELECT|INSERT|UPDATE|DELETE|CREATE)\b' ELSE '(?i)(SELECT|INSERT|UPDATE|DELETE)\b' END)) t
WHERE q IS NOT NULL""")
cte("o_sql", "o_sql0", sql=r"""
SELECT path, language, query, line, nullif(upper(regexp_extract(query, '(?i)(SELECT|INSERT|UPDATE|DELETE)', 1)), '') AS type,
       CASE WHEN language IN ('python', 'java') THEN coalesce(nullif(regexp_extract(query, '(?i)FROM\s+(\w+)', 1), ''), nullif(regexp_extract(query, '(?i)INTO\s+(\w+)', 1), ''), nullif(regexp_extract(query, '(?i)UPDATE\s+(\w+)', 1), ''))
            WHEN language = 'javascript' THEN coalesce(nullif(regexp_extract(query, '(?i)FROM\s+(\w+)', 1), ''), nullif(regexp_extract(query, '(?i)INTO\s+(\w+)', 1), ''))
            ELSE nullif(regexp_extract(query, '(?i)FROM\s+(\w+)', 1), '') END AS "table"
FROM o_sql0""")
cte("o_calls", "o_lines", sql=r"""
SELECT path, language, name, line FROM (
  SELECT path, language, line, 'c.execute' AS name, language = 'python' AND regexp_matches(text, '\bc\.execute\s*\(') AS hit FROM o_lines
  UNION ALL SELECT path, language, line, n, language = 'java' AND regexp_matches(text, '\.' || n || '\s*\(') FROM o_lines, (SELECT unnest(['executeQuery', 'executeUpdate', 'execute', 'prepareStatement', 'createQuery']) AS n) p
  UNION ALL SELECT path, language, line, n, language = 'javascript' AND regexp_matches(text, '\.' || n || '\s*\(') FROM o_lines, (SELECT unnest(['query', 'execute', 'run', 'all', 'get']) AS n) p
  UNION ALL SELECT path, language, line, n, language = 'csharp' AND regexp_matches(text, '\.' || n || '\s*\(') FROM o_lines, (SELECT unnest(['ExecuteReader', 'ExecuteScalar', 'ExecuteNonQuery']) AS n) p
  UNION ALL SELECT path, language, line, n, language = 'php' AND regexp_matches(text, n || '\s*\(') FROM o_lines, (SELECT unnest(['mysql_query', 'mysqli_query']) AS n) p
) t WHERE hit""")

_TYPES = {
    "hardcoded_password": ("CRITICAL", "Move credentials to environment variables or secrets manager", [
        r"""password\s*=\s*["'']([^"'']+)["'']""", r"""passwd\s*=\s*["'']([^"'']+)["'']""", r"""pwd\s*=\s*["'']([^"'']+)["'']"""]),
    "api_key": ("CRITICAL", "Store API keys in environment variables or secrets manager", [
        r"""api_key\s*=\s*["'']([^"'']+)["'']""", r"""api_secret\s*=\s*["'']([^"'']+)["'']""", r"""secret_key\s*=\s*["'']([^"'']+)["'']"""]),
    "sql_injection": ("HIGH", "Use parameterized queries or ORM with proper escaping", [
        r"""execute\s*\(\s*["''].*%s.*["'']""", r"""query\s*\(\s*["''].*\+.*["'']""", r"""\.format\s*\(.*sql.*\)"""]),
    "insecure_connection": ("MEDIUM", "Enable SSL/TLS verification and use HTTPS", [
        r"""http://""", r"""verify\s*=\s*False""", r"""ssl_verify\s*=\s*False"""]),
}


def _security_sql() -> str:
    rows = []
    for i, (name, (severity, fix, patterns)) in enumerate(_TYPES.items()):
        for j, p in enumerate(patterns):
            # RE2 has no lookahead: local addresses are subtracted.
            local = "- len(regexp_extract_all(content, '(?i)http://(?:localhost|127\\.0\\.0\\.1)'))" if p == "http://" else ""
            rows.append(
                f"SELECT file_id, path, content, {i} AS type_ord, {j} AS pattern_ord, '{name}' AS issue_type, '{severity}' AS severity, '{fix}' AS mitigation, "
                f"len(regexp_extract_all(content, '(?i){p}')) {local} AS hits, length(string_split_regex(content, '(?i){p}')[1]) AS position FROM v_code"
            )
    return " UNION ALL ".join(rows)


cte("v_code", "v_files", sql="SELECT * FROM v_files UNION ALL SELECT page_id + 100000000, 'web/p' || page_id || '.py', 'u = ' || chr(34) || url || chr(34) || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'get(u, verify=False)' ELSE 'pwd=' || chr(39) || url || chr(39) END FROM pages")
cte("o_findings0", "v_code", sql=_security_sql())
cte("o_findings", "o_findings0", sql="""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, type_ord ORDER BY pattern_ord) AS rn FROM o_findings0 WHERE hits > 0) t WHERE rn = 1""")
cte("o_security", "o_findings", sql="""
SELECT 3 AS detector_ord, lpad(CAST(file_id AS VARCHAR), 19, '0') || '/' || type_ord AS item_key,
       'Security: ' || CASE type_ord WHEN 0 THEN 'Hardcoded Password' WHEN 1 THEN 'Api Key' WHEN 2 THEN 'Sql Injection' ELSE 'Insecure Connection' END || ' in ' || regexp_extract(path, '[^/]*$') AS title,
       'Found ' || hits || ' instance(s) of ' || replace(issue_type, '_', ' ') || ' in ' || path || '. This is a security vulnerability.' AS description,
       severity, 'security' AS category, 'high' AS confidence, mitigation,
       'code|' || path || '|' || CASE WHEN position > 40 THEN '...' ELSE '' END
         || trim(substr(content, greatest(position - 40, 0) + 1, least(length(content), position + 40) - greatest(position - 40, 0)), ' ' || chr(10))
         || CASE WHEN position + 40 < length(content) THEN '...' ELSE '' END AS evidence
FROM o_findings""")


def code_files(t):
    """The derived source files plus one small script per page."""
    pages = t.sql(
        "SELECT page_id + 100000000 AS file_id, 'web/p' || CAST(page_id AS STRING) || '.py' AS path, "
        "'u = ' || chr(34) || url || chr(34) || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'get(u, verify=False)' "
        "ELSE 'pwd=' || chr(39) || url || chr(39) END AS content FROM pages"
    )
    return t.files.unionByName(pages)


@check("C1_code_imports", "o_imports", sql="SELECT * FROM o_imports")
def _(t):
    return code.code_imports(t.files).drop("name")


@check("C2_python_imports", "o_imports", sql="SELECT path, kind, module, CAST(NULL AS VARCHAR) AS name FROM o_imports WHERE language = 'python'")
def _(t):
    return code.python_imports(t.files).drop("language")


@check("C3_code_sql", "o_sql", sql="SELECT * FROM o_sql")
def _(t):
    return t.code_sql


# Migrations in code: the table of a DDL statement is the name after TABLE.
_MIGRATIONS = """
SELECT 'mig/' || CAST(p_partkey AS STRING) || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '.java' END AS path,
       'x.execute(' || chr(34) || CASE p_partkey % 3 WHEN 0 THEN 'DROP TABLE d' WHEN 1 THEN 'create table c' ELSE 'SELECT * FROM s' END || CAST(p_partkey AS STRING) || chr(34) || ')' AS content
FROM part"""


@check("C3_code_sql_ddl", sql="""
SELECT 'mig/' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.py' ELSE '.java' END AS path, 1 AS line,
       CASE p_partkey % 3 WHEN 0 THEN 'DROP' WHEN 1 THEN 'CREATE' ELSE 'SELECT' END AS type, CASE p_partkey % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'c' ELSE 's' END || p_partkey AS "table"
FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0""")
def _(t):
    return code.code_sql(t.sql(_MIGRATIONS), ddl_tables=True).select("path", "line", "type", "table")


@check("C4_python_sql", "o_sql", sql="SELECT * FROM o_sql WHERE language = 'python'")
def _(t):
    return code.python_sql(t.files)


@check("C5_db_calls", "o_calls", sql="SELECT * FROM o_calls")
def _(t):
    return code.db_calls(t.files)


@check("C6_class_defs", "o_lang", sql=r"""
SELECT path, unnest(regexp_extract_all(content, '(?m)^class\s+(\w+)', 1)) AS class_name, 'Base' AS bases FROM o_lang WHERE language = 'python'""")
def _(t):
    return code.class_defs(t.files).select("path", "class_name", F.array_join("bases", "|").alias("bases"))


@check("C7_tables_defined", "v_scripts", sql=r"""
SELECT path, 'sql' AS language, unnest(list_distinct(regexp_extract_all(content, '(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w+)', 1))) AS "table" FROM v_scripts""")
def _(t):
    return code.tables_defined(t.view("v_scripts"))


@check("C8_scan_code", "o_lang", "o_imports", "o_sql", "o_calls", sql="""
SELECT f.path, f.language, coalesce(i.n, 0) AS n_imports, coalesce(s.n, 0) AS n_sql, coalesce(c.n, 0) AS n_calls
FROM o_lang f LEFT JOIN (SELECT path, count(*) AS n FROM o_imports GROUP BY 1) i ON f.path = i.path
LEFT JOIN (SELECT path, count(*) AS n FROM o_sql GROUP BY 1) s ON f.path = s.path
LEFT JOIN (SELECT path, count(*) AS n FROM o_calls GROUP BY 1) c ON f.path = c.path""")
def _(t):
    def size(c):
        return F.size(c).cast("bigint")

    return code.code_facts(t.files).select(
        "path", "language", size("imports").alias("n_imports"), size("sql_queries").alias("n_sql"), size("db_calls").alias("n_calls")
    )


# Whole files of hundreds of the derived ones, so that lines are counted over long texts.
_LARGE = 300
cte("o_offsets", "o_lang", sql=f"""
SELECT path, language || CAST(file_id // {_LARGE} AS VARCHAR) AS large,
  CAST(sum(len(string_split(content, chr(10)))) OVER (PARTITION BY language, file_id // {_LARGE} ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(string_split(content, chr(10))) AS BIGINT) AS before
FROM o_lang""")


@check("C8_scan_code_large", "o_offsets", "o_imports", "o_sql", "o_calls", sql="""
SELECT f.large, coalesce(i.n, 0) AS n_imports, coalesce(s.n, 0) AS n_sql, coalesce(s.lines, 0) AS sql_lines, coalesce(c.n, 0) AS n_calls, coalesce(c.lines, 0) AS call_lines
FROM (SELECT DISTINCT large FROM o_offsets) f
LEFT JOIN (SELECT large, count(DISTINCT module) AS n FROM o_imports JOIN o_offsets USING (path) GROUP BY 1) i ON f.large = i.large
LEFT JOIN (SELECT large, count(*) AS n, CAST(sum(before + line) AS BIGINT) AS lines FROM o_sql JOIN o_offsets USING (path) GROUP BY 1) s ON f.large = s.large
LEFT JOIN (SELECT large, count(*) AS n, CAST(sum(before + line) AS BIGINT) AS lines FROM o_calls JOIN o_offsets USING (path) GROUP BY 1) c ON f.large = c.large""")
def _(t):
    suffix = F.element_at(F.split("path", r"\."), -1)
    names = F.when(suffix == "py", "python").when(suffix == "js", "javascript").when(suffix == "cs", "csharp").otherwise(suffix)
    # The fixture gathers a fixed number of files into one text each.
    large = t.files.groupBy(suffix.alias("suffix"), F.concat(names, (F.col("file_id") / _LARGE).cast("bigint").cast("string")).alias("large")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "content"))), lambda f: f["content"]), "\n").alias("content"))
    facts = code.code_facts(large.select(F.concat("large", F.lit("."), "suffix").alias("path"), "content"))

    def lines(c):
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda n, f: n + f["line"])

    return facts.select(
        F.regexp_replace("path", r"\.\w+$", "").alias("large"), F.size("imports").cast("bigint").alias("n_imports"), F.size("sql_queries").cast("bigint").alias("n_sql"),
        lines("sql_queries").alias("sql_lines"), F.size("db_calls").cast("bigint").alias("n_calls"), lines("db_calls").alias("call_lines"))


# Files of seven languages with every kind of fact: imports of names, real bases, calls in fields of formatted strings.
_MIX = """
SELECT 'mix/f' || k || CASE o_orderkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.go' WHEN 3 THEN '.rb' WHEN 4 THEN '.java' WHEN 5 THEN '.sql' ELSE '.php' END AS path, k, o_orderkey % 7 AS kind,
  CASE o_orderkey % 7
    WHEN 0 THEN 'from pkg' || k || '.core import Alpha, Beta as b' || chr(10) || 'import os, m' || k || chr(10) || 'class C' || k || '(Base' || CAST(o_custkey % 3 AS STRING) || ', mod.Mixin, metaclass=M):' || chr(10)
      || '    ' || repeat(chr(34), 3) || 'import no' || repeat(chr(34), 3) || chr(10) || '    x = f' || chr(34) || '{db.fetch_all(1)} {{no.fetch(2)}}' || chr(34) || chr(10) || '    cur.execute(' || chr(34) || 'UPDATE u' || k || ' SET a = 1' || chr(34) || ')'
    WHEN 1 THEN 'import { A } from ' || chr(39) || './m' || k || chr(39) || ';' || chr(10) || 'const r = require(' || chr(39) || 'lib' || chr(39) || ');' || chr(10) || chr(10) || 'db.query(`SELECT * FROM t' || k || '`);'
    WHEN 2 THEN 'package m' || chr(10) || 'import ' || chr(34) || 'fmt' || chr(34) || chr(10) || 'import (' || chr(10) || '  db ' || chr(34) || 'database/sql' || chr(34) || chr(10) || '  ' || chr(34) || 'os' || k || chr(34) || chr(10) || ')' || chr(10) || 'q := `SELECT a FROM g' || k || '`'
    WHEN 3 THEN 'require ' || chr(39) || 'json' || k || chr(39) || chr(10) || 'db.execute(' || chr(34) || 'SELECT * FROM r' || k || chr(34) || ')'
    WHEN 4 THEN 'import a.b' || k || ';' || chr(10) || 'public class U' || k || ' extends B {' || chr(10) || '  ps.executeQuery(' || chr(34) || 'DELETE FROM j' || k || chr(34) || ');'
    WHEN 5 THEN 'CREATE TABLE s' || k || ' (id INT);' || chr(10) || 'create table if not exists s_log (id INT);'
    ELSE 'include_once ' || chr(39) || 'i' || k || '.php' || chr(39) || ';' || chr(10) || '$pdo->query(' || chr(34) || 'DELETE FROM p' || k || chr(34) || ')' || chr(59) END AS content
FROM (SELECT *, CAST(o_orderkey AS STRING) AS k FROM orders) o"""


def _mix_oracle() -> str:
    facts = {
        0: ["import|from|pkg{k}.core|Alpha", "import|from|pkg{k}.core|Beta", "import|import|os|", "import|import|m{k}|", "class|C{k}|Base{b},Mixin|", "call|db.fetch_all|5|", "call|cur.execute|6|",
            "sql|6|UPDATE|u{k}"],
        1: ["import|import|./m{k}|", "import|import|lib|", "call|query|4|", "sql|4|SELECT|t{k}"],
        2: ["import|import|fmt|", "import|import|database/sql|", "import|import|os{k}|", "sql|7|SELECT|g{k}"],
        3: ["import|import|json{k}|", "sql|2|SELECT|r{k}"],
        4: ["import|import|a.b{k}|", "class|U{k}||", "call|executeQuery|3|", "sql|3|DELETE|j{k}"],
        5: ["table|s{k}||", "table|s_log||"],
        6: ["import|import|i{k}.php|", "call|query|2|", "sql|2|DELETE|p{k}"],
    }
    parts = []
    for kind, rows in facts.items():
        for r in rows:
            text = "'" + r.replace("{k}", "' || k || '").replace("{b}", "' || CAST(o_custkey % 3 AS VARCHAR) || '") + "'"
            parts.append(f"SELECT path, {text} AS fact FROM v_mix WHERE kind = {kind}")
    return " UNION ALL ".join(parts)


cte("v_mix", sql=_MIX.replace("k, o_orderkey % 7 AS kind,", "k, o_custkey, o_orderkey % 7 AS kind,"))


@check("C8_all_facts", "v_mix", sql=_mix_oracle())
def _(t):
    facts = code.code_facts(t.sql(_MIX))

    def text(*parts):
        return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])

    rows = F.concat(
        F.transform("imports", lambda f: text(F.lit("import"), f["kind"], f["module"], f["name"])),
        F.transform("sql_queries", lambda f: text(F.lit("sql"), f["line"], f["type"], f["table"])),
        F.transform("db_calls", lambda f: text(F.lit("call"), f["name"], f["line"], F.lit(""))),
        F.transform("classes", lambda f: text(F.lit("class"), f["name"], F.array_join(f["bases"], ","), F.lit(""))),
        F.transform("tables_defined", lambda f: text(F.lit("table"), f, F.lit(""), F.lit(""))),
    )
    return facts.select("path", F.explode(rows).alias("fact"))


@check("C8_scan_of_a_tree", "o_lines", sql=r"""
SELECT count(*) AS n_sql FROM o_lines WHERE regexp_matches(text, '(?i)\b(SELECT|INSERT|UPDATE|DELETE)\b')
  AND (regexp_matches(text, '(?i)["''][^"'']*(SELECT|INSERT|UPDATE|DELETE)[^"'']*["'']') OR regexp_matches(text, '(?i)`[^`]*(SELECT|INSERT|UPDATE|DELETE)[^`]*`'))""")
def _(t):
    # Text files of a written tree have no language of their own, so the generic rules apply to their lines.
    path = scratch_path(t.spark, "code-tree")
    t.files.select("content").write.option("maxRecordsPerFile", 500).text(path)
    return code.scan_code(t.spark, path, extensions=[".txt"]).agg(F.coalesce(F.sum(F.size("sql_queries")), F.lit(0)).cast("bigint").alias("n_sql"))


cte("v_tree", "v_files", "v_docs", sql="""
SELECT path, content FROM v_files UNION ALL SELECT path, content FROM v_docs
UNION ALL SELECT 'app' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/package.json' WHEN 1 THEN '/go.mod' ELSE '/data.bin' END, p_name || chr(10) FROM part""")


def tree(t):
    """Code, documents, manifests and other files together."""
    other = t.sql(
        "SELECT 'app' || CAST(p_partkey AS STRING) || CASE p_partkey % 3 WHEN 0 THEN '/package.json' WHEN 1 THEN '/go.mod' "
        "ELSE '/data.bin' END AS path, p_name || chr(10) AS content FROM part"
    )
    return t.files.select("path", "content").unionByName(t.docs.select("path", "content")).unionByName(other)


_LINES = "CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END"
cte("o_tree", "v_tree", sql=f"""
SELECT CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'Python' WHEN '.java' THEN 'Java' WHEN '.js' THEN 'JavaScript' WHEN '.cs' THEN 'C#' WHEN '.php' THEN 'PHP' WHEN '.md' THEN 'Markdown' WHEN '.json' THEN 'JSON' END AS language,
       {_LINES} AS lines, regexp_matches(path, '/(package\\.json|go\\.mod)$') AS manifest, path FROM v_tree""")


@check("A5_repo_inventory", "o_tree", sql="""
SELECT count(*) AS total_files, CAST(sum(lines) FILTER (language IS NOT NULL) AS BIGINT) AS lines_of_code, count(DISTINCT language) AS language_count, count(*) FILTER (manifest) AS dependency_file_count,
       (SELECT string_agg(language || '=' || n, ',' ORDER BY language) FROM (SELECT language, count(*) AS n FROM o_tree WHERE language IS NOT NULL GROUP BY 1) l) AS languages
FROM o_tree""")
def _(t):
    entries = F.transform(F.map_entries("languages"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return code.repo_inventory(tree(t)).withColumn("languages", F.array_join(entries, ","))


@check("A5_language_counts", "o_tree", sql="""
SELECT language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, count(*) FILTER (manifest) AS manifests FROM o_tree GROUP BY 1""")
def _(t):
    return code.language_counts(tree(t))


@check("A5_dependency_files", "o_tree", sql="SELECT path FROM o_tree WHERE manifest")
def _(t):
    return code.dependency_files(tree(t))


@check("A5_lines_of_code", "o_tree", sql="SELECT CAST(sum(lines) AS BIGINT) AS lines_of_code FROM o_tree WHERE language IN ('Python', 'Java')")
def _(t):
    return code.lines_of_code(tree(t), [".py", ".java"])


@check("A11_security_issues", "o_security", sql="SELECT * FROM o_security")
def _(t):
    return flat_risks(security.security_issues(code_files(t), "file_id"))


@check("W1_first_matching_pattern", "o_findings", sql="SELECT path, issue_type, pattern_ord, CAST(hits AS INTEGER) AS hits FROM o_findings")
def _(t):
    return security.security_findings(code_files(t)).select("path", "issue_type", "pattern_ord", "hits")
