"""Dependency-graph operators."""

from pyspark.sql import functions as F

from auditframe.operators import code, cycles, graph, risk
from auditframe.session import materialize
from checks.registry import cte, check
from checks.text_queries import flat_risks

# Tables the derived source files may use; two of the five are left out.
_SYSTEM_TABLES = "SELECT 'orders' AS name UNION ALL SELECT 'Customer' UNION ALL SELECT 'part'"

cte("o_tables", sql=_SYSTEM_TABLES)
cte("o_uses", "o_sql", "o_tables", sql="""
SELECT src, dst, 'uses' AS type, 'line=' || line || ',query_type=' || type AS metadata FROM (
  SELECT 'module:' || s.path AS src, 'table:' || t.name AS dst, s.line, s.type, row_number() OVER (PARTITION BY s.path, t.name ORDER BY s.line DESC, s.type DESC) AS rn
  FROM o_sql s JOIN o_tables t ON lower(s."table") = lower(t.name)
  WHERE s.language IN ('python', 'java', 'javascript', 'php')) u WHERE rn = 1""")
cte("o_import_exact", "v_files", sql="""
SELECT 'module:m' || a.file_id || '.py' AS src, 'module:m' || b.file_id || '.py' AS dst, 'imports' AS type, 'import=m' || b.file_id AS metadata
FROM v_files a JOIN v_files b ON a.file_id - 5 = b.file_id WHERE a.file_id % 5 = 0""")
cte("o_import_suffix", "v_files", sql="""
SELECT 'module:src/m' || a.file_id || '.py' AS src, 'module:src/m' || b.file_id || '.py' AS dst, 'imports' AS type, 'import=m' || b.file_id AS metadata
FROM v_files a JOIN v_files b ON a.file_id - 5 = b.file_id WHERE a.file_id % 5 = 0""")
cte("o_fk", "v_columns", sql="""
SELECT 'table:' || table_name AS src, 'table:' || fk_table AS dst, 'references' AS type, 'column=' || arg_max(column_name, seq) AS metadata
FROM v_columns WHERE fk_table IS NOT NULL GROUP BY table_name, fk_table""")
# Shortest paths by enumeration; graphs of the fixtures have a small diameter.
cte("o_links", "v_edges", sql="SELECT DISTINCT src, dst FROM v_edges WHERE src <> dst")
cte("o_cyclic_links", "v_cyclic", sql="SELECT DISTINCT src, dst FROM v_cyclic UNION SELECT src, src || '_leaf' FROM v_cyclic")


def _betweenness_sql(links: str, nodes: str) -> str:
    return f"""
SELECT n.id, round(coalesce(b.score, 0) / CASE WHEN c.n > 2 THEN (c.n - 1) * (c.n - 2) ELSE 1 END, 9) AS betweenness_centrality
FROM ({nodes}) n
LEFT JOIN (
  SELECT node, sum(share) AS score FROM (
    SELECT unnest(path[2:len(path) - 1]) AS node, 1.0 / sigma AS share FROM (
      SELECT path, count(*) OVER (PARTITION BY path[1], path[len(path)]) AS sigma FROM (
        SELECT path, len(path) AS l, min(len(path)) OVER (PARTITION BY path[1], path[len(path)]) AS shortest FROM walk) s
      WHERE l = shortest) p
    WHERE len(path) > 2) q
  GROUP BY node) b ON n.id = b.node, (SELECT count(*) AS n FROM ({nodes}) x) c"""


def _walk(links: str) -> str:
    return f"""
SELECT [src, dst] AS path FROM {links}
UNION ALL SELECT list_append(w.path, l.dst) FROM walk w JOIN {links} l ON w.path[len(w.path)] = l.src WHERE NOT list_contains(w.path, l.dst)"""


_ENDS = "SELECT src AS id FROM {0} UNION SELECT dst FROM {0}"


def _metadata(df):
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return df.withColumn("metadata", F.array_join(pairs, ","))


def _system_nodes(t):
    tables = t.sql(_SYSTEM_TABLES).select(
        F.concat(F.lit("table:"), "name").alias("id"), F.lit("table").alias("type"), "name", F.create_map().cast("map<string,string>").alias("metadata")
    )
    return graph.module_nodes(t.files).unionByName(tables)


@check("J3_code_db_edges", "o_uses", sql="SELECT * FROM o_uses")
def _(t):
    return _metadata(graph.code_db_edges(t.code_sql, _system_nodes(t)))


@check("J4_import_edges_exact", "o_import_exact", sql="SELECT * FROM o_import_exact")
def _(t):
    flat = t.files.withColumn("path", F.replace("path", F.lit("src/"), F.lit("")))
    return _metadata(graph.import_edges(code.python_imports(flat), graph.module_nodes(flat)))


@check("J4_import_edges_suffix", "o_import_suffix", sql="SELECT * FROM o_import_suffix")
def _(t):
    return _metadata(graph.import_edges(code.python_imports(t.files), graph.module_nodes(t.files), "suffix"))


@check("J5_fk_edges", "o_fk", sql="SELECT * FROM o_fk")
def _(t):
    return _metadata(graph.fk_edges(t.schema_columns))


@check("J5_implicit_nodes", "o_fk", "v_tables", sql="""
SELECT DISTINCT dst AS id, 'unknown' AS type, dst AS name FROM o_fk WHERE substr(dst, 7) NOT IN (SELECT table_name FROM v_tables)""")
def _(t):
    return graph.implicit_nodes(graph.fk_edges(t.schema_columns), graph.table_nodes(t.schema_tables)).drop("metadata")


cte("o_flat_uses", "o_uses", sql="SELECT replace(src, 'module:src/', 'module:') AS src, dst, type, metadata FROM o_uses")


@check("G1_build_graph_edges", "o_fk", "o_flat_uses", "o_import_exact", sql="""
SELECT src, dst, type, metadata FROM o_fk UNION ALL SELECT src, dst, type, metadata FROM o_flat_uses UNION ALL SELECT src, dst, type, metadata FROM o_import_exact""")
def _(t):
    return _metadata(_graph(t)[1])


@check("G1_build_graph_nodes", "o_fk", "v_files", "v_tables", sql="""
SELECT 'module:' || replace(path, 'src/', '') AS id, 'module' AS type, replace(path, 'src/', '') AS name FROM v_files
UNION ALL SELECT 'table:' || table_name, 'table', table_name FROM v_tables
UNION ALL SELECT 'table:' || name, 'table', name FROM (SELECT 'orders' AS name UNION ALL SELECT 'Customer' UNION ALL SELECT 'part') x
UNION ALL SELECT DISTINCT dst, 'unknown', dst FROM o_fk WHERE substr(dst, 7) NOT IN (SELECT table_name FROM v_tables)""")
def _(t):
    return _graph(t)[0].drop("metadata")


def _flat(t):
    """The files at the root of their tree, where modules import each other by name."""
    return t.files.withColumn("path", F.replace("path", F.lit("src/"), F.lit("")))


def _graph(t, files=None):
    extra = t.sql(_SYSTEM_TABLES).select(
        F.lit(-1).cast("bigint").alias("seq"), F.col("name").alias("table"),
        F.lit(0).cast("bigint").alias("n_columns"), F.lit(0).cast("bigint").alias("n_indexes"),
    )
    files = _flat(t) if files is None else files
    return graph.build_graph(
        files, t.schema_tables.unionByName(extra), t.schema_columns, code.code_sql(files), code.python_imports(files)
    )


# Four dumps of three databases that share names: a has all log tables, b those of even buckets, c and d a few.
_DUMPS = """
SELECT 'a' AS dump, 'db0' AS database, table_name FROM v_tables
UNION ALL SELECT 'b', 'db1', table_name FROM v_tables WHERE CAST(substr(table_name, length(table_name)) AS INT) % 2 = 0
UNION ALL SELECT 'c', 'db1', table_name FROM v_tables WHERE table_name IN ('purchases_0', 'clicks_2')
UNION ALL SELECT 'd', 'db2', table_name FROM v_tables WHERE table_name IN ('clicks_0', 'clicks_1')
UNION ALL SELECT 'a', 'db0', 'orders' UNION ALL SELECT 'b', 'db1', 'orders' UNION ALL SELECT 'a', 'db0', 'Customer'"""
cte("o_dumps", "v_tables", sql=_DUMPS)
cte("o_scoped", "o_dumps", sql="""
SELECT dump, database, table_name, lower(table_name) AS key, 'table:' || CASE
  WHEN count(*) OVER (PARTITION BY lower(table_name)) = 1 THEN table_name
  WHEN count(*) OVER (PARTITION BY lower(table_name), database) = 1 THEN database || '.' || table_name ELSE dump || '.' || table_name END AS id
FROM o_dumps""")
cte("o_scoped_fk", "o_scoped", "v_columns", sql="""
SELECT f.id AS src, coalesce(s.id, d.id, g.id, 'table:' || f.fk_table) AS dst, 'references' AS type, 'column=' || f.col AS metadata
FROM (SELECT o.dump, o.database, o.id, c.fk_table, arg_max(c.column_name, c.seq) AS col FROM o_scoped o JOIN v_columns c ON c.table_name = o.table_name
      WHERE c.fk_table IS NOT NULL GROUP BY ALL) f
LEFT JOIN o_scoped s ON s.dump = f.dump AND s.key = f.fk_table
LEFT JOIN (SELECT database, key, min(id) AS id FROM o_scoped GROUP BY ALL HAVING count(*) = 1) d ON d.database = f.database AND d.key = f.fk_table
LEFT JOIN (SELECT key, min(id) AS id FROM o_scoped GROUP BY ALL HAVING count(*) = 1) g ON g.key = f.fk_table""")
cte("o_scoped_uses", "o_scoped", "o_sql", sql="""
SELECT src, dst, 'uses' AS type, 'line=' || line || ',query_type=' || type AS metadata FROM (
  SELECT 'module:' || s.path AS src, n.dst, s.line, s.type, row_number() OVER (PARTITION BY s.path, n.dst ORDER BY s.line DESC, s.type DESC) AS rn
  FROM o_sql s JOIN (SELECT DISTINCT key, CASE WHEN id = 'table:' || table_name THEN id ELSE 'table:' || key END AS dst FROM o_scoped) n ON lower(s."table") = n.key
  WHERE s.language IN ('python', 'java', 'javascript', 'php')) u WHERE rn = 1""")


def _scoped_graph(t):
    dumps = t.sql(_DUMPS)
    tables = dumps.select("dump", "database", F.lit(0).cast("bigint").alias("seq"), F.col("table_name").alias("table"),
                          F.lit(4).cast("bigint").alias("n_columns"), F.lit(0).cast("bigint").alias("n_indexes"))
    columns = dumps.withColumnRenamed("table_name", "table").join(t.schema_columns, "table")
    return graph.build_graph(t.files, tables, columns, t.code_sql, code.python_imports(t.files))


@check("G1_scoped_edges", "o_scoped_fk", "o_scoped_uses", sql="SELECT * FROM o_scoped_fk UNION ALL SELECT * FROM o_scoped_uses")
def _(t):
    return _metadata(_scoped_graph(t)[1])


@check("G1_scoped_nodes", "o_scoped", "o_scoped_fk", "o_scoped_uses", "v_files", sql="""
SELECT 'module:' || path AS id, 'module' AS type, path AS name FROM v_files
UNION ALL SELECT id, 'table', table_name FROM o_scoped
UNION ALL SELECT DISTINCT dst, 'unknown', dst FROM (SELECT dst FROM o_scoped_fk UNION SELECT dst FROM o_scoped_uses) x WHERE dst NOT IN (SELECT id FROM o_scoped)""")
def _(t):
    return _scoped_graph(t)[0].drop("metadata")


@check("G2_node_degrees", "v_uses", sql="""
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) + sum(o) AS BIGINT) AS degree
FROM (SELECT src AS id, 0 AS i, 1 AS o FROM v_uses UNION ALL SELECT dst, 1, 0 FROM v_uses) x GROUP BY id""")
def _(t):
    return graph.node_degrees(t.view("v_uses"))


cte("walk_e", "o_links", sql=_walk("o_links").replace("walk", "walk_e"))
cte("walk_c", "o_cyclic_links", sql=_walk("o_cyclic_links").replace("walk", "walk_c"))
cte("o_between", "walk_e", "v_nodes", sql=_betweenness_sql("o_links", "SELECT id FROM v_nodes").replace("walk", "walk_e"))


@check("G2_graph_metrics", "v_edges", "v_nodes", "o_between", recursive=True, sql="""
SELECT n.n AS node_count, e.m AS edge_count, round(e.m / (n.n * (n.n - 1.0)), 9) AS density, round(d.degree / (n.n - 1.0), 9) AS max_degree_centrality,
       (SELECT max(betweenness_centrality) FROM o_between) AS max_betweenness_centrality
FROM (SELECT count(*) AS n FROM v_nodes) n, (SELECT count(*) AS m FROM v_edges) e,
     (SELECT max(degree) AS degree FROM (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM v_edges UNION ALL SELECT dst FROM v_edges) x GROUP BY id) y) d""")
def _(t):
    row = graph.graph_metrics(t.nodes, t.edges, graph.betweenness(t.edges, t.nodes))
    return row.withColumns({c: F.round(c, 9) for c in ("density", "max_degree_centrality", "max_betweenness_centrality")})


@check("G3_betweenness_hubs", "o_between", sql="SELECT * FROM o_between", recursive=True)
def _(t):
    return graph.betweenness(t.edges, t.nodes).withColumn("betweenness_centrality", F.round("betweenness_centrality", 9))


@check("G3_betweenness_cyclic", "walk_c", "o_cyclic_links", recursive=True,
       sql=_betweenness_sql("o_cyclic_links", _ENDS.format("o_cyclic_links")).replace("walk", "walk_c"))
def _(t):
    links = t.sql("SELECT src, dst FROM v_cyclic UNION SELECT src, src || '_leaf' FROM v_cyclic")
    found = graph.betweenness(links, source_batches=2)
    return found.withColumn("betweenness_centrality", F.round("betweenness_centrality", 9))


_SPOF_FLOOR = 0.0001
cte("o_spofs", "o_between", "v_nodes", "v_edges", sql=f"""
SELECT b.id AS node_id, n.type AS node_type, n.name AS node_name, b.betweenness_centrality, d.degree AS dependencies_count, d.in_degree AS dependent_count,
       CASE WHEN b.betweenness_centrality > 0.3 THEN 'high' ELSE 'medium' END AS risk_level
FROM o_between b JOIN v_nodes n ON b.id = n.id
JOIN (SELECT id, count(*) AS degree, count(*) FILTER (i = 1) AS in_degree FROM (SELECT src AS id, 0 AS i FROM v_edges UNION ALL SELECT dst, 1 FROM v_edges) x GROUP BY id) d ON d.id = b.id
WHERE b.betweenness_centrality > {_SPOF_FLOOR}""")


def _spofs(t):
    central = graph.betweenness(t.edges, t.nodes).withColumn(
        "betweenness_centrality", F.round("betweenness_centrality", 9)
    )
    return graph.spofs(central, t.nodes, t.edges, _SPOF_FLOOR)


@check("G3_spofs", "o_spofs", sql="SELECT * FROM o_spofs", recursive=True)
def _(t):
    return _spofs(t)


@check("K5_ranked_spofs", "o_spofs", recursive=True, sql="""
SELECT node_id, betweenness_centrality FROM o_spofs""")
def _(t):
    return graph.ranked_spofs(_spofs(t)).select("node_id", "betweenness_centrality")


@check("G4_simple_cycles", "v_cyclic", recursive=True, sql="""
, paths AS (
  SELECT src AS start, dst AS last, [src, dst] AS path FROM v_cyclic WHERE src < dst
  UNION ALL SELECT p.start, c.dst, list_append(p.path, c.dst) FROM paths p JOIN v_cyclic c ON p.last = c.src WHERE c.dst > p.start AND NOT list_contains(p.path, c.dst))
SELECT CAST(len(p.path) AS INTEGER) AS length, array_to_string(p.path, '>') AS path FROM paths p JOIN v_cyclic c ON p.last = c.src AND c.dst = p.start""")
def _(t):
    return graph.simple_cycles(t.view("v_cyclic")).withColumn("path", F.array_join("path", ">"))


# The dense cycles of event types, with a tail of customers that leads to them, one of parts that leads off, and a ring of suppliers beside them.
_TAILS = """
SELECT src, dst FROM v_cyclic
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), CASE WHEN c_custkey = m THEN 'view' ELSE 'c' || CAST(c_custkey + 1 AS STRING) END FROM customer, (SELECT max(c_custkey) AS m FROM customer) x
UNION ALL SELECT CASE WHEN p_partkey = m THEN 'click' ELSE 'part' || CAST(p_partkey - 1 AS STRING) END, 'part' || CAST(p_partkey AS STRING) FROM part, (SELECT min(p_partkey) AS m FROM part) z
UNION ALL SELECT 'ring' || CAST(s_suppkey AS STRING), 'ring' || CAST((s_suppkey + 1) % n AS STRING) FROM supplier, (SELECT count(*) AS n FROM supplier) y"""
cte("o_circuits", "v_cyclic", sql="""
SELECT src AS start, dst AS last, [src, dst] AS path FROM v_cyclic WHERE src < dst
UNION ALL SELECT p.start, c.dst, list_append(p.path, c.dst) FROM o_circuits p JOIN v_cyclic c ON p.last = c.src WHERE c.dst > p.start AND NOT list_contains(p.path, c.dst)""")
cte("o_reach", "v_cyclic", sql="SELECT src, dst FROM v_cyclic UNION SELECT r.src, c.dst FROM o_reach r JOIN v_cyclic c ON r.dst = c.src")
cte("o_strong", "o_reach", sql="SELECT a.src AS node, min(a.dst) AS component FROM o_reach a JOIN o_reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src")


@check("G4_cycles_with_tails", "o_circuits", recursive=True, sql="""
SELECT CAST(len(p.path) AS INTEGER) AS length, array_to_string(p.path, '>') AS path FROM o_circuits p JOIN v_cyclic c ON p.last = c.src AND c.dst = p.start
UNION ALL SELECT CAST(count(*) AS INTEGER), 'ring' FROM supplier""")
def _(t):
    found = graph.simple_cycles(t.sql(_TAILS))
    is_ring = F.startswith(F.get("path", F.lit(0)), F.lit("ring"))
    return found.withColumn("path", F.when(is_ring, "ring").otherwise(F.array_join("path", ">")))


@check("G4_strong_components", "o_strong", recursive=True, sql="""
SELECT node, component FROM o_strong UNION ALL SELECT 'ring' || s_suppkey, 'ring0' FROM supplier""")
def _(t):
    return cycles.strong_components(t.sql(_TAILS))


@check("G4_component_report", "o_circuits", "o_strong", recursive=True, sql="""
SELECT component, count(*) AS nodes, (SELECT count(*) FROM v_cyclic) AS edges,
  (SELECT count(*) FROM v_cyclic a JOIN v_cyclic b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst) AS circuits, false AS complete FROM o_strong GROUP BY component
UNION ALL SELECT 'ring0', count(*), count(*), 1, true FROM supplier""")
def _(t):
    # With room for ten open paths the dense component is given up after its circuits of two nodes; the ring is not.
    return cycles.cycle_search(t.sql(_TAILS), max_paths=10)[1]


@check("G5_spof_risks", "o_spofs", recursive=True, sql="""
SELECT 'SPOF: ' || node_name AS title,
       'Component "' || node_name || '" is a single point of failure. It has high centrality (' || printf('%.3f', betweenness_centrality) || ') and is critical to system operation.' AS description,
       CASE risk_level WHEN 'high' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'spof' AS category, 'high' AS confidence, CAST(NULL AS VARCHAR) AS mitigation,
       'topology|topology.json|Betweenness centrality: ' || printf('%.3f', betweenness_centrality) AS evidence, CAST(dependent_count AS VARCHAR) AS dependent_count
FROM o_spofs""")
def _(t):
    return flat_risks(risk.spof_risks(_spofs(t)), F.col("attrs")["dependent_count"].alias("dependent_count")).drop(
        "detector_ord", "item_key"
    )


@check("G6_topology_statistics", "o_fk", "o_uses", "v_files", "v_tables", sql="""
, links AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM o_fk UNION ALL SELECT src, dst FROM o_uses) x WHERE src <> dst)
SELECT f.n + t.n + 3 + i.n AS total_nodes, f.n AS modules, t.n + 3 AS tables, e.n AS total_edges, s.n AS spof_count
FROM (SELECT count(*) AS n FROM v_files) f, (SELECT count(*) AS n FROM v_tables) t,
     (SELECT count(DISTINCT dst) AS n FROM o_fk WHERE substr(dst, 7) NOT IN (SELECT table_name FROM v_tables)) i,
     (SELECT (SELECT count(*) FROM o_fk) + (SELECT count(*) FROM o_uses) AS n) e,
     (SELECT count(DISTINCT a.dst) AS n FROM links a JOIN links b ON a.dst = b.src LEFT JOIN links c ON c.src = a.src AND c.dst = b.dst
      WHERE a.src <> b.dst AND c.src IS NULL) s""")
def _(t):
    # Every node that lies between two others counts; only such nodes are the middle of two edges without a shorter way.
    nodes, edges = (materialize(x, "graph") for x in _graph(t, t.files))
    found = graph.spofs(graph.betweenness(edges, nodes), nodes, edges, threshold=0.0)
    return graph.topology_statistics(nodes, edges, found)
