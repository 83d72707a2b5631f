"""Audit inputs derived from the given tables; the text runs on both engines.

``chr(39)``, ``chr(34)`` and ``chr(10)`` stand for quotes and line ends, because
the engines escape them differently.
"""

_PREFIX = (
    "CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'views' WHEN 'signup' THEN 'signups' "
    "WHEN 'purchase' THEN 'purchases' ELSE 'errors' END"
)

VIEWS = {
    # One log record per event, five statement shapes over 35 tables.
    "v_query_log": """
SELECT event_id AS seq, ts, value AS duration_ms,
       'db' || CAST(user_id % 3 AS STRING) AS database,
       'u' || CAST(user_id AS STRING) || '@corp.example.com' AS user_name,
       CASE event_type
         WHEN 'click'    THEN 'SELECT * FROM clicks_' || CAST(user_id % 7 AS STRING) || ' WHERE user_id = ' || CAST(user_id AS STRING) || ' AND page IN (' || chr(39) || 'p' || CAST(event_id AS STRING) || chr(39) || ')'
         WHEN 'view'     THEN 'select id  from views_' || CAST(user_id % 7 AS STRING) || ' where user_id = ' || CAST(user_id AS STRING) || ' order by id'
         WHEN 'signup'   THEN 'INSERT INTO signups_' || CAST(user_id % 7 AS STRING) || ' (user_id) VALUES (' || CAST(user_id AS STRING) || ')'
         WHEN 'purchase' THEN 'UPDATE purchases_' || CAST(user_id % 7 AS STRING) || ' SET total = 1 WHERE order_id = ' || CAST(event_id AS STRING)
         ELSE 'DELETE FROM errors_' || CAST(user_id % 7 AS STRING) || ' WHERE event_id > ' || CAST(event_id AS STRING) || ';'
       END AS query
FROM events""",
    # Table names of that log; even buckets index user_id.
    "v_tables": f"""
SELECT prefix || '_' || CAST(bucket AS STRING) AS table_name, min(event_id) AS seq
FROM (SELECT {_PREFIX} AS prefix, user_id % 7 AS bucket, event_id FROM events) t
GROUP BY prefix, bucket""",
    "v_schema": f"""
WITH named AS (SELECT DISTINCT {_PREFIX} || '_' || CAST(user_id % 7 AS STRING) AS table_name, user_id % 7 AS bucket FROM events)
SELECT table_name, 'user_id' AS column_name, bucket % 2 = 0 AS indexed FROM named
UNION ALL SELECT table_name, 'page', false FROM named
UNION ALL SELECT table_name, 'order_id', false FROM named
UNION ALL SELECT table_name, 'event_id', false FROM named""",
    "v_columns": f"""
WITH named AS (SELECT DISTINCT {_PREFIX} || '_' || CAST(user_id % 7 AS STRING) AS table_name, 'users_' || CAST(user_id % 7 % 2 AS STRING) AS owner, 'purchases_' || CAST(user_id % 7 AS STRING) AS bought FROM events)
SELECT table_name, 'user_id' AS column_name, owner AS fk_table, CAST(0 AS BIGINT) AS seq FROM named
UNION ALL SELECT table_name, 'owner_id', owner, CAST(1 AS BIGINT) FROM named
UNION ALL SELECT table_name, 'order_id', bought, CAST(2 AS BIGINT) FROM named
UNION ALL SELECT table_name, 'page', CAST(NULL AS STRING), CAST(3 AS BIGINT) FROM named""",
    "v_docs": """
SELECT doc_id, source || '/' || CAST(doc_id AS STRING) || '.md' AS path,
       text || ' Contact ops' || CAST(doc_id % 13 AS STRING) || ' for access.' ||
       CASE WHEN doc_id % 3 = 0 THEN ' Only dba' || CAST(doc_id % 5 AS STRING) || ' knows it. Manually restart the job and ssh into the host.' ELSE '' END AS content
FROM documents""",
    "v_files": """
SELECT o_orderkey AS file_id,
       'src/m' || CAST(o_orderkey AS STRING) || CASE o_orderkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.js' WHEN 3 THEN '.cs' ELSE '.php' END AS path,
       CASE o_orderkey % 5
         WHEN 0 THEN 'import m' || CAST(o_orderkey - 5 AS STRING) || chr(10) || 'class S' || CAST(o_orderkey AS STRING) || '(Base):' || chr(10) || '    c.execute(' || chr(34) || 'SELECT * FROM orders WHERE id = ?' || chr(34) || ')' || chr(10) || 'password = ' || chr(34) || 'x' || CAST(o_custkey AS STRING) || chr(34)
         WHEN 1 THEN 'import java.sql.Connection;' || chr(10) || 'String q = ' || chr(34) || 'INSERT INTO customer VALUES (?)' || chr(34) || ';' || chr(10) || 's.executeUpdate(q);'
         WHEN 2 THEN 'const db = require(' || chr(39) || './m' || CAST(o_custkey % 50 AS STRING) || chr(39) || ');' || chr(10) || 'db.query(`SELECT * FROM part`);' || chr(10) || 'fetch(' || chr(34) || 'http://api.example.com' || chr(34) || ');'
         WHEN 3 THEN 'using System.Data;' || chr(10) || 'var q = @' || chr(34) || 'DELETE FROM lineitem' || chr(34) || ';' || chr(10) || 'cmd.ExecuteReader();'
         ELSE 'require_once ' || chr(34) || 'db.php' || chr(34) || ';' || chr(10) || 'mysqli_query($c, ' || chr(34) || 'SELECT s FROM supplier' || chr(34) || ');'
       END AS content
FROM orders""",
    # SQL scripts: one per part.
    "v_scripts": """
SELECT p_partkey AS file_id, 'db/t' || CAST(p_partkey AS STRING) || '.sql' AS path,
       'CREATE TABLE t' || CAST(p_partkey AS STRING) || ' (id INTEGER, name VARCHAR(20), made DATETIME, big BIGINT, price DECIMAL(9,2));' || chr(10) ||
       'create table if not exists log_' || CAST(p_size AS STRING) || ' (id INT, at TIMESTAMP);' || chr(10) ||
       CASE WHEN p_partkey % 2 = 0 THEN 'CREATE UNIQUE INDEX ix' || CAST(p_partkey AS STRING) || ' ON t' || CAST(p_partkey AS STRING) || ' (id);' ELSE 'INSERT INTO x VALUES (1);' END AS content
FROM part""",
    # Directed acyclic, hubs at nations.
    "v_edges": """
SELECT 'supplier:' || CAST(s_suppkey AS STRING) AS src, 'nation:' || CAST(s_nationkey AS STRING) AS dst FROM supplier
UNION SELECT 'nation:' || CAST(n_nationkey AS STRING), 'region:' || CAST(n_regionkey AS STRING) FROM nation""",
    "v_nodes": """
SELECT 'supplier:' || CAST(s_suppkey AS STRING) AS id, 'supplier' AS type, s_name AS name FROM supplier
UNION ALL SELECT 'nation:' || CAST(n_nationkey AS STRING), 'nation', n_name FROM nation
UNION ALL SELECT 'region:' || CAST(r_regionkey AS STRING), 'region', r_name FROM region""",
    # Event-type transitions: a dense digraph on five nodes.
    "v_cyclic": """
SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) t WHERE dst IS NOT NULL AND dst <> src""",
    # Which modules use which log tables.
    "v_uses": """
SELECT DISTINCT 'module:src/m' || CAST(o_custkey % 40 AS STRING) || '.py' AS src,
       'table:' || CASE o_orderkey % 5 WHEN 0 THEN 'Clicks' WHEN 1 THEN 'views' WHEN 2 THEN 'signups' WHEN 3 THEN 'purchases' ELSE 'errors' END || '_' || CAST(o_orderkey % 7 AS STRING) AS dst,
       CASE WHEN o_custkey % 11 = 0 THEN 'references' ELSE 'uses' END AS type
FROM orders""",
    "v_reviews": """
SELECT 'art' || CAST(user_id AS STRING) AS artifact_id,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'request_changes' WHEN 'error' THEN 'rejected' ELSE 'approved' END AS decision, ts, event_id AS seq
FROM events""",
    "v_history": """
SELECT user_id AS engagement_id, event_id AS seq, from_state, to_state FROM (
  SELECT user_id, event_id, lag(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, st AS to_state FROM (
    SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'new' WHEN 'view' THEN 'ingested' WHEN 'click' THEN 'analyzed' WHEN 'purchase' THEN 'reviewed' ELSE 'finalized' END AS st FROM events) a) b
WHERE from_state IS NOT NULL""",
    # What each engagement has delivered.
    "v_artifacts": """
SELECT DISTINCT user_id AS engagement_id,
       CASE (event_id + user_id) % 23 WHEN 0 THEN 'repo_inventory' WHEN 1 THEN 'db_schema' WHEN 2 THEN 'topology' WHEN 3 THEN 'cost_drivers' WHEN 4 THEN 'risk_register' WHEN 5 THEN 'review_approval' WHEN 6 THEN 'executive_summary' WHEN 7 THEN 'technical_appendix' ELSE 'notes' END AS artifact_type
FROM events""",
    # Findings of known severity, category and confidence.
    "v_findings": """
SELECT event_id AS seq,
       CASE user_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE 'OTHER' END AS severity,
       CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END AS confidence,
       CASE event_type WHEN 'signup' THEN 'security' WHEN 'click' THEN 'spof' WHEN 'error' THEN 'documentation' WHEN 'view' THEN 'manual_ops' ELSE 'operational' END AS category
FROM events""",
}
