"""Risk register, roll-up and lifecycle operators."""

from pyspark.sql import functions as F

from auditframe.plans import audit
from auditframe.operators import documents, graph, lifecycle, query_log, report, risk, schema, security
from checks.code_queries import code_files
from checks.graph_queries import _spofs
from checks.registry import cte, check
from checks.text_queries import flat_risks
from auditframe.session import materialize

_COLUMNS = "detector_ord, item_key, title, description, severity, category, confidence, mitigation, evidence"

cte("o_unindexed", "v_tables", "v_schema", sql="""
SELECT seq, table_name AS "table" FROM v_tables WHERE lower(table_name) NOT IN (SELECT lower(table_name) FROM v_schema WHERE indexed)""")
cte("o_unindexed_risk", "o_unindexed", sql="""
SELECT 5 AS detector_ord, '0' AS item_key, 'Tables Without Indexes' AS title,
       'Found ' || n || ' table(s) without any indexes: ' || names || '. This can lead to slow query performance.' AS description,
       'MEDIUM' AS severity, 'operational' AS category, 'high' AS confidence, 'Add appropriate indexes based on query patterns' AS mitigation,
       'database|database.json|Unindexed tables: ' || names AS evidence
FROM (SELECT (SELECT count(*) FROM o_unindexed) AS n, string_agg("table", ', ' ORDER BY seq) AS names FROM (SELECT * FROM o_unindexed ORDER BY seq LIMIT 5) f) x""")
cte("o_gap", "v_files", "v_docs", sql="""
SELECT 4 AS detector_ord, '0' AS item_key, 'Insufficient Documentation' AS title,
       'Found only ' || d || ' documentation file(s) for ' || c || ' code files. Documentation coverage is ' || printf('%.1f', CAST(d AS DOUBLE) / c * 100) || '%. This makes the system harder to maintain and onboard new team members.' AS description,
       'HIGH' AS severity, 'documentation' AS category, 'high' AS confidence, 'Create README files, architecture docs, and inline code comments' AS mitigation,
       'repository|repository.json|' || c || ' code files, ' || d || ' docs' AS evidence
FROM (SELECT (SELECT count(*) FROM v_docs) AS d, (SELECT count(*) FROM v_files) AS c) x WHERE c > 0 AND CAST(d AS DOUBLE) / c < 0.1""")
cte("o_spof_risk", "o_spofs", sql="""
SELECT 0 AS detector_ord, lpad(printf('%.12f', 2.0 - betweenness_centrality), 20, '0') || '/' || node_id AS item_key, 'SPOF: ' || node_name AS title,
       'Component "' || node_name || '" is a single point of failure. It has high centrality (' || printf('%.3f', betweenness_centrality) || ') and is critical to system operation.' AS description,
       CASE risk_level WHEN 'high' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, 'spof' AS category, 'high' AS confidence, CAST(NULL AS VARCHAR) AS mitigation,
       'topology|topology.json|Betweenness centrality: ' || printf('%.3f', betweenness_centrality) AS evidence
FROM o_spofs""")
_SCORE = (
    "(CASE severity WHEN 'CRITICAL' THEN 10.0::DOUBLE WHEN 'HIGH' THEN 7.0::DOUBLE WHEN 'LOW' THEN 2.0::DOUBLE ELSE 4.0::DOUBLE END) * "
    "(CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'low' THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END)"
)
_SEVERITY_ORDER = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'LOW' THEN 3 ELSE 2 END"
cte("o_register", "o_spof_risk", "o_tribal", "o_manual", "o_security", "o_gap", "o_unindexed_risk", sql=f"""
SELECT *, {_SCORE} AS risk_score FROM (""" + " UNION ALL ".join(
    f"SELECT {_COLUMNS} FROM {c}" for c in ("o_spof_risk", "o_tribal", "o_manual", "o_security", "o_gap", "o_unindexed_risk")
) + ") u")
_RISK_ORDER = f"risk_score DESC, {_SEVERITY_ORDER}, detector_ord, item_key"


def _register(t, spofs=None):
    """Every detector's risks. Each query below reads them once, so they are not written out and columns it leaves aside are not made."""
    return risk.risk_register(
        risk.spof_risks(_spofs(t) if spofs is None else spofs),
        documents.tribal_knowledge(t.docs, "doc_id"),
        documents.manual_operations(t.docs, "doc_id"),
        security.security_issues(code_files(t), "file_id"),
        risk.documentation_gap(t.files, t.docs),
        schema.unindexed_risk(schema.unindexed_tables(t.schema_tables, t.schema_indexes)),
    )


def _advised(t):
    stats = materialize(t.stats, "stats")
    return query_log.missing_indexes(query_log.cost_drivers(stats), t.schema_indexes)


@check("J6_unindexed_tables", "o_unindexed", sql="SELECT * FROM o_unindexed")
def _(t):
    return schema.unindexed_tables(t.schema_tables, t.schema_indexes)


@check("J6_unindexed_risk", "o_unindexed_risk", sql="SELECT * FROM o_unindexed_risk")
def _(t):
    return flat_risks(schema.unindexed_risk(schema.unindexed_tables(t.schema_tables, t.schema_indexes)))


@check("J7_documentation_gap", "o_gap", sql="SELECT * FROM o_gap")
def _(t):
    return flat_risks(risk.documentation_gap(t.files, t.docs))


@check("U1_risk_register", "o_register", sql="SELECT * FROM o_register", recursive=True)
def _(t):
    return flat_risks(_register(t), "risk_score")


@check("K2_risk_score", "v_findings", sql=f"SELECT seq, {_SCORE} AS risk_score FROM v_findings")
def _(t):
    return risk.score_risks(t.view("v_findings")).select("seq", "risk_score")


@check("K2_rank_risks", "o_register", recursive=True, sql=f"""
SELECT title, severity, risk_score FROM o_register ORDER BY {_RISK_ORDER} LIMIT 15""")
def _(t):
    return risk.rank_risks(_register(t)).select("title", "severity", "risk_score")


@check("A12_risk_summary", "v_findings", sql="""
SELECT count(*) AS total_risks, count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'HIGH') AS high_count,
       count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'LOW') AS low_count FROM v_findings""")
def _(t):
    return risk.risk_summary(t.view("v_findings"))


@check("A12_audit_totals", "o_register", recursive=True, sql="""
SELECT count(*) AS total_risks, count(*) FILTER (severity = 'CRITICAL') AS critical_count, count(*) FILTER (severity = 'HIGH') AS high_count,
       count(*) FILTER (severity = 'MEDIUM') AS medium_count, count(*) FILTER (severity = 'LOW') AS low_count FROM o_register""")
def _(t):
    # The composition that run_audit uses, over the whole register.
    return audit.risk_analysis(code_files(t), t.docs, t.schema_tables, t.schema_indexes, materialize(_spofs(t), "spofs"))["risk_summary"]


@check("A12_risks_by_category", "v_findings", sql="SELECT category, count(*) AS risk_count FROM v_findings GROUP BY 1")
def _(t):
    return risk.risks_by_category(t.view("v_findings"))


@check("A13_business_value", "o_top", "o_register", recursive=True, sql="""
SELECT round(c.s * 0.4, 6) AS cost_savings_potential_ms, round(c.s * 0.4 / 1000 / 60 / 60, 9) AS cost_savings_potential_hours_per_day, c.h AS high_impact_cost_drivers,
       c.n AS total_optimizable_queries, r.c AS critical_risks_to_mitigate, r.h AS high_risks_to_mitigate
FROM (SELECT coalesce(sum(total_cost_ms) FILTER (impact = 'HIGH'), 0) AS s, count(*) FILTER (impact = 'HIGH') AS h, count(*) AS n FROM o_top) c,
     (SELECT count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h FROM o_register) r""")
def _(t):
    value = report.business_value(query_log.top_cost_drivers(t.drivers), _register(t))
    return value.withColumns({
        "cost_savings_potential_ms": F.round("cost_savings_potential_ms", 6),
        "cost_savings_potential_hours_per_day": F.round("cost_savings_potential_hours_per_day", 9),
    })


@check("A14_audit_metrics", "o_stats", "o_top", "o_register", "o_spofs", "v_nodes", "v_edges", recursive=True, sql="""
SELECT n.n AS total_components, e.n AS total_dependencies, s.n AS spof_count, round(c.total, 2) AS total_cost_ms, c.h AS high_impact_costs, CAST(q.n AS BIGINT) AS queries_analyzed,
       r.n AS total_risks, r.c AS critical_risks, r.h AS high_risks, r.s AS security_issues
FROM (SELECT count(*) AS n FROM v_nodes) n, (SELECT count(*) AS n FROM v_edges) e, (SELECT count(*) AS n FROM o_spofs) s,
     (SELECT sum(total_cost_ms) AS total, count(*) FILTER (impact = 'HIGH') AS h FROM o_top) c, (SELECT sum(execution_count) AS n FROM o_stats) q,
     (SELECT count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (category = 'security') AS s FROM o_register) r""")
def _(t):
    stats = materialize(t.stats, "stats")
    costs = query_log.cost_summary(stats, query_log.top_cost_drivers(query_log.cost_drivers(stats)))
    spofs = materialize(_spofs(t), "spofs")
    topology = graph.topology_statistics(t.nodes, t.edges, spofs)
    return report.audit_metrics(topology, costs, _register(t, spofs))


cte("o_top_risks", "o_register", sql=f"""
SELECT *, row_number() OVER (ORDER BY {_RISK_ORDER}) AS position FROM o_register QUALIFY position <= 10""")
cte("o_top_costs", "o_missing", sql="""
SELECT *, row_number() OVER (ORDER BY total_cost_ms DESC, first_seq) AS position FROM o_missing QUALIFY position <= 10""")
cte("o_recommend0", "o_top_costs", "o_top_risks", sql="""
SELECT 0 AS source_ord, position, CASE impact WHEN 'HIGH' THEN 7 WHEN 'MEDIUM' THEN 4 ELSE 2 END AS priority, 'performance' AS category,
       'Optimize ' || coalesce("table", 'None') || ' performance' AS title, recommendations[1] AS description, impact,
       CASE WHEN contains(lower(recommendations[1]), 'index') THEN 'LOW' ELSE 'MEDIUM' END AS effort, 'cost_analysis' AS source
FROM o_top_costs WHERE position <= 5 AND len(recommendations) > 0
UNION ALL
SELECT 1, position, CASE severity WHEN 'CRITICAL' THEN 12 WHEN 'HIGH' THEN 7 WHEN 'LOW' THEN 2 ELSE 4 END, category, 'Mitigate: ' || title, left(mitigation, 200), severity,
       CASE category WHEN 'spof' THEN 'HIGH' WHEN 'documentation' THEN 'LOW' ELSE 'MEDIUM' END, 'risk_analysis'
FROM o_top_risks WHERE position <= 5 AND coalesce(mitigation, '') <> ''""")
cte("o_recommend", "o_recommend0", sql="""
SELECT CAST(row_number() OVER (ORDER BY priority DESC, source_ord, position) AS INTEGER) AS rank, priority, category, title, description, impact, effort, source FROM o_recommend0 QUALIFY rank <= 10""")


@check("K3_top_findings", "o_top_costs", "o_top_risks", recursive=True, sql="""
SELECT 'cost' AS type, CAST(position AS INTEGER) AS position, 'Cost Driver: ' || coalesce("table", 'None') AS title,
       'Query pattern executing ' || execution_count || ' times with total cost of ' || printf('%.0f', total_cost_ms) || 'ms' AS description, impact, array_to_string(recommendations, '|') AS recommendations
FROM o_top_costs WHERE position <= 2
UNION ALL SELECT 'risk', CAST(position AS INTEGER), title, description, severity, mitigation FROM o_top_risks WHERE position <= 3""")
def _(t):
    found = report.top_findings(_advised(t), _register(t))
    return found.withColumn("recommendations", F.array_join("recommendations", "|"))


@check("K4_prioritize", "o_recommend", recursive=True, sql="SELECT * FROM o_recommend")
def _(t):
    return report.prioritize(_advised(t), _register(t))


@check("R4_action_plan", "o_recommend", recursive=True, sql="""
SELECT CASE effort WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS phase, item, title, impact, category, effort
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY effort ORDER BY rank) AS INTEGER) AS item FROM o_recommend) r WHERE item <= CASE effort WHEN 'HIGH' THEN 3 ELSE 5 END""")
def _(t):
    return report.action_plan(report.prioritize(_advised(t), _register(t)))


@check("R4_action_plan_many", "v_findings", sql="""
SELECT CASE effort WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS phase, item, title, severity AS impact, category, effort
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY effort ORDER BY seq) AS INTEGER) AS item FROM (
  SELECT seq, 't' || seq AS title, severity, category, CASE category WHEN 'spof' THEN 'HIGH' WHEN 'documentation' THEN 'LOW' ELSE 'MEDIUM' END AS effort FROM v_findings) a) b
WHERE item <= CASE effort WHEN 'HIGH' THEN 3 ELSE 5 END""")
def _(t):
    from auditframe.functions.scoring import estimate_effort

    many = t.view("v_findings").select(
        F.col("seq").alias("rank"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("title"),
        F.col("severity").alias("impact"), "category", estimate_effort(F.col("category")).alias("effort"),
    )
    return report.action_plan(many)


@check("R5_appendix_risks", "o_register", recursive=True, sql=f"""
SELECT CAST(position AS INTEGER) AS position, title, severity, category, confidence, description, left(mitigation, 300) AS mitigation
FROM (SELECT *, row_number() OVER (ORDER BY {_RISK_ORDER}) AS position FROM o_register WHERE severity IN ('CRITICAL', 'HIGH')) r WHERE position <= 10""")
def _(t):
    return report.appendix_risks(_register(t))


cte("o_latest", "v_reviews", sql="SELECT artifact_id, arg_max(decision, (ts, seq)) AS decision FROM v_reviews GROUP BY 1")


@check("R1_latest_review_status", "o_latest", sql="SELECT * FROM o_latest")
def _(t):
    return lifecycle.latest_review_status(t.view("v_reviews"))


@check("R2_pending_reviews", "o_latest", sql="SELECT artifact_id FROM o_latest WHERE decision = 'pending'")
def _(t):
    return lifecycle.pending_reviews(t.view("v_reviews"))


@check("R3_review_summary", "o_latest", sql="""
SELECT s.decision, count(l.artifact_id) AS artifact_count
FROM (SELECT unnest(['pending', 'approved', 'rejected', 'request_changes']) AS decision) s LEFT JOIN o_latest l ON s.decision = l.decision GROUP BY 1""")
def _(t):
    return lifecycle.review_summary(t.view("v_reviews"))


@check("W3_latest_state_per_key", "v_history", sql="SELECT engagement_id, arg_max(to_state, seq) AS state FROM v_history GROUP BY 1")
def _(t):
    steps = t.view("v_history").select(
        F.col("engagement_id").alias("artifact_id"), F.col("to_state").alias("decision"), F.lit(0).alias("ts"), "seq"
    )
    return lifecycle.latest_review_status(steps).select(
        F.col("artifact_id").alias("engagement_id"), F.col("decision").alias("state")
    )


_LEGAL = "(from_state || '>' || to_state) IN ('new>ingested', 'ingested>analyzed', 'analyzed>reviewed', 'reviewed>finalized')"
cte("o_required", sql="""
SELECT * FROM (VALUES ('new>ingested', 'repo_inventory'), ('new>ingested', 'db_schema'), ('ingested>analyzed', 'topology'), ('ingested>analyzed', 'cost_drivers'),
  ('ingested>analyzed', 'risk_register'), ('analyzed>reviewed', 'review_approval'), ('reviewed>finalized', 'executive_summary'), ('reviewed>finalized', 'technical_appendix')) v(step, artifact)""")
cte("o_missing_artifacts", "v_history", "v_artifacts", "o_required", sql="""
SELECT h.engagement_id, h.seq, string_agg(r.artifact, ',' ORDER BY r.artifact) AS missing, count(*) AS n
FROM v_history h JOIN o_required r ON h.from_state || '>' || h.to_state = r.step
WHERE NOT EXISTS (SELECT 1 FROM v_artifacts a WHERE a.engagement_id = h.engagement_id AND a.artifact_type = r.artifact) GROUP BY 1, 2""")


@check("L1_validate_transitions", "v_history", "o_missing_artifacts", sql=f"""
SELECT h.engagement_id, h.seq, {_LEGAL} AS legal, coalesce(m.missing, '') AS missing, {_LEGAL} AND m.n IS NULL AS valid
FROM v_history h LEFT JOIN o_missing_artifacts m ON h.engagement_id = m.engagement_id AND h.seq = m.seq""")
def _(t):
    checked = lifecycle.validate_transitions(t.view("v_history"), t.view("v_artifacts"))
    return checked.select(
        "engagement_id", "seq", "legal", F.array_join(F.array_sort("missing"), ",").alias("missing"), "valid"
    )


@check("L1_validate_transitions_only", "v_history", sql=f"SELECT engagement_id, seq, {_LEGAL} AS valid FROM v_history")
def _(t):
    return lifecycle.validate_transitions(t.view("v_history")).select("engagement_id", "seq", "valid")


@check("L2_next_states", "v_history", sql="""
SELECT engagement_id, seq, CASE to_state WHEN 'new' THEN 'ingested' WHEN 'ingested' THEN 'analyzed' WHEN 'analyzed' THEN 'reviewed' WHEN 'reviewed' THEN 'finalized' ELSE '' END AS next_states FROM v_history""")
def _(t):
    return lifecycle.next_states(t.view("v_history"), "to_state").select(
        "engagement_id", "seq", F.array_join("next_states", ",").alias("next_states")
    )


@check("L2_required_artifacts", "v_history", "o_required", sql="""
SELECT h.engagement_id, h.seq, coalesce(string_agg(r.artifact, ',' ORDER BY r.artifact), '') AS required
FROM v_history h LEFT JOIN o_required r ON h.from_state || '>' || h.to_state = r.step GROUP BY 1, 2""")
def _(t):
    return lifecycle.required_artifacts(t.view("v_history")).select(
        "engagement_id", "seq", F.array_join(F.array_sort("required_artifacts"), ",").alias("required")
    )


@check("U2_required_minus_available", "v_history", "o_missing_artifacts", sql="""
SELECT engagement_id, seq, missing FROM o_missing_artifacts""")
def _(t):
    checked = lifecycle.validate_transitions(t.view("v_history"), t.view("v_artifacts"))
    return checked.where(F.size("missing") > 0).select(
        "engagement_id", "seq", F.array_join(F.array_sort("missing"), ",").alias("missing")
    )
