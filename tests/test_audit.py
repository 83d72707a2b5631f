import json
import os

import pytest

import __spark_entry__ as contract
from auditframe.plans.audit import run_audit, write_audit
from auditframe.sinks.artifacts import read_artifact
from auditframe.sources.schema import scan_schema_json
from checks.compare import compare

TESTDATA = "/root/testdata/sf0.001"
# One query per module by default; AUDITFRAME_ALL=1 compares all of them.
QUICK = ["K1_top_cost_drivers", "J1_missing_indexes", "T1_redact_documents", "A9_tribal_knowledge", "C3_code_sql",
         "A11_security_issues", "J3_code_db_edges", "G3_betweenness_hubs", "K4_prioritize", "L1_validate_transitions",
         "S1_scan_query_log_json", "S6_scan_schema_ddl"]


def test_whole_audit(rows, spark, tmp_path):
    (tmp_path / "schema.json").write_text(json.dumps({
        "database_name": "shop", "total_tables": 2, "total_columns": 3,
        "tables": [
            {"name": "users", "columns": [{"name": "id", "type": "INT"}], "indexes": [{"name": "pk", "columns": ["id"]}]},
            {"name": "orders", "columns": [{"name": "user_id", "type": "INT", "foreign_key": {"table": "users", "column": "id"}}]},
        ]}))
    log = rows([(i, f"SELECT * FROM users WHERE email = '{i}'", 6000.0) for i in range(3)], "seq bigint, query string, duration_ms double")
    files = rows(
        [("app/api.py", "import app.db\npassword = 'x'\n"), ("app/db.py", 'c.execute("SELECT * FROM users")\nget("http://x.com")\n')],
        "path string, content string")
    docs = rows([("run.md", "Ask Ann. Contact Ann. Manually deploy, then ssh into box.")], "path string, content string")
    results = run_audit(log, scan_schema_json(spark, str(tmp_path / "schema.json")), files, docs)
    write_audit(results, str(tmp_path / "out"), "eng-1")

    def table(name):
        return [r.asDict() for r in read_artifact(spark, str(tmp_path / "out"), name, "eng-1").collect()]

    driver = table("cost_drivers")[0]
    assert (driver["table"], driver["impact"], driver["missing_indexes"]) == ("users", "HIGH", ["email"])
    assert [r["component"] for r in table("cost_components")] == ["app/db.py"]
    assert {(r["src"], r["dst"]) for r in table("edges")} == {
        ("module:app/api.py", "module:app/db.py"), ("module:app/db.py", "table:users"), ("table:orders", "table:users")}
    assert [r["node_id"] for r in table("spofs")] == ["module:app/db.py"]
    ranked = sorted(table("risks"), key=lambda r: -r["risk_score"])
    assert ranked[0]["title"] == "Security: Hardcoded Password in api.py"
    assert {r["category"] for r in ranked} == {"spof", "tribal_knowledge", "manual_ops", "security", "operational"}
    figures = table("audit_metrics")[0]
    assert (figures["total_components"], figures["total_dependencies"], figures["spof_count"]) == (4, 3, 1)
    assert (figures["critical_risks"], figures["security_issues"], figures["queries_analyzed"]) == (1, 2, 3)
    assert table("business_value")[0]["cost_savings_potential_ms"] == pytest.approx(7200.0)
    plan = sorted(table("action_plan"), key=lambda r: (r["phase"], r["item"]))
    assert plan[0]["title"] == "Optimize users performance"
    assert len(table("top_findings")) == 4
    assert table("risk_summary")[0]["total_risks"] == len(table("risk_register"))
    assert table("cost_totals")[0]["high_impact_count"] == 1 and table("log_metrics")[0]["total_queries"] == 3
    assert {(r["kind"], r["path"].rsplit("/", 1)[-1]) for r in table("risk_register_sources")} == {
        ("file", "api.py"), ("file", "db.py"), ("document", "run.md"), ("dump", "schema.json")}
    assert {r["kind"] for r in table("edges_sources")} == {"file", "dump"} and {r["kind"] for r in table("cost_drivers_sources")} == {"dump"}
    assert table("edges_metrics")[0]["edge_count"] == 3 and table("risk_register_metrics")[0]["total_risks"] == len(ranked)
    assert table("cost_drivers_metrics")[0]["unique_query_patterns"] == 1
    assert len(table("slowest_queries")) == 3 and table("repo_inventory")[0]["total_files"] == 2
    assert results["circular_components"].count() == 0 and results["circular_dependencies"].count() == 0 and [r["table"] for r in table("unindexed_tables")] == ["orders"]


def test_audit_of_two_databases_and_a_dense_import_graph(rows, spark, tmp_path):
    """Databases share table names; modules import each other in a graph with very many circuits."""
    for name, indexed in (("one", True), ("two", False)):
        (tmp_path / f"{name}.json").write_text(json.dumps({
            "database_name": name, "total_tables": 2, "total_columns": 2,
            "tables": [
                {"name": "users", "columns": [{"name": "email", "type": "INT"}], "indexes": [{"name": "ix", "columns": ["email"]}] if indexed else []},
                {"name": "orders", "columns": [{"name": "user_id", "type": "INT", "foreign_key": {"table": "users", "column": "id"}}]}]}))
    log = rows([(i, f"SELECT * FROM users WHERE email = '{i}'", 6000.0, ["one", "two", None][i % 3]) for i in range(6)],
               "seq bigint, query string, duration_ms double, database string")
    names = [f"m{i:02d}" for i in range(14)]
    code = [(f"{n}.py", "".join(f"import {m}\n" for m in names if m != n) + 'c.execute("SELECT * FROM users")\n') for n in names]
    files = rows([*code, ("x.py", "import y\n"), ("y.py", "import x\n")], "path string, content string")
    dumps = scan_schema_json(spark, str(tmp_path))
    results = run_audit(log, dumps, files, rows([("a.md", "text")], "path string, content string"))
    drivers = {r["database"]: r["missing_indexes"] for r in results["cost_drivers"].collect()}
    assert drivers == {"one": [], "two": ["email"], None: []}
    assert results["cost_summary"].first()["unique_query_patterns"] == 1
    tables = {r["id"] for r in results["nodes"].where("type = 'table'").collect()}
    assert tables == {"table:one.users", "table:two.users", "table:one.orders", "table:two.orders"}
    edges = {(r["src"], r["dst"]) for r in results["edges"].where("type <> 'imports'").collect()}
    assert edges == {("table:one.orders", "table:one.users"), ("table:two.orders", "table:two.users")} | {(f"module:{n}.py", "table:users") for n in names}
    report = {r["component"]: (r["nodes"], r["complete"]) for r in results["circular_components"].collect()}
    assert report == {"module:m00.py": (14, False), "module:x.py": (2, True)}
    assert [r["path"] for r in results["circular_dependencies"].where("component = 'module:x.py'").collect()] == [["module:x.py", "module:y.py"]]


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    got = contract.entry(spark)
    assert got.columns == ["query_pattern", "table", "execution_count", "total_cost_ms", "impact", "first_seq"]
    assert got.count() == 10


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="needs the given tables")
def test_registered_queries_agree_with_their_sql(spark):
    names = list(contract.queries()) if os.environ.get("AUDITFRAME_ALL") else QUICK
    assert compare(spark, TESTDATA, names) == []
