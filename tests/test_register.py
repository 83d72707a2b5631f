import datetime

import pytest

from checks import QUERIES, risk_queries
from auditframe.operators import graph


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Small tables of the given schema."""
    root = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(2024, 1, 1)
    made = {
        "documents": ([(k, "see Bob for it" if k else None, "wiki") for k in range(6)], "doc_id long, text string, source string"),
        "pages": ([(1, "http://a.com/x"), (2, "http://b.com/y")], "page_id long, url string"),
        "orders": ([(k, k % 3) for k in range(20)], "o_orderkey long, o_custkey long"),
        "supplier": ([(k, k % 2, f"S{k}") for k in range(8)], "s_suppkey long, s_nationkey long, s_name string"),
        "nation": ([(0, 0, "N0"), (1, 0, "N1")], "n_nationkey long, n_regionkey long, n_name string"),
        "region": ([(0, "R0")], "r_regionkey long, r_name string"),
        "events": ([(k, k % 4, kind, day, 1.5) for k, kind in enumerate(["click", "view", "signup", "purchase", "error"] * 2)],
                   "event_id long, user_id long, event_type string, ts timestamp, value double"),
    }
    # Names that only the texts of the derived files mention.
    made |= {name: ([(1,)], "id long") for name in ("customer", "part", "lineitem")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return root


def test_audit_metrics_search_the_graph_once(spark, tables, monkeypatch):
    searched, betweenness = [], graph.betweenness
    monkeypatch.setattr(graph, "betweenness", lambda *a, **k: searched.append(1) or betweenness(*a, **k))
    row = QUERIES["A14_audit_metrics"](spark, tables).collect()[0]
    assert len(searched) == 1
    # Files: four with passwords, four with plain addresses. Pages: one with a password, both with plain addresses.
    assert (row.total_components, row.total_dependencies, row.security_issues) == (11, 10, 11)


@pytest.mark.parametrize("name", ["R5_appendix_risks", "A13_business_value", "K4_prioritize"])
def test_reports_do_not_write_the_whole_register(spark, tables, monkeypatch, name):
    written, materialize = [], risk_queries.materialize
    monkeypatch.setattr(risk_queries, "materialize", lambda df, label="table": written.append(label) or materialize(df, label))
    assert QUERIES[name](spark, tables).count() > 0
    assert "register" not in written


def test_appendix_ranks_passwords_first(spark, tables):
    rows = QUERIES["R5_appendix_risks"](spark, tables).collect()
    assert [r.position for r in rows] == list(range(1, 7))
    assert [r.title for r in rows] == [*[f"Security: Hardcoded Password in {x}.py" for x in ("m0", "m5", "m10", "m15", "p1")], "Tribal Knowledge: Bob"]
