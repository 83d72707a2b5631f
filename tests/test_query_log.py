import math

import pytest
from pyspark.sql import functions as F

from auditframe.functions import sqltext
from auditframe.operators import query_log

LOG = (
    [(i, f'SELECT * FROM users WHERE email = "u{i}@x.com"', 150.0 + i) for i in range(3)]
    + [(3 + i, f"SELECT * FROM sessions WHERE user_id = {i}", 2500.0) for i in range(5)]
    + [(8 + i, f'INSERT INTO audit_log VALUES ("a{i}")', 10.0) for i in range(2)]
)
SCHEMA = "seq bigint, query string, duration_ms double"


@pytest.fixture
def log(rows):
    return rows(LOG, SCHEMA)


@pytest.fixture
def drivers(log):
    return query_log.cost_drivers(query_log.query_stats(log))


def _apply(rows, fn, *texts):
    df = rows([(i, t) for i, t in enumerate(texts)], "i int, q string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("q"))).collect()]


def test_normalize_replaces_literals_in_order(rows):
    got = _apply(
        rows, sqltext.normalize_query,
        "SELECT * FROM users WHERE id = 123", "select *\n from  t where a='x 1'  and b = 2", "SELECT c1 FROM t2 WHERE n=07",
        'a = "keep 5"', "", None, "x = 'It''s'",
    )
    assert got == [
        "SELECT * FROM USERS WHERE ID = ?", "SELECT * FROM T WHERE A='?' AND B = ?", "SELECT C1 FROM T2 WHERE N=?",
        'A = "KEEP ?"', "", "", "X = '?''?'",
    ]


def test_extract_table_takes_from_then_into_then_update(rows):
    got = _apply(
        rows, sqltext.extract_table,
        "SELECT * FROM Users", "insert into orders values (1)", "UPDATE products SET x=1", "SELECT 1",
        "INSERT INTO a SELECT * FROM b", "SELECT EXTRACT(YEAR FROM ts) FROM t", "from  été",
    )
    assert got == ["users", "orders", "products", None, "b", "ts", "été"]


def test_where_columns_keep_order_and_repeats(rows):
    got = _apply(
        rows, sqltext.extract_where_columns,
        "SELECT * FROM t WHERE Email = 1 AND status IN (2) ORDER BY x", "SELECT 1",
        "SELECT * FROM t WHERE a >= 1 OR a <> 2 GROUP BY a", "SELECT * FROM t WHERE a = 1\nAND b = 2",
        "x WHERE main AND origin = 5 AND joined IN (1)  AND a >= 3",
    )
    assert got == [["email", "status"], [], ["a", "a"], [], ["ma", "origin", "joined", "a"]]


def test_impact_limits_are_exclusive(rows):
    df = rows([(v,) for v in (10000.01, 10000.0, 1000.01, 1000.0, 0.0)], "v double")
    assert [r[0] for r in df.select(sqltext.classify_impact(F.col("v"))).collect()] == [
        "HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW"]


def test_query_type_by_prefix_and_by_content(rows):
    texts = ("  select 1", "WITH x AS (SELECT 1) DELETE FROM t", "Delete from t", "BEGIN")
    assert _apply(rows, sqltext.query_type, *texts) == ["SELECT", "OTHER", "DELETE", "OTHER"]
    contains = lambda q: sqltext.query_type(q, ("SELECT", "INSERT", "UPDATE", "DELETE"), "contains", None)
    assert _apply(rows, contains, *texts) == ["SELECT", "SELECT", "DELETE", None]


def test_stats_group_by_pattern_and_keep_first_example(log):
    got = {r.pattern: r for r in query_log.query_stats(log).collect()}
    assert len(got) == 6  # double-quoted literals stay, so they keep patterns apart
    sessions = got["SELECT * FROM SESSIONS WHERE USER_ID = ?"]
    assert (sessions.execution_count, sessions.total_duration_ms, sessions.first_seq) == (5, 12500.0, 3)
    assert sessions.example_query == "SELECT * FROM sessions WHERE user_id = 0"
    assert sessions.avg_duration_ms == 2500.0


def test_drivers_classify_and_rank(drivers):
    top = query_log.top_cost_drivers(drivers, 3).collect()
    assert [(r.table, r.impact, r.total_cost_ms) for r in top] == [
        ("sessions", "HIGH", 12500.0), ("users", "LOW", 152.0), ("users", "LOW", 151.0)]


def test_ties_keep_first_seen_order(rows):
    log = rows([(i, f"SELECT * FROM t{i}x", 5.0) for i in (3, 1, 2)], SCHEMA)
    drivers = query_log.cost_drivers(query_log.query_stats(log))
    assert [r.first_seq for r in query_log.top_cost_drivers(drivers).collect()] == [1, 2, 3]


def test_summary_counts_all_but_costs_only_the_top(log, drivers):
    row = query_log.cost_summary(query_log.query_stats(log), query_log.top_cost_drivers(drivers, 2)).collect()[0]
    assert (row.total_queries_analyzed, row.unique_query_patterns, row.total_cost_ms) == (10, 6, 12652.0)
    assert (row.high_impact_count, row.medium_impact_count, row.low_impact_count) == (1, 0, 1)


def test_summary_of_an_empty_log_is_zero(rows):
    empty = query_log.query_stats(rows([], SCHEMA))
    row = query_log.cost_summary(empty, query_log.top_cost_drivers(query_log.cost_drivers(empty))).collect()[0]
    assert row.asDict() == {
        "total_queries_analyzed": 0, "unique_query_patterns": 0, "total_cost_ms": 0.0,
        "high_impact_count": 0, "medium_impact_count": 0, "low_impact_count": 0}


def test_missing_indexes_and_advice(rows, drivers):
    indexes = rows(
        [("Users", "ix", ["ID"], False, "table"), ("sessions", "ix2", ["user_id"], False, "schema")],
        "table string, index string, columns array<string>, unique boolean, level string",
    )
    got = {r.query_pattern: r for r in query_log.missing_indexes(drivers, indexes).collect()}
    sessions = got["SELECT * FROM SESSIONS WHERE USER_ID = ?"]
    assert sessions.missing_indexes == ["user_id"]
    assert sessions.recommendations == ["Consider adding index on sessions.user_id"]
    wide = {r.table: r.missing_indexes for r in query_log.missing_indexes(drivers, indexes, True).collect()}
    assert wide["sessions"] == [] and wide["users"] == ["email"] and wide["audit_log"] == []


def test_composite_advice(rows):
    log = rows([(0, "SELECT * FROM t WHERE b = 1 AND a = 2", 1.0)], SCHEMA)
    none = rows([], "table string, index string, columns array<string>, unique boolean, level string")
    row = query_log.missing_indexes(query_log.cost_drivers(query_log.query_stats(log)), none).collect()[0]
    assert row.recommendations == ["Consider adding composite index on t(b, a)"]


def test_components_of_a_driver(rows, drivers):
    edges = rows(
        [("module:a.py", "table:Users", "uses"), ("module:b.py", "table:users", "uses"), ("module:c.py", "table:users", "reads"),
         ("table:x", "table:users", "uses"), ("module:a.py", "module:users", "uses")],
        "src string, dst string, type string",
    )
    counts = {r.table: r.component_count for r in query_log.component_counts(drivers, edges).collect()}
    assert counts == {"users": 2, "sessions": 0, "audit_log": 0}
    top = query_log.top_cost_drivers(drivers, 2)
    found = query_log.affected_components(top, edges).collect()
    assert sorted((r.table, r.component) for r in found) == [("users", "a.py"), ("users", "b.py")]


def test_workload_profile(log, rows):
    row = query_log.workload_profile(log).collect()[0]
    assert (row.total_queries, row.select_count, row.insert_count, row.other_count) == (10, 8, 2, 0)
    empty = query_log.workload_profile(rows([], SCHEMA)).collect()[0]
    assert (empty.total_queries, empty.total_duration_ms, empty.avg_duration_ms) == (0, 0.0, 0.0)


def test_totals_do_not_depend_on_row_order(rows):
    values = [145.46, 1.15, 0.1, 0.2, 0.3, 54.75, 1e-3] * 40
    for order in (values, values[::-1], sorted(values)):
        log = rows([(i, "SELECT 1", v) for i, v in enumerate(order)], SCHEMA).repartition(3)
        assert query_log.query_stats(log).collect()[0].total_duration_ms == math.fsum(values)
    tiny = rows([(0, "SELECT 1", 1e-11), (1, "SELECT 1", 2e-11)], SCHEMA)
    assert query_log.query_stats(tiny).collect()[0].total_duration_ms == 3e-11
    odd = rows([(0, "SELECT 1", 1e300), (1, "SELECT 1", 1.0)], SCHEMA)
    assert query_log.query_stats(odd).collect()[0].total_duration_ms == 1e300


def test_slowest_queries_are_cut(rows):
    log = rows([(0, "a" * 101, 1.0, None), (1, "b" * 100, 9.0, None)], "seq bigint, query string, duration_ms double, ts timestamp")
    assert [r.query for r in query_log.slowest_queries(log).collect()] == ["b" * 100, "a" * 100 + "..."]


def test_hot_pattern_is_aggregated_before_the_shuffle(log):
    plan = query_log.query_stats(log)._jdf.queryExecution().executedPlan().toString()
    # One exchange of partial rows by pattern and bin, one of the few bins of each pattern.
    assert plan.count("Exchange") == 2 and plan.count("partial_sum") >= 2
