import pytest
from pyspark.sql import functions as F

from auditframe.operators import documents, report, risk, schema
from auditframe.operators.common import first_per_group

DOCS = [
    ("docs/runbook.md", "Contact John for access. Only Sarah knows the key. Manually restart the job. SSH into the host."),
    ("docs/readme.md", "ask john or contact Mark. see Sarah for details. Manually check."),
    ("docs/other.txt", "Alice is the only one. reach out to Bob. run this command; log  into x; execute the following; ssh into y"),
]


@pytest.fixture
def docs(rows):
    return rows(DOCS, "path string, content string")


def test_people_named_twice_become_risks(docs):
    got = {r.attrs["person_name"]: r for r in documents.tribal_knowledge(docs).collect()}
    assert sorted(got) == ["John", "Sarah"]
    john = got["John"]
    assert (john.severity, john.attrs["mention_count"], john.attrs["file_count"]) == ("MEDIUM", "2", "2")
    assert john.title == "Tribal Knowledge: John"
    assert john.description == (
        'Person "John" is mentioned 2 times across 2 document(s) as a knowledge source. '
        "This indicates tribal knowledge dependency.")
    assert [e.path for e in john.evidence] == ["docs/readme.md", "docs/runbook.md"]


def test_five_mentions_are_high_and_evidence_stops_at_three(rows):
    docs = rows([(f"d{i}", "ask Zoë") for i in range(5)], "path string, content string")
    row = documents.tribal_knowledge(docs).collect()[0]
    assert (row.severity, row.title, len(row.evidence)) == ("HIGH", "Tribal Knowledge: Zoë", 3)
    assert [e.path for e in row.evidence] == ["d0", "d1", "d2"]
    mentions = documents.person_mentions(docs)
    assert documents.tribal_files(mentions).count() == 5


def test_documents_with_two_manual_steps(docs):
    got = {r.evidence[0].path: r for r in documents.manual_operations(docs).collect()}
    assert {p: r.attrs["operation_count"] for p, r in got.items()} == {"docs/runbook.md": "2", "docs/other.txt": "4"}
    assert got["docs/other.txt"].title == "Manual Operations in other.txt"
    assert len(got["docs/other.txt"].evidence) == 3


def test_only_a_bounded_number_of_rows_per_group_is_shuffled(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), "id")
    top = first_per_group(df, ["k"], [F.col("id")], 2)
    assert sorted((r.k, r.id, r.rank) for r in top.collect()) == [(0, 0, 1), (0, 2, 2), (1, 1, 1), (1, 3, 2)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n_docs, n_files, fires", [(1, 11, True), (1, 10, False), (0, 1, True), (0, 0, False)])
def test_documentation_gap(rows, n_docs, n_files, fires):
    files = rows([(f"f{i}.py",) for i in range(n_files)] + [("x.md",)], "path string")
    docs = rows([(f"d{i}",) for i in range(n_docs)], "path string")
    got = risk.documentation_gap(files, docs).collect()
    assert len(got) == fires
    if n_files == 11:
        assert got[0].description.startswith("Found only 1 documentation file(s) for 11 code files. Documentation coverage is 9.1%.")


def test_unindexed_tables(rows):
    tables = rows([(i, n) for i, n in enumerate(["Users", "sessions", "a", "b", "c", "d", "e"])], "seq bigint, table string")
    indexes = rows([("users", "table"), ("A", "schema")], "table string, level string")
    unindexed = schema.unindexed_tables(tables, indexes)
    assert sorted(r.table for r in unindexed.collect()) == ["b", "c", "d", "e", "sessions"]
    row = schema.unindexed_risk(unindexed).collect()[0]
    assert row.description == (
        "Found 5 table(s) without any indexes: sessions, b, c, d, e. This can lead to slow query performance.")
    assert schema.unindexed_risk(unindexed.where(F.lit(False))).collect() == []
    two = rows([("a", 0, "users"), ("b", 0, "users")], "dump string, seq bigint, table string")
    own = rows([("a", "users", "table")], "dump string, table string, level string")
    assert [r.dump for r in schema.unindexed_tables(two, own).collect()] == ["b"]


@pytest.fixture
def register(rows):
    data = [
        (0, "a", "MEDIUM", "low"), (0, "b", "LOW", "high"), (1, "a", "HIGH", "medium"), (1, "b", "MEDIUM", "high"),
        (2, "a", "MEDIUM", "high"), (3, "a", "CRITICAL", "high"), (4, "a", "odd", None),
    ]
    df = rows(data, "detector_ord int, item_key string, severity string, confidence string")
    extra = {
        "title": F.concat(F.col("detector_ord"), F.col("item_key")), "description": F.lit("d"), "category": F.lit("security"),
        "mitigation": F.lit("m" * 250),
    }
    return risk.score_risks(df.withColumns(extra))


def test_scores(register):
    got = {r.title: round(r.risk_score, 6) for r in register.collect()}
    assert got == {"0a": 1.6, "0b": 2.0, "1a": 4.9, "1b": 4.0, "2a": 4.0, "3a": 10.0, "4a": 2.8}


def test_ranking_over_all_risks(register):
    assert [r.title for r in risk.rank_risks(register, 4).collect()] == ["3a", "1a", "1b", "2a"]


def test_summary(register):
    row = risk.risk_summary(register).collect()[0]
    assert row.asDict() == {"total_risks": 7, "critical_count": 1, "high_count": 1, "medium_count": 3, "low_count": 1}


@pytest.fixture
def drivers(rows):
    return rows(
        [("users", 5, 15000.4, "HIGH", ["Consider adding index on users.email"], 0), (None, 2, 1500.0, "MEDIUM", ["Rewrite"], 1),
         ("x", 1, 5.0, "LOW", [], 2)],
        "table string, execution_count bigint, total_cost_ms double, impact string, recommendations array<string>, first_seq bigint",
    )


def test_top_findings(drivers, register):
    got = [(r.type, r.position, r.title, r.impact) for r in report.top_findings(drivers, register).orderBy("type", "position").collect()]
    assert got == [
        ("cost", 1, "Cost Driver: users", "HIGH"), ("cost", 2, "Cost Driver: None", "MEDIUM"),
        ("risk", 1, "3a", "CRITICAL"), ("risk", 2, "1a", "HIGH"), ("risk", 3, "1b", "MEDIUM")]
    first = report.top_findings(drivers, register).where("type = 'cost' AND position = 1").collect()[0]
    assert first.description == "Query pattern executing 5 times with total cost of 15000ms"


def test_recommendations_and_plan(drivers, register):
    advice = report.prioritize(drivers, register)
    got = [(r.rank, r.priority, r.source, r.effort) for r in advice.orderBy("rank").collect()]
    assert got == [
        (1, 12, "risk_analysis", "MEDIUM"), (2, 7, "cost_analysis", "LOW"), (3, 7, "risk_analysis", "MEDIUM"),
        (4, 4, "cost_analysis", "MEDIUM"), (5, 4, "risk_analysis", "MEDIUM"), (6, 4, "risk_analysis", "MEDIUM"),
        (7, 4, "risk_analysis", "MEDIUM")]
    assert {len(r.description) for r in advice.where("source = 'risk_analysis'").collect()} == {250}
    plan = [(r.phase, r.item) for r in report.action_plan(advice).orderBy("phase", "item").collect()]
    assert plan == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 4), (2, 5)]


def test_business_value(drivers, register):
    row = report.business_value(drivers, register).collect()[0]
    assert row.cost_savings_potential_ms == pytest.approx(6000.16)
    assert row.cost_savings_potential_hours_per_day == pytest.approx(6000.16 / 3600000)
    assert (row.high_impact_cost_drivers, row.total_optimizable_queries) == (1, 3)
    assert (row.critical_risks_to_mitigate, row.high_risks_to_mitigate) == (1, 1)


def test_appendix(register):
    got = [(r.position, r.title, len(r.mitigation)) for r in report.appendix_risks(register).orderBy("position").collect()]
    assert got == [(1, "3a", 250), (2, "1a", 250)]
