import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from auditframe.operators import schema as schema_ops
from auditframe.sinks.artifacts import read_artifact, write_artifact
from auditframe.sources import schema as schema_source
from auditframe.sources.files import redact_documents, scan_documents, scan_source_files
from auditframe.sources.query_log import query_log_rejects, redact_query_log, scan_query_log_json, scan_query_log_text
from tests.conftest import one

EVENTS = [
    {"query": "SELECT 1", "timestamp": "2024-01-01T12:00:00", "duration_ms": 45.2, "rows_affected": 3, "database": "d", "user": "a@b.com"},
    {"query": "SELECT 2", "timestamp": "never", "duration_ms": 1},
    {"query": "SELECT 3", "timestamp": "2024-01-02 08:00:00", "duration_ms": "slow"},
    {"query": "INSERT 4", "timestamp": "2024-01-02"},
    {"timestamp": "2024-01-01T00:00:00", "duration_ms": "1e3"},
]


def test_json_array_object_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps(EVENTS, indent=1))
    (tmp_path / "object.json").write_text(json.dumps(EVENTS[0]))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(e) for e in EVENTS) + "\n{broken\n")
    array = scan_query_log_json(spark, str(tmp_path / "array.json"), lines=False).orderBy("seq").collect()
    assert [(r.query, r.duration_ms) for r in array] == [("SELECT 1", 45.2), ("INSERT 4", 0.0), ("", 1000.0)]
    assert (array[0].ts, array[0].rows_affected, array[0].database) == (dt.datetime(2024, 1, 1, 12), 3, "d")
    assert scan_query_log_json(spark, str(tmp_path / "object.json"), lines=False).count() == 1
    lines = scan_query_log_json(spark, str(tmp_path / "lines.json"), lines=True)
    assert [r.query for r in lines.orderBy("seq").collect()] == ["SELECT 1", "INSERT 4", ""]
    assert one(redact_query_log(lines.limit(1)).select("user")) == "[REDACTED]"


def test_json_rejects_are_kept(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"query": "a", "duration_ms": "1"}\n{broken\n{"query": "b", "duration_ms": "slow"}\n')
    assert [r.query for r in scan_query_log_json(spark, str(tmp_path / "l.json")).collect()] == ["a"]
    assert [(r.reason, "slow" in r.record) for r in query_log_rejects(spark, str(tmp_path / "l.json")).orderBy("seq").collect()] == [
        ("not JSON", False), ("unreadable value", True)]


def test_seq_follows_the_log(spark, tmp_path):
    (tmp_path / "2024-01.log").write_text("Query: JAN ;\n" * 3)
    (tmp_path / "2024-02.log").write_text("Query: FEB ;\n" * 4000)
    got = [r.query for r in scan_query_log_text(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == ["JAN"] * 3 + ["FEB"] * 4000


def test_large_files_are_read(spark, tmp_path):
    (tmp_path / "big.py").write_text("x = 1\n" * 400_000)
    (tmp_path / "big.md").write_text("word " * 2_500_000)
    assert [r["size"] for r in scan_source_files(spark, str(tmp_path), extensions=[".py"]).collect()] == [2_400_000]
    assert scan_documents(spark, str(tmp_path)).select(F.length("content")).collect()[0][0] == 12_500_000


LOG = """2024-01-01 12:00:00 [INFO] Query: SELECT * FROM users; Duration: 123ms
noise
Query: SELECT 2 Duration: 1.5ms
[x] Query:   UPDATE t SET a = 1 ; done
Query: no end here
"""


def test_text_log(spark, tmp_path):
    (tmp_path / "q.log").write_text(LOG)
    got = scan_query_log_text(spark, str(tmp_path / "q.log")).orderBy("seq").collect()
    assert [(r.query, r.duration_ms, r.ts) for r in got] == [
        ("SELECT * FROM users", 123.0, dt.datetime(2024, 1, 1, 12)), ("SELECT 2", 1.5, None), ("UPDATE t SET a = 1", 0.0, None)]


def test_pipe_log(spark, tmp_path):
    (tmp_path / "p.log").write_text("2024-01-02 10:00:00 | SELECT a || b FROM t | 150ms\nother\n")
    row = scan_query_log_text(spark, str(tmp_path / "p.log"), fmt="pipe").collect()
    assert [(r.query, r.duration_ms, r.ts) for r in row] == [("SELECT a || b FROM t", 150.0, dt.datetime(2024, 1, 2, 10))]
    with pytest.raises(ValueError):
        scan_query_log_text(spark, str(tmp_path / "p.log"), fmt="csv")


def test_source_tree(spark, tmp_path):
    root = tmp_path / "repo"
    for path, data in {
        "a.py": b"x = 1\r\ny = 2\r", "lib/B.JAVA": "é".encode(), "node_modules/n.js": b"no", "lib/.git/c.py": b"no",
        "bad.py": b"ok\xff\xfeok", "README.md": b"doc", "my build/ok.py": b"1",
    }.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    files = scan_source_files(spark, str(root), extensions=[".py", ".java", ".js"])
    got = {r.path: (r.extension, r.size, r.content) for r in files.collect()}
    assert got == {
        "a.py": (".py", 13, "x = 1\ny = 2\n"), "lib/B.JAVA": (".java", 2, "é"), "bad.py": (".py", 6, "okok"), "my build/ok.py": (".py", 1, "1")}
    assert scan_source_files(spark, str(root)).count() == 5


def test_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("\n# Title " + "x" * 200 + "\nbody a@b.com\n")
    (tmp_path / "sub" / "b.TXT").write_text("only line")
    (tmp_path / "c.pdf").write_text("no")
    docs = scan_documents(spark, str(tmp_path))
    got = {r.metadata["file_name"]: r for r in docs.collect()}
    assert set(got) == {"a.md", "b.TXT"}
    assert (got["a.md"].type, len(got["a.md"].title), got["a.md"].title[:8]) == ("md", 100, "# Title ")
    assert (got["b.TXT"].type, got["b.TXT"].title, got["b.TXT"].metadata["file_size"]) == ("txt", "only line", "9")
    clean = redact_documents(docs).where(F.col("type") == "md").collect()[0]
    assert clean.content.endswith("body [REDACTED]\n")


SCHEMA = {
    "database_name": "test_db",
    "tables": [
        {"name": "users", "columns": [{"name": "id", "type": "INT"}, {"name": "email", "type": "TEXT"}], "row_count": 5,
         "indexes": [{"name": "pk", "columns": ["id"]}]},
        {"name": "orders", "columns": [{"name": "user_id", "type": "INT", "foreign_key": {"table": "users", "column": "id"}}]},
    ],
    "indexes": [{"name": "ix", "table": "orders"}], "relationships": [], "total_tables": 2, "total_columns": 6,
}


def test_schema_json_totals_are_read_or_counted(spark, tmp_path):
    (tmp_path / "named.json").write_text(json.dumps(SCHEMA))
    (tmp_path / "plain.json").write_text(json.dumps({"name": "p", "tables": SCHEMA["tables"]}))
    dumps = scan = schema_source.scan_schema_json(spark, str(tmp_path))
    got = {r.database_name: (r.total_tables, r.total_columns) for r in scan.collect()}
    assert got == {"test_db": (2, 6), "p": (2, 3)}
    named = dumps.where(F.col("database_name") == "test_db")
    assert [(r.table, r.n_columns, r.n_indexes) for r in schema_source.schema_tables(named).orderBy("seq").collect()] == [
        ("users", 2, 1), ("orders", 1, 0)]
    fk = schema_source.schema_columns(named).where("fk_table IS NOT NULL").collect()
    assert [(r.table, r.column, r.fk_table) for r in fk] == [("orders", "user_id", "users")]
    assert {(r.table, r["index"], r.level) for r in schema_source.schema_indexes(named).collect()} == {
        ("users", "pk", "table"), ("orders", "ix", "schema")}
    metrics = schema_ops.schema_metrics(
        schema_source.schema_tables(named), schema_source.schema_columns(named), schema_source.schema_indexes(named)).collect()[0]
    assert (metrics.total_tables, metrics.total_columns, metrics.total_indexes) == (2, 3, 1)


DDL = """-- schema
CREATE TABLE users (id INTEGER, d DATETIME, b BIGINT, t TIMESTAMP);
/* next */ create table IF NOT EXISTS orders (name varchar(10));
CREATE UNIQUE INDEX ix_u ON users (id);
CREATE INDEX ix_o ON orders (name);
INSERT INTO users VALUES (1);
CREATE INDEX ix_t ON table_x (a);
DROP TABLE old"""


def test_schema_ddl(rows):
    dumps = schema_source.scan_schema_ddl(rows([("d1", DDL)], "dump string, ddl string"))
    row = dumps.collect()[0]
    assert (row.database_name, row.total_tables, row.total_columns) == ("imported_schema", 2, 4)
    columns = schema_source.schema_columns(dumps).orderBy("table", "seq").collect()
    assert [(r.table, r.column, r.type) for r in columns] == [
        ("orders", "name", "VARCHAR"), ("users", "id", "INT"), ("users", "d", "DATE"), ("users", "t", "TIMESTAMP")]
    indexes = schema_source.schema_indexes(dumps).orderBy("index").collect()
    assert [(r["index"], r.table, r.unique, r.level) for r in indexes] == [
        ("ix_o", "orders", False, "schema"), ("ix_u", "users", True, "schema")]


SPLITS = {
    "a;b;c": ["a", "b", "c"],
    "x ';' y;z": ["x ';' y", "z"],
    "it''s ';''; ' ;q": ["it''s ';''; ' ", "q"],
    r"'a\';b';c": [r"'a\';b'", "c"],
    '"a;b" `c;d`;e': ['"a;b" `c;d`', "e"],
    "a -- x; y\nb;c": ["a -- x; y\nb", "c"],
    "a /* ; ' */ b;c": ["a /* ; ' */ b", "c"],
    "f(a; (b; ')') ; --;)\n);c": ["f(a; (b; ')') ; --;)\n)", "c"],
    "a - b / c;d": ["a - b / c", "d"],
    "$$ x; y $$;z": ["$$ x; y $$", "z"],
    "$f$ a; $$ ; $f$ b;c": ["$f$ a; $$ ; $f$ b", "c"],
    "cost $5;b": ["cost $5", "b"],
    "open ( x;b": ["open ( x", "b"],
    "it's open;b": ["it's open", "b"],
    "/* open ;b": ["/* open ", "b"],
    "": [], ";;": [],
    "(" * 20 + ";" + ")" * 20 + ";q": None,
}


def test_statements_end_at_semicolons_outside_quotes_comments_and_brackets(rows):
    got = {r.d: r.s for r in rows([(k,) for k in SPLITS], "d string").select("d", schema_source.statements(F.col("d")).alias("s")).collect()}
    assert {k: v for k, v in got.items() if SPLITS[k] is not None} == {k: v for k, v in SPLITS.items() if v is not None}


def test_long_scripts_do_not_overflow_the_matcher(rows):
    big = "CREATE TABLE a (x INT DEFAULT '" + "q;" * 200_000 + "');" + "INSERT INTO t VALUES (1, ';');\n" * 20_000 + "/*" + "; *" * 100_000 + "*/ CREATE TABLE b (y INT);"
    row = schema_source.scan_schema_ddl(rows([("d", big), ("e", "(" * 3000 + "; CREATE TABLE c (z INT)")], "dump string, ddl string")).orderBy("dump").collect()
    assert [[t.name for t in r.tables] for r in row] == [["a", "b"], ["c"]]


def test_a_semicolon_inside_a_statement_does_not_cut_it(rows):
    text = "CREATE TABLE t (id INT, note VARCHAR(9) DEFAULT 'a;b', -- c; d\n made DATE /* ;e */, CHECK (note <> ';'), big DECIMAL(9,2));CREATE INDEX i ON t (id)"
    dumps = schema_source.scan_schema_ddl(rows([("d", text)], "dump string, ddl string"))
    assert [(r.column, r.type) for r in schema_source.schema_columns(dumps).orderBy("seq").collect()] == [
        ("id", "INT"), ("note", "VARCHAR"), ("made", "DATE"), ("big", "DECIMAL")]
    assert [r["index"] for r in schema_source.schema_indexes(dumps).collect()] == ["i"]


def test_artifacts_round_trip(rows, spark, tmp_path):
    data = rows([(1, "x")], "n int, s string")
    for fmt in ("parquet", "json"):
        root = str(tmp_path / fmt)
        for engagement in ("e1", "e2"):
            write_artifact(data, root, "costs", engagement, metrics=data.select("n"), sources=data.select("s"), fmt=fmt)
        back = read_artifact(spark, root, "costs", "e2", fmt=fmt).collect()
        assert [(r.n, r.s, r.confidence, r.engagement_id) for r in back] == [(1, "x", "high", "e2")]
        assert read_artifact(spark, root, "costs_metrics", fmt=fmt).count() == 2
    with pytest.raises(ValueError):
        write_artifact(data, root, "costs", "e1", confidence="sure")
