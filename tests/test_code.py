import ast

import pytest
from pyspark.sql import functions as F

from auditframe.operators import code, security

PYTHON = '''"""Order service.

import fake.module
"""
import os, json as js
import a.b.c
from pathlib import Path, PurePath as P
from typing import (
    Dict,
    List,  # trailing
)
from . import sibling
from .near import thing
from x import *
# import commented
note = "import quoted"


class Order(Base, models.Model, metaclass=Meta):
    def execute_order(self):
        q = 'it''s "execute(" here'
        conn.execute("SELECT * FROM orders WHERE id = ?", (1,))
        rows = cursor.fetchall()
        db.cursor().execute('INSERT INTO audit VALUES (1)')
        run_query(
            "UPDATE stock SET n = 1")
        return "DROP TABLE old", os.getcwd()


class Plain: pass
'''
JAVA = '''import java.sql.Connection;
import  com.acme.Repo ;
public class UserDao {
  String q = "SELECT * FROM users WHERE id = ?";
  String d = "DROP VIEW v"; // no gate word
  void f() { stmt.executeQuery(q); ps.executeUpdate (); em.createQuery("insert into log values (1)"); }
}'''
JS = '''import React from 'react';
import { a } from "./util";
const db = require('pg');
db.query("SELECT * FROM t1"); const s = `INSERT INTO t2 VALUES (1)`;
cache.get('k'); both("delete from t3", `select 1 from t4`);
selected = "preselected rows";'''
CSHARP = '''using System.Data;
var a = @"SELECT * FROM Users";
var c = new SqlCommand ("UPDATE Users SET x = 1");
c.ExecuteReader(); c.ExecuteNonQuery();'''
PHP = '''<?php
require 'a.php'; require_once "b.php"; include_once 'c.php';
$r = mysqli_query($c, "SELECT s FROM supplier");
$pdo->prepare('x')->execute();'''
GO = 'package m\nimport "fmt"\nimport (\n  db "database/sql"\n  "os"\n)\nq := `SELECT a FROM b`'
RUBY = "require 'json'\nrequire_relative 'lib'\ndb.execute(\"SELECT * FROM t\")"
SQL = "CREATE TABLE b (id INT);\ncreate table IF NOT EXISTS a (id INT); CREATE TABLE b (x INT)"

FILES = [("src/o.py", PYTHON), ("U.java", JAVA), ("a.ts", JS), ("b.cs", CSHARP), ("c.php", PHP), ("d.go", GO), ("e.rb", RUBY), ("f.sql", SQL),
         ("lib.so", "SELECT 'SELECT x FROM y'"), ("notes.txt", "run \"select * from jobs\" or 'x'")]


@pytest.fixture
def files(rows):
    return rows(FILES, "path string, content string")


def by_path(df, *fields):
    got = {}
    for r in df.collect():
        got.setdefault(r.path, []).append(tuple(r[f] for f in fields))
    return got


def test_python_imports_equal_the_syntax_tree(files):
    want = []
    names = set()
    for node in ast.walk(ast.parse(PYTHON)):
        if isinstance(node, ast.Import):
            names.update(a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            want += [("from", node.module, a.name) for a in node.names]
    want += [("import", n, None) for n in names]
    got = by_path(code.python_imports(files), "kind", "module", "name")["src/o.py"]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_imports_of_other_languages(files):
    got = {p: sorted(m for m, in v) for p, v in by_path(code.code_imports(files), "module").items() if p != "src/o.py"}
    assert got == {
        "U.java": ["com.acme.Repo", "java.sql.Connection"], "a.ts": ["./util", "pg", "react"], "b.cs": ["System.Data"],
        "c.php": ["a.php", "b.php", "c.php"], "d.go": ["database/sql", "fmt", "os"], "e.rb": ["json"],
    }


def test_embedded_sql(files):
    got = by_path(code.code_sql(files), "line", "type", "table", "query")
    assert [g[:3] for g in got["U.java"]] == [(4, "SELECT", "users"), (6, "INSERT", "log")]
    assert [g[:3] for g in got["a.ts"]] == [(4, "SELECT", "t1"), (4, "INSERT", "t2"), (5, "DELETE", "t3"), (5, "SELECT", "t4")]
    assert got["b.cs"] == [(2, "SELECT", "Users", "SELECT * FROM Users"), (3, "UPDATE", None, "UPDATE Users SET x = 1")]
    assert [g[:3] for g in got["c.php"]] == [(3, "SELECT", "supplier")]
    assert [g[:3] for g in got["d.go"]] == [(7, "SELECT", "b")]
    assert got["notes.txt"] == [(1, "SELECT", "jobs", "select * from jobs")]
    assert "f.sql" not in got and "lib.so" not in got


def test_python_sql_takes_execute_first_and_may_lack_a_type(rows):
    text = 'x = "a"; c.execute("SELECT * FROM t1")\nif where == "north": pass\nlog("join us")\ny = "  update t2 set a = 1"\n'
    got = code.python_sql(rows([("a.py", text)], "path string, content string")).collect()
    assert [(r.line, r.query, r.type, r.table) for r in got] == [
        (1, "SELECT * FROM t1", "SELECT", "t1"), (2, "north", None, None), (3, "join us", None, None),
        (4, "update t2 set a = 1", "UPDATE", "t2")]


def test_database_calls(files):
    got = by_path(code.db_calls(files), "name", "line")
    want = []
    for node in ast.walk(ast.parse(PYTHON)):
        if isinstance(node, ast.Call):
            name = ast.unparse(node.func) if not isinstance(getattr(node.func, "value", None), ast.Call) else node.func.attr
            if any(w in name.lower() for w in ("execute", "query", "fetch")):
                want.append((name, node.lineno))
    assert sorted(got["src/o.py"]) == sorted(want)
    assert sorted(got["U.java"]) == [("createQuery", 6), ("executeQuery", 6), ("executeUpdate", 6)]
    assert sorted(got["a.ts"]) == [("get", 5), ("query", 4)]
    assert sorted(got["b.cs"]) == [("ExecuteNonQuery", 4), ("ExecuteReader", 4), ("SqlCommand", 3)]
    assert sorted(got["c.php"]) == [("execute", 4), ("mysqli_query", 3), ("prepare", 4)]


FORMATTED = r'''
a = f"{db.execute('SELECT 1')} {{no.execute()}} {x:{cur.fetch_width()}}" + 'f"{quoted.execute()}"'
b = f"""
import not_this
{cursor.fetchall()}
  {f'{deep.query(1)} {"plain.execute()"}'}
"""  # comment.execute(1) f"{c.execute()}"
c = rf'{one.execute(d["k"])}\\d{{2}}' + Rb'no.fetch()' + u"no.fetch()"
d = f'{a!r:>{w}}' f"{two.query(f'{three.fetch()}')}" # it's "open
e = f"{four.execute({'k': {'n': 1}})}"; f"{five.execute(g)}"
f = if_("x"); elif_f = "not.execute()"
g = f"{'nested.execute()'}" f"{
    late.execute()
}"
import this_one
'''


def test_calls_in_fields_of_formatted_strings(rows):
    """As the syntax tree has them; strings in fields and doubled braces are no code, nor are imports in strings."""
    files = rows([("a.py", FORMATTED)], "path string, content string")
    want = [(ast.unparse(n.func), n.lineno) for n in ast.walk(ast.parse(FORMATTED)) if isinstance(n, ast.Call)]
    want = [(n, i) for n, i in want if any(w in n.lower() for w in ("execute", "query", "fetch"))]
    assert len(want) == 10
    assert sorted((r["name"], r["line"]) for r in code.db_calls(files).collect()) == sorted(want)
    assert [r["module"] for r in code.python_imports(files).collect()] == ["this_one"]


def test_code_only_keeps_lines(rows):
    text = FORMATTED + PYTHON + 'x = f"{unclosed"\ny = f"}"\nz = "\\\\"\nimport late\n'
    got = rows([(text,)], "c string").select(code.python_code_only(F.col("c"))).first()[0]
    assert got.count("\n") == text.count("\n") and got.endswith("import late\n") and "not_this" not in got


def test_long_formatted_strings_do_not_overflow_the_matcher(rows):
    text = 'x = f"' + "a{b.execute(1)} {{" * 20_000 + '"\nimport late\n'
    files = rows([("a.py", text), ("b.py", 'f"' + "{" * 20_000 + '"\nimport last\n')], "path string, content string")
    assert sorted(r["module"] for r in code.python_imports(files).collect()) == ["last", "late"]
    assert code.db_calls(files).count() == 20_000


def test_looser_variants(rows):
    files = rows(
        [("a.java", 's = "preselected rows";'), ("b.rb", "require_relative 'lib'"), ("c.py", "conn.commit()\nconn.execute('x')")],
        "path string, content string")
    assert code.code_sql(files).count() == 0
    assert [r.query for r in code.code_sql(files, whole_words=False).collect()] == ["preselected rows"]
    assert code.code_imports(files).count() == 0
    assert [r.module for r in code.code_imports(files, relative_ruby=True).collect()] == ["lib"]
    assert [r.name for r in code.db_calls(files, ("commit",)).collect()] == ["conn.commit"]


def test_scan_of_a_tree(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, text in {"a.py": "import os\n", "b.xyz": "q = 'select 1 from t'", "c.dll": "x", "node_modules/d.py": "import no"}.items():
        (tmp_path / name).write_text(text)
    facts = {r.path: r for r in code.scan_code(spark, str(tmp_path)).collect()}
    assert set(facts) == {"a.py", "b.xyz"}
    assert [i.module for i in facts["a.py"].imports] == ["os"]
    assert [(q.type, q.table) for q in facts["b.xyz"].sql_queries] == [("SELECT", "t")]


def test_classes_and_tables(files):
    got = by_path(code.class_defs(files), "class_name", "bases")
    assert got == {"src/o.py": [("Order", ["Base", "Model"]), ("Plain", [])], "U.java": [("UserDao", [])]}
    assert by_path(code.tables_defined(files), "table") == {"f.sql": [("a",), ("b",)]}


def test_facts_in_one_scan_equal_the_flat_tables(files):
    facts = code.code_facts(files)
    for flat in (code.code_sql, code.code_imports, code.db_calls, code.class_defs, code.tables_defined):
        assert sorted(flat(facts).collect(), key=str) == sorted(flat(files).collect(), key=str)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_long_strings_do_not_overflow_the_matcher(rows):
    text = 'x = "' + "a\\n" * 200_000 + '"\nimport late\n"""' + "b\\" * 99_999 + ' """\nimport last\n'
    got = code.python_imports(rows([("a.py", text)], "path string, content string")).collect()
    assert sorted(r.module for r in got) == ["last", "late"]


def test_inventory(rows):
    tree = rows(
        [("a.py", "x\ny"), ("b/c.py", "x\n"), ("d.h", ""), ("e/package.json", "{}\n"), ("f.bin", "zz\n"), ("go.mod", "m\n")],
        "path string, content string",
    )
    row = code.repo_inventory(tree).collect()[0]
    assert (row.total_files, row.lines_of_code, row.language_count, row.dependency_file_count) == (6, 4, 3, 2)
    assert row.languages == {"Python": 2, "C/C++ Header": 1, "JSON": 1}
    assert sorted(r.path for r in code.dependency_files(tree).collect()) == ["e/package.json", "go.mod"]
    assert code.lines_of_code(tree, [".py"]).collect()[0][0] == 3
    empty = code.repo_inventory(tree.where(F.lit(False))).collect()[0]
    assert (empty.total_files, empty.languages) == (0, {})


SECURITY = [
    ("config.py", 'passwd = "b"\npassword = "secret"\nPASSWORD = \'two\'\napi_key = "k"\n'),
    ("database.py", "cursor.execute(\"SELECT %s\" % x)\n"),
    ("api.py", "get('http://localhost/a'); get('http://127.0.0.1'); get('http://api.com', verify=False)\n"),
    ("ok.py", "get('http://localhost')\n"), ("README.md", 'password = "x"'), ("empty.py", ""),
]


def test_security_takes_the_first_matching_pattern(rows):
    found = security.security_issues(rows(SECURITY, "path string, content string")).collect()
    got = {(r.evidence[0].path, r.attrs["issue_type"]): (r.severity, r.attrs["occurrence_count"], r.title) for r in found}
    assert got == {
        ("config.py", "hardcoded_password"): ("CRITICAL", "2", "Security: Hardcoded Password in config.py"),
        ("config.py", "api_key"): ("CRITICAL", "1", "Security: Api Key in config.py"),
        ("database.py", "sql_injection"): ("HIGH", "1", "Security: Sql Injection in database.py"),
        ("api.py", "insecure_connection"): ("MEDIUM", "1", "Security: Insecure Connection in api.py"),
    }
    details = {r.evidence[0].path: r.evidence[0].details for r in found if r.attrs["issue_type"] != "api_key"}
    assert details["config.py"].startswith('passwd = "b"\npassword') and details["config.py"].endswith("...")
