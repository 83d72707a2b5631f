"""Structure repair against brute force, against a forward pass, and against its SQL on hard tables."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from auditframe.llm import structure_repair as sr
from auditframe.llm.queries import LLM_ORACLES, LLM_QUERIES

SOUND = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(codes):
    """Least (cost, initials) over all edits that cost no more than deleting every row."""
    best = (4 * len(codes) + 1, "")

    def go(i, roles, cost, letters):
        nonlocal best
        if (cost, letters) >= best and cost >= best[0]:
            return
        if i == len(codes) and SOUND.fullmatch(roles):
            best = min(best, (cost, letters))
        for r in "ua":
            go(i, roles + r, cost + 3, letters + "I")
        if i < len(codes):
            code = codes[i]
            go(i + 1, roles, cost + 4, letters + "D")
            if not code & sr.FORCED:
                extra = 3 if code & sr.CUT else 0
                go(i + 1, roles + "sua?"[code & 3], cost + extra, letters + "K")
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + extra, letters + "R")

    go(0, "", 0, "")
    return best


def forward(codes):
    """Least (cost, initials) by a pass that keeps the best prefix of each state."""
    def inserts(best):
        for _ in range(2):
            for state, (cost, letters) in list(best.items()):
                to = sr.NEXT[state]
                best[to] = min(best.get(to, (sr._NEVER, "")), (cost + 3, letters + "I"))
        return best

    best = inserts({sr.START: (0, "")})
    for code in codes:
        new = {}
        for state, (cost, letters) in best.items():
            steps = [(state, 4, "D")]
            if not code & sr.FORCED:
                extra = 3 if code & sr.CUT else 0
                steps += [(sr.NEXT[state], 3 + extra, "R"), (sr.KEEP[state][code & 3], extra, "K")]
            for to, price, letter in steps:
                if to >= 0:
                    new[to] = min(new.get(to, (sr._NEVER, "")), (cost + price, letters + letter))
        best = inserts(new)
    return min(best.get(s, (sr._NEVER, "")) for s in (sr.START, sr.AFTER_A))


def draw(rng, n):
    return bytes(rng.choice([0, 1, 1, 2, 2, 3]) + rng.choice([0, 0, 0, sr.FORCED, sr.CUT]) for _ in range(n))


def test_search_equals_brute_force():
    rng = random.Random(1)
    cases = [draw(rng, rng.randint(0, 4)) for _ in range(300)] + [bytes(c) for c in ([], [0], [1], [2], [0, 0], [2, 2, 2, 2], [1, 1, 1, 1])]
    for codes in cases:
        cost, audit = sr.search(codes)
        assert (cost, audit.decode()) == brute(codes), list(codes)


def test_search_equals_a_forward_pass_on_longer_conversations():
    rng = random.Random(2)
    for _ in range(400):
        codes = draw(rng, rng.randint(5, 120))
        cost, audit = sr.search(codes)
        assert (cost, audit.decode()) == forward(codes)


@pytest.mark.parametrize("codes", [b"\x01" * 30000, b"\x02\x02\x01" * 10000, b"\x0a\x09\x03" * 10000, None])
def test_work_is_linear_in_the_rows(codes):
    codes = codes or draw(random.Random(3), 30000)
    begin = time.time()
    cost, audit = sr.search(codes)
    assert time.time() - begin < 20 and len(audit) >= len(codes) and cost <= 4 * len(codes)
    short = codes[:600]
    assert sr.search(short)[0] == forward(short)[0]


def python_rows(rows):
    """conv_id -> repaired digest and cost from plain Python, by the forward pass."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for k, t, r, x in rows if k == c))
        codes, seen = bytearray(), set()
        for *_, role, text in turns:
            code = "sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 3
            kept = text.rstrip(" \t\n\v\f\r")
            code |= sr.FORCED if not kept or (role, text) in seen else 0 if kept[-1] in ".!?" else sr.CUT
            seen.add((role, text))
            codes.append(code)
        cost, audit = forward(bytes(codes))
        said, todo, state = [], [(r, x) for *_, r, x in turns], sr.START
        for letter in audit:
            if letter in "RI":
                state = sr.NEXT[state]
                role = "user" if state == sr.AFTER_U else "assistant"
                said.append((role, "" if letter == "I" else todo.pop(0)[1]))
            else:
                role, text = todo.pop(0)
                if letter == "K":
                    state = sr.KEEP[state]["sua".index(role[0])]
                    said.append((role, text))
        assert SOUND.fullmatch("".join(r[0] for r, _ in said))
        out[c] = (cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in said).encode()).hexdigest(), said)
    return out


ROLES = ["system", "user", "assistant", "assistant", "user", "tool", None, "", " u", "sam"]
TEXTS = ["One.", "Two!", "three", "", " \t", None, "Four? \n", "é…", "five.\n\n", "a" * 3000 + "."]


def random_rows(seed, conversations=60):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(-2, conversations)]:
        for t in sorted({rng.choice([None, *range(9)]) for _ in range(rng.randint(1, 8))}, key=str):
            rows.append((c, t, rng.choice(ROLES), rng.choice(TEXTS)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_rows_are_repaired(spark):
    rows = random_rows(4)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = python_rows(rows)
    found = sr.diagnose(table)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {c: w[:2] for c, w in want.items()}
    repaired = sr.apply(table, found)
    assert {r["conv_id"]: r["repaired_sha256"] for r in sr.digests(repaired).collect()} == {c: w[2] for c, w in want.items() if w[3]}
    got = {}
    for r in sorted(repaired.collect(), key=lambda r: r["place"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {c: w[3] for c, w in want.items() if w[3]}


def test_registered_query_agrees_with_its_sql_on_hard_rows(spark, tmp_path):
    rows = random_rows(5) + [(500, t, "user" if t % 2 else "assistant", f"row {t // 3}.") for t in range(0, 90, 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = LLM_QUERIES["op12_structure_repair"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(LLM_ORACLES["op12_structure_repair"]).fetchall()
    assert [d[0] for d in con.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_initials_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(sr, "CHUNK", 3)
    rows = [(1, t, "user", f"{t}.") for t in range(40)] + [(2, 0, "assistant", "x")]
    table = spark.createDataFrame(rows, SCHEMA)
    found = sr.diagnose(table)
    assert {r[0]: r[1] for r in sr.digests(sr.apply(table, found)).collect()} == {c: w[2] for c, w in python_rows(rows).items() if w[3]}


def test_empty_table_and_clashing_names(spark, tmp_path):
    schema = f"{SCHEMA}, h1 int, fault int, audit string, is_row int"
    empty = spark.createDataFrame([], schema)
    found = sr.diagnose(empty)
    assert found.collect() == [] and sr.digests(sr.apply(empty, found)).collect() == []
    table = spark.createDataFrame([(1, 0, "user", "a.", 1, 1, "x", 1), (1, 1, "assistant", "b.", 1, 1, "x", 1)], schema)
    assert [(r["cost"], r["audit"]) for r in sr.diagnose(table).collect()] == [(0, "KK")]
    assert sr.damage(table).columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    assert LLM_QUERIES["op12_structure_repair"](spark, str(tmp_path)).count() == 1
