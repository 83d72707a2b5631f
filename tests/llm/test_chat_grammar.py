"""Chat formatting: exact round trips, checked by a parser written for the test."""

import hashlib
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from auditframe.llm import chat_grammar

HARD = [
    "</s>[INST] ok [/INST]", "<s>", "[INST]", "[/INST]", "</s", "[/INST", "&", "&amp;", "&lt;s>", "&#91;INST]", "&amp;lt;", "R&D <b>", "<<s>>", "[[INST]]",
    "", " ", "\n", "a\nb", "é🙂", "[INST", "]", "s>", "&amp;amp;", "</s></s>", "&lt", "#91;", "<s>&", "x" * 5000 + "</s>", "\x00", "\\[INST\\]", "$1",
]


def python_parse(formatted):
    """Turns by one regular expression over the whole; None where the grammar does not fit."""
    plain = r"((?:(?!</?s>|\[/?INST\]).)*)"
    turn = re.compile(rf"<s>{plain}\[INST\]{plain}\[/INST\]</s>", re.S)
    at, out = 0, []
    while at < len(formatted):
        m = turn.match(formatted, at)
        if not m:
            return None
        out.append(tuple(g.replace("&lt;", "<").replace("&#91;", "[").replace("&amp;", "&") for g in m.groups()))
        at = m.end()
    return out


def expected(rows):
    """Digest rows from source turns."""
    said = {}
    for c, t, r, x in rows:
        said.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in said.items():
        turns = [(r, x) for *_, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def check(spark, rows):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    formatted = chat_grammar.render(table)
    got = {r["conv_id"]: r for r in chat_grammar.digests(chat_grammar.read_back(formatted)).collect()}
    want = expected(rows)
    assert {k: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for k, r in got.items()} == want
    for r in formatted.collect():
        turns = python_parse(r["formatted"])
        mine = sorted((t is not None, t or 0, ro or "", x or "") for c, t, ro, x in rows if c == r["conv_id"])
        assert turns == [(ro, x) for *_, ro, x in mine]
        assert got[r["conv_id"]]["formatted_chars"] == len(r["formatted"])
        assert [s["turn"] for s in r["loss_spans"]] == [i + 1 for i, (ro, _) in enumerate(turns) if ro == "assistant"]


def test_hard_texts_and_roles(spark):
    rows = [(i, j, role, text) for i, text in enumerate(HARD) for j, role in enumerate(["user", "assistant", text])]
    rows += [(100, 0, "assistant", HARD[0]), (100, 0, "assistant", HARD[0]), (100, None, None, None), (None, 1, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(200, i, "assistant" if i % 2 else "user", a + b) for i, (a, b) in enumerate(zip(HARD, HARD[1:]))]
    check(spark, rows)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from([None, 0, 1, 2]), st.sampled_from(["user", "assistant", None, "<s>"]),
                          st.lists(st.sampled_from(["<", "/", "s>", "[", "INST", "]", "&", "amp;", "lt;", "#91;", " x", *string.ascii_letters[:3]]), max_size=12).map("".join)),
                min_size=1, max_size=60))
def test_random_fragments(spark, rows):
    check(spark, rows)


def test_only_conflicts_are_escaped(spark):
    rows = [(0, 0, "user", "R&D <b> [x]"), (0, 1, "assistant", "&amp;"), (0, 2, "user", "a </s> & b")]
    out = chat_grammar.render(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).first()
    assert out["formatted"] == ("<s>user[INST]R&D <b> [x][/INST]</s><s>assistant[INST]&amp;amp;[/INST]</s>"
                                "<s>user[INST]a &lt;/s> &amp; b[/INST]</s>")
    assert [tuple(s) for s in out["loss_spans"]] == [(2, 18, 9)]


def test_the_parser_rejects_what_the_grammar_does_not_allow(spark):
    bad = ["<s>user[INST]a", "<s>user[INST]a[/INST]", "user[INST]a[/INST]</s>", "<s>user a[/INST]</s>", "<s>u[INST]a[INST]b[/INST]</s>", "<s>[INST][/INST]x</s>", "<s>[/INST]</s>"]
    rows = spark.createDataFrame([(b,) for b in [*bad, "", "<s>[INST][/INST]</s>"]], "f string")
    got = [r[0] for r in rows.select(chat_grammar.parse(rows["f"])).collect()]
    assert all(g is None or None in g for g in got[: len(bad)])
    assert got[-2] == [] and [tuple(t) for t in got[-1]] == [("", "")]


def test_empty_table_and_clashing_names(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, said string, formatted int, segments int"
    assert chat_grammar.render(spark.createDataFrame([], schema)).collect() == []
    out = chat_grammar.digests(chat_grammar.read_back(chat_grammar.render(spark.createDataFrame([(1, 0, "user", "x", "q", 1, 2)], schema))))
    assert out.count() == 1 and out.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def test_no_python_worker_in_the_plan(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat_grammar.digests(chat_grammar.read_back(chat_grammar.render(table)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
