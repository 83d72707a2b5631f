import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions import columns, display, paths, text
from tests.conftest import one


def around(content, position, length):
    """The context rule, stated once more in plain Python."""
    start, end = max(0, position - length // 2), min(len(content), position + length // 2)
    return ("..." if start else "") + content[start:end].strip() + ("..." if end < len(content) else "")


def expected(content, patterns, width, group):
    return [
        (i, n, m.group(group), around(content, m.start(), width))
        for i, p in enumerate(patterns)
        for n, m in enumerate(re.finditer(p, content, re.IGNORECASE))
    ]


TEXTS = [
    "", "nothing here", "ask x", "Contact José for help. Ask  bob; only Ann knows. Sam is the only one.",
    "ask a ask b ask c " * 40, "x" * 300 + " see Bob for it " + "y" * 300, "reach out to\nops_1", "contact\r\ncarl ",
]


def contexts_of(rows, content, patterns, width, group, shortest):
    df = rows([(content,)], "c string")
    got = one(df.select(text.match_contexts(F.col("c"), [text.WORDS + p for p in patterns], width, group, shortest)))
    return [tuple(m) for m in got]


@pytest.mark.parametrize("content", TEXTS)
def test_contexts_equal_a_plain_search(rows, content):
    patterns = vocab.TRIBAL_PATTERNS
    assert contexts_of(rows, content, patterns, 100, 1, 5) == expected(content, patterns, 100, 1)


@pytest.mark.parametrize("width", [2, 9, 150])
def test_contexts_of_short_matches(rows, width):
    content = "ab a bb  a ba" * 9
    assert contexts_of(rows, content, ["a", "b+"], width, 0, 1) == expected(content, ["a", "b+"], width, 0)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["ask ", "bob", " ", "see ", "for", ".", "é", "\n", "only ", "knows"]), max_size=60))
def test_positions_and_contexts_of_any_text(spark, parts):
    content = "".join(parts)
    df = spark.createDataFrame([(content,)], "c string")
    p = r"ask\s+(\w+)"
    row = df.select(
        text.match_positions(F.col("c"), text.WORDS + p).alias("p"), text.match_contexts(F.col("c"), [text.WORDS + p], 20, 1, 5).alias("m")
    ).collect()[0]
    assert row.p == [m.start() for m in re.finditer(p, content, re.IGNORECASE)]
    assert [tuple(m) for m in row.m] == expected(content, [p], 20, 1)


@pytest.mark.parametrize("pattern, words", [
    (r"(\w+)\s+is\s+the\s+only\s+one", {"is", "the", "only", "one"}), (r"http://(?!localhost)", {"http://"}), (r"https?://x", {"http", "://x"}),
    ("ab*c", {"a", "c"}), ("ab{0,2}", {"a"}), ("a|bc", set()), ("(a|b)cd", {"cd"}), ("[[b]c]d", set()), (r"\x41b", set()), (r"\(Sql\.", {"sql"}), ("[abc]+", set()),
])
def test_words_that_every_match_holds(pattern, words):
    assert set(text.words_of(pattern)) == words


def test_no_letter_that_a_pattern_takes_is_lost_when_folded(rows):
    df = rows([(f"<{chr(c)}>",) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000], "c string")
    lost = [F.count_if(F.rlike("c", F.lit(text.WORDS + x)) & ~F.contains(text.folded(F.col("c")), F.lit(x))) for x in string.ascii_lowercase]
    assert set(df.agg(*lost).collect()[0]) == {0}


def test_contexts_of_letters_beyond_ascii(rows):
    content = "A\u017f\u212a Bob. ONLY \u00dcmit \u212aNOW\u017f it, M\u0131nd. \u0130"
    assert contexts_of(rows, content, vocab.TRIBAL_PATTERNS, 100, 1, 5) == expected(content, vocab.TRIBAL_PATTERNS, 100, 1)


@pytest.mark.parametrize("pattern, alone", [
    (r"(?idU)ask\s+(\w+)", True), (r"a[^\]$]b", True), (r"\$", True), (r"\bask", False), ("ask$", False), ("(?<=x)ask", False), ("a++", False), ("ask(?! me)", False),
])
def test_matches_that_stand_alone(pattern, alone):
    assert text.stands_alone(pattern) is alone


def test_groups_of_matches_that_look_around(rows):
    # The group of the match alone would be "ab": there the look-ahead holds at its end.
    assert contexts_of(rows, "abc abd ab", [r"(a\w*?)(?=c| |$)"], 20, 1, 1) == expected("abc abd ab", [r"(a\w*?)(?=c| |$)"], 20, 1)


def test_positions_across_blocks(rows):
    content = "ab" * 1000
    got = one(rows([(content,)], "c string").select(text.match_positions(F.col("c"), "b")))
    assert got == list(range(1, 2000, 2))


def test_redaction_defaults(rows):
    samples = {
        "Mail john.doe@example.com now": "Mail [REDACTED] now",
        "password: secretpass123 x": "[REDACTED] x",
        "key abc123def456ghi789jkl012mno345pqr678": "key [REDACTED]",
        "AKIA" + "A1" * 8 + "-x": "[REDACTED]-x",
        'token = "' + "a-" * 10 + '"': '[REDACTED]"',
        "plain 123-45-6789": "plain 123-45-6789",
    }
    df = rows([(k,) for k in samples], "t string")
    assert {r.t: r.x for r in df.select("t", text.redact(F.col("t")).alias("x")).collect()} == samples


def test_redaction_with_own_patterns_replaces_the_defaults(rows):
    df = rows([("a@b.com 123-45-6789",)], "t string")
    assert one(df.select(text.redact(F.col("t"), [r"\d{3}-\d{2}-\d{4}"]))) == "a@b.com [REDACTED]"


@pytest.mark.parametrize("answer, want", [
    ("1. Add an index on users\n- short\n* Rewrite the whole query", ["Add an index on users", "Rewrite the whole query"]),
    ("• First long item\n2 . Second long item\n- Third long item\n- Fourth long item", ["First long item", "Second long item", "Third long item"]),
    ("  You should consider caching.\nNothing.\nOPTIMIZE it", ["You should consider caching.", "OPTIMIZE it"]),
    ("- tiny\nnothing to do", []),
])
def test_recommendations(rows, answer, want):
    assert one(rows([(answer,)], "t string").select(text.extract_recommendations(F.col("t")))) == want


def test_title_preview_and_context(rows):
    df = rows([("\n  Head line\nbody",)], "c string")
    assert one(df.select(text.document_title(F.col("c")))) == "Head line"
    assert one(df.select(text.preview(F.lit("T"), F.lit("md"), F.lit("abcdef"), 3))) == "**T** (md):\nabc...\n"
    for position in (0, 5, 15):
        got = one(df.select(text.context(F.col("c"), F.lit(position), 10)))
        assert got == around("\n  Head line\nbody", position, 10)


def test_fingerprint_ignores_column_order(rows):
    df = rows([(1, "x")], "a int, b string")
    first, second = df.select(text.fingerprint("a", "b"), text.fingerprint("b", "a")).collect()[0]
    assert first == second and len(first) == 64 and set(first) <= set(string.hexdigits.lower())


def test_rounding_follows_the_exact_binary_value(rows):
    values = [2.675, 1.15, 0.125, 0.375, 1.005, 1234567.895, -2.675, 1e15]
    df = rows([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(columns.round_exact(F.col("v"), 2), columns.fixed(F.col("v"), 1)).collect()]
    assert got == [(round(v, 2), f"{v:.1f}") for v in values]


def test_title_case(rows):
    names = ["john", "o_neil", "ops1a", "josé", "mc-donald"]
    df = rows([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(columns.title_case(F.col("n"))).collect()] == [n.title() for n in names]


def test_display_formats(rows):
    sizes = {100: "100.0 B", 1024: "1.0 KB", 1280: "1.2 KB", 1024**2: "1.0 MB", 1024**3: "1.0 GB", 1024**5: "1.0 PB"}
    df = rows([(k,) for k in sizes], "n bigint")
    assert [r[0] for r in df.select(display.format_bytes(F.col("n"))).collect()] == list(sizes.values())
    times = {100.0: "100ms", 0.5: "0ms", 1000.0: "1.0s", 1500.0: "1.5s", 1150.0: "1.1s", 60000.0: "1.0m", 3600000.0: "1.0h"}
    df = rows([(k,) for k in times], "n double")
    assert [r[0] for r in df.select(display.format_duration(F.col("n"))).collect()] == list(times.values())


def test_paths(rows):
    names = ["src/A.PY", "README.md", ".bashrc", "x/.git/c.js", "a.b/noext", "x.tar.gz", "w.SQL"]
    df = rows([(n,) for n in names], "p string")
    p = F.col("p")
    got = df.select(paths.extension(p), paths.file_name(p), paths.is_code_file(p), paths.in_directory(p, (".git",))).collect()
    assert [r[0] for r in got] == [".py", ".md", "", ".js", "", ".gz", ".sql"]
    assert [r[1] for r in got] == ["A.PY", "README.md", ".bashrc", "c.js", "noext", "x.tar.gz", "w.SQL"]
    assert [r[2] for r in got] == [True, False, False, True, False, False, True]
    assert [r[3] for r in got] == [False, False, False, True, False, False, False]
    langs = df.select(paths.detect_language(p), paths.detect_language(p, vocab.INVENTORY_LANGUAGES, None)).collect()
    assert [tuple(r) for r in langs][:3] == [("python", "Python"), ("unknown", "Markdown"), ("unknown", None)]
