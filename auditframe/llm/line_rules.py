"""Quality rules by lines: drop bad lines first, then reject documents that lost too much.

Every line is judged by itself. A line fails the punctuation rule when signs
make up too much of it, the navigation rule when it is a row of short entries
between separators, and the boilerplate rule when it consists of a known notice
and little else. What is left, joined again, is the clean text; a document is
kept when enough of its characters are left and the base figures
(length, repeated 5-word windows) pass.

Only built-in column functions are used, so a document never leaves its row.

Nulls, empties, repeats: a null or empty text has no words and fails; blank lines
stay and count nothing; equal rows get equal results; further columns are passed
through ``clean_lines`` unless an output column replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.columns import words

#: Fixed values of the base figures.
SYMBOLS = "[#*$%&|<>]+"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Parameters of the line rules.
SIGNS = r"[#*$%&|<>!?~^_={}\[\]\\/@+]+"
MAX_SIGN_PERCENT = 12
SEPARATORS = "[|»›•·]"
MIN_ENTRIES = 4
MAX_ENTRY_WORDS = 3
BOILERPLATE = (
    "all rights reserved|cookie policy|use of cookies|uses cookies|enable javascript|privacy policy|terms of (use|service)"
    "|subscribe to our newsletter|click here|share this|skip to (main )?content|powered by|licensed under"
)
MAX_BOILERPLATE_WORDS = 15
MAX_LOST_PERCENT = 30

_WORD = "[^ \\t-\\r]"


def _count(c: Column, pattern: str) -> Column:
    """Code points that runs of ``pattern`` cover."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def bad_punctuation(line: Column) -> Column:
    """Signs make up more than MAX_SIGN_PERCENT of the line."""
    return _count(line, SIGNS) * 100 > F.length(line) * MAX_SIGN_PERCENT


def is_navigation(line: Column) -> Column:
    """At least MIN_ENTRIES entries between separators, of MAX_ENTRY_WORDS words at most on average."""
    entries = _count(line, SEPARATORS) + 1
    return (entries >= MIN_ENTRIES) & (F.size(words(F.regexp_replace(line, SEPARATORS, ""))) <= entries * MAX_ENTRY_WORDS)


def is_boilerplate(line: Column) -> Column:
    """A short line with a known notice."""
    return (F.size(words(line)) <= MAX_BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE)


def line_passes(line: Column) -> Column:
    return ~(bad_punctuation(line) | is_navigation(line) | is_boilerplate(line))


def _repeat_words(n: str, hashes: str, ordered: str) -> Column:
    """Words inside 5-word windows that occur twice or more; windows are compared by 64-bit hash."""
    o = F.col(ordered)
    twice = F.filter(o, lambda e, i: (F.get(o, i - 1)["h"] == e["h"]) | F.coalesce(F.get(o, i + 1)["h"] == e["h"], F.lit(False)))
    at = F.sort_array(F.transform(twice, lambda e: e["i"]))
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(at, none, lambda a, i: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end")))
    return F.when(o.isNull(), F.lit(0).cast("bigint")).otherwise(covered["n"])


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its figures, verdict and clean text beside all its columns.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text and n_bad_lines.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_bad_lines"]
    rest = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)]
    names = [c for c in docs.columns if c.lower() not in made]
    back = [F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns) if c in names]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    passed = [f"in_{k}" for k in range(len(docs.columns))]

    split = docs.select(*rest, whole.alias("whole")).select(
        *passed, "whole", words(F.col("whole")).alias("w"), F.split("whole", "\n", -1).alias("lines"))
    n = F.size("w")
    windows = split.select(
        *passed, "whole", "lines", n.alias("n"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))).alias("h"))
    ordered = windows.select(
        *passed, "whole", "lines", "n", "word_chars",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(
            F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("o"))
    solid = F.filter("lines", lambda x: x.rlike(_WORD))
    figures = ordered.select(
        *passed, "whole", "lines", F.col("n").cast("bigint").alias("n_words"), "word_chars",
        _count(F.col("whole"), SYMBOLS).cast("bigint").alias("n_symbols"),
        solid.alias("solid"), F.filter("lines", lambda x: ~x.rlike(_WORD) | line_passes(x)).alias("good"),
        _repeat_words("n", "h", "o").alias("n_repeat_words"))
    clean = F.array_join("good", "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    judged = figures.select(
        *passed, F.length("whole").alias("before"), "n_words", "word_chars", "n_symbols",
        (F.size("solid") - F.size(F.array_distinct("solid"))).cast("bigint").alias("n_dup_lines"), "n_repeat_words",
        failed.alias("base_failed"), clean.alias("clean_text"), (F.size("lines") - F.size("good")).cast("bigint").alias("n_bad_lines"))
    enough = (F.col("before") - F.length("clean_text")).cast("bigint") * 100 <= F.col("before").cast("bigint") * MAX_LOST_PERCENT
    results = F.struct(*made[:6], (~F.col("base_failed") & enough).alias("kept"), "clean_text", "n_bad_lines")
    # A generated row: filters on the results then stay above this work instead of repeating it inside them.
    return judged.select(*back, F.inline(F.array(results)))


def _duck_words(c: str) -> str:
    return f"regexp_extract_all({c}, '[^ \\t-\\r]+')"


def _duck_count(c: str, pattern: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, '{pattern}', '', 'g')))"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, {_duck_words('t')} AS w FROM d),
win AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM w WHERE len(w) >= {WINDOW}),
seq AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM win),
dup AS (SELECT r, s FROM seq GROUP BY r, s HAVING count(*) > 1),
rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT seq.r, unnest(range(i, i + {WINDOW})) AS p FROM seq JOIN dup ON seq.r = dup.r AND seq.s = dup.s) GROUP BY r),
l AS (SELECT r, k, u.l AS l FROM (
  SELECT r, unnest(range(1, len(ls) + 1)) AS k, ls FROM (SELECT r, string_split(t, chr(10)) AS ls FROM d)) x, LATERAL (SELECT x.ls[x.k] AS l) u),
lf AS (
  SELECT r, l, regexp_matches(l, '{_WORD}') AS solid,
    {_duck_count('l', SIGNS)} * 100 > length(l) * {MAX_SIGN_PERCENT} AS p,
    {_duck_count('l', SEPARATORS)} + 1 >= {MIN_ENTRIES}
      AND len({_duck_words(f"regexp_replace(l, '{SEPARATORS}', '', 'g')")}) <= ({_duck_count('l', SEPARATORS)} + 1) * {MAX_ENTRY_WORDS} AS v,
    regexp_matches(lower(l), '{BOILERPLATE}') AND len({_duck_words('l')}) <= {MAX_BOILERPLATE_WORDS} AS b
  FROM l),
ls AS (
  SELECT r, count(*) FILTER (solid) - count(DISTINCT l) FILTER (solid) AS n_dup_lines,
    greatest(0, coalesce(sum(length(l) + 1) FILTER (NOT solid OR NOT p AND NOT v AND NOT b), 0) - 1) AS left_chars
  FROM lf GROUP BY r),
f AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, length(t) AS before,
    CAST({_duck_count('t', SYMBOLS)} AS BIGINT) AS n_symbols, n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(w) < {MIN_WORDS} OR coalesce(rep.n, 0) * 100 > len(w) * {MAX_REPEAT_PERCENT} AS base_failed, left_chars
  FROM d JOIN w USING (r) JOIN ls USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (before - left_chars) * 100 <= before * {MAX_LOST_PERCENT} AS kept
FROM f
"""
