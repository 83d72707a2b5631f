"""Functions over whole texts: redaction, match positions, contexts, digests."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import all_groups, let, strip

# People and words may carry any Unicode letter; "." stops at \n only.
WORDS = "(?idU)"

_BLOCK = 256

# The characters beyond ASCII whose upper or lower case is an ASCII letter, as Java folds them.
_LIKE_ASCII = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}


def words_of(pattern: str) -> tuple[str, ...]:
    """Lower-case runs of letters (also ``_ / : %``) that every match of ``pattern`` holds; none where that is not plain to see.

    Only what lies outside groups and classes counts, and a pattern with alternatives has none. The longest come first.
    """
    plain = re.sub(r"\\.", "\0", pattern)
    if re.search(r"\\(?![sSwWdDbB\W])|\(\?[a-zA-Z]*x", pattern) or re.search(r"\[[^\]]*\[", plain):
        return ()
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "\0", plain)
    while (inner := re.sub(r"\([^()]*\)", "\0", plain)) != plain:
        plain = inner
    if "|" in plain:
        return ()
    runs = re.findall(r"[a-z_/:%]+", re.sub(r"[a-zA-Z_/:%](?=[?*{])|\{[^}]*\}", "\0", plain).lower())
    return tuple(sorted(dict.fromkeys(runs), key=len, reverse=True))


def folded(col: Column) -> Column:
    """Lower case in which every character that a pattern without regard to case takes for an ASCII letter is that letter."""
    odd = reduce(lambda a, b: a | b, [F.contains(col, F.lit(c)) for c in _LIKE_ASCII])
    return F.lower(F.when((F.octet_length(col) > F.length(col)) & odd, F.translate(col, *map("".join, zip(*_LIKE_ASCII.items())))).otherwise(col))


def may_match(lower: Column, pattern: str) -> Column:
    """False only where ``pattern`` matches nowhere in the text whose :func:`folded` form is ``lower``; it saves the engine a scan."""
    return reduce(lambda a, b: a & b, [F.contains(lower, F.lit(w)) for w in words_of(pattern)], F.lit(True))


def stands_alone(pattern: str) -> bool:
    """Whether a match of ``pattern`` depends on its own characters only: no anchors, no look-around, nothing possessive.

    Then the pattern matches the same way in a match by itself, and no text like the first match comes before it.
    """
    plain = re.sub(r"\[\^?\]?[^\]]*\]", "\0", re.sub(r"\\[^a-zA-Z]", "\0", pattern))
    return not re.search(r"\\[^sSwWdD]|[\^$\[\]]|\(\?(?![a-zA-Z]*[:)])|[+*?}]\+", plain)


def redact(col: Column, patterns: Sequence[str] | None = None) -> Column:
    """Replace every match of each pattern, in order, by ``[REDACTED]``."""
    for pattern in vocab.REDACTION_PATTERNS if patterns is None else patterns:
        replaced = F.regexp_replace(col, "(?iU)" + pattern, vocab.REDACTION_MARK)
        # A text without an @ skips the scan for the built-in e-mail pattern, and for no other.
        is_email = pattern == vocab.REDACTION_PATTERNS[0]
        col = F.when(F.contains(col, F.lit("@")), replaced).otherwise(col) if is_email else replaced
    return col


def match_positions(col: Column, pattern: str) -> Column:
    """Start offset (0-based, in characters) of every match of ``pattern``.

    An offset is the length of all gaps and matches before it. The running sum
    is taken in blocks, so the work stays near linear in the match count.
    """
    matches = all_groups(col, pattern, 0)
    gaps = F.split(col, pattern, -1)
    steps = F.zip_with(
        gaps, F.concat(F.array(F.lit("")), matches), lambda gap, before: F.length(before) + F.length(gap)
    )
    return let(F.slice(steps, 1, F.size(matches)), _running_sum)


def _running_sum(steps: Column) -> Column:
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, x: acc + x)

    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(steps) - 1) / _BLOCK), F.lit(0)).cast("int")),
        lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    per_block = let(
        blocks,
        lambda bs: let(
            F.transform(bs, total),
            lambda sums: F.transform(
                bs,
                lambda part, b: let(
                    total(F.slice(sums, F.lit(1), b)),
                    lambda base: F.transform(part, lambda _, i: base + total(F.slice(part, F.lit(1), i + 1))),
                ),
            ),
        ),
    )
    return F.when(F.size(steps) == 0, F.array().cast("array<bigint>")).otherwise(F.flatten(per_block))


def context(col: Column, position: Column, length: int) -> Column:
    """Text around ``position``: half of ``length`` on each side, cut sides marked."""
    half = length // 2
    start = F.greatest(position - half, F.lit(0))
    end = F.least(F.length(col), position + half)
    middle = strip(col.substr((start + 1).cast("int"), (end - start).cast("int")))
    return F.concat(
        F.when(start > 0, "...").otherwise(""), middle, F.when(end < F.length(col), "...").otherwise("")
    )


def match_contexts(
    col: Column, patterns: Sequence[str], length: int, group: int = 0, shortest: int = 1, lower: Column | None = None
) -> Column:
    """Every match of every pattern as ``array<struct<ord, n, found, context>>``.

    ``ord`` numbers the patterns and ``n`` the matches of one pattern. ``context``
    equals :func:`context` at the match start, but is pieced together from the
    neighbouring gaps and matches, so one text costs time linear in its length
    however many matches it holds. ``shortest`` is a lower bound on the
    characters of a match; it limits how many neighbours must be looked at.
    ``lower`` is the :func:`folded` text, if it is a column already.
    """
    half = length // 2
    keep = F.lit(half + 1)
    reach = F.lit(math.ceil((half + 1) / shortest))
    kind = "struct<ord: int, m: array<string>, g: array<string>, found: array<string>>"

    def matched(ord_: int, pattern: str, low: Column) -> Column:
        def parts(whole: Column) -> Column:
            found = whole
            if group:
                found = F.transform(whole, lambda m: F.regexp_extract(m, pattern, group)) if stands_alone(pattern) else all_groups(col, pattern, group)
            return F.when(F.size(whole) > 0, F.struct(F.lit(ord_), whole, F.split(col, pattern, -1), found).cast(kind))

        possible = may_match(low, pattern)
        if _existence(pattern) != pattern:
            possible = possible & F.rlike(col, F.lit(_existence(pattern)))
        return F.when(possible, let(all_groups(col, pattern, 0), parts))

    def windows(p: Column) -> Column:
        before = F.zip_with(p["g"], p["m"], lambda g, m: F.concat(F.right(g, keep), F.right(m, keep)))
        after = F.zip_with(
            p["m"], F.slice(p["g"], 2, F.size(p["m"])), lambda m, g: F.concat(F.left(m, keep), F.left(g, keep))
        )
        return F.struct(p["ord"].alias("ord"), p["found"].alias("found"), p["g"].alias("g"), before.alias("b"), after.alias("a"))

    def one(w: Column, text: Column, n: Column) -> Column:
        seen = F.least(n, reach)
        before = F.right(F.concat(F.array_join(F.slice(w["b"], n - seen + 1, seen), ""), F.get(w["g"], n)), keep)
        after = F.left(F.array_join(F.slice(w["a"], n + 1, reach), ""), keep)
        around = let(
            F.struct(before.alias("b"), after.alias("a")),
            lambda s: F.concat(
                F.when(F.length(s["b"]) > half, "...").otherwise(""),
                strip(F.concat(F.right(s["b"], F.lit(half)), F.left(s["a"], F.lit(half)))),
                F.when(F.length(s["a"]) > half, "...").otherwise(""),
            ),
        )
        return F.struct(w["ord"].alias("ord"), n.alias("n"), text.alias("found"), around.alias("context"))

    def all_matched(low: Column) -> Column:
        return F.array_compact(F.array(*[matched(i, p, low) for i, p in enumerate(patterns)]))

    hits = let(folded(col), all_matched) if lower is None else all_matched(lower)
    return F.flatten(
        F.transform(
            F.transform(hits, windows), lambda w: F.transform(w["found"], lambda text, n: one(w, text, n))
        )
    )


def _existence(pattern: str) -> str:
    """A pattern that matches in the same texts as ``pattern``, at less cost.

    A leading run of word characters is cut to its last one: the engine would
    otherwise try that run again from each of its characters.
    """
    run = r"(\w+)"
    return pattern.replace(run, r"\w", 1) if pattern.startswith((run, WORDS + run)) else pattern


def extract_recommendations(col: Column, limit: int = 3) -> Column:
    """First bullet or numbered lines over 10 characters, else lines with a keyword."""
    bullet = "(?U)" + vocab.RECOMMENDATION_BULLET
    lines = F.transform(F.split(col, "\n", -1), strip)
    listed = F.filter(
        F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(bullet))), lambda x: F.regexp_replace(x, bullet, "")),
        lambda x: F.length(x) > 10,
    )
    words = "|".join(vocab.RECOMMENDATION_KEYWORDS)
    hinted = F.filter(lines, lambda x: F.rlike(F.lower(x), F.lit(words)))
    return F.slice(let(listed, lambda b: F.when(F.size(b) > 0, b).otherwise(hinted)), 1, limit)


def preview(title: Column, kind: Column, content: Column, max_length: int = 500) -> Column:
    """Heading line plus the first ``max_length`` characters."""
    body = F.concat(
        F.left(content, F.lit(max_length)), F.when(F.length(content) > max_length, "...").otherwise("")
    )
    return F.concat(F.lit("**"), title, F.lit("** ("), kind, F.lit("):\n"), body, F.lit("\n"))


def document_title(content: Column) -> Column:
    """First line of the stripped text, at most 100 characters."""
    return F.left(F.substring_index(strip(content), "\n", 1), F.lit(100))


def fingerprint(*names: str) -> Column:
    """SHA-256 of the record as JSON with its keys in sorted order; a NULL stays a key."""
    record = F.struct(*[F.col(n) for n in sorted(names)])
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)
