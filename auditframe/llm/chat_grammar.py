"""Chat formatting by a grammar that is read back: render, reparse, compare, escape what conflicts.

::

    conversation := turn*
    turn         := "<s>" role "[INST]" text "[/INST]" "</s>"

Roles and texts hold no control string. Each turn is rendered as it is and reparsed; if the
parser does not give back its role and text, it is rendered again with control strings and
``&`` escaped, and if that should not do, with every ``&``, ``<`` and ``[`` escaped. The parser
always unescapes, so a text that happens to contain an escape conflicts too. Then the whole
conversation is reparsed and compared; a difference ends the job with an error.

The loss mask is a list of spans (turn, begin, length), in code points of that turn's rendered
form: the texts of assistant turns.

Only built-in column functions are used. The conversation is one string by nature, so its
turns meet in one row; nothing else is gathered.

Nulls, empties, repeats: a null role or text is empty, a null turn sorts first, rows with a null
id form one conversation, equal turn numbers are ordered by role and text, repeated rows are
turns of their own, an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings, and what stands for their first character and for ``&``.
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
AMP, LT, BRACKET = "&amp;", "&lt;", "&#91;"
CONTROL = r"</?s>|\[/?INST\]"
#: Parameter: the role whose texts bear loss.
LEARNED = "assistant"

_TURNS = "array<struct<role: string, text: string>>"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    """Break control strings and mark ``&``."""
    c = F.regexp_replace(_swap(c, "&", AMP), "<(/?s>)", f"{LT}$1")
    return F.regexp_replace(c, r"\[(/?INST\])", f"{BRACKET}$1")


def escape_all(c: Column) -> Column:
    return _swap(_swap(_swap(c, "&", AMP), "<", LT), "[", BRACKET)


def unescape(c: Column) -> Column:
    """Undo either escape; ``&`` comes last, so that no escape arises on the way."""
    return _swap(_swap(_swap(c, LT, "<"), BRACKET, "["), AMP, "&")


def _segment(role: Column, text: Column) -> Column:
    """A turn without its end mark."""
    return F.concat(F.lit(BEGIN), role, F.lit(OPEN), text, F.lit(CLOSE))


def _opening(segment: Column) -> Column:
    """Code points of a segment before its text."""
    return F.instr(segment, OPEN) + len(OPEN) - 1


def _parsed(segment: Column) -> Column:
    """(role, text) of a segment; null if the grammar does not allow it."""
    inner = F.substr(segment, F.lit(len(BEGIN) + 1), F.length(segment) - len(BEGIN) - len(CLOSE))
    fits = (
        segment.startswith(BEGIN) & segment.endswith(CLOSE) & (F.length(segment) >= len(BEGIN + OPEN + CLOSE))
        & (F.instr(inner, OPEN) > 0) & (F.regexp_count(inner, F.lit(CONTROL)) == 1)
    )
    role = F.substr(inner, F.lit(1), F.instr(inner, OPEN) - 1)
    text = F.substr(segment, _opening(segment) + 1, F.length(segment) - _opening(segment) - len(CLOSE))
    return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))


def _unless_read_back(t: Column, other) -> Column:
    """The turn with its segment, or with another one where the parser does not give the turn back."""
    same = _parsed(t["segment"]).eqNullSafe(F.struct(t["role"].alias("role"), t["text"].alias("text")))
    again = _segment(other(t["role"]), other(t["text"]))
    return F.struct(t["role"].alias("role"), t["text"].alias("text"), F.when(same, t["segment"]).otherwise(again).alias("segment"))


def segments(formatted: Column) -> Column:
    """The turns' segments of a conversation; null if it does not end with a turn's end."""
    parts = F.split(formatted, END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))


def parse(formatted: Column) -> Column:
    """All turns of a formatted conversation."""
    return F.transform(segments(formatted), _parsed)


def render(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted and loss_spans, an array of (turn, begin, length)."""
    rows = conversations.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    raw = F.transform("said", lambda t: F.struct(
        t["role"].alias("role"), t["text"].alias("text"), _segment(t["role"], t["text"]).alias("segment")))
    whole = whole.select("conv_id", raw.alias("said"))
    for other in (escape, escape_all):
        whole = whole.select("conv_id", F.transform("said", lambda t: _unless_read_back(t, other)).alias("said"))  # noqa: B023
    whole = whole.select("conv_id", "said", F.array_join(F.transform("said", lambda t: F.concat(t["segment"], F.lit(END))), "").alias("formatted"))
    source = F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    wrong = F.concat(F.lit("conversation cannot be read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    spans = F.filter(
        F.transform("said", lambda t, i: F.struct(
            (i + 1).alias("turn"), _opening(t["segment"]).alias("begin"),
            (F.length(t["segment"]) - _opening(t["segment"]) - len(CLOSE)).alias("length"), t["role"].alias("role"))),
        lambda s: s["role"] == LEARNED)
    return whole.select(
        "conv_id",
        F.when(parse(F.col("formatted")).eqNullSafe(source), F.col("formatted")).otherwise(F.raise_error(wrong).cast("string")).alias("formatted"),
        F.transform(spans, lambda s: F.struct(
            s["turn"].alias("turn"), s["begin"].alias("begin"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output itself says: conv_id, turns (role, text), loss_text and formatted_chars."""
    parts = formatted.select("conv_id", "formatted", "loss_spans", segments(F.col("formatted")).alias("segments"))
    under = F.transform("loss_spans", lambda s: unescape(F.substr(F.element_at(F.col("segments"), s["turn"]), s["begin"] + 1, s["length"])))
    return parts.select(
        "conv_id",
        F.transform("segments", _parsed).cast(_TURNS).alias("turns"),
        F.array_join(under, "").alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The same figures from the source rows: escapes only lengthen a turn in which something conflicts.
ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, role || chr(1) || text AS said,
    regexp_matches(role || chr(1) || text, '</?s>|\[/?INST\]|&amp;|&lt;|&#91;') AS conflicts
  FROM rows
), turns AS (
  SELECT *, 20 + length(role) + length(text) + CASE WHEN conflicts THEN
    4 * (length(said) - length(replace(said, '&', ''))) + 3 * len(regexp_extract_all(said, '</?s>'))
    + 4 * len(regexp_extract_all(said, '\[/?INST\]')) ELSE 0 END AS chars
  FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
