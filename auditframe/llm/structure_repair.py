"""Conversation structure repair by depth-first branch-and-bound.

A sound conversation has the role initials ``(s?(ua)+)?``. A row may be kept (K, nothing),
given the role user or assistant (R, 3) or deleted (D, 4); a row with that role and no text may
be inserted anywhere (I, 3). Blank and duplicate rows must go; a truncated row that stays adds 3.
The cheapest edits win, and among them those whose initials, in order, are least in ASCII.

The search keeps an explicit stack and enters children in ASCII order, so paths are met in the
order of their initials. It has three ways to cut:

* *suffix lower bound*: ``bound[i]``, the cheapest edits of rows i.. if they might begin in
  whichever state suits them. It forgets how the prefix ended, costs one number a row and is at
  most 6 too low, since two insertions lead from any state to any that matters.
* *incumbent* (cost, initials): only cheaper solutions may follow, because later ones are greater
  in ASCII. Before there is one, ``bound[0] + 6`` limits the search.
* *dominance table*: a node (row, state) that was entered at the same or a lower cost is not
  entered again; an earlier prefix of equal cost is also the lesser one.

Costs at a node fall with each visit and lie within 12 of each other, so a node is entered 13 times
at most and the work is linear in the rows, however long the conversation.

Plan: faults and digests are computed in the row; a task streams the digests of its conversations
in order (no texts; the memory is some 500 bytes a row of one conversation at a time). To apply the edits, texts are
shuffled once and stream past the initials, so no conversation's text is ever held.

Order: by turn (nulls first), then role, then hash of role and text; equal rows are interchangeable.
Nulls, empties, repeats: a null role or text is one space, rows with a null id form one conversation, an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: costs, and the ids of states (nothing yet, after system, after user, after assistant).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: How far the bound may lie below the cheapest edits.
SLACK = 2 * INSERT
#: A row's code: its initial (s, u, a, other) plus these.
FORCED, CUT = 4, 8
#: The state after keeping a row of that initial, by state; -1 where the grammar forbids it.
KEEP = ((AFTER_S, AFTER_U, -1, -1), (-1, AFTER_U, -1, -1), (-1, -1, AFTER_A, -1), (-1, AFTER_U, -1, -1))
#: The state after a row of the role that the grammar wants next.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
#: Rows in an Arrow batch of results, and letters in a row that carries a part of the initials.
BATCH = 4096
CHUNK = 1 << 16

_NEVER = 1 << 60


def _bounds(codes: bytes) -> array:
    """The cheapest edits of each suffix, over all states it might begin in."""
    out = array("q", bytes(8 * (len(codes) + 1)))
    cost = [0, 2 * INSERT, INSERT, 0]
    for i in range(len(codes) - 1, -1, -1):
        code = codes[i]
        if code & FORCED:
            cost = [c + DELETE for c in cost]
        else:
            extra = TRUNCATED if code & CUT else 0
            row = []
            for state in range(4):
                best = min(cost[state] + DELETE, cost[NEXT[state]] + REROLE + extra)
                to = KEEP[state][code & 3]
                row.append(min(best, cost[to] + extra) if to >= 0 else best)
            user, assistant = min(row[AFTER_U], row[AFTER_A] + INSERT), min(row[AFTER_A], row[AFTER_U] + INSERT)
            cost = [min(row[START], user + INSERT), min(row[AFTER_S], user + INSERT), user, assistant]
        out[i] = min(cost)
    return out


def search(codes: bytes) -> tuple[int, bytes]:
    """(cost, initials) of the cheapest edits of the rows with these codes, the least in ASCII among them."""
    n = len(codes)
    bound = _bounds(codes)
    limit = bound[0] + SLACK  # no costlier solution is looked at
    seen = array("q", [_NEVER]) * (4 * (n + 1))  # the dominance table: least cost by node
    path = bytearray()
    incumbent: tuple[int, bytes] | None = None
    stack = [(0, START, 0, 0, 0)]  # row, state, cost, letters before, letter
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost + bound[i] > limit or seen[4 * i + state] <= cost:
            continue
        seen[4 * i + state] = cost
        del path[depth:]
        if letter:
            path.append(letter)
            depth += 1
        if i == n and state in (START, AFTER_A):
            incumbent, limit = (cost, bytes(path)), cost - 1
            continue
        # Pushed in falling order of the letters: R, K, I, D.
        if i < n and not codes[i] & FORCED:
            extra = TRUNCATED if codes[i] & CUT else 0
            stack.append((i + 1, NEXT[state], cost + REROLE + extra, depth, 82))
            to = KEEP[state][codes[i] & 3]
            if to >= 0:
                stack.append((i + 1, to, cost + extra, depth, 75))
        stack.append((i, NEXT[state], cost + INSERT, depth, 73))
        if i < n:
            stack.append((i + 1, state, cost + DELETE, depth, 68))
    return incumbent


def _said(c: Column) -> Column:
    return F.coalesce(c, F.lit(" "))


def _ordered(conversations: DataFrame) -> tuple[DataFrame, list[str]]:
    """The four columns, nulls filled, with two hashes of each row, and the order of a conversation's rows."""
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _said(F.col("role")).alias("role"), _said(F.col("text")).alias("text"))
    rows = rows.select("*", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit(1), "role").alias("h2"))
    return rows, ["turn", "role", "h1", "h2"]


def damage(conversations: DataFrame) -> DataFrame:
    """The given rows with faults that depend on ``crc32(conv_id:turn) % 20``: dropped, emptied, unpointed, repeated, of another role."""
    name = F.concat(_said(F.col("conv_id").cast("string")), F.lit(":"), _said(F.col("turn").cast("string")))
    rows = conversations.select("conv_id", "turn", _said(F.col("role")).alias("role"), _said(F.col("text")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    kind = F.col("fault")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def diagnose(conversations: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit, the initials of the edits."""
    rows, order = _ordered(conversations)
    first = F.substring("role", 1, 1)
    last = F.regexp_extract("text", r"([^ \t-\r])[ \t-\r]*\z", 1)
    rows = rows.select(
        "conv_id", "turn", "role", "h1", "h2",
        F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3).alias("initial"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
    kind = dict(rows.dtypes)["conv_id"]
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        of, case = None, None
        for b in batches:
            of = b.schema.field("conv_id").type
            for c, turn, h1, h2, initial, blank, cut in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "h1", "h2", "initial", "blank", "truncated"))):
                if case is None or case.id != c:
                    if case is not None:
                        out.append(case.result())
                    case = _Case(c)
                    if len(out) >= BATCH:
                        yield _batch(out, names, of)
                case.add(turn, h1, h2, initial, blank, cut)
        if case is not None:
            out.append(case.result())
            yield _batch(out, names, of)

    return rows.select("conv_id", "turn", "h1", "h2", "initial", "blank", "truncated").mapInArrow(
        run, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


def _batch(rows: list[tuple], names: list[str], of: pa.DataType) -> pa.RecordBatch:
    """The rows as a batch whose first column has type ``of``; empties the list."""
    columns = [pa.array(c, of) if k == 0 else pa.array(c) for k, c in enumerate(zip(*rows))]
    rows.clear()
    return pa.RecordBatch.from_arrays(columns, names)


class _Case:
    """One conversation while its rows stream past."""

    def __init__(self, conv_id):
        self.id = conv_id
        self.codes = bytearray()
        self.known: set[int] = set()
        self.low = self.high = self.last = None
        self.distinct = self.illegal = self.blank = self.duplicate = self.truncated = 0

    def add(self, turn: int | None, h1: int, h2: int, initial: int, blank: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:  # turns come in rising order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        code, key = initial, (h1 << 64) + h2
        if blank:
            self.blank += 1
            code |= FORCED
        elif key in self.known:
            self.duplicate += 1
            code |= FORCED
        elif cut:
            self.truncated += 1
            code |= CUT
        self.known.add(key)
        if self.last is not None and (self.last, initial) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.last = initial
        self.codes.append(code)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        cost, audit = search(bytes(self.codes))
        return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit.decode()


def apply(conversations: DataFrame, diagnosed: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place, role, text; rows of one conversation are neighbours, in order.

    Initials come first in each conversation's stream, in parts of CHUNK letters, and then the rows that they edit.
    """
    rows, order = _ordered(conversations)
    kind = dict(rows.dtypes)["conv_id"]
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("audit") - 1, F.lit(0)), F.lit(CHUNK)))
    edits = diagnosed.select("conv_id", "audit", parts.alias("part")).select(
        "conv_id", F.col("part").cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.substr("audit", F.col("part") + 1, F.lit(CHUNK)).alias("text"), F.lit(0).cast("bigint").alias("h1"), F.lit(0).cast("bigint").alias("h2"), F.lit(0).alias("is_row"))
    both = edits.unionByName(rows.withColumn("is_row", F.lit(1))).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", "is_row", *order).select("conv_id", "is_row", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names, of, size = ["conv_id", "place", "role", "text"], None, 0
        repair = None
        for b in batches:
            of = b.schema.field("conv_id").type
            for c, is_row, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "is_row", "role", "text"))):
                if repair is None or repair.id != c:
                    if repair is not None:
                        out.extend(repair.rest())
                    repair = _Repair(c)
                if is_row:
                    out.extend(repair.row(role, text))
                    size += len(text)
                else:
                    repair.edits.append(text)
                if len(out) >= BATCH or size > 1 << 22:
                    size = 0
                    if out:
                        yield _batch(out, names, of)
        if repair is not None:
            out.extend(repair.rest())
            if out:
                yield _batch(out, names, of)

    return both.mapInArrow(run, f"conv_id {kind}, place bigint, role string, text string")


class _Repair:
    """Applies the edits of one conversation to its rows as they come."""

    def __init__(self, conv_id):
        self.id = conv_id
        self.edits: list[str] = []
        self.letters: Iterator[str] | None = None
        self.next: str | None = None
        self.place = 0
        self.state = START

    def _step(self) -> str | None:
        """The next letter that is not an insertion is left in ``next``."""
        if self.letters is None:
            self.letters = (x for part in self.edits for x in part)
        return next(self.letters, None)

    def _emit(self, role: str, text: str) -> tuple:
        self.place += 1
        return self.id, self.place - 1, role, text

    def _wanted(self) -> str:
        self.state = NEXT[self.state]
        return "user" if self.state == AFTER_U else "assistant"

    def row(self, role: str, text: str) -> Iterator[tuple]:
        while (letter := self._step()) == "I":
            yield self._emit(self._wanted(), "")
        if letter == "K":
            self.state = KEEP[self.state]["sua".index(role[0])]
            yield self._emit(role, text)
        elif letter == "R":
            yield self._emit(self._wanted(), text)

    def rest(self) -> Iterator[tuple]:
        while self._step() is not None:  # only insertions are left
            yield self._emit(self._wanted(), "")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of ``role:text``, joined by newlines, of rows in the order that ``apply`` gives."""
    kind = dict(repaired.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names, of, now, digest = ["conv_id", "repaired_sha256"], None, None, None
        for b in batches:
            of = b.schema.field("conv_id").type
            for c, place, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if digest is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = c, hashlib.sha256()
                    if len(out) >= BATCH:
                        yield _batch(out, names, of)
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            out.append((now, digest.hexdigest()))
            yield _batch(out, names, of)

    return repaired.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


#: The same by another way: every row's damage and faults in SQL, then a forward pass that keeps, for each
#: state, the least (cost, initials, repaired rows); two prefixes of equal cost are never one the start of the other.
ORACLE_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS l FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))
), named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
), hit AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, l[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS fault
  FROM named, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
    regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS ending
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, ending = '' AS blank,
    ending <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate
  FROM placed
), coded AS (
  SELECT *, blank OR duplicate AS forced, NOT blank AND NOT duplicate AND ending NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS initial
  FROM judged
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM coded GROUP BY conv_id
), step AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, {'c': CAST(0 AS BIGINT), 'x': '', 'o': CAST([] AS VARCHAR[])} AS b,
    {'c': CAST(1000000 AS BIGINT), 'x': '', 'o': CAST([] AS VARCHAR[])} AS s,
    {'c': CAST(3 AS BIGINT), 'x': 'I', 'o': ['user:']} AS u, {'c': CAST(6 AS BIGINT), 'x': 'II', 'o': ['user:', 'assistant:']} AS a
  FROM figures
  UNION ALL
  SELECT conv_id, pos, b, s, u, CASE WHEN a < ua THEN a ELSE ua END FROM (
    SELECT *, {'c': u.c + 3, 'x': u.x || 'I', 'o': list_append(u.o, 'assistant:')} AS ua FROM (
      SELECT conv_id, pos, b, s, a, list_sort([u, {'c': b.c + 3, 'x': b.x || 'I', 'o': list_append(b.o, 'user:')},
        {'c': s.c + 3, 'x': s.x || 'I', 'o': list_append(s.o, 'user:')}, {'c': a.c + 3, 'x': a.x || 'I', 'o': list_append(a.o, 'user:')}])[1] AS u
      FROM (
        SELECT conv_id, pos, db AS b,
          CASE WHEN forced OR initial <> 's' THEN ds ELSE list_sort([ds, kept_b])[1] END AS s,
          CASE WHEN forced THEN du WHEN initial = 'u' THEN list_sort([du, kept_b, kept_s, kept_a, ru_b, ru_s, ru_a])[1] ELSE list_sort([du, ru_b, ru_s, ru_a])[1] END AS u,
          CASE WHEN forced THEN da WHEN initial = 'a' THEN list_sort([da, kept_u, ra_u])[1] ELSE list_sort([da, ra_u])[1] END AS a
        FROM (
          SELECT step.conv_id, coded.pos, forced, initial,
            {'c': b.c + 4, 'x': b.x || 'D', 'o': b.o} AS db, {'c': s.c + 4, 'x': s.x || 'D', 'o': s.o} AS ds,
            {'c': u.c + 4, 'x': u.x || 'D', 'o': u.o} AS du, {'c': a.c + 4, 'x': a.x || 'D', 'o': a.o} AS da,
            {'c': b.c + t, 'x': b.x || 'K', 'o': list_append(b.o, said)} AS kept_b, {'c': s.c + t, 'x': s.x || 'K', 'o': list_append(s.o, said)} AS kept_s,
            {'c': u.c + t, 'x': u.x || 'K', 'o': list_append(u.o, said)} AS kept_u, {'c': a.c + t, 'x': a.x || 'K', 'o': list_append(a.o, said)} AS kept_a,
            {'c': b.c + t + 3, 'x': b.x || 'R', 'o': list_append(b.o, 'user:' || text)} AS ru_b, {'c': s.c + t + 3, 'x': s.x || 'R', 'o': list_append(s.o, 'user:' || text)} AS ru_s,
            {'c': a.c + t + 3, 'x': a.x || 'R', 'o': list_append(a.o, 'user:' || text)} AS ru_a, {'c': u.c + t + 3, 'x': u.x || 'R', 'o': list_append(u.o, 'assistant:' || text)} AS ra_u
          FROM step JOIN (SELECT *, CASE WHEN truncated THEN 3 ELSE 0 END AS t, role || ':' || text AS said FROM coded) coded
            ON coded.conv_id IS NOT DISTINCT FROM step.conv_id AND coded.pos = step.pos + 1
        )
      )
    )
  )
), best AS (
  SELECT step.conv_id, list_sort([b, a])[1] AS r FROM step JOIN figures f ON f.conv_id IS NOT DISTINCT FROM step.conv_id AND f.n = step.pos
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(r.c, 0) AS cost, coalesce(r.x, '') AS audit, sha256(coalesce(array_to_string(r.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
