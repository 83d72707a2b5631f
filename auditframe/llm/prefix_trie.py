"""Prefix trie of conversations whose heads come from another one, by composable fingerprints.

A sequence of turns has the fingerprint ``x1 B^(n-1) + ... + xn`` modulo a prime of 127 bits, where ``xi``
are digests of its turns. Fingerprints compose: ``f(uv) = f(u) B^|v| + f(v)``. That is used three times:

* **Scan.** Turns are sorted over all tasks at once, so a conversation may span many of them. A task
  composes what it sees; the products of conversations that cross a border are carried over.
* **Rebuilding.** Conversation c is the head of another one and its own suffix. With F the own prefix
  products, the rebuilt prefix up to the own turn d is ``F_d + (H - F_h) B^(d-h)``: head and suffix are
  combined as products, no rebuilt text and no copied turn arises. A rebuilt row is a few numbers and
  the reference (conversation, position) of the stored turn that it ends with.
* **Parents.** A prefix's parent has the fingerprint ``(f - x) / B``.

**Equality.** Every group of equal (depth, fingerprint) must agree on its parent and on the digest of its last
turn, and where its turns are not all one stored turn, all stored turns of that digest must have one role and
text. By induction over depth its members then are equal sequences. If not, another seed is drawn.

**Subtrees** need no walk: the smallest member of a node owns it. A conversation owns the end of its own
path from some depth on, so the subtree of a node holds the rest of its owner's path and everything
that its other members own: sums over the node's members.

No group is gathered: counts and sums are partial aggregates, joins run on (conversation, task of the scan),
the few nodes with a thousandth of all nodes as children are joined by a broadcast of a thousand rows
at most, and lists of ends are digested as streams of joined parts.

Order: by turn (nulls first), then by digest. Nulls, empties, repeats: a null role or text is empty, rows with a null
id take no part, repeated rows are turns of their own, an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.session import materialize, materialize_counted

#: Fixed value: a Mersenne prime.
PRIME = (1 << 127) - 1
#: Parameters: seeds tried until no fingerprint collides, conversation ids in one part of a list of ends.
SEEDS = range(8)
PART = 4096
#: Parents with at least a HOT-th of all nodes as children, so HOT of them at most, are joined by broadcast.
HOT = 1000

_LOW = (1 << 64) - 1


def _base(seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"prefix trie {seed}".encode(), digest_size=16).digest(), "big") % (PRIME - 2) + 2


def _signed(value: int) -> tuple[int, int]:
    """Upper and lower half of a fingerprint as signed longs."""
    low = value & _LOW
    return value >> 64, low - (1 << 64) if low >> 63 else low


def _number(high: int | None, low: int | None) -> int:
    return 0 if high is None else (high << 64) | (low & _LOW)


def _turn(a: int, b: int) -> int:
    """A turn's digest as an element."""
    return (((a & (_LOW >> 1)) << 64) | (b & _LOW)) % PRIME


def digests(role: Column, text: Column, seed: int) -> tuple[Column, Column]:
    """Two 64-bit digests of a turn."""
    return F.xxhash64(F.lit(seed), role, text), F.xxhash64(text, F.lit(~seed), role)


def _columns(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"opens": pa.bool_(), "is_end": pa.bool_(), "ids": pa.string(), "ends_sha256": pa.string(), "part": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names)


def _scan(turns: DataFrame, base: int) -> DataFrame:
    """Position and prefix product of every turn in its conversation: conv_id, part, pos, hi, lo, a, b, chars."""
    order = ["conv_id", "turn", "a", "b", "row"]
    names = ["conv_id", "part", "pos", "hi", "lo", "a", "b", "chars", "opens"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now, pos, value = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            out = []
            for c, a, b, chars in _columns(batch, ["conv_id", "a", "b", "chars"]):
                if c != now:
                    first = c if now is None else first
                    now, pos, value = c, 0, 0
                pos, value = pos + 1, (value * base + _turn(a, b)) % PRIME
                out.append((c, part, pos, *_signed(value), a, b, chars, c == first))
            if out:
                yield _batch(out, names)

    schema = "conv_id bigint, part int, pos bigint, hi bigint, lo bigint, a bigint, b bigint, chars bigint"
    scanned = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "a", "b", "chars").mapInArrow(local, schema + ", opens boolean")
    scanned = materialize(scanned, "scanned")
    # One conversation opens each task, so these are two rows a task at most.
    opening = scanned.where("opens and pos = 1").select("conv_id").distinct()
    ends = scanned.join(F.broadcast(opening), "conv_id", "left_semi").groupBy("conv_id", "part").agg(
        F.max("pos").alias("n"), F.max_by("hi", "pos").alias("hi"), F.max_by("lo", "pos").alias("lo"))
    carry: dict[tuple[int, int], tuple[int, int]] = {}
    before: dict[int, tuple[int, int]] = {}
    for r in ends.orderBy("conv_id", "part").collect():
        n, value = before.get(r["conv_id"], (0, 0))
        if n:
            carry[r["conv_id"], r["part"]] = n, value
        before[r["conv_id"]] = n + r["n"], (value * pow(base, r["n"], PRIME) + _number(r["hi"], r["lo"])) % PRIME
    if not carry:
        return scanned.drop("opens")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, part, pos, hi, lo, a, b, chars in _columns(batch, names[:-1]):
                n, value = carry.get((c, part), (0, 0))
                if n:
                    hi, lo = _signed((value * pow(base, pos, PRIME) + _number(hi, lo)) % PRIME)
                out.append((c, part, pos + n, hi, lo, a, b, chars))
            if out:
                yield _batch(out, names[:-1])

    return materialize(scanned.mapInArrow(carried, schema), "carried")


def _rebuilt(scanned: DataFrame, base: int, head_of: Callable[[Column], Column], head_turns: Callable[[Column], Column], longest: int) -> DataFrame:
    """The members of all nodes: a row for each conversation and depth.

    conv_id, part, depth, hi, lo, phi, plo (the parent's fingerprint), a, b, chars, rconv, rpos (the stored turn), is_end.
    """
    at_cut = F.col("pos") == head_turns(F.col("conv_id"))
    pieces = materialize(scanned.groupBy("conv_id", "part").agg(
        F.max("pos").alias("n"), F.max(F.when(at_cut, F.col("hi"))).alias("yhi"), F.max(F.when(at_cut, F.col("lo"))).alias("ylo")), "pieces")
    heads = scanned.where((F.col("pos") <= longest) & (F.col("conv_id") == head_of(F.col("conv_id")))).groupBy(F.col("conv_id").alias("rconv")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hi", "lo", "a", "b", "chars"))).alias("head"))
    convs = pieces.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("yhi").alias("yhi"), F.max("ylo").alias("ylo"))
    convs = convs.withColumns({"rconv": head_of(F.col("conv_id")), "h": head_turns(F.col("conv_id")).cast("bigint")}).join(heads, "rconv", "left")
    convs = convs.withColumn("head", F.filter("head", lambda t: t["pos"] <= F.col("h")))
    convs = convs.withColumn("k", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).cast("bigint"))
    convs = convs.withColumn("total", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = materialize(convs.withColumn("x", F.when(F.col("k") > 0, F.element_at("head", -1))), "convs")

    none = F.lit(None).cast("bigint")
    columns = ["conv_id", "part", "depth", "hi", "lo", "xhi", "xlo", "yhi", "ylo", "steps", "a", "b", "chars", "rconv", "rpos", "is_end"]
    roots = convs.select(
        "conv_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("hi", "lo")],
        *[none.alias(c) for c in ("xhi", "xlo", "yhi", "ylo")], F.lit(0).cast("bigint").alias("steps"), none.alias("a"), none.alias("b"),
        F.lit(0).cast("bigint").alias("chars"), none.alias("rconv"), none.alias("rpos"), (F.col("total") == 0).alias("is_end"))
    taken = convs.select("conv_id", "rconv", "total", F.explode("head").alias("t")).select(
        "conv_id", F.lit(-1).alias("part"), F.col("t.pos").alias("depth"), "t.hi", "t.lo", *[none.alias(c) for c in ("xhi", "xlo", "yhi", "ylo")],
        F.lit(0).cast("bigint").alias("steps"), "t.a", "t.b", "t.chars", "rconv", F.col("t.pos").alias("rpos"), (F.col("t.pos") == F.col("total")).alias("is_end"))
    joints = pieces.select("conv_id", "part").join(
        convs.select("conv_id", "h", "k", "total", F.col("x.hi").alias("xhi"), F.col("x.lo").alias("xlo"), "yhi", "ylo"), "conv_id")
    own = scanned.join(joints, ["conv_id", "part"]).where("pos > h").select(
        "conv_id", "part", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "hi", "lo", "xhi", "xlo", "yhi", "ylo",
        (F.col("pos") - F.col("h")).alias("steps"), "a", "b", "chars", F.col("conv_id").alias("rconv"), F.col("pos").alias("rpos"),
        (F.col("k") + F.col("pos") - F.col("h") == F.col("total")).alias("is_end"))
    inverse = pow(base, -1, PRIME)
    names = ["conv_id", "part", "depth", "hi", "lo", "phi", "plo", "a", "b", "chars", "rconv", "rpos", "is_end"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, part, depth, hi, lo, xhi, xlo, yhi, ylo, steps, a, b, chars, rconv, rpos, is_end in _columns(batch, columns):
                phi = plo = None
                if depth:
                    value = _number(hi, lo)
                    if steps:
                        value = (value + (_number(xhi, xlo) - _number(yhi, ylo)) * pow(base, steps, PRIME)) % PRIME
                        hi, lo = _signed(value)
                    phi, plo = _signed((value - _turn(a, b)) * inverse % PRIME)
                out.append((c, part, depth, hi, lo, phi, plo, a, b, chars, rconv, rpos, is_end))
            if out:
                yield _batch(out, names)

    schema = "conv_id bigint, part int, depth bigint, hi bigint, lo bigint, phi bigint, plo bigint, a bigint, b bigint, chars bigint, rconv bigint, rpos bigint, is_end boolean"
    return materialize(roots.unionByName(taken).unionByName(own).mapInArrow(combine, schema), "members")


def _ends(members: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node, in rising order: parts of lists are joined in parallel and then streamed."""
    key = ["depth", "hi", "lo"]
    order = [*key, "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []
        for batch in batches:
            for *node, c in _columns(batch, order):
                if ids and (node != now or len(ids) == PART):
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = node
                ids.append(c)
            if out:
                yield _batch(out, [*key, "conv_id", "ids"])
                out = []
        if ids:
            yield _batch([(*now, ids[0], ",".join(map(str, ids)))], [*key, "conv_id", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for *node, ids in _columns(batch, [*key, "ids"]):
                if node == now:
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = node, hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield _batch(out, [*key, "ends_sha256"])
        if now is not None:
            yield _batch([(*now, sha.hexdigest())], [*key, "ends_sha256"])

    schema = "depth bigint, hi bigint, lo bigint"
    parts = members.where("is_end").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, f"{schema}, conv_id bigint, ids string")
    return parts.repartition(*key).sortWithinPartitions(*order).select(*key, "ids").mapInArrow(digest, f"{schema}, ends_sha256 string")


def _nodes(members: DataFrame) -> DataFrame:
    """One row per group of equal fingerprints; ``differs`` where its members do not agree."""
    both = [f(c).alias(f"{n}_{c}") for c in ("phi", "plo", "a", "b", "rconv", "rpos") for n, f in (("least", F.min), ("most", F.max))]
    nodes = members.groupBy("depth", "hi", "lo").agg(
        F.min("conv_id").alias("conv_id"), F.min_by("part", "conv_id").alias("part"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), *both)

    def unequal(*names: str) -> Column:
        found = F.lit(False)
        for c in names:
            found = found | F.coalesce(F.col(f"least_{c}") != F.col(f"most_{c}"), F.lit(False))
        return found

    return nodes.select(
        "depth", "hi", "lo", "conv_id", "part", "n_convs", "chars", F.col("least_phi").alias("phi"), F.col("least_plo").alias("plo"), F.col("least_a").alias("a"),
        F.col("least_b").alias("b"), unequal("phi", "plo", "a", "b").alias("differs"), unequal("rconv", "rpos").alias("several"))


def _is_exact(nodes: DataFrame, source: DataFrame) -> bool:
    """No group joins different prefixes, and no digest that stands for several stored turns has two contents."""
    if not nodes.where("differs").isEmpty():
        return False
    suspects = nodes.where("several").select("a", "b").distinct()
    contents = source.select("a", "b", "role", "text").distinct().join(suspects, ["a", "b"], "left_semi")
    return contents.groupBy("a", "b").count().where("count > 1").isEmpty()


def _hundreds(conv_id: Column) -> Column:
    return conv_id - conv_id % 100


def _head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 6


def prefix_trie(conversations: DataFrame, head_of: Callable[[Column], Column] = _hundreds, head_turns: Callable[[Column], Column] = _head_turns, longest: int = 5) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt as the first ``head_turns(c)`` turns (``longest`` at most) of ``head_of(c)`` and its own turns after
    as many; ``head_of`` must map the ids it yields to themselves.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text")).where("conv_id is not null")
    for seed in SEEDS:
        a, b = digests(F.col("role"), F.col("text"), seed)
        source = rows.select("*", a.alias("a"), b.alias("b"))
        turns = materialize(source.select("conv_id", "turn", "a", "b", F.length("text").cast("bigint").alias("chars"), F.monotonically_increasing_id().alias("row")), "turns")
        base = _base(seed)
        members = _rebuilt(_scan(turns, base), base, head_of, head_turns, longest)
        nodes = materialize(_nodes(members), "nodes")
        if _is_exact(nodes, source):
            return _measured(members, nodes)
    raise ValueError("fingerprints collided under every seed")


def _measured(members: DataFrame, nodes: DataFrame) -> DataFrame:
    key = ["depth", "hi", "lo"]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("phi").alias("hi"), F.col("plo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.drop("a", "b", "differs", "several").join(children, key, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes, total = materialize_counted(nodes, "children")

    # What each owner's path holds, in all and after each stretch of it.
    stretches = nodes.groupBy("conv_id", "part").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    later = Window.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stretches = materialize(stretches.select(
        "conv_id", "part", F.coalesce(F.sum("saved").over(later), F.lit(0)).alias("after"), F.sum("saved").over(Window.partitionBy("conv_id")).alias("owned"),
        F.sum("leaf").over(Window.partitionBy("conv_id")).alias("leaves")), "stretches")
    owners = stretches.groupBy("conv_id").agg(F.max("owned").alias("owned"), F.max("leaves").alias("leaves"))
    worth = members.select("conv_id", "part").distinct().join(owners, "conv_id")
    below = members.select("conv_id", "part", *key).join(worth, ["conv_id", "part"]).groupBy(*key).agg(F.sum("owned").alias("all_owned"), F.sum("leaves").alias("n_leaves"))
    rest = Window.partitionBy("conv_id", "part").orderBy(F.col("depth").desc())
    nodes = nodes.withColumn("rest", F.sum("saved").over(rest)).join(stretches.drop("leaves"), ["conv_id", "part"])
    nodes = nodes.join(below, key).join(_ends(members), key, "left")
    nodes = nodes.select(
        *key, "phi", "plo", "conv_id", "n_convs", "n_children", "n_leaves", (F.col("all_owned") - F.col("owned") + F.col("rest") + F.col("after")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    nodes = materialize(nodes, "measured")

    parents = nodes.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    link = ["depth", "phi", "plo"]
    is_hot = F.col("n_children") * HOT >= total
    hot, cold = F.broadcast(parents.where(is_hot).drop("n_children")), parents.where(~is_hot).drop("n_children")
    below_root = nodes.where("depth > 0")
    linked = below_root.join(hot, link).unionByName(below_root.join(hot, link, "left_anti").join(cold, link))
    linked = linked.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint")))
    return linked.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same with rebuilt prefixes spelled out as strings of digests.
ORACLE_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS l FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    sha256(coalesce(role, '') || chr(1) || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS source, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, l[1 + (xor(c, b) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), sized AS (
  SELECT ids.conv_id, source, h, count(t.pos) AS k FROM ids LEFT JOIN turns t ON t.conv_id = source AND t.pos <= h GROUP BY ALL
), rebuilt AS (
  SELECT s.conv_id, t.pos AS depth, digest, chars FROM sized s JOIN turns t ON t.conv_id = s.source AND t.pos <= s.h
  UNION ALL SELECT s.conv_id, k + t.pos - h, digest, chars FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.pos > s.h
), members AS (
  SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, chars, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM ids
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM members GROUP BY depth, path
), families AS (
  SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN nodes p ON n.depth = p.depth + 1 AND left(n.path, length(n.path) - 64) = p.path
  LEFT JOIN (SELECT depth - 1 AS depth, left(path, length(path) - 64) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL) c
    ON c.depth = n.depth AND c.path = n.path
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, count(*) FILTER (s.n_children = 0) AS n_leaves,
  CAST(sum((s.n_convs - 1) * s.chars) AS BIGINT) AS saved_tokens, n.ends_sha256
FROM families n JOIN families s ON s.depth >= n.depth AND starts_with(s.path, n.path)
GROUP BY n.conv_id, n.depth, n.path, n.parent_conv_id, n.n_convs, n.n_children, n.ends_sha256
"""
