"""The prefix trie against one built turn by turn."""

import hashlib
import random
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from auditframe.llm import prefix_trie as pt
from auditframe.llm.queries import LLM_ORACLES, LLM_QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    """Every node's row, from rebuilt turns."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        source = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(own.get(source, [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items())


def result(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def random_rows(seed, n=130):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(0, 420), n), -3, -120, -100, 200]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None, "assistant"]), rng.choice(["a", "bb", "", None, "ccc é🙂"])))
    rows += [(None, 0, "user", "lost"), (77, 50, "user", "again"), (77, 50, "user", "again")]
    return rows


def test_random_tables(spark):
    for seed in (1, 2):
        rows = random_rows(seed)
        table = spark.createDataFrame(rows, SCHEMA).repartition(6)
        assert result(pt.prefix_trie(table)) == brute(rows)


def test_conversation_that_spans_tasks(spark):
    """Two thirds of the rows belong to two equal long conversations, cut by borders of the scan."""
    rows = [(c, t, "user", f"turn {t // 2}") for c in (100, 300) for t in range(400)] + random_rows(3, 40)
    table = spark.createDataFrame(rows, SCHEMA).repartition(8)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scanned = pt._scan(table.where("conv_id is not null").select(
            "conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64("text").alias("b"), F.lit(1).cast("bigint").alias("chars"),
            F.monotonically_increasing_id().alias("row")), pt._base(0))
        assert scanned.where("conv_id = 100").select("part").distinct().count() > 1
        assert [r["pos"] for r in scanned.where("conv_id = 100").orderBy("pos").collect()] == list(range(1, 401))
        assert result(pt.prefix_trie(table)) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_colliding_digests_are_found_and_drawn_again(spark, monkeypatch):
    rows = random_rows(4, 60)
    real, seeds = pt.digests, []

    def weak(role, text, seed):
        seeds.append(seed)
        a, b = real(role, text, seed)
        if seed == 0:  # one digest for all
            return F.lit(1).cast("bigint"), F.lit(2).cast("bigint")
        return (F.pmod(a, F.lit(2)), F.lit(0).cast("bigint")) if seed == 1 else (a, b)

    monkeypatch.setattr(pt, "digests", weak)
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert seeds == [0, 1, 2]


def test_colliding_fingerprints_are_found(spark, monkeypatch):
    rows, used = random_rows(5, 60), []
    real = pt._base

    def weak(seed):
        used.append(seed)
        return 1 if seed == 0 else real(seed)  # base 1 forgets the order of turns

    monkeypatch.setattr(pt, "_base", weak)
    rows += [(301, 9, "user", "a"), (301, 10, "user", "bb"), (302, 9, "user", "bb"), (302, 10, "user", "a")]
    rows += [(c, t, "user", x) for c, order in ((310, "xyz"), (311, "yxz"), (315, "zyx"), (316, "zxy")) for t, x in enumerate("same " * 6 + order)]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert used == [0, 1]


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(pt, "PART", 7)
    rows = [(c, 0, "user", "hello") for c in range(1000, 1300)] + [(7, 0, "user", "x")]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_parents_and_others(spark, monkeypatch):
    monkeypatch.setattr(pt, "HOT", 10)
    rows = random_rows(6)
    assert result(pt.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_registered_query_agrees_with_its_sql_on_hard_rows(spark, tmp_path):
    rows = [r for r in random_rows(7) if r[0] != 77]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    got = LLM_QUERIES["op11_prefix_trie"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(LLM_ORACLES["op11_prefix_trie"]).fetchall()
    assert sorted([d[0] for d in con.description]) == sorted(got.columns)
    assert result(got) == sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in want)


def test_other_heads(spark):
    rows = random_rows(8, 50)
    got = pt.prefix_trie(spark.createDataFrame(rows, SCHEMA), head_of=lambda c: F.lit(None).cast("bigint"), head_turns=lambda c: F.lit(0))
    own = Counter(r[0] for r in rows if r[0] is not None)
    assert got.where("depth = 0").first()["n_convs"] == len(own)
    assert got.agg(F.max("depth")).first()[0] == max(own.values())


def test_empty_table_and_clashing_names(spark):
    schema = f"{SCHEMA}, a int, part int, depth string, hi int, leaf int"
    assert pt.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", 1, 1, "x", 1, 1)], schema)).collect() == []
    rows = [(1, 0, "user", "x", 1, 1, "q", 1, 1), (2, 0, "user", "x", 1, 1, "q", 1, 1)]
    assert result(pt.prefix_trie(spark.createDataFrame(rows, schema))) == brute([r[:4] for r in rows])
