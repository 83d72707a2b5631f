"""Components, SimHash, substring dedup and the pipeline, against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from auditframe.llm import simhash_anchor, substring_debruijn
from auditframe.llm.components import components
from auditframe.llm.fingerprints import fingerprint
from auditframe.llm.queries import LLM_QUERIES
from auditframe.session import materialize

SF = "/root/testdata/sf0.001"


def union(pairs, n):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    links = spark.createDataFrame(pairs + [(5, 5)] + [(None, 7)], "a bigint, b bigint").repartition(6)
    want = union(pairs, 260)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert {r["node"]: r["component"] for r in components(links).collect()} == {x: want[x] for x in nodes}
    assert components(links.limit(0)).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for t in [None, "", "One", "A b\tC d e f É", "x y z w x y z w x y z"]:
        assert fingerprint(t) == slow_fingerprint(t)


def test_anchors_cover():
    """Each segment lies within one bit of its home; close pairs meet at the home of either."""
    rng = np.random.default_rng(2)
    segments = rng.integers(0, 1 << 21, 500).astype(np.uint64)
    assert (np.bitwise_count(simhash_anchor.home(segments) ^ segments) <= 1).all()
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1 << int(bit))
    for x, y in ((a, b), (b, a)):
        rows, keys = simhash_anchor.anchors(x, False)
        more_rows, more_keys = simhash_anchor.anchors(y, True)
        around = set(zip(more_rows.tolist(), more_keys.tolist()))
        assert {r for r, k in zip(rows.tolist(), keys.tolist()) if (r, k) in around} == set(range(len(a)))


def test_replicas_are_not_broadcast(spark):
    """Fingerprints that Spark would broadcast have 42 times as many replicas, which pass by the driver all the same."""
    rng = random.Random(13)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(1000)]
    fps += [f ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for f in fps[:300]]
    found = simhash_anchor.links(materialize(spark.createDataFrame([(f,) for f in set(fps)], "fp bigint")))
    close = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert len(close) >= 290 and {(r["a"], r["b"]) for r in found.distinct().collect()} == close
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def check_near(rows, texts):
    ids = sorted(texts)
    fps = {i: fingerprint(texts[i]) for i in ids}
    pairs = [(x, y) for x in range(len(ids)) for y in range(x) if (fps[ids[x]] ^ fps[ids[y]]).bit_count() <= 4]
    want = union(pairs, len(ids))
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[want[k]] for k, i in enumerate(ids)}


def test_near_duplicates(spark, odd, nothing):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_near(LLM_QUERIES["op4_simhash_anchor"](spark, SF).collect(), texts)
    texts = dict(enumerate([r["text"] for r in odd.collect()]))
    check_near(simhash_anchor.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect(), texts)
    assert simhash_anchor.near_duplicates(odd).count() == odd.count() and simhash_anchor.near_duplicates(nothing).count() == 0
    kept = [r["doc_id"] for r in simhash_anchor.keep_one(odd).collect()]
    assert len(kept) == len(set(kept)) and 0 in kept and 1 not in kept and 4 not in kept


def test_near_duplicates_without_large_broadcasts(spark):
    """A broadcast of over 2 MB ends the query here; replicas of 4,000 fingerprints take 16."""
    rng = random.Random(14)
    rows = [(i, " ".join(f"w{rng.randrange(1000)}" for _ in range(12))) for i in range(4000)]
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        got = simhash_anchor.near_duplicates(spark.createDataFrame(rows + rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(r["doc_id"] for r in got) == sorted(2 * list(range(4000))) and all(r["component_id"] <= r["doc_id"] for r in got)


def brute_repeats(rows):
    first, out = set(), {}
    for i, words in sorted((i, (t or "").encode().split()) for i, t in rows):
        gone = set()
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in first:
                gone.update(range(s, s + 20))
            first.add(key)
        kept = b" ".join(w for j, w in enumerate(words) if j not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_random(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abc") for _ in range(300)).split() for _ in range(3)]
    noise = lambda: [rng.choice("abcd") for _ in range(rng.randrange(30))]
    rows = []
    for i in range(60):
        s = rng.randrange(250)
        rows.append((i, " ".join(noise() + rng.choice(base)[s : rng.randrange(s, 300)] + noise())))
    rows += [(60, None), (61, ""), (62, "a b"), (63, " ".join(["x"] * 100)), (64, rows[5][1]), (65, rows[5][1])]
    got = substring_debruijn.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_repeats(rows)
    texts = dict(rows)
    for r in got:
        assert hashlib.sha256(b" ".join((r["kept_text"] or "").encode().split())).hexdigest() == r["kept_sha256"]
        for s in r["spans"]:  # source coordinates name the same words, earlier
            mine, theirs = texts[r["doc_id"]].split(), texts[s["source_doc"]].split()
            assert mine[s["start"] : s["start"] + s["n_words"]] == theirs[s["source_start"] : s["source_start"] + s["n_words"]]
            assert (s["source_doc"], s["source_start"]) < (r["doc_id"], s["start"])


def test_repeats_query(spark, odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = LLM_QUERIES["op9_substring_debruijn"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_repeats(rows)
    found = substring_debruijn.remove_repeats(odd).collect()
    assert len(found) == odd.count() and sum(r["doc_id"] is None for r in found) == 1
    assert substring_debruijn.remove_repeats(nothing).count() == 0


def in_order(rows):
    """Rows as documents 0, 1, ... in the order that the operator gives them: id (nulls first), hash of the text."""
    def hashed(text):
        if text is None:
            return 42
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    return sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, hashed(r[1])))


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_repeats_with_null_and_repeated_ids(spark, kind):
    rng = random.Random(11)
    vary = lambda n: " ".join(rng.choice("abcdefghijklmnop") + rng.choice("abcdefghijklmnop") for _ in range(n))
    shared = [vary(40) for _ in range(4)]
    ids = [None] * 4 + [7] * 3 + list(range(8, 14))
    rows = [(rng.choice(ids), f"{vary(rng.randrange(15))} {rng.choice(shared)} {vary(rng.randrange(40))}") for _ in range(60)]
    alone = [(None, vary(60)), (7, vary(60)), (9, vary(60))]
    rows += alone + [(7, shared[0])] * 3 + [(None, shared[1])] * 3 + [(None, None), (None, None), (7, None), (7, ""), (9, "x")]
    if kind == "string":
        rows = [(None if i is None else f"d{i:02d}", t) for i, t in rows]
    placed = in_order(rows) if kind == "bigint" else sorted(in_order([(None if i is None else int(i[1:]), t) for i, t in rows]), key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute_repeats(list(enumerate(t for _, t in placed)))
    name = (lambda i: i) if kind == "bigint" else (lambda i: None if i is None else f"d{i:02d}")
    table = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], f"doc_id {kind}, text string, key int, found int").repartition(5)
    got = substring_debruijn.remove_repeats(table)
    assert got.columns == ["doc_id", "text", "key", "found", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"]
    got = got.collect()
    assert sorted(r["key"] for r in got) == list(range(len(rows))) and all((r["doc_id"], r["text"]) == rows[r["key"]] for r in got)
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=key) == sorted(
        ((name(i), t, *want[k]) for k, (i, t) in enumerate(placed)), key=key)
    assert all(r["n_removed"] == 0 for r in got if r["text"] in {t for _, t in alone})
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").split())
    for r in got:
        for s in r["spans"]:
            mine = r["text"].split()[s["start"] : s["start"] + s["n_words"]]
            assert any(t[s["source_start"] : s["source_start"] + s["n_words"]] == mine for t in texts[s["source_doc"]])


def test_long_texts_in_stretches(monkeypatch):
    """A text cut into many stretches has the windows of the whole."""
    text = " ".join(random.Random(5).choice("abcdefgh") * 3 for _ in range(900))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc", "text"])

    def windows():
        out = {}
        for b in substring_debruijn._emit_paths([batch], True):
            for p in b.to_pylist():
                for k in range(p["windows"]):
                    assert p["start"] + k not in out
                    out[p["start"] + k] = p["minimizer"]
        return out

    whole = windows()
    for cut in (400, 50, 3):
        monkeypatch.setattr(substring_debruijn, "CUT", cut)
        assert windows() == whole and len(whole) == 881


def test_words_are_hashed_by_their_bytes_alone(monkeypatch):
    """Equal words have equal hashes wherever they stand, in grouped and in long texts; others differ."""
    rng = random.Random(8)
    texts = [None, "", " ", "x", " lead and trail \n", "é é\u00a0é \x1c \x1d", "a" * 90 + " b"] + [
        " ".join(rng.choice(["a", "b", "ab", "ba", "aa", "é", "日本", "w" * 40]) for _ in range(rng.randrange(120))) + rng.choice(["", "\t", " \v"]) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for cut in (1 << 20, 64):
        monkeypatch.setattr(substring_debruijn, "CUT", cut)
        words, seen = {}, {}
        for row, first, high, low in substring_debruijn._stretches(batch):
            edge = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first[1:] != first[:-1])))[: len(row)]
            start = np.repeat(edge, np.diff(np.append(edge, len(row))))
            for k in range(len(row)):
                words.setdefault(int(row[k]), {})[int(first[k] + k - start[k])] = (int(high[k]), int(low[k]))
        for r, t in enumerate(texts):
            want = (t or "").encode().split()
            assert sorted(words.get(r, {})) == list(range(len(want)))
            for k, w in enumerate(want):
                assert seen.setdefault(w, words[r][k]) == words[r][k]
        assert len({h for h, _ in seen.values()}) == len({h for _, h in seen.values()}) == len(seen)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    last = corpus_pipeline.materialize(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "last")
    assert last.select("doc_id").distinct().count() == n
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
