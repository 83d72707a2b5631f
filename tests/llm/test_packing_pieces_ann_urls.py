"""Packing, piece encoding, nearest neighbours, URL equivalence."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from auditframe.llm import ann_collisions, packing, piece_dropout, url_equivalence
from auditframe.llm.queries import LLM_QUERIES, URL_RULES

SF = "/root/testdata/sf0.001"


def check_packed(rows, texts, capacity=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for k, t in texts.items():
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        end = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity and end & (end - 1) == 0 and len(parts) <= packing.MAX_SEGMENTS


def test_packing_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packed(LLM_QUERIES["op7_packing"](spark, SF).collect(), texts)


def test_packing_odd_texts(spark, odd, nothing):
    texts = {i: t for i, t in enumerate([r["text"] for r in odd.collect()])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    check_packed(packing.pack(docs).collect(), texts)
    assert packing.pack(odd, with_ids=True).where("size(ids) <> length").count() == 0 and packing.pack(nothing).count() == 0
    quiet = packing.pack(spark.createDataFrame([(1, "one two three", 2), (2, "four", None)], "doc_id bigint, text string, p int"), prompt_tokens="p")
    assert {r["doc_id"]: r["loss_tokens"] for r in quiet.collect()} == {1: 2, 2: 1}


def test_packer_keeps_every_limit():
    rng = random.Random(1)
    packer, out, total = packing.Packer(64, 4, 40, 8), [], 0
    for i in range(300):
        n = rng.randrange(1, 150)
        total += n
        out += packer.add(i, np.arange(n, dtype=np.uint32), rng.randrange(20))
    out += packer.finish()
    assert sum(len(p.ids) for s in out for p in s) == total
    assert all(len(s) <= 4 and sum(p.loss() for p in s) <= 40 and sum(len(p.ids) for p in s) <= 64 for s in out)


SPACES = [c for c in map(chr, range(0x3100)) if c.isspace() or c in "\u180e\u200b\u2060\ufeff"]


def hard_texts():
    rng = random.Random(7)
    fixed = ["Hello  World's\x1cfoo <|endoftext|> x<|startoftext|>y", "ΟΔΟΣ ΣΑΣ. é́ ́a", "'s 't I'll 123 4a5 ¿?!", "\x85a b", "<|ENDOFTEXT|> A<|b", "J\u030c j\u030c A\u030a",
             "\u0130 I\u0307 x\u0130's", "ǅ ﬁ K Å", "a" * 700 + "'s", None, "", " "]
    fixed += [f"it's {c} fine {c}'s{c}I'M" for c in SPACES] + [f"it's{c}cd don't {c}{c} x" for c in SPACES]
    letters = [*"abcXYZ019.,!-_'\u0130\u0301\u030cçÉßŒ日ж\U0001f642", "'s", "'LL", "<|", "|>", "  ", "\n", *SPACES]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]


@pytest.mark.parametrize("order", [1, -1])
def test_runs_encode_as_whole_texts(order):
    """With an encoder that knows nothing yet and with one that has met every text before, in either order."""
    path = public_tokenizers.path(packing.VOCABULARY)
    tokenizer, encoder, texts = Tokenizer.from_file(path), packing._Encoder(path), hard_texts()[::order]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.texts(texts)] == want
    for t, w in zip(texts[:200], want):
        encoder._forget()
        assert [ids.tolist() for ids in encoder.texts([t])] == [w]


def test_long_texts_and_a_small_memory(monkeypatch):
    path = public_tokenizers.path(packing.VOCABULARY)
    texts = ["it's one  two's\u2003three " * 30, "x", "no_space" * 40, *hard_texts()[:300]]
    want = [ids.tolist() for ids in packing._Encoder(path).texts(texts)]
    monkeypatch.setattr(packing, "CUT", 64)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    assert [ids.tolist() for ids in packing._Encoder(path).texts(texts)] == want


@pytest.mark.parametrize("limit", ["capacity", "max_segments", "max_loss"])
def test_limits_below_one_are_refused(spark, odd, limit):
    with pytest.raises(ValueError):
        packing.pack(odd, **{limit: 0})


def test_pieces_without_dropout_are_the_models_own(spark):
    path = public_tokenizers.path(piece_dropout.MODEL)
    model, own = piece_dropout.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for t in [*texts, "", "  a  b ", "x\ty\n\nz", "ﬁ①é日本語\U0001f642", "<s> <unk> <0x41>", "a" * 300]:
        assert model.encode(t) == own.encode(t)


def test_dropout_varies_and_decodes(spark, odd, nothing):
    model = piece_dropout.Pieces(public_tokenizers.path(piece_dropout.MODEL))
    found = set()
    for seed in range(12):
        model.known.clear()
        found.add(tuple(model.encode("internationalization of words", 0.2, seed, 1)))
    assert len(found) > 6 and {model.decode(list(f)) for f in found} == {"internationalization of words"}
    encoded = piece_dropout.encode(odd)
    assert sorted(map(repr, piece_dropout.decode(encoded).select("doc_id", "text").collect())) == sorted(map(repr, odd.select("doc_id", "text").collect()))
    assert [r["ids"] for r in piece_dropout.encode(odd).collect()] == [r["ids"] for r in encoded.collect()]
    assert piece_dropout.encode(nothing).count() == 0 and piece_dropout.encode(odd, digest=True).where("NOT lossless").count() == 0
    assert LLM_QUERIES["op2_piece_dropout"](spark, SF).where("NOT lossless").count() == 0


def brute(ids, vectors, k):
    out = {}
    for q in [i for i in range(len(ids)) if ids[i] % 100 == 0]:
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(ids[i], far[i]) for i in order]
    return out


def test_neighbours_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    want, got = brute(ids, vectors, 10), {}
    for r in LLM_QUERIES["op5_ann_collisions"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    found = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert found >= 0.95
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(s - exact[q, i]) < 1e-12 for q in got for i, s in got[q] if (q, i) in exact)


def test_neighbours_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]),
            (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id bigint, embedding array<double>, rank string")
    got = [tuple(r) for r in ann_collisions.search(df, df.where("vec_id % 100 = 0"), 10).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 3)] and got[2][3] == pytest.approx(2**0.5)
    assert ann_collisions.search(df.limit(0), df.limit(0)).count() == 0


def test_url_equivalence_against_sql(spark, tmp_path):
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/fr/1">'), (2, "http://b.net/fr/1.html", None),
        (3, "http://c.org/", '<meta http-equiv="refresh" content="0; url=http://a.org/x/">'), (4, None, ""), (5, "nourl", "x"),
        (6, "http://d.org/y", "<LINK rel=canonical href='/z'>"), (7, "https://www.D.org/z?utm_x=1&ref=2", '<link rel="canonical" href="http://q.com/">'),
        (8, "http://com", ""), (9, "HTTP://Example.COM/en/a#b", ""), (9, "HTTP://Example.COM/en/a#b", ""),
        (10, "http://www.example.com/en/", '<link rel="canonical" href="http://e.org/1">'),
        (11, "http://e.org/1", '<link rel="canonical" href="http://k.example.com/en/1">'), (None, "http://x?a=b/c", "")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, node int")
    got = url_equivalence.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    con.execute("CREATE VIEW pages AS SELECT * FROM frame")
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, con.execute(url_equivalence.oracle_sql(URL_RULES)).fetchall()))
    verdict = {r["page_id"]: r["verdict"] for r in got.collect()}
    # A block reaches aliases of aliases; where an allow and a block meet, the allow wins.
    assert (verdict[1], verdict[3], verdict[6], verdict[11]) == ("block", "block", "allow", "allow")
    known = spark.createDataFrame([("http://n.org/1", "http://b.net/fr/1"), (None, "x")], "from_url string, to_url string")
    one = spark.createDataFrame([(1, "http://n.org/1/", None)], "page_id bigint, url string, html string")
    assert url_equivalence.judge(one, URL_RULES, known).collect()[0]["verdict"] == "block"
    assert url_equivalence.judge(pages.limit(0), URL_RULES).count() == 0
