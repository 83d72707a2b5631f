"""Language identification, quality classifier, toxicity, line rules."""

import duckdb
import numpy as np
import pytest

from auditframe.llm import language_id, line_rules, quality_mil, toxicity_ordinal
from auditframe.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.01"


def labelled(spark, n=120):
    """Documents of two kinds, told apart by their words; kind 1 is French, of low quality and toxic."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(n):
        if i % 2:
            words = [*rng.choice(["le", "été", "une", "garçon", "trash###", "vaurien"], 150), "vaurien"]
        else:
            words = rng.choice(["the", "with", "house", "Things.", "going", "water"], 150)
        rows.append((i, " ".join(words), "fr" if i % 2 else "en", i % 2))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1 - r[3], r[3]) for r in rows] + [(0, None, None), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 30):
        code = language_id.codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2) and len({tuple(c) for c in code}) == n
    assert language_id.codewords(4).shape == (4, 7) and language_id.codewords(1).shape == (1, 0)


def test_decoding_survives_a_wrong_bit():
    code = language_id.codewords(4)
    model = language_id.LanguageModel(list("abcd"), code, np.zeros((language_id._D, 7), np.float32), np.zeros(7, np.float32))
    for c in range(4):
        for bit in range(7):
            model.bias = np.where(np.arange(7) == bit, -1.0, 1.0) * code[c] * 3
            assert language_id.decode(model, np.ones((1, language_id._D), np.float32))[0][0] == c


def test_ngrams_of_a_long_text_equal_those_of_its_whole(monkeypatch):
    raw = np.frombuffer("Ünd ÉTÉ the quick brown fox ".encode() * 40, np.uint8)
    at = np.array([0, 0, 300, len(raw)])
    whole = language_id.ngram_counts(raw, at)
    monkeypatch.setattr(language_id, "pieces", lambda a: __import__("auditframe.llm.batches", fromlist=["pieces"]).pieces(a, 64))
    assert (language_id.ngram_counts(raw, at) == whole).all() and whole[0].sum() == 0


def test_language_id(spark, odd, nothing):
    docs, _ = labelled(spark)
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("fr" if i % 2 else "en") and 0 <= got[i]["score"] <= 1 for i in got)
    rows = language_id.predict(odd, model, keep=("doc_id", "text")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not has_letter) and (has_letter or r["score"] == 0)
    empty = language_id.fit(nothing)
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}
    assert language_id.predict(nothing, model).count() == 0


def test_passages_by_hand():
    texts = ["a " * 250, "", "One TWO  three!"]
    data = [t.encode() for t in texts]
    raw = np.frombuffer(b"".join(data), np.uint8)
    owner, x = quality_mil.passage_features(raw, np.cumsum([0, *map(len, data)]))
    assert owner.tolist() == [0, 0, 0, 2]
    k = quality_mil._CLASSES
    assert x[0][k + 4] == pytest.approx(99 / 100) and x[0][k + 3] == pytest.approx(1 / 100)  # repeated, distinct
    assert x[3][k] == pytest.approx((3 + 3 + 6) / 3 / 8) and x[3][k + 5] == pytest.approx(2 / 3)


def test_attention_gradient():
    """Loss falls, and a bag with one bad passage among good ones is recognised."""
    rng = np.random.default_rng(0)
    bags, y = [], []
    for i in range(200):
        bag = rng.normal(size=(rng.integers(1, 8), quality_mil.N_FEATURES)).astype(np.float32)
        if i % 2:
            bag[0, :3] += 6
        bags.append(bag)
        y.append(1 - i % 2)
    model = quality_mil.fit_bags(bags, np.array(y, float))
    owner = np.repeat(np.arange(200), [len(b) for b in bags])
    assert ((model.score(owner, np.concatenate(bags), 200) > 0.5) == np.array(y)).mean() > 0.97


def test_quality(spark, odd, nothing):
    docs, labels = labelled(spark)
    model = quality_mil.fit(docs, labels)
    rows = quality_mil.score(docs, model).collect()
    assert all(r["predicted"] == 1 - r["doc_id"] % 2 for r in rows)
    got = quality_mil.score(odd, model).collect()
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (not (r["text"] or "").split()) or "\x1c" in r["text"] for r in got)
    assert [r["score"] for r in got if r["text"] == "x"] == [got[3]["score"]] * 3
    none = quality_mil.fit(docs, labels.limit(0))
    assert none is None and {r["score"] for r in quality_mil.score(docs, none).collect()} == {1.0}
    assert quality_mil.score(nothing, model).count() == 0


def test_ordinal_thresholds_are_ordered():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    eta = x @ np.array([2.0, -1.0, 0, 0.5])
    grade = np.digitize(eta + rng.logistic(size=3000), [-1.0, 1.0, 3.0])
    w, t = toxicity_ordinal.fit_ordinal(x, grade, 4, 1500)
    assert (np.diff(t) > 0).all() and np.allclose(t, [-1, 1, 3], atol=0.4) and np.allclose(w, [2, -1, 0, 0.5], atol=0.3)


def test_toxicity(spark, odd, nothing):
    docs, labels = labelled(spark)
    model = toxicity_ordinal.fit(docs, labels)
    rows = toxicity_ordinal.score(docs, model).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in rows)
    assert toxicity_ordinal.score(odd, model).count() == odd.count() and toxicity_ordinal.score(nothing, model).count() == 0
    assert toxicity_ordinal.fit(docs, labels.where("toxic = 0")) is None
    assert {r["expected_severity"] for r in toxicity_ordinal.score(odd, None).collect()} == {0.0}
    graded = labels.selectExpr("doc_id", "toxic * 2 AS grade")
    assert toxicity_ordinal.fit(docs, graded, label="grade", graded=True) is not None


def test_held_out_accuracy(spark):
    truth = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in LLM_QUERIES["op1_language_id"](spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in rows]) > 0.98
    rows = [r for r in LLM_QUERIES["op3_quality_classifier"](spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["quality"] for r in rows]) > 0.93
    rows = [r for r in LLM_QUERIES["op10_toxicity_ordinal"](spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["toxic"] for r in rows]) > 0.9


def test_line_rules(odd, nothing, spark):
    good = "This is a plain line of a text that says something. "
    text = "\n".join([good + str(i) for i in range(6)] + ["Home | About | News | Contact", "All rights reserved.", "### *** $$$ %%% a"])
    docs = spark.createDataFrame([(1, text, 7)], "doc_id bigint, text string, kept int")
    row = line_rules.clean_lines(docs).collect()[0]
    assert row["n_bad_lines"] == 3 and row["clean_text"].split("\n") == text.split("\n")[:6]
    got = line_rules.clean_lines(odd).collect()
    assert len(got) == odd.count() and all(not r["kept"] for r in got)
    assert [r["n_dup_lines"] for r in got if r["doc_id"] == 8] == [2] and line_rules.clean_lines(nothing).count() == 0
    assert line_rules.clean_lines(odd).where("kept").count() == 0


def test_line_rules_agree_with_sql(spark, odd):
    con = duckdb.connect()
    pdf = odd.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    con.register("frame", pdf)
    con.execute("CREATE VIEW documents AS SELECT doc_id, text FROM frame")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(map(repr, con.execute(line_rules.ORACLE_SQL).fetchall()))
    assert sorted(repr(tuple(r)) for r in line_rules.clean_lines(odd).select(*names).collect()) == want
