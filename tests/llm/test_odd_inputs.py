"""Repeated and null ids, equal rows and columns whose names clash, for the operators that sample, pass columns through or pick rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditframe.llm import ann_collisions, language_id, piece_dropout, quality_mil, simhash_anchor, toxicity_ordinal
from auditframe.llm.columns import sample_rows, text_hash
from auditframe.llm.fingerprints import fingerprints


def test_samples_are_bounded_in_rows(spark):
    rows = [(7, f"t{i}") for i in range(300)] + [(8, "same")] * 200 + [(None, f"n{i}") for i in range(100)] + [(i, "x") for i in range(100, 400)]
    texts = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    for limit in (1, 5, 250, 10_000):
        got = sample_rows(texts, texts.select("id", text_hash()), limit).collect()
        assert sum(r["copies"] for r in got) == min(limit, len(rows)) and len({(r["id"], r["text"]) for r in got}) == len(got)
    labelled = texts.select("id", text_hash(), F.when(F.col("id") == 7, "a").otherwise("b").alias("lang"))
    got = sample_rows(texts, labelled, 20, "lang").collect()
    assert {k: sum(r["copies"] for r in got if r["lang"] == k) for k in "ab"} == {"a": 20, "b": 20}


@pytest.fixture
def hot(spark):
    """A third of the rows under one id, some rows equal, some ids null."""
    words = ["the of and to in", "der die und das ist", "le la et les des"]
    rows = [(5 if i % 3 == 0 else None if i % 11 == 0 else i, f"{words[i % 3]} {'bad ugly vile ' * (i % 2)}{words[i % 3]} {i % 40}", "en de fr".split()[i % 3]) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)


@pytest.fixture
def collected(monkeypatch):
    """Rows that the fits bring to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, real = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: (rows := real(self), sizes.append(len(rows)))[0])
    return sizes


def test_fits_bring_a_bounded_number_of_rows_to_the_driver(hot, collected):
    labels = hot.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    language_id.fit(hot, per_language=5)
    assert collected and max(collected) <= 15
    collected.clear()
    quality_mil.fit(hot, labels, max_documents=5)
    assert collected and max(collected) <= 5
    collected.clear()
    toxicity_ordinal.fit(hot, labels, max_documents=5)
    assert max(collected, default=0) <= max(5, toxicity_ordinal.N_FEATURES)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_bucket_counts_cover_all_labelled_rows(spark, monkeypatch, few):
    """Words that are toxic only outside the sample of rows are features too, whichever way labels and texts meet."""
    monkeypatch.setattr(toxicity_ordinal, "BROADCAST_LABELS", few)
    rows = [(i, f"common words here {'rareword' if i >= 50 and i % 2 else 'plain'} {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("text").contains("rareword")).cast("int").alias("toxic"))
    monkeypatch.setattr(toxicity_ordinal, "MIN_CHI_SQUARE", 5)
    model = toxicity_ordinal.fit(docs, labels, max_documents=40)
    buckets = toxicity_ordinal._Buckets()
    assert buckets[b"rareword"] in set(model.buckets.tolist())
    # Brute force over all rows.
    a = np.array([[("rareword" in t.split()) for _, t in rows], [("plain" in t.split()) for _, t in rows]])
    assert a.sum() == 400 and buckets[b"plain"] in set(model.buckets.tolist()) and buckets[b"common"] not in set(model.buckets.tolist())


def test_clashing_names(spark, hot):
    docs = hot.selectExpr("doc_id", "text", "lang", "1 as _row", "2 as row", "3 as _key", "4 as key", "5 as _text", "6 as score", "7 as ids", "8 as fp", "9 as in_0", "10 as copies",
                          "'q' as lang_pred", "0 as _ids", "1 as text_hash", "2 as th", "'z' as letter")
    kept = simhash_anchor.keep_one(docs)
    assert kept.columns == docs.columns
    first = kept.first()
    assert (first["_row"], first["row"], first["text_hash"], first["in_0"]) == (1, 2, 1, 9)
    encoded = piece_dropout.encode(docs)
    assert encoded.columns == [c for c in docs.columns if c not in ("text", "ids")] + ["ids"]
    back = piece_dropout.decode(encoded)
    assert {(r["key"], r["_key"], r["_ids"]) for r in back.collect()} == {(4, 3, 0)}
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in docs.collect())
    model = language_id.fit(docs, per_language=30)
    found = language_id.predict(docs, model, keep=tuple(docs.columns))
    assert found.columns == [c for c in docs.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score", "runner_up", "ambiguous"]
    assert found.where("lang_pred = lang").count() > 500 and found.where("letter = 'z' and in_0 = 9").count() == 600
    assert language_id.predict(docs, model, keep=()).count() == 600
    marked = fingerprints(docs)
    assert marked.columns == [c for c in docs.columns if c not in ("text", "fp")] + ["fp"] and marked.where("_text = 5 and key = 4").count() == 600


def test_rows_of_equal_vec_id_are_all_candidates(spark):
    """Brute force over rows; only the query's own row is left out."""
    rng = np.random.default_rng(4)
    points = rng.standard_normal((60, 8))
    points[1] = points[0] + 0.01
    rows = [(int(i % 20), [float(x) for x in points[i]]) for i in range(60)] + [(3, [float(x) for x in points[3]])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = sorted(map(tuple, ann_collisions.search(table, table.where("vec_id % 5 = 0"), k=70).collect()))
    want = []
    for i, (q, v) in enumerate(rows):
        if q % 5 == 0:
            far = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), c) for j, (c, w) in enumerate(rows) if j != i)
            want += [(q, r + 1, c, d) for r, (d, c) in enumerate(far)]
    assert len(got) == len(want) == 12 * 60
    for g, w in zip(sorted(got, key=lambda x: (x[0], x[1], x[3])), sorted(want, key=lambda x: (x[0], x[1], x[3]))):
        assert g[:2] == w[:2] and g[3] == pytest.approx(w[3], abs=1e-12)
