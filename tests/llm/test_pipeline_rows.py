"""The whole pipeline on rows with null and repeated ids, against what each stage should leave of them."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from auditframe.llm import packing

WORDS = ["river", "stone", "garden", "winter", "letter", "window", "market", "bridge", "silver", "forest", "candle", "harbor", "meadow", "copper", "signal", "thunder"]


def prose(rng, n):
    """Sentences without repeated five-word windows, as the line rules want them."""
    words = [f"{rng.choice(WORDS)}{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}" for _ in range(n)]
    return " ".join(w + "." if k % 12 == 11 else w for k, w in enumerate(words))


def test_rows_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(21)
    passage = prose(rng, 60)
    alone = [prose(rng, 90) for _ in range(9)]
    rows = [(1, alone[0]), (7, alone[1]), (7, alone[2]), (7, alone[3]), (None, alone[4]), (None, alone[5]), (3, None), (None, ""), (4, "too short")]
    rows += [(20, alone[6]), (21, alone[6]), (None, alone[6])]  # copies: id 20 stays
    rows += [(None, alone[7]), (None, alone[7])]  # equal rows: one stays
    rows += [(30, f"{passage} {prose(rng, 70)}"), (31, f"{prose(rng, 70)} {passage} {prose(rng, 30)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "k") for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars bigint, _row int, key string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    left = [(1, alone[0]), (7, alone[1]), (7, alone[2]), (7, alone[3]), (None, alone[4]), (None, alone[5]), (20, alone[6]), (None, alone[7]), rows[-2]]
    cut = rows[-1][1].replace(passage, "").split()
    left.append((31, " ".join(cut)))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = corpus_pipeline.materialize(stage(spark, current, str(tmp_path)), name)
        assert current.columns == docs.columns
        counts.append(current.count())
    assert counts == [13, 13, 10, 10]
    got = [(r["doc_id"], " ".join(r["text"].split())) for r in current.collect()]
    assert sorted(got, key=repr) == sorted(left, key=repr)
    assert current.where("n_chars <> length(text) or _row <> 1 or key <> 'k'").count() == 0

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = sorted((i is None, i or 0, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in left)
    whole = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in pieces if r["start"] == 0)
    assert whole == want and sum(r["length"] for r in pieces) == sum(w[2] for w in want)
    first = next(r for r in pieces if r["doc_id"] == 1 and r["start"] == 0)
    ids = np.array([*tokenizer.encode(alone[0], add_special_tokens=False).ids, 1], "<u4")
    assert first["ids_crc32"] == zlib.crc32(ids[: first["length"]].tobytes())
