"""Language identification with error-correcting output codes.

Every language gets a codeword. One binary classifier per bit, a logistic
regression over hashed byte n-grams of letters, predicts that bit; the language
whose codeword has the smallest summed logistic loss wins, so a few wrong bits
do no harm. A small gap to the runner-up flags the row as ambiguous.

Training fits on ``per_language`` rows of each language at most, those with
the smallest hash of their id (ties by hash of the text), wherever they lie. Prediction reads whole texts in
pieces of bounded size.

Nulls, empties, repeats: a null text or one without a letter is ``und`` with score 0;
so is every text when nothing could be learned from (with one language, all are it).
Rows with a null label are not learned from; rows with a null id are. Equal texts get equal results; very
long ones are counted piece by piece. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.batches import append, pieces, utf8
from auditframe.llm.columns import numbered, sample_rows, text_hash

#: Parameters.
BUCKET_BITS = 11
ORDERS = (1, 2, 3)
PER_LANGUAGE = 500
STEPS = 150
AMBIGUOUS_MARGIN = 0.5
UNKNOWN = "und"

_D = 1 << BUCKET_BITS
#: Letters stay, capital ASCII letters become small, the rest becomes a space.
_LETTER = np.full(256, 0x20, np.uint8)
for _c in range(26):
    _LETTER[0x61 + _c] = _LETTER[0x41 + _c] = 0x61 + _c
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _letters(raw: np.ndarray) -> np.ndarray:
    b = _LETTER[raw]
    capital = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
    b[capital] += 0x20
    return b


def ngram_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams for each row: shape (rows, 2 ** BUCKET_BITS)."""
    out = np.zeros((len(at) - 1, _D), np.float32)
    for group in pieces(at):
        rows = np.array([g[0] for g in group])
        lengths = np.array([g[2] - g[1] for g in group])
        begin, stop = group[0][1], group[-1][2]
        # A byte more in front and two behind, for a text that goes on in the pieces around.
        b = _letters(raw[max(begin - 1, 0) : min(stop + max(ORDERS) - 1, len(raw))])[min(begin, 1) :].astype(np.uint32)
        n = stop - begin
        slot = np.repeat(np.arange(len(group)), lengths)
        left = np.repeat(at[rows + 1] - begin, lengths) - np.arange(n)
        code = np.zeros(n, np.uint32)
        for order in range(1, max(ORDERS) + 1):
            tail = b[order - 1 : order - 1 + n]
            code[: len(tail)] |= tail << np.uint32(8 * (order - 1))
            use = (left >= order) & ((b[:n] != 0x20) if order == 1 else True)
            if order > 1:
                use &= ~((b[:n] == 0x20) & (np.append(b[1 : n + 1], [0x20] * max(0, n + 1 - len(b))) == 0x20))
            bucket = ((code + np.uint32(order * 0x1000193)) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
            flat = (slot * _D + bucket)[use]
            out[rows] += np.bincount(flat, minlength=len(group) * _D).reshape(len(group), _D)
    return out


def _features(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return np.sqrt(counts / np.maximum(total, 1))


def codewords(n: int) -> np.ndarray:
    """A +1/-1 codeword for each of n classes: all splits of few classes, a seeded code of wide rows for more."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 7:
        bits = ((np.arange(1, 2 ** (n - 1))[None, :] >> np.arange(n - 1)[:, None]) & 1).astype(np.int8)
        return np.vstack([np.zeros((1, bits.shape[1]), np.int8), bits]) * 2 - 1
    width, best, most = int(np.ceil(10 * np.log2(n))), None, -1
    for seed in range(50):
        code = np.random.default_rng(seed).integers(0, 2, (n, width), dtype=np.int8) * 2 - 1
        product = code.astype(np.int32) @ code.T.astype(np.int32)
        np.fill_diagonal(product, -width)
        apart = (width - product.max()) // 2
        if apart > most and (np.abs(code.sum(axis=0)) < n).all():
            best, most = code, apart
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows of ``docs`` that have a label, ``per_language`` of each language at most."""
    known = docs.where(F.col(f"`{lang}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("label"), F.col(f"`{text}`").alias("text"))
    sample = sample_rows(known.select("id", "text"), known.select("id", text_hash(), "label"), per_language, "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = ngram_counts(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("id"), batch.column("copies"), pa.array([c.tobytes() for c in counts], pa.binary())], ["label", "id", "copies", "counts"])

    kind = dict(known.dtypes)
    rows = sample.mapInArrow(count, f"label string, id {kind['id']}, copies bigint, counts binary").collect()
    rows = [r for r in sorted(rows, key=lambda r: (r["label"], r["id"] is None, r["id"] or 0, bytes(r["counts"]))) for _ in range(r["copies"])]
    languages = sorted({r["label"] for r in rows})
    code = codewords(len(languages))
    w, bias = np.zeros((_D, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    if code.shape[1]:
        x = _features(np.array([np.frombuffer(r["counts"], np.float32) for r in rows]))
        y = code[[languages.index(r["label"]) for r in rows]].astype(np.float32)
        first, second = [np.zeros_like(w), np.zeros_like(bias)], [np.zeros_like(w), np.zeros_like(bias)]
        for step in range(1, STEPS + 1):
            slope = -y / (1 + np.exp(np.clip(y * (x @ w + bias), -30, 30))) / len(y)
            for k, (p, g) in enumerate(((w, x.T @ slope + 1e-5 * w), (bias, slope.sum(axis=0)))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                p -= 0.3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return LanguageModel(languages, code, w, bias)


def decode(model: LanguageModel, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best language, runner-up, score and ambiguity of each row."""
    margin = _features(counts) @ model.weights + model.bias
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None, :, :]).sum(axis=2)
    order = np.argsort(loss, axis=1, kind="stable")
    row = np.arange(len(loss))
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    second = order[:, 1] if loss.shape[1] > 1 else order[:, 0]
    return order[:, 0], second, 1 / share.sum(axis=1), loss[row, second] - loss[row, order[:, 0]] < AMBIGUOUS_MARGIN


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, runner_up and ambiguous for each row; a kept column of such a name is replaced."""
    made = ("lang_pred", "score", "runner_up", "ambiguous")
    names = numbered([c for c in keep if c.lower() not in made])
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()],
                       F.coalesce(F.col(f"`{text}`").rlike("\\p{L}"), F.lit(False)).alias("letter"), F.col(f"`{text}`").alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            n = batch.num_rows
            best, second = np.full(n, len(known) - 1), np.full(n, len(known) - 1)
            score, ambiguous = np.zeros(n), np.zeros(n, bool)
            letter = batch.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            if model.languages and letter.any():
                raw, at = utf8(batch.column("text"))
                for lo in range(0, n, 512):
                    hi = min(n, lo + 512)
                    counts = ngram_counts(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    use = np.flatnonzero(letter[lo:hi]) + lo
                    best[use], second[use], score[use], ambiguous[use] = decode(model, counts[use - lo])
            yield append(
                batch.select(list(names.values())), lang_pred=pa.array(known[best], pa.string()), score=pa.array(score),
                runner_up=pa.array(known[second], pa.string()), ambiguous=pa.array(ambiguous))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    fields = f"{fields}, " if fields else ""
    found = rows.mapInArrow(label, f"{fields}lang_pred string, score double, runner_up string, ambiguous boolean")
    return found.select(*[F.col(n).alias(c) for c, n in names.items()], *made)
