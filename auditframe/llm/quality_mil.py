"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is
encoded from its bytes and words (shares of character classes, word lengths,
repetition, hashed byte pairs) by a learned layer; gated attention, learned from
document labels alone, weighs the passages, and the weighted representation is
scored. All passages of a text take part.

Training fits on ``max_documents`` labelled rows (smallest hash of the id, ties by hash of
the text) with all their passages.

Nulls, empties, repeats: a null text or one without a word scores 0. Rows whose
label is null are not learned from; if a document has several labels, the largest
counts. With no label to learn from every other text scores 1 (nothing speaks
against it). Equal texts get equal scores. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.batches import PIECE, SPACE, append, pieces, sigmoid, utf8
from auditframe.llm.columns import sample_rows, text_hash

#: Parameters.
PASSAGE_WORDS = 100
MAX_DOCUMENTS = 4000
STEPS = 200
HIDDEN, GATE = 24, 12
THRESHOLD = 0.3

_PAIR_BITS = 6
_CLASSES = 12
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:", b"!?", b"#*$%&|<>",
    b"'\"()-", b"=_~^+/\\@{}[]`", bytes(range(0x80, 0x100)),
)):
    _KIND[list(_chars)] = _k + 1
_WORD_FEATURES = 7
N_FEATURES = _CLASSES + _WORD_FEATURES + (1 << _PAIR_BITS)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(PIECE + 8, int(_BASE))
_INVERSE = _powers(PIECE + 8, pow(int(_BASE), -1, 1 << 64))


def passage_features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each passage, and its features; rows without a word have none."""
    owners, features = [np.zeros(0, np.int64)], [np.zeros((0, N_FEATURES), np.float32)]
    for group in pieces(at):
        begin, stop = group[0][1], group[-1][2]
        b = raw[begin:stop]
        if not len(b):
            continue
        lengths = np.array([g[2] - g[1] for g in group])
        edge = np.zeros(len(b) + 1, bool)
        edge[np.array([g[1] - begin for g in group])] = True
        solid = ~SPACE[b]
        first = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
        last = np.flatnonzero(solid & (edge[1:] | np.append(~solid[1:], True)))
        if not len(first):
            continue
        stretch = np.repeat(np.arange(len(group)), lengths)
        owner = stretch[first]
        place = np.arange(len(first)) - np.searchsorted(owner, owner)
        opens = place % PASSAGE_WORDS == 0
        passage = np.cumsum(opens) - 1
        n = int(passage[-1]) + 1
        # A byte belongs to the passage of the last word that began before it, in its own stretch.
        mark = np.zeros(len(b), np.int64)
        mark[first[opens]] = 1
        of_byte = np.cumsum(mark) - 1
        use = (of_byte >= 0) & (stretch == owner[opens][np.maximum(of_byte, 0)])
        kinds = np.bincount((of_byte * _CLASSES + _KIND[b])[use], minlength=n * _CLASSES).reshape(n, _CLASSES)
        pair = ((b[:-1].astype(np.uint32) << np.uint32(8) | b[1:]) * np.uint32(2654435761)) >> np.uint32(32 - _PAIR_BITS)
        within = use[:-1] & (stretch[1:] == stretch[:-1])
        pairs = np.bincount(((of_byte[:-1] << _PAIR_BITS) + pair)[within], minlength=n << _PAIR_BITS).reshape(n, 1 << _PAIR_BITS)
        size = (last - first + 1).astype(np.float64)
        sums = np.append(np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWER[: len(b)], dtype=np.uint64))
        word = (sums[last + 1] - sums[first]) * _INVERSE[first]
        again = np.append(False, (word[1:] == word[:-1]) & (passage[1:] == passage[:-1]))
        ordered = np.sort((passage.astype(np.uint64) << np.uint64(40)) | (word >> np.uint64(24)))
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        count = np.bincount(passage, minlength=n)
        per_word = [
            np.bincount(passage, size, n) / count / 8, np.sqrt(np.maximum(np.bincount(passage, size**2, n) / count, 0)) / 10,
            np.log1p(count) / 5, np.bincount((ordered[fresh] >> np.uint64(40)).astype(np.int64), minlength=n) / count,
            np.bincount(passage, again, n) / count, np.bincount(passage, _KIND[b[first]] == 2, n) / count,
            np.bincount(passage, _KIND[b[last]] == 6, n) / count,
        ]
        out = np.empty((n, N_FEATURES), np.float32)
        out[:, :_CLASSES] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
        out[:, _CLASSES : _CLASSES + _WORD_FEATURES] = np.stack(per_word, axis=1)
        out[:, _CLASSES + _WORD_FEATURES :] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
        owners.append(np.array([g[0] for g in group])[owner[opens]])
        features.append(out)
    return np.concatenate(owners), np.concatenate(features)


@dataclass
class BagModel:
    """Scaling, encoder (w, b), gated attention (v, u, a) and output layer (c, c0)."""

    shift: np.ndarray
    scale: np.ndarray
    layers: dict[str, np.ndarray]

    def _encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.layers
        h = np.tanh(((x - self.shift) * self.scale) @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        return h, t, s, (t * s) @ p["a"]

    def score(self, bag: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Score of each of n bags; bags without a passage get 0."""
        out = np.zeros(n)
        if len(bag):
            h, _, _, e = self._encode(x)
            begin = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
            z = _pool(h, e, begin)[0]
            out[bag[begin]] = sigmoid(z @ self.layers["c"] + self.layers["c0"])
        return out


def _pool(h: np.ndarray, e: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention-weighted sum of h over each bag, and the weights."""
    sizes = np.diff(np.append(begin, len(e)))
    weight = np.exp(e - np.repeat(np.maximum.reduceat(e, begin), sizes))
    weight /= np.repeat(np.add.reduceat(weight, begin), sizes)
    return np.add.reduceat(h * weight[:, None], begin, axis=0), weight


def fit_bags(bags: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> BagModel:
    """Adam over the mean logistic loss of the bags' labels."""
    x = np.concatenate(bags).astype(np.float32)
    sizes = np.array([len(b) for b in bags])
    begin = np.append(0, np.cumsum(sizes)[:-1])
    model = BagModel(x.mean(axis=0), 1 / (x.std(axis=0) + 0.05), {})
    rng = np.random.default_rng(7)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = model.layers
    p |= {"w": draw(N_FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE),
          "a": draw(GATE), "c": draw(HIDDEN), "c0": np.zeros(1, np.float32)}
    moments = {k: [np.zeros_like(q), np.zeros_like(q)] for k, q in p.items()}
    scaled = (x - model.shift) * model.scale
    for step in range(1, steps + 1):
        h, t, s, e = model._encode(x)
        z, weight = _pool(h, e, begin)
        slope = ((sigmoid(z @ p["c"] + p["c0"]) - labels) / len(labels)).astype(np.float32)
        d_z = np.repeat(slope[:, None] * p["c"], sizes, axis=0)
        d_weight = (h * d_z).sum(axis=1)
        d_e = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, begin), sizes))
        d_gate = d_e[:, None] * p["a"]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = (weight[:, None] * d_z + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h * h)
        slopes = {"w": scaled.T @ d_h, "b": d_h.sum(axis=0), "v": h.T @ d_t, "u": h.T @ d_s, "a": (t * s).T @ d_e,
                  "c": z.T @ slope, "c0": slope.sum(keepdims=True)}
        for k, g in slopes.items():
            m = moments[k]
            g = g + 1e-4 * p[k]
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p[k] = (p[k] - 0.02 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
        max_documents: int = MAX_DOCUMENTS) -> BagModel | None:
    """Learn from the labelled rows of ``docs``; None where there are none."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("double").alias("y"))
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    sample = sample_rows(texts, texts.select("id", text_hash()).join(known, "id").select("id", "th", "y"), max_documents)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, x = passage_features(*utf8(batch.column("text")))
            cells = [x[slice(*np.searchsorted(owner, (row, row + 1)))].astype(np.float32).tobytes() for row in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("copies"), pa.array(cells, pa.binary())], ["id", "y", "copies", "x"])

    kind = dict(texts.dtypes)["id"]
    rows = [r for r in sample.select("id", "y", "copies", "text").mapInArrow(encode, f"id {kind}, y double, copies bigint, x binary").collect() if len(r["x"])]
    if not rows:
        return None
    rows = [r for r in sorted(rows, key=lambda r: (r["id"], bytes(r["x"]))) for _ in range(r["copies"])]
    return fit_bags([np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows], np.array([r["y"] for r in rows]))


def score(docs: DataFrame, model: BagModel | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted added; columns of those names are replaced."""
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros(batch.num_rows)
            raw, at = utf8(batch.column(text))
            for lo in range(0, batch.num_rows, 256):
                hi = min(batch.num_rows, lo + 256)
                bag, x = passage_features(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                if model is None:
                    values[lo + np.unique(bag)] = 1.0
                else:
                    values[lo:hi] = model.score(bag, x, hi - lo)
            yield append(batch, score=pa.array(values), predicted=pa.array((values >= threshold).astype(np.int32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(add, f"{fields}, score double, predicted int")
