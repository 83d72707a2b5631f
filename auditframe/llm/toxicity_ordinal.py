"""Toxicity by cumulative-link ordinal regression.

Severity is a grade 0..K. One weight vector over sparse word features gives a
latent severity; ordered thresholds, sharing those weights, part it into grades:
P(grade > k) = sigmoid(w.x - threshold_k). The result is the expected severity,
the sum of these probabilities.

Words (ASCII-lower-cased, outer punctuation off) are hashed to 2 ** BUCKET_BITS
buckets. The ``n_features`` buckets whose counts over all labelled rows have the largest
chi-square (MIN_CHI_SQUARE at least, so that chance plays no part) become features, with log(1 + count) as value.
Weights are fitted on ``max_documents`` labelled rows (smallest hash of the id, ties by hash of the text).

Labels that only say toxic or not are graded by evidence: a toxic row's grade
grows with its occurrences of buckets that toxic rows have at least LIFT times as
often (GRADE_HITS).

Nulls, empties, repeats: a null or empty text has no features and gets the severity
of the thresholds alone. Rows with a null label are not learned from; of several
labels of a document the largest counts. Without a toxic label all severities are 0.
Equal texts get equal results; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.batches import append, sigmoid
from auditframe.llm.columns import sample_rows, text_hash
from auditframe.session import materialize_counted

#: Parameters.
BUCKET_BITS = 18
N_FEATURES = 1024
MAX_DOCUMENTS = 10_000
MIN_CHI_SQUARE = 24
#: Labels that are broadcast at most; their number is counted first, and more are joined by a shuffle of what texts are reduced to.
BROADCAST_LABELS = 1_000_000
LIFT = 8
GRADE_HITS = (3, 6)
STEPS = 300
THRESHOLD = 0.2
CUT = 1 << 20
REMEMBERED = 300_000

_EDGES = b".,;:!?\"'()[]{}<>*#$%&|_-"


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        place = xxhash.xxh3_64_intdigest(word.strip(_EDGES)) >> (64 - BUCKET_BITS)
        if len(self) < REMEMBERED:
            self[word] = place
        return place

    def of(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets of a text's words, stretch by stretch."""
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        position = 0
        while position < len(data):
            stop = position + CUT
            if stop < len(data):
                stop = min((p for p in (data.find(s, stop) for s in (b" ", b"\n", b"\t")) if p >= 0), default=len(data))
            words = data[position:stop].split()
            yield np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            position = stop


def _distinct_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct buckets of every text, as bytes, beside the first column."""
    buckets = _Buckets()
    for batch in batches:
        cells = [np.unique(np.concatenate([*buckets.of(t.as_py()), np.zeros(0, np.int64)])).astype("<u4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary())], [batch.schema.names[0], "buckets"])


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of this task: rows that have each bucket, by label."""
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        for y, cell in zip(batch.column("y").to_pylist(), batch.column("buckets")):
            counts[int(y > 0), np.frombuffer(cell.as_py(), "<u4")] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[1, some]), pa.array(counts[0, some])], ["bucket", "toxic", "clean"])


@dataclass
class OrdinalModel:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def columns(self) -> np.ndarray:
        """Column of each bucket, -1 for none."""
        column = np.full(1 << BUCKET_BITS, -1, np.int64)
        column[self.buckets] = np.arange(len(self.buckets))
        return column

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        return sigmoid((x @ self.weights)[:, None] - self.thresholds[None, :])


def _values(buckets: _Buckets, column: np.ndarray, n: int, text: str | None) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for part in buckets.of(text):
        at = column[part]
        out += np.bincount(at[at >= 0], minlength=n)
    return out


def fit_ordinal(x: np.ndarray, grade: np.ndarray, n_grades: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds that maximise the likelihood of the grades (Adam, small L2)."""
    w = np.zeros(x.shape[1], np.float32)
    free = np.concatenate([[1.0], np.full(n_grades - 2, 0.5)]).astype(np.float32)  # first threshold, then log gaps
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, free)]
    for step in range(1, steps + 1):
        gaps = np.exp(free[1:])
        thresholds = free[0] + np.append(0, np.cumsum(gaps))
        eta = x @ w
        lower = np.append(-np.inf, thresholds)[grade]
        upper = np.append(thresholds, np.inf)[grade]
        at_upper, at_lower = sigmoid(upper - eta), sigmoid(lower - eta)
        # d log P / d upper and d lower, with P = at_upper - at_lower
        p = np.maximum(at_upper - at_lower, 1e-9)
        d_upper, d_lower = at_upper * (1 - at_upper) / p, -at_lower * (1 - at_lower) / p
        d_eta = -(d_upper + d_lower) / len(x)
        d_threshold = (np.bincount(grade, d_upper, n_grades)[:-1] + np.bincount(grade, d_lower, n_grades)[1:]) / len(x)
        d_free = np.append(d_threshold.sum(), [d_threshold[k + 1 :].sum() * gaps[k] for k in range(len(gaps))])
        for p_, g, m in zip((w, free), (x.T @ d_eta - 1e-4 * w, d_free), moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p_ += (0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w, free[0] + np.append(0, np.cumsum(np.exp(free[1:])))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", graded: bool = False, text: str = "text", doc_id: str = "doc_id",
        n_features: int = N_FEATURES, max_documents: int = MAX_DOCUMENTS) -> OrdinalModel | None:
    """Learn from the labelled rows of ``docs``; ``graded`` labels are grades themselves. None without a positive label."""
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known, n_labels = materialize_counted(known, "labels")
    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = dict(texts.dtypes)["id"]
    labelled = texts.select("id", text_hash()).join(known, "id").select("id", "th", "y")
    # Counted are all labelled rows. Few labels go to the texts; many meet the distinct buckets that texts are reduced to.
    if n_labels <= BROADCAST_LABELS:
        reduced = texts.join(F.broadcast(known), "id").select("y", "text").mapInArrow(_distinct_buckets, "y int, buckets binary")
    else:
        reduced = texts.mapInArrow(_distinct_buckets, f"id {kind}, buckets binary").join(known, "id").select("y", "buckets")
    counts = reduced.mapInArrow(_count_documents, "bucket bigint, toxic bigint, clean bigint").groupBy("bucket").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = labelled.agg(F.sum(F.when(F.col("y") > 0, 1.0)).alias("toxic"), F.sum(F.when(F.col("y") <= 0, 1.0)).alias("clean")).first()
    if not n["toxic"]:
        return None
    n_toxic, n_clean = n["toxic"], n["clean"] or 1.0
    a, b = F.col("toxic"), F.col("clean")
    rows = n_toxic + n_clean
    apart = F.pow(a * (n_clean - b) - b * (n_toxic - a), F.lit(2.0)) / ((a + b) * (rows - a - b + 1)) * (rows / (n_toxic * n_clean))
    best = counts.select("bucket", "toxic", "clean", apart.alias("chi")).where(F.col("chi") >= MIN_CHI_SQUARE).orderBy(F.desc("chi"), "bucket").limit(n_features).collect()
    buckets = np.array([r["bucket"] for r in best], np.int64)
    strong = np.array([r["toxic"] / n_toxic > LIFT * max(r["clean"], 0.5) / n_clean for r in best], bool)
    model = OrdinalModel(buckets, np.zeros(len(buckets)), np.zeros(1))
    column = model.columns()
    sample = sample_rows(texts, labelled, max_documents)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = _Buckets()
        for batch in batches:
            cells = [_values(known_words, column, len(buckets), t.as_py()).astype(np.uint32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("copies"), pa.array(cells, pa.binary())], ["id", "y", "copies", "x"])

    found = sample.select("id", "y", "copies", "text").mapInArrow(encode, f"id {kind}, y int, copies bigint, x binary").collect()
    found = [r for r in sorted(found, key=lambda r: (r["id"], bytes(r["x"]))) for _ in range(r["copies"])]
    if not found or not len(buckets):
        return None
    hits = np.array([np.frombuffer(r["x"], np.uint32) for r in found])
    y = np.array([r["y"] for r in found])
    if graded:
        grade = np.maximum(y, 0)
    else:
        evidence = hits[:, strong].sum(axis=1, dtype=np.int64)
        grade = np.where(y > 0, 1 + sum((evidence >= g).astype(int) for g in GRADE_HITS), 0)
    if not grade.any():
        return None
    _, grade = np.unique(np.append(grade, 0), return_inverse=True)  # grades without a row close up
    grade = grade[:-1]
    model.weights, model.thresholds = fit_ordinal(np.log1p(hits, dtype=np.float32), grade, int(grade.max()) + 1)
    return model


def score(docs: DataFrame, model: OrdinalModel | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with expected_severity, severity (likeliest grade), score = P(grade > 0) and predicted; same-named columns are replaced."""
    made = ("expected_severity", "severity", "score", "predicted")
    rest = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(*[F.col(f"`{c}`") for c in rest])
    column = model.columns() if model else None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = _Buckets()
        for batch in batches:
            above = np.zeros((batch.num_rows, len(model.thresholds) if model else 1))
            if model:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.column(text)[lo : lo + 1024]
                    x = [_values(known_words, column, len(model.buckets), t.as_py()) for t in part]
                    above[lo : lo + len(part)] = model.above(np.log1p(np.array(x)))
            steps = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
            yield append(
                batch, expected_severity=pa.array(above.sum(axis=1)), severity=pa.array((-np.diff(steps, axis=1)).argmax(axis=1).astype(np.int32)),
                score=pa.array(above[:, 0]), predicted=pa.array((above[:, 0] >= threshold).astype(np.int32)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(add, f"{fields}, expected_severity double, severity int, score double, predicted int")
