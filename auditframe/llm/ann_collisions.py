"""Approximate nearest neighbours by query-aware collision counting.

Every vector is projected on ``N_PROJECTIONS`` random lines; the values along each
line form a sorted array. A query's window on a line is centred at its own
projection and grows by virtual rehashing: each round widens all windows by
``GROWTH`` and only the newly covered stretches of the arrays are counted. A vector
whose collisions reach the threshold is verified with its exact distance, in double
precision on the original components. A query stops when k verified vectors lie within the
radius that its windows stand for; otherwise windows grow until they hold everything, so
there is no cap on candidates. How wide a window stands for a radius is measured on vectors of the slot, whose
true neighbours are computed, so that the recall asked for is reached on the data at hand.

Vectors are dealt once into slots of about ``ROWS`` by hash; every slot is indexed once, and all queries stream
past it in batches, so a task holds one slot and one batch. The best k of all slots are merged by partial ranks.
Queries times slots is what is dealt out: all queries against all vectors, by nature.

Nulls, empties, repeats: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part. Only vectors of one length are
compared. Rows that share an id are candidates each; equal rows are kept once with their number, and only the query's own row
is left out. A repeated query is answered as often. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditframe.session import materialize, materialize_counted

#: Parameters. The stopping width is measured: SAMPLES vectors of a slot ask for their TRIED nearest, and the smallest of WIDTHS with
#: which the recall reaches RECALL is taken.
N_PROJECTIONS = 128
COLLISIONS = 0.85
GROWTH = 1.12
ROUNDS = 80
WIDTHS = tuple(2 + 0.2 * k for k in range(31))
RECALL = 0.98
SAMPLES, TRIED = 48, 10
ROWS = 8192


def usable(vector: Column) -> Column:
    """Holds finite numbers only, and one that is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Index:
    """Sorted projections of a set of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5):
        self.ids, self.vectors = ids, vectors
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], N_PROJECTIONS))
        values = np.ascontiguousarray((vectors @ self.lines).T)
        self.order = np.argsort(values, axis=1, kind="stable")
        self.values = np.take_along_axis(values, self.order, axis=1)
        self.spread = float(values.std(axis=1).mean())
        self.width = self._measured_width()

    def _rounds(self, query: np.ndarray, skip: int) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """After each widening: the windows' half width, and places and distances of what was verified by then."""
        n, at = len(self.ids), query @ self.lines
        reach = float(max((self.values[:, -1] - at).max(), (at - self.values[:, 0]).max(), 0.0))
        halves = (0.05 * self.spread + 1e-300) * GROWTH ** np.arange(ROUNDS)
        halves = np.append(halves[halves < reach], reach * 1.01 + 1e-300)
        edges = np.concatenate([at[:, None] - halves[None, ::-1], at[:, None] + halves[None, :]], axis=1)
        cuts = np.stack([np.searchsorted(v, e) for v, e in zip(self.values, edges)])
        low, high = cuts[:, : len(halves)][:, ::-1], cuts[:, len(halves) :]
        threshold = int(np.ceil(COLLISIONS * N_PROJECTIONS))
        base = np.arange(N_PROJECTIONS) * n
        counts, known = np.zeros(n, np.int64), np.arange(n) == skip
        found, far = np.zeros(0, np.int64), np.zeros(0)
        flat = self.order.ravel()
        for r in range(len(halves)):
            if r:
                begin = np.concatenate([base + low[:, r], base + high[:, r - 1]])
                size = np.concatenate([low[:, r - 1] - low[:, r], high[:, r] - high[:, r - 1]])
            else:
                begin, size = base + low[:, 0], high[:, 0] - low[:, 0]
            total = int(size.sum())
            if total:
                places = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(total)
                counts += np.bincount(flat[places], minlength=n)
            fresh = np.flatnonzero((counts >= threshold) & ~known)
            if len(fresh):
                known[fresh] = True
                gap = self.vectors[fresh] - query
                found, far = np.append(found, fresh), np.append(far, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            yield halves[r], found, far

    def _measured_width(self) -> float:
        n = len(self.ids)
        if n <= 2 * TRIED:
            return float("inf")
        recall = np.zeros(len(WIDTHS))
        chosen = np.unique(np.linspace(0, n - 1, SAMPLES).astype(np.int64))
        for place in chosen:
            gap = self.vectors - self.vectors[place]
            true = np.einsum("ij,ij->i", gap, gap)
            true[place] = np.inf
            near = np.sqrt(np.partition(true, TRIED - 1)[TRIED - 1]) * (1 + 1e-12)
            reached = np.zeros(len(WIDTHS), bool)
            for half, _, far in self._rounds(self.vectors[place], int(place)):
                kth = np.partition(far, TRIED - 1)[TRIED - 1] if len(far) >= TRIED else np.inf
                hits = min(TRIED, int((far <= near).sum())) / TRIED
                stops = ~reached & (kth * np.array(WIDTHS) <= 2 * half)
                recall[stops] += hits
                reached |= stops
                if reached.all() or hits == 1:
                    break
            recall[~reached] += 1
        good = np.flatnonzero(recall / len(chosen) >= RECALL)
        return WIDTHS[good[0]] if len(good) else float("inf")

    def nearest(self, query: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest that were found, by distance, then id; never the place ``skip``."""
        for half, found, far in self._rounds(query, skip):
            if len(far) >= k and np.partition(far, k - 1)[k - 1] * self.width <= 2 * half:
                break
        best = np.lexsort((self.ids[found], far))[:k]
        return found[best], far[best]


class _Slot:
    """The vectors of one slot; indexed, by length, when the first query comes."""

    def __init__(self, number: int):
        self.number = number
        self.ids: list[int] = []
        self.vectors: list[np.ndarray] = []
        self.copies: list[int] = []
        self.indexes: dict[int, tuple[np.ndarray, Index, dict[int, list[int]]]] = {}

    def add(self, ids: list[int], vectors: list[np.ndarray], copies: list[int]) -> None:
        self.ids += ids
        self.vectors += vectors
        self.copies += copies

    def _index(self, size: int) -> tuple[np.ndarray, Index, dict[int, list[int]]] | None:
        if size not in self.indexes:
            mine = np.array([k for k, v in enumerate(self.vectors) if len(v) == size], np.int64)
            if not len(mine):
                return None
            index = Index(np.array(self.ids, np.int64)[mine], np.stack([self.vectors[k] for k in mine]))
            places: dict[int, list[int]] = {}
            for place, i in enumerate(index.ids.tolist()):
                places.setdefault(i, []).append(place)
            self.indexes[size] = mine, index, places
        return self.indexes[size]

    def nearest(self, query_id: int, query: np.ndarray, k: int) -> Iterator[tuple[int, float, int]]:
        """Ids, distances and numbers of equal rows; one row equal to the query is the query's own."""
        found = self._index(len(query))
        if found is None:
            return
        mine, index, places = found
        own = next((p for p in places.get(query_id, ()) if np.array_equal(index.vectors[p], query)), -1)
        alone = own >= 0 and self.copies[mine[own]] == 1
        for place, far in zip(*index.nearest(query, k, own if alone else -1)):
            yield int(index.ids[place]), float(far), self.copies[mine[place]] - (place == own)


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return [values[i:j] for i, j in zip(offsets, offsets[1:])]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score for the k nearest of ``vectors`` to each row of ``queries``, which are rows of ``vectors`` too."""
    def plain(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{embedding}`").alias("v"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))

    rows, n = materialize_counted(plain(vectors), "vectors")
    asked = materialize(plain(queries).withColumn("key", F.monotonically_increasing_id()), "queries")
    slots = max(1, -(-n // ROWS))
    dealt = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(slots)).cast("int").alias("slot"), F.lit(None).cast("bigint").alias("key"), "id", "v", "copies")
    posed = asked.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), "key", "id", "v", "copies")
    stream = dealt.unionByName(posed).repartition("slot").sortWithinPartitions("slot", F.col("key").asc_nulls_first())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _Slot(-1)
        for batch in batches:
            numbers, keys = batch.column("slot").to_numpy(), batch.column("key").to_pylist()
            ids, data, copies = batch.column("id").to_pylist(), _vectors(batch.column("v")), batch.column("copies").to_pylist()
            out: list[tuple] = []
            for number in np.unique(numbers).tolist():
                if number != slot.number:
                    slot = _Slot(number)
                here = np.flatnonzero(numbers == number).tolist()
                mine = [i for i in here if keys[i] is None]
                slot.add([ids[i] for i in mine], [data[i] for i in mine], [copies[i] for i in mine])
                for i in here[len(mine) :]:
                    out += [(keys[i], ids[i], copies[i], *found) for found in slot.nearest(ids[i], data[i], k)]
            if out:
                names = ["key", "query_id", "times", "vec_id", "score", "copies"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    found = stream.mapInArrow(answer, "key bigint, query_id bigint, times bigint, vec_id bigint, score double, copies bigint")
    each = found.select("key", "query_id", "times", "vec_id", "score", F.explode(F.array_repeat(F.lit(0), F.least("copies", F.lit(k)).cast("int"))))
    order = Window.partitionBy("key").orderBy("score", "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    repeated = ranked.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return repeated.select("query_id", "rank", "vec_id", "score")
