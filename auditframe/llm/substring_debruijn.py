"""Substring dedup over a de Bruijn graph of token 20-mers.

A window of 20 consecutive words is an edge of the graph. Edges are never written
one by one: consecutive windows of a document that share their minimizer (the
5-word shingle with the smallest hash inside the window, leftmost on ties) form a
path and are written as one row, about one for eight words. Equal windows have
equal minimizers, so whatever repeats meets under one minimizer:

1. Minimizers are counted; paths whose minimizer occurs once are done with. A join
   brings the others together.
2. Equal paths are nonbranching repeats: every occurrence but the first is repeated
   as a whole, with the first one's document and start as source coordinates.
3. Where different paths share a minimizer, the graph branches. One representative
   of each such path is split into its windows, which are matched one by one. This
   is exact: a window's first occurrence lies in the first occurrence of its path.
4. Pieces on the same diagonal (same source document and distance) compact into
   long spans; spans cover the words to remove.

Paths and windows are compared by two independent 64-bit hashes of their words, so
source coordinates are right unless both collide. Counts and first occurrences
combine before each shuffle and the joins are split by size, so a passage with a
third of all rows loads no single task.

Nulls, empties, repeats: null texts have no words; texts under 20 words keep all.
Every row is a document of its own. Documents are ordered by id, nulls first; rows that share
an id, null ids among them, by hash of the text and place. Ids that are not unique long
numbers are replaced by the rows' places in that order, written once. Long texts are read in
overlapping pieces of bounded size. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.batches import SPACE, append, utf8
from auditframe.session import materialize

#: Words of a window (an edge of the graph).
WINDOW = 20
#: Words of a minimizer; a window holds WINDOW - SHINGLE + 1 = 16 shingles, a power of two.
SHINGLE = 5
#: Bytes of text hashed at once; they bound memory only.
CUT = 1 << 20

_PLACES = np.uint64((1 << 20) - 1)
_SPACE = re.compile(rb"[ \t-\r]")
_FACTORS = np.random.default_rng(20).integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
#: Two hashes of a word: what each byte stands for, and the base whose powers its place multiplies.
_BYTES = np.random.default_rng(21).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@cache
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _size(n: int) -> int:
    """A length of at least ``n`` of which few are ever asked for."""
    return max(CUT + (CUT >> 3), 1 << n.bit_length())


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _words(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and two 64-bit hashes of every word; a text begins at each of ``breaks``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    solid = ~SPACE[raw]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    opens[breaks] = solid[breaks]
    inner = breaks[breaks > 0] - 1
    closes[inner] = solid[inner]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = []
    for values, base in zip(_BYTES, _BYTE_BASES):
        power, inverse = _powers(base, _size(n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[raw] * power[:n], out=sums[1:])
        hashes.append(_mix((sums[end] - sums[begin]) * inverse[begin]))
    return begin, hashes[0], hashes[1]


def _long(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first word, hashes) of stretches of one text that share WINDOW - 1 words."""
    first, position, stop = 0, 0, 0
    while stop < len(raw):
        stop += CUT
        while stop < len(raw) and not SPACE[raw[stop]]:
            spaces = np.flatnonzero(SPACE[raw[stop : stop + CUT]])
            stop += int(spaces[0]) if len(spaces) else CUT
        begin, high, low = _words(raw[position:stop], np.zeros(1, np.int64))
        yield first, high, low
        kept = min(len(begin), WINDOW - 1)
        first += len(begin) - kept
        position = position + int(begin[-kept]) if kept else stop


def _blocks(data: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first word, words) of stretches that share ``overlap`` words."""
    first, position, carry = 0, 0, []
    while position < len(data):
        stop = position + CUT
        space = _SPACE.search(data, stop) if stop < len(data) else None
        stop = space.start() if space else len(data)
        words = carry + data[position:stop].split()
        yield first, words
        carry = words[len(words) - min(overlap, len(words)) :]
        first += len(words) - len(carry)
        position = stop


class _Ranges:
    """Hashes of word ranges from prefix sums."""

    def __init__(self, hashes: np.ndarray):
        self.powers = _powers(_BASE, _size(len(hashes)))
        self.sums = np.append(np.uint64(0), np.cumsum(hashes * self.powers[0][: len(hashes)], dtype=np.uint64))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.powers[1][begin])


def paths(high: np.ndarray, low: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, number of windows, minimizer and content hash of each path; ``owner`` parts the documents."""
    n = len(high) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    shingle = np.zeros(len(high) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        shingle += high[k : k + len(shingle)] * _FACTORS[k]
    shingle = _mix(shingle)
    least = (shingle & ~_PLACES) | np.arange(len(shingle), dtype=np.uint64)
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    chosen = (least & _PLACES).astype(np.int64)
    inside = owner[:n] == owner[WINDOW - 1 :]
    opens = inside & np.append(True, ~inside[:-1] | (chosen[1:] != chosen[:-1]))
    first = np.flatnonzero(opens)
    ends = np.append(np.flatnonzero(opens | ~inside), n)
    length = ends[np.searchsorted(ends, first, "right")] - first
    return first, length, shingle[chosen[first]], _Ranges(low).of(first, first + length + WINDOW - 1)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of stretches of texts: row, place of the stretch's first word and two hashes, by word."""
    raw, at = utf8(batch.column("text"))
    lo, rows = 0, batch.num_rows
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CUT, "right")) - 1)
        part = raw[at[lo] : at[hi]]
        if len(part) > CUT:
            for first, high, low in _long(part):
                yield np.full(len(high), lo), np.full(len(high), first), high, low
        elif len(part):
            inside = at[lo:hi] - at[lo]
            begin, high, low = _words(part, inside[inside < len(part)])
            yield np.searchsorted(inside, begin, "right") - 1 + lo, np.zeros(len(begin), np.int64), high, low
        lo = hi


def _emit_paths(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        for row, first_word, high, low in _stretches(batch):
            stretch = np.cumsum(np.append(0, (row[1:] != row[:-1]) | (first_word[1:] != first_word[:-1])))[: len(row)]
            begin = np.searchsorted(stretch, stretch)
            first, length, minimizer, content = paths(high, low, stretch)
            columns = {"minimizer": pa.array(minimizer.view(np.int64))}
            if whole:
                columns |= {
                    "content": pa.array(content.view(np.int64)), "doc": pa.array(doc[row[first]]),
                    "start": pa.array(first_word[first] + first - begin[first], pa.int64()), "windows": pa.array(length.astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[np.ndarray, ...]] = []

    def batch_of() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["high", "low", "doc", "start"])
        out.clear()
        return made

    held = 0
    for batch in batches:
        doc, wanted = batch.column("doc").to_numpy(), [_places(p) for p in batch.column("parts")]
        for row, first_word, high, low in _stretches(batch):
            edges = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (first_word[1:] != first_word[:-1])))[: len(row)]
            at, docs, starts = [], [], []
            for o, size in zip(edges.tolist(), np.diff(np.append(edges, len(row))).tolist()):
                places, first = wanted[row[o]], int(first_word[o])
                here = places[np.searchsorted(places, first) : np.searchsorted(places, first + size - WINDOW, "right")]
                if len(here):
                    at.append(here + (o - first))
                    docs.append(np.full(len(here), doc[row[o]]))
                    starts.append(here)
            if at:
                begin = np.concatenate(at)
                ends = begin + WINDOW
                out.append((*[_Ranges(h).of(begin, ends).view(np.int64) for h in (high, low)], np.concatenate(docs), np.concatenate(starts)))
                held += len(begin)
                if held >= 1 << 16:
                    yield batch_of()
                    held = 0
    if out:
        yield batch_of()


def _places(parts: pa.Scalar) -> np.ndarray:
    """Starts of the windows in a document's parts, in order."""
    starts, counts = (np.array([p[k] for p in parts.as_py()], np.int64) for k in ("start", "windows"))
    return np.sort(np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum()))


def pieces(texts: DataFrame) -> DataFrame:
    """Repeated pieces of ``texts(doc, text)``: doc, start, windows, source_doc and source_start; ``doc`` is never null."""
    here = F.struct("doc", "start")
    counts = texts.mapInArrow(lambda b: _emit_paths(b, False), "minimizer bigint").groupBy("minimizer").count()
    counted = materialize(counts.where("count > 1").select("minimizer"), "repeated-minimizers")  # a plain scan, so that the join can be split
    all_paths = texts.mapInArrow(lambda b: _emit_paths(b, True), "minimizer bigint, content bigint, doc bigint, start bigint, windows int")
    shared = materialize(all_paths.join(counted, "minimizer"), "shared-paths")
    distinct = materialize(
        shared.groupBy("minimizer", "content").agg(F.min(here).alias("source"), F.count(F.lit(1)).alias("n"), F.min("windows").alias("windows")),
        "distinct-paths")
    whole = shared.join(distinct.where("n > 1").select("minimizer", "content", "source"), ["minimizer", "content"]).where(here > F.col("source"))
    branching = distinct.groupBy("minimizer").count().where("count > 1").select("minimizer")
    parts = distinct.join(branching, "minimizer").groupBy(F.col("source.doc").alias("doc")).agg(
        F.collect_list(F.struct(F.col("source.start").alias("start"), "windows")).alias("parts"))
    windows = texts.join(parts, "doc").mapInArrow(_emit_windows, "high bigint, low bigint, doc bigint, start bigint")
    firsts = windows.groupBy("high", "low").agg(F.min(here).alias("source"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    single = windows.join(firsts, ["high", "low"]).where(here > F.col("source")).withColumn("windows", F.lit(1))
    columns = ["doc", "start", "windows", F.col("source.doc").alias("source_doc"), F.col("source.start").alias("source_start")]
    return whole.select(*columns).union(single.select(*columns))


def compact(found: list[dict]) -> list[tuple[int, int, int, int]]:
    """Spans (start, words, source document, source start) of one document, pieces joined along diagonals."""
    spans: list[list[int]] = []
    for p in sorted(found, key=lambda p: (p["source_doc"], p["source_start"] - p["start"], p["start"])):
        same = spans and spans[-1][2] == p["source_doc"] and spans[-1][3] - spans[-1][0] == p["source_start"] - p["start"]
        if same and p["start"] <= spans[-1][0] + spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], p["start"] + p["windows"] + WINDOW - 1 - spans[-1][0])
        else:
            spans.append([p["start"], p["windows"] + WINDOW - 1, p["source_doc"], p["source_start"]])
    return [tuple(s) for s in spans]


def _removed(n: int, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for start, size, _, _ in spans:
        if start < n:
            change[start] += 1
            change[min(n, start + size)] -= 1
    return np.cumsum(change[:-1]) > 0


def _cut(data: bytes, spans: list[tuple[int, int, int, int]]) -> tuple[int, int, str, bytes]:
    """Words, removed words, digest of the kept words, and the text without the removed ones."""
    if not spans:
        digest, n = hashlib.sha256(), 0
        for _, words in _blocks(data, 0):
            digest.update(b" " * (n > 0 and len(words) > 0) + b" ".join(words))
            n += len(words)
        return n, 0, digest.hexdigest(), data
    solid = ~SPACE[np.frombuffer(data, np.uint8)]
    begin = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    end = np.flatnonzero(solid & np.append(~solid[1:], True)) + 1
    gone = _removed(len(begin), spans)
    kept = np.flatnonzero(~gone)
    digest = hashlib.sha256()
    runs = np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1) if len(kept) else []
    out, last = [], 0
    for k, run in enumerate(runs):
        part = data[begin[run[0]] : end[run[-1]]]
        for j, (_, words) in enumerate(_blocks(part, 0)):
            digest.update(b" " * ((k > 0 or j > 0) and len(words) > 0) + b" ".join(words))
        if k:
            out.append(b"\n" if b"\n" in data[last : begin[run[0]]] else b" ")
        out.append(part)
        last = end[run[-1]]
    return len(begin), int(gone.sum()), digest.hexdigest(), b"".join(out)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """``docs`` as doc, id, text and in_0, in_1, ...; ``doc`` is a long of the row's own in the order of documents. And whether that is the id."""
    rest = [F.col(f"`{c}`").alias(f"in_{k}") for k, c in enumerate(docs.columns)]
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), *rest)
    if dict(rows.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        if rows.groupBy("id").count().where("count > 1 or id is null").isEmpty():
            # Never null, and known to be: else a join filters one reading of the texts only, which then are dealt out twice.
            return rows.withColumn("doc", F.coalesce(F.col("id").cast("bigint"), F.lit(0).cast("bigint"))), True
    order = ["id", "hash", "place"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.drop("hash", "place").withColumn("doc", F.monotonically_increasing_id()), "keyed-documents"), False


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256, spans and, if asked for, kept_text.

    ``spans`` lists (start, n_words, source_doc, source_start) of the repeated stretches. Columns of ``docs`` with these names are replaced.
    """
    rows, by_id = _keyed(docs, doc_id, text)
    found = pieces(rows.select("doc", "text"))
    if not by_id:
        found = found.join(rows.select(F.col("doc").alias("source_doc"), F.col("id").alias("source_id")), "source_doc")
    found = found.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "source_doc", "source_start", *["source_id"] * (not by_id))).alias("found"))
    made = ("n_words", "n_removed", "kept_sha256", "spans", "kept_text")
    places = [k for k, c in enumerate(docs.columns) if c.lower() not in made and (with_text or c != text)]
    # Where nothing but doc and text passes through, the texts are the ones that were dealt out to find the pieces.
    passed = [f"in_{k}" for k in places if docs.columns[k] not in (text, doc_id)] + ["id"] * (not by_id)
    joined = rows.select("doc", "text", *passed).join(found, "doc", "left")
    through = (["text"] if with_text else []) + ["doc", *passed]
    source = "source_doc" if by_id else "source_id"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind_of = batch.schema.field("found").type.value_type.field(source).type
            span = pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("source_doc", kind_of), ("source_start", pa.int64())])
            out = []
            for t, f in zip(batch.column("text"), batch.column("found")):
                parts = f.as_py() or []
                spans, ids = compact(parts), {p["source_doc"]: p[source] for p in parts}
                value = t.as_py()
                n, removed, digest, kept = _cut((value or "").encode("utf-8", "surrogatepass"), spans)
                out.append((n, removed, digest, [{"start": a, "n_words": w, "source_doc": ids[d], "source_start": b} for a, w, d, b in spans],
                            (kept.decode("utf-8", "surrogatepass") if value is not None else None) if with_text else None))
            n, removed, digest, spans, kept = zip(*out) if out else ((),) * 5
            more = {"n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
                    "spans": pa.array(spans, pa.list_(span))}
            if with_text:
                more["kept_text"] = pa.array(kept, pa.string())
            yield append(batch.select(through), **more)

    kind = "bigint" if by_id else dict(rows.dtypes)["id"]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*through).schema.fields]
    fields += ["n_words bigint", "n_removed bigint", "kept_sha256 string",
               f"spans array<struct<start: bigint, n_words: bigint, source_doc: {kind}, source_start: bigint>>"]
    result = joined.mapInArrow(finish, ", ".join(fields + ["kept_text string"] * with_text))
    own = {text: F.col("text"), doc_id: F.col("doc").cast(dict(rows.dtypes)["id"]) if by_id else F.col("id")}
    back = [own.get(docs.columns[k], F.col(f"in_{k}")).alias(docs.columns[k]) for k in places]
    return result.select(*back, "n_words", "n_removed", "kept_sha256", "spans", *["kept_text"] * with_text)
