"""Vector bin packing of tokenized examples under limits on tokens, segments and loss-bearing tokens.

Every piece of a document is a vector (tokens, one segment, loss-bearing tokens);
a sequence is a bin with a limit in each dimension. A task keeps a bounded pool of
document ends; whole sequences are cut off first. A bin takes, of the pieces that
still fit, the one with the largest dot product with what is left of the bin; when
none fits, the best is cut to fill it. A bin that a limit or the end of a task leaves
under ``CAPACITY`` tokens is written as sequences whose lengths are powers of two, which need no padding.

Packing needs no shuffle: sequences are numbered within their task.

Tokens come from a vocabulary file. The tokenizer splits at white space and drops
it, so runs between ASCII spaces are encoded once each, by themselves, and remembered.

Nulls, empties, repeats: a null or empty text is one end token. Every row is packed
by itself, repeated rows too; a null id stays null. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parameters.
CAPACITY = 2048
MAX_SEGMENTS = 64
MAX_LOSS = 2048
POOL = 512
VOCABULARY = "word_bpe_49k.json"
END = 1
_SPACE = re.compile(rb"[ \t-\r]")
_SIMPLE = re.compile(rb"[!-&(-~]+").fullmatch
#: Distinct runs and bytes of them that a worker remembers, and bytes of text encoded at once; they bound memory only.
REMEMBERED = 800_000
REMEMBERED_BYTES = 1 << 24
CUT = 1 << 20


class _Places(dict):
    """The place of each run in the order they were first seen; ``fresh`` are those not encoded yet."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, run: bytes) -> int:
        self.fresh.append(run)
        place = self[run] = len(self)
        return place


class _Encoder:
    """Ids of texts. Each distinct run between ASCII spaces is encoded by itself, many runs in one call, and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.remembered = REMEMBERED
        self.tokenizer = Tokenizer.from_file(path)
        # What the tokenizer's patterns come to on small printable ASCII without apostrophes and special tokens.
        self.simple = Tokenizer.from_file(path)
        self.simple.normalizer = normalizers.Sequence([])
        self.simple.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Digits(individual_digits=True), pre_tokenizers.Punctuation(behavior="contiguous")])
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.bytes = 0
        self.cuts = array("q", [0])  # the run at place i has the ids from cuts[i] to cuts[i + 1]
        self.ids = array("I")

    def _learn(self, runs: list[bytes]) -> None:
        """Encode runs; ``word_ids`` of input in words name the word of each id."""
        simple = [k for k, r in enumerate(runs) if _SIMPLE(r) and b"<|" not in r]
        other = sorted(set(range(len(runs))).difference(simple))
        ids, owner = [], []
        for tokenizer, mine, words in (
            (self.simple, simple, [runs[k].decode("ascii").lower() for k in simple]),
            (self.tokenizer, other, [runs[k].decode("utf-8") for k in other]),
        ):
            if mine:
                found = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(found.ids, np.uint32))
                owner.append(np.array(mine, np.int64)[np.array(found.word_ids, np.int64)])
        whose = np.concatenate(owner)
        self.ids.frombytes(np.concatenate(ids)[np.argsort(whose, kind="stable")].tobytes())
        self.cuts.frombytes((self.cuts[-1] + np.cumsum(np.bincount(whose, minlength=len(runs)))).astype(np.int64).tobytes())
        self.bytes += sum(map(len, runs))

    def _of_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the runs, one after another, and how many each has."""
        if len(self.places) > self.remembered or self.bytes > REMEMBERED_BYTES:
            self._forget()
        at = np.fromiter(map(self.places.__getitem__, runs), np.int64, len(runs))
        fresh, self.places.fresh = self.places.fresh, []
        for lo in range(0, len(fresh), 1024):
            self._learn(fresh[lo : lo + 1024])
        cuts, ids = np.array(self.cuts, np.int64), np.array(self.ids, np.uint32)
        sizes = cuts[at + 1] - cuts[at]
        ends = np.cumsum(sizes)
        return ids[np.repeat(cuts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def texts(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text and the end id."""
        runs: list[bytes] = []
        counts: list[int] = []
        held = 0
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            if held and held + len(data) > CUT:
                yield from self._parted(runs, counts)
                runs, counts, held = [], [], 0
            if len(data) > CUT:
                parts = [self._of_runs(data[i:j].split())[0] for i, j in _stretches(data)]
                yield np.concatenate([*parts, np.array([END], np.uint32)])
                continue
            if b"\xcc" not in data and b"<|" not in data:  # no mark that would join a small letter, but not a capital one
                data = data.lower()
            before = len(runs)
            runs += data.split()
            counts.append(len(runs) - before)
            held += len(data)
        yield from self._parted(runs, counts)

    def _parted(self, runs: list[bytes], counts: list[int]) -> Iterator[np.ndarray]:
        ids, sizes = self._of_runs(runs)
        ends = np.append(0, np.cumsum(sizes))[np.cumsum(counts, dtype=np.int64)]
        begin = 0
        for end in ends.tolist():
            yield np.append(ids[begin:end], np.uint32(END))
            begin = end


def _stretches(data: bytes) -> Iterator[tuple[int, int]]:
    """Stretches of about CUT bytes that end before a space."""
    position = 0
    while position < len(data):
        space = _SPACE.search(data, position + CUT)
        stop = space.start() if space else len(data)
        yield position, stop
        position = stop


_encoders: dict[str, _Encoder] = {}


def encoder(path: str) -> _Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


class _Piece:
    __slots__ = ("row", "start", "ids", "total", "quiet")

    def __init__(self, row, start: int, ids: np.ndarray, total: int, quiet: int):
        self.row, self.start, self.ids, self.total, self.quiet = row, start, ids, total, quiet

    def loss(self) -> int:
        """Ids from place ``quiet`` of the document on bear loss."""
        return max(0, self.start + len(self.ids) - max(self.start, self.quiet))

    def longest(self, tokens: int, loss: int) -> int:
        """Ids from the front that stay within both limits."""
        return min(tokens, len(self.ids), max(0, self.quiet - self.start) + loss)

    def split(self, n: int) -> tuple[_Piece, _Piece]:
        return (_Piece(self.row, self.start, self.ids[:n], self.total, self.quiet),
                _Piece(self.row, self.start + n, self.ids[n:], self.total, self.quiet))


class Packer:
    """Greedy dot-product packing of a stream of documents into lists of pieces."""

    def __init__(self, capacity: int = CAPACITY, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS, pool: int = POOL):
        if min(capacity, segments, loss, pool) < 1:
            raise ValueError("limits must be at least 1")
        self.limits = (capacity, segments, loss)
        self.size = pool
        self.pool: list[_Piece] = []
        self.vectors = np.zeros((0, 3))

    def _vector(self, p: _Piece) -> tuple[int, int, int]:
        return len(p.ids), 1, p.loss()

    def add(self, row, ids: np.ndarray, quiet: int) -> Iterator[list[_Piece]]:
        """Take a document; yield the sequences that are done."""
        piece = _Piece(row, 0, ids, len(ids), quiet)
        while True:
            n = piece.longest(self.limits[0], self.limits[2])
            if n == len(piece.ids) and n < self.limits[0]:
                break
            front, piece = piece.split(n)
            yield from self._closed([front])
            if not len(piece.ids):
                return
        self.pool.append(piece)
        if len(self.pool) >= 2 * self.size:
            yield from self._fill(self.size)

    def finish(self) -> Iterator[list[_Piece]]:
        yield from self._fill(0)

    def _fill(self, until: int) -> Iterator[list[_Piece]]:
        limits = np.array(self.limits, float)
        vectors = np.array([self._vector(p) for p in self.pool], float).reshape(-1, 3)
        alive = np.ones(len(self.pool), bool)
        left = len(self.pool)
        while left > until:
            room, taken = limits.copy(), []
            while left and room[0] > 0 and room[1] > 0:
                scores = np.where(alive, (vectors / limits) @ (room / limits), -1)
                fits = np.where((vectors <= room).all(axis=1), scores, -1)
                best = int(np.argmax(fits))
                if fits[best] < 0:
                    best = int(np.argmax(scores))
                    n = self.pool[best].longest(int(room[0]), int(room[2]))
                    if not n:
                        break
                    front, self.pool[best] = self.pool[best].split(n)
                    vectors[best] = self._vector(self.pool[best])
                else:
                    front, alive[best] = self.pool[best], False
                    left -= 1
                taken.append(front)
                room -= self._vector(front)
            yield from self._closed(taken)
        self.pool = [p for p, a in zip(self.pool, alive) if a]

    def _closed(self, pieces: list[_Piece]) -> Iterator[list[_Piece]]:
        """A full sequence as it is; another one as sequences of power-of-two lengths."""
        rest = sum(len(p.ids) for p in pieces)
        queue = pieces[::-1]
        while rest:
            room = self.limits[0] if rest == self.limits[0] else 1 << (rest.bit_length() - 1)
            rest -= room
            out = []
            while room:
                piece = queue.pop()
                if len(piece.ids) > room:
                    piece, back = piece.split(room)
                    queue.append(back)
                out.append(piece)
                room -= len(piece.ids)
            yield out


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prompt_tokens: str | None = None, with_ids: bool = False,
         vocabulary: str | None = None, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS,
         remembered: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens and, if asked for, ids.

    The first ``prompt_tokens`` ids of a document (one where no column is named or it is null) bear no loss.
    ``remembered`` is how many distinct runs a worker keeps; only its memory and time depend on it.
    """
    Packer(capacity, max_segments, max_loss)  # limits that cannot be kept are refused here
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    quiet = F.coalesce(F.col(f"`{prompt_tokens}`").cast("long"), F.lit(1)) if prompt_tokens else F.lit(1).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), quiet.alias("quiet"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        encode.remembered = REMEMBERED if remembered is None else remembered
        packer = Packer(capacity, max_segments, max_loss)
        number = TaskContext.get().partitionId() << 33
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids
        types = [None, *[pa.int64()] * 7] + [pa.list_(pa.int32())] * with_ids
        out: list[tuple] = []

        def write(sequences: Iterator[list[_Piece]]) -> None:
            nonlocal number
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    ids = (p.ids.astype(np.int32),) if with_ids else ()
                    out.append((p.row, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, number, offset, p.loss(), *ids))
                    offset += len(p.ids)
                number += 1

        def batch(of: pa.DataType) -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t or of) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return made

        of = None
        for b in batches:
            of = b.column("doc_id").type
            encoded = encode.texts(value.as_py() for value in b.column("text"))
            for row, ids, silent in zip(b.column("doc_id").to_pylist(), encoded, b.column("quiet").to_pylist()):
                write(packer.add(row, ids, silent))
                if len(out) >= 4096:
                    yield batch(of)
        write(packer.finish())
        if out:
            yield batch(of)

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, loss_tokens bigint"
    return rows.mapInArrow(run, schema + ", ids array<int>" * with_ids)
