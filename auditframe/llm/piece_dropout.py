"""SentencePiece encoding with seeded merge-dropout, and decoding.

A BPE model of pieces merges symbols by an agenda: the candidate with the best
score, leftmost on ties, comes first. With dropout a candidate is skipped when a
keyed hash of the seed, the document, the stretch's place in the text and the candidate falls
below the dropout rate, so every occurrence of a word is drawn for itself, any worker gives
the same one, and every one decodes to the text. At rate 0 the result is the model's own encoding.

No piece crosses from a letter into a space, nor holds a line feed or tab, so a text
is segmented in stretches (spaces and the word behind them), and those in parts that no
piece joins. Many parts of like length go through the agenda together, a row of symbols each:
every round takes each row's best candidate and merges or skips it. Nothing is remembered between
occurrences, so neither time nor memory depends on how often words repeat.

A literal U+2581, which the model would confuse with a space, is written as bytes,
so that decoding is exact for every text.

Nulls, empties, repeats: a null text has null ids and decodes to null, an empty one
has none. Rows of one id and text get equal ids; a null id is told apart by its text. Columns other than the text pass through.
"""

from __future__ import annotations

import heapq
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.batches import append
from auditframe.llm.columns import numbered

#: Parameters.
MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
#: Characters worked on at once; it bounds memory only.
BLOCK = 1 << 17

SPACE = "▁"
_STRETCH = re.compile("[ ]*[^ \n\t]+|[ ]+|[\n\t]")
_LONG = (1 << 64) - 1
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_NONE, _GONE = -1, -2
_NEVER = (1 << 31) - 1
#: Parts longer than ``SHORT`` share rounds only if ``TOGETHER`` of like length meet and none is longer than ``LONGEST``; it decides on speed only.
SHORT, TOGETHER, LONGEST = 32, 32, 1024


def _draw(key, candidate):
    """32 bits for a candidate of an occurrence; numbers or arrays."""
    mixed = (key ^ candidate) * _ODD[0] & _LONG
    return ((mixed ^ mixed >> 29) * _ODD[1] & _LONG) >> 32


def _keys(bases: list[int], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """A key for each part from its text and its place in it; ``spans`` are (text, first place, parts)."""
    mixed = np.concatenate([np.arange(lo, lo + n, dtype=np.uint64) * np.uint64(_ODD[0]) + np.uint64(bases[t]) for t, lo, n in [*spans, (0, 0, 0)]])
    mixed = (mixed ^ mixed >> np.uint64(30)) * np.uint64(_ODD[1])
    mixed = (mixed ^ mixed >> np.uint64(27)) * np.uint64(_ODD[2])
    return mixed ^ mixed >> np.uint64(31)


class _Pairs:
    """Values below ``_NEVER`` of pairs of small numbers, looked up for whole arrays: the rows of a sparse table, shifted until they fit into one."""

    def __init__(self, values: dict[int, int], numbers: int):
        """``values`` by left number by 2**20 plus right number, both below ``numbers``."""
        left = np.fromiter((k >> 20 for k in values), np.int64, len(values))
        right = np.fromiter((k & 0xFFFFF for k in values), np.int64, len(values))
        order = np.argsort(left, kind="stable")
        left, right, value = left[order], right[order], np.fromiter(values.values(), np.int64, len(values))[order]
        owners, first, count = np.unique(left, return_index=True, return_counts=True)
        room, at, places = 4 * len(values) + 64, 1, random.Random(0)
        free, begin = np.ones(room + numbers + 1, bool), np.zeros(len(owners), np.int64)
        for row in np.argsort(-count, kind="stable").tolist():
            mine, tries = right[first[row] : first[row] + count[row]], 0
            while not free[at + mine].all():
                tries += 1
                if tries % 100 == 0:
                    free, room = np.append(free, np.ones(room, bool)), 2 * room
                at = places.randrange(1, room)
            free[at + mine] = False
            begin[row] = at
        #: Cells hold their row and value; numbers without a row, -1 among them, point to a stretch of free cells at the end.
        self.cells = np.full(room + 2 * numbers + 4, _NEVER | -8 << 32, np.int64)
        self.cells[np.repeat(begin, count) + right] = left << 32 | value
        self.shift = np.full(numbers + 1, room + numbers + 2, np.int64)
        self.shift[owners] = begin

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, ``_NEVER`` where there is none; a number may be -1, which has none."""
        found = self.cells[self.shift[left] + right]
        return np.where(found >> 32 == left, found & 0xFFFFFFFF, _NEVER).astype(np.int32)


class Pieces:
    """A piece model with its agenda."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface: list[bytes] = []
        self.byte = [0] * 256
        normal: dict[str, int] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                normal[piece] = i
                self.surface.append(piece.replace(SPACE, " ").encode())
        assert not any(c in p for p in normal for c in "\n\t") and not any(SPACE in p.lstrip(SPACE) for p in normal)
        # Ids in order of merging; the rank of each pair of pieces that make one; ids of single characters, a space as the text has it.
        self.by_rank = sorted(normal.values(), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(self.by_rank)}
        self.pairs = {
            normal[p[:k]] << 20 | normal[p[k:]]: rank[i] for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal}
        self.single = {(" " if p == SPACE else p): i for p, i in normal.items() if len(p) == 1}
        #: Neighbouring characters of some piece; no merge reaches over others.
        self.inside = {t[k : k + 2] for t in (p.replace(SPACE, " ") for p in normal) for k in range(len(t) - 1)}
        # The same for arrays of code points: ids, numbers of the characters inside pieces, values of their pairs.
        self.merged = np.array(self.by_rank, np.int32)
        self.rank_of = _Pairs(self.pairs, len(self.surface))
        number = {c: i for i, c in enumerate(sorted({c for pair in self.inside for c in pair}))}
        self.symbol, self.number = np.full(0x110000, _NONE, np.int32), np.full(0x110000, _NONE, np.int32)
        for c, i in self.single.items():
            self.symbol[ord(c)] = i
        for c, i in number.items():
            self.number[ord(c)] = i
        self.joined = _Pairs({number[a] << 20 | number[b]: 1 for a, b in self.inside}, len(number))
        #: Ids of the bytes of characters met that are no piece.
        self.known: dict[str, list[int]] = {}

    def _bytes(self, char: str) -> list[int]:
        found = self.known.get(char)
        if found is None:
            found = self.known[char] = [self.byte[b] for b in char.encode("utf-8", "surrogatepass")]
        return found

    def segment(self, stretch: str, limit: int = 0, key: int = 0, skips: tuple[int, ...] = (), trace: list[int] | None = None) -> tuple[int, ...]:
        """Ids of one part without the candidates that ``skips`` names or whose hash with ``key`` falls below ``limit``; ``trace`` takes its merges."""
        return self._long(stretch, limit, key, skips, [] if trace is None else trace)

    def _long(self, stretch: str, limit: int, key: int, skips: tuple[int, ...], trace: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        for s, c in zip(self._agenda(stretch, limit, key, skips, trace), stretch):
            if s >= 0:
                out.append(s)
            elif s == _NONE:
                out += self._bytes(c)
        return tuple(out)

    def _agenda(self, stretch: str, limit: int, key: int, skips: tuple[int, ...], trace: list[int]) -> list[int]:
        """For each character the id of the piece that begins there, ``_NONE`` where no piece has it, ``_GONE`` within pieces."""
        pairs, n = self.pairs, len(stretch)
        symbols = [self.single.get(c, _NONE) for c in stretch]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A candidate is one number: its rank, then its place.
        agenda = []
        for i in range(n - 1):
            if symbols[i] >= 0 and symbols[i + 1] >= 0:
                found = pairs.get(symbols[i] << 20 | symbols[i + 1])
                if found is not None:
                    agenda.append(found << 32 | i)
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            candidate = pop(agenda)
            left, rank = candidate & 0xFFFFFFFF, candidate >> 32
            right = after[left]
            if right >= n or symbols[left] < 0 or pairs.get(symbols[left] << 20 | symbols[right]) != rank:
                continue
            if candidate in skips or limit and _draw(key, candidate) < limit:
                continue
            trace.append(candidate)
            merged = symbols[left] = self.by_rank[rank]
            symbols[right] = _GONE
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                if symbols[right] >= 0:
                    found = pairs.get(merged << 20 | symbols[right])
                    if found is not None:
                        push(agenda, found << 32 | left)
            earlier = before[left]
            if earlier >= 0 and symbols[earlier] >= 0:
                found = pairs.get(symbols[earlier] << 20 | merged)
                if found is not None:
                    push(agenda, found << 32 | earlier)
        return symbols

    def _rounds(self, symbols: np.ndarray, keys: np.ndarray | None, limit: int) -> None:
        """The agenda of many parts at once, in place; a row holds a part's symbols between columns of ``_NONE``, by whose keys candidates are drawn."""
        n, width = symbols.shape
        ranks = np.full((n, width), _NEVER, np.int32)
        ranks[:, :-1] = self.rank_of(symbols[:, :-1], symbols[:, 1:])
        flat, rank_at = symbols.reshape(-1), ranks.reshape(-1)
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        rows = np.arange(n)
        while True:
            # The first of the least ranks is the leftmost.
            place = ranks[rows].argmin(axis=1)
            at = rows * width + place
            best = rank_at[at]
            open_ = best < _NEVER
            if not open_.all():
                rows, place, at, best = rows[open_], place[open_], at[open_], best[open_]
            if not len(rows):
                return
            if limit:
                skipped = _draw(keys[rows], best.astype(np.uint64) << np.uint64(32) | (place - 1).astype(np.uint64)) < np.uint64(limit)
                rank_at[at[skipped]] = _NEVER
                at, best = at[~skipped], best[~skipped]
            merged, right, earlier = self.merged[best], after[at], before[at]
            beyond = after[right]
            flat[at], flat[right] = merged, _GONE
            after[at], before[beyond] = beyond, at
            rank_at[right] = _NEVER
            rank_at[at] = self.rank_of(merged, flat[beyond])
            rank_at[earlier] = self.rank_of(flat[earlier], merged)

    def _split(self, stretch: str) -> list[str]:
        """Parts of a stretch that no piece joins."""
        cuts = [k for k in range(1, len(stretch)) if stretch[k - 1 : k + 1] not in self.inside]
        return [stretch[i:j] for i, j in zip([0, *cuts], [*cuts, len(stretch)])]

    def _begins(self, points: np.ndarray) -> np.ndarray:
        """Whether a part begins at each code point: as ``_STRETCH`` and ``_split`` cut."""
        begins = np.ones(len(points), bool)
        space, alone = points == 0x20, (points == 0x0A) | (points == 0x09)
        number = self.number[points]
        begins[1:] = (self.joined(number[:-1], number[1:]) == _NEVER) | alone[1:] | alone[:-1] | space[1:] & ~space[:-1]
        return begins

    def _merge(self, block: str, points: np.ndarray, first: np.ndarray, length: np.ndarray, keys: np.ndarray | None, limit: int) -> np.ndarray:
        """As ``_agenda`` for the parts of a block that begin at ``first``."""
        symbols = self.symbol[points]
        least, width = 1, 2
        while least < length.max():
            some = np.flatnonzero((length > least) & (length <= width))
            if width <= SHORT or width <= LONGEST and len(some) >= TOGETHER:
                at, inside = first[some][:, None] + np.arange(width), np.arange(width) < length[some][:, None]
                rows = np.full((len(some), width + 2), _NONE, np.int32)
                rows[:, 1:-1][inside] = symbols[at[inside]]
                self._rounds(rows, None if keys is None else keys[some], limit)
                symbols[at[inside]] = rows[:, 1:-1][inside]
            else:
                for part in some.tolist():
                    lo, n = int(first[part]), int(length[part])
                    symbols[lo : lo + n] = self._agenda(block[lo : lo + n], limit, int(keys[part]) if limit else 0, (), [])
            least, width = width, 2 * width
        return symbols

    def _ids(self, symbols: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids from what ``_merge`` gives, with bytes for what is no piece, and the number of ids before each code point."""
        count = (symbols != _GONE).astype(np.int64)
        missing = np.flatnonzero(symbols == _NONE)
        chars, which = np.unique(points[missing], return_inverse=True)
        made = [self._bytes(chr(c)) for c in chars.tolist()]
        count[missing] = np.array([len(m) for m in made], np.int64)[which]
        ids = np.repeat(symbols, count)
        if made:
            table = np.array([m + [_NONE] * (4 - len(m)) for m in made], np.int32)[which].reshape(-1)
            ids[ids == _NONE] = table[table != _NONE]
        return ids, np.concatenate([[0], np.cumsum(count)])

    def encode_all(self, texts: list[str | None], dropout: float = 0.0, seed: int = 0, keys: list[int] | None = None) -> list[np.ndarray]:
        """Ids of each text; ``keys`` tell apart texts that should vary."""
        limit = int(dropout * 2**32)
        bases = [xxhash.xxh64_intdigest(f"{seed}/{k}") for k in keys or [0] * len(texts)]
        whole = "".join([" " + t if t else "" for t in texts])
        starts = np.cumsum([0, *[len(t) + 1 if t else 0 for t in texts]])
        out: list[list[np.ndarray]] = [[] for _ in texts]
        size = even = -(-len(whole) // max(1, len(whole) // BLOCK))
        lo, last, place = 0, -1, 0
        while lo < len(whole):
            points = np.frombuffer(whole[lo : lo + size].encode("utf-32-le", "surrogatepass"), np.uint32)
            here = np.flatnonzero((starts[:-1] >= lo) & (starts[:-1] < lo + len(points)) & (starts[1:] > starts[:-1]))
            begins = self._begins(points)
            begins[starts[here] - lo] = True
            first = np.flatnonzero(begins)
            end = len(points)
            if lo + end < len(whole):
                # The last part may go on behind the block.
                first, end = first[:-1], int(first[-1])
                if not end:
                    size *= 2
                    continue
            here = here[starts[here] < lo + end]
            if not len(here) or starts[here[0]] > lo:
                here = np.concatenate([[last], here])
            bounds = np.append(np.maximum(starts[here] - lo, 0), end)
            points, block = points[:end], whole[lo : lo + end]
            parts = np.diff(np.searchsorted(first, bounds))
            spans = [(t, place if t == last else 0, n) for t, n in zip(here.tolist(), parts.tolist())]
            hashed = _keys(bases, spans) if limit else None
            ids, before = self._ids(self._merge(block, points, first, np.diff(np.append(first, end)), hashed, limit), points)
            cuts = before[bounds].tolist()
            for (t, _, _), i, j in zip(spans, cuts, cuts[1:]):
                out[t].append(ids[i:j])
            last, place = spans[-1][0], spans[-1][1] + spans[-1][2]
            lo, size = lo + end, even
        return [o[0] if len(o) == 1 else np.concatenate([np.zeros(0, np.int32), *o]) for o in out]

    def encode(self, text: str, dropout: float = 0.0, seed: int = 0, key: int = 0) -> list[int]:
        """Ids of a text; ``key`` tells apart texts that should vary."""
        return self.encode_all([text], dropout, seed, [key])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text: surfaces joined, without the space put before it."""
        whole = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return whole[1:] if whole.startswith(" ") else whole


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One model for each file and worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _groups(keys: pa.Array, texts: pa.Array) -> Iterator[tuple[list[int], list[str | None]]]:
    """Keys and texts in groups that have some ``BLOCK`` characters."""
    some_keys, some, chars = [], [], 0
    for k, t in zip(keys.to_pylist(), texts):
        some_keys.append(k)
        some.append(t.as_py())
        chars += len(some[-1] or "")
        if chars >= BLOCK:
            yield some_keys, some
            some_keys, some, chars = [], [], 0
    if some:
        yield some_keys, some


def encode(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, text: str = "text", doc_id: str = "doc_id",
           model: str | None = None, digest: bool = False) -> DataFrame:
    """``docs`` without its text, with ids; or, as ``digest``, with n_pieces, pieces_crc32 and lossless."""
    path = model or public_tokenizers.path(MODEL)
    made = ("n_pieces", "pieces_crc32", "lossless") if digest else ("ids",)
    names = numbered([c for c in docs.columns if c.lower() not in made and c != text])
    rest = list(names.values())
    key = F.xxhash64(F.col(f"`{doc_id}`"), F.when(F.col(f"`{doc_id}`").isNull(), F.col(f"`{text}`")))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], key.alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for k, t in _groups(part.column("key"), part.column("text")):
                    for value, ids in zip(t, model.encode_all(t, dropout, seed, k)):
                        if digest:
                            crc = zlib.crc32(ids.astype("<u4").tobytes())
                            out.append((len(ids), crc, value is None or model.decode(ids.tolist()) == value))
                        else:
                            out.append((None if value is None else ids,))
                kinds = (pa.int64(), pa.int64(), pa.bool_()) if digest else (pa.list_(pa.int32()),)
                yield append(part.select(rest), **{n: pa.array(c, kind) for n, c, kind in zip(made, zip(*out), kinds)})

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*rest).schema.fields)
    encoded = rows.mapInArrow(run, fields + ("n_pieces bigint, pieces_crc32 bigint, lossless boolean" if digest else "ids array<int>"))
    return encoded.select(*[F.col(n).alias(c) for c, n in names.items()], *made)


def decode(encoded: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """``encoded`` with a column text in place of its ids."""
    path = model or public_tokenizers.path(MODEL)
    names = numbered([c for c in encoded.columns if c != ids and c.lower() != "text"])
    rest = list(names.values())
    rows = encoded.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{ids}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [None if i.as_py() is None else model.decode(i.as_py()) for i in batch.column("ids")]
            yield append(batch.select(rest), text=pa.array(texts, pa.string()))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*rest).schema.fields)
    return rows.mapInArrow(run, fields + "text string").select(*[F.col(n).alias(c) for c, n in names.items()], "text")
