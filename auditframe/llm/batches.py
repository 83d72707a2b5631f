"""Texts of Arrow batches as byte arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at once, and the longest stretch of one text that is looked at as a whole.
PIECE = 1 << 20

#: Fixed value: spaces as in columns.SPACES.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; nulls are empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(at: np.ndarray, piece: int = PIECE) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, begin, end) that cover every byte, ``piece`` bytes and 256 stretches a group at most.

    A text longer than ``piece`` is cut into several stretches.
    """
    group: list[tuple[int, int, int]] = []
    size = 0
    for row in range(len(at) - 1):
        begin, end = int(at[row]), int(at[row + 1])
        while True:
            stop = min(end, begin + piece)
            if group and (size + stop - begin > piece or len(group) == 256):
                yield group
                group, size = [], 0
            group.append((row, begin, stop))
            size += stop - begin
            begin = stop
            if begin >= end:
                break
    if group:
        yield group


def append(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))
