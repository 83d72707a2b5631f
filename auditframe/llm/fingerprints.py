"""SimHash fingerprints of 4-word shingles, 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.batches import append
from auditframe.llm.columns import numbered

#: Fixed values.
SHINGLE = 4
SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII spaces part
    n = len(words)
    if not n:
        return 0
    sizes = np.fromiter(map(len, words), np.int64, n)
    joined = b" ".join(words)
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = begin + sizes
    if n > SHINGLE:
        begin, end = begin[: n - SHINGLE + 1], end[SHINGLE - 1 :]
    else:
        begin, end = begin[:1], end[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(begin), _BLOCK):
        part = [digest(joined[i:j], SEED) for i, j in zip(begin[lo : lo + _BLOCK].tolist(), end[lo : lo + _BLOCK].tolist())]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((counts * 2 > len(begin)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long ``fp``."""
    names = numbered([c for c in docs.columns if c != text and c.lower() != "fp"])
    rest = list(names.values())
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{text}`").alias("text"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield append(batch.select(rest), fp=pa.array(values.view(np.int64)))

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*rest).schema.fields)
    return rows.mapInArrow(add, f"{fields}fp bigint").select(*[F.col(n).alias(c) for c, n in names.items()], "fp")


def as_hex(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
