"""SimHash near-duplicates through anchor points of a covering code.

A fingerprint's 64 bits are cut into three segments. Two fingerprints that differ
in 4 bits at most differ in one bit at most in one of the segments. Each segment
has anchors: the codewords of a perfect 15-bit code with covering radius 1,
beside 6 or 7 free bits. Every fingerprint has a home anchor (the one within the
covering radius) and is replicated to all anchors within the radius plus one,
about 14 of 131,072 or more; so a pair that is close in a segment always meets at
the home anchor of one of the two. There the whole fingerprints are compared.

Only distinct fingerprints are compared: equal ones, a third of all rows perhaps,
are one row. The comparison is an equi-join on the anchor, which adaptive
execution splits where an anchor is crowded. Links form components by joins; no
link, fingerprint or component passes through the driver.

Nulls, empties, repeats: null and empty texts have fingerprint zero and link like
any other. Repeated rows share a component. Null ids are ignored when the smallest
id is chosen; a component of null ids alone has a null id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditframe.llm.columns import numbered
from auditframe.llm.components import components
from auditframe.llm.fingerprints import fingerprints
from auditframe.session import materialize

#: Fixed value: the limit for which three segments with one bit each are enough is 5.
MAX_BITS = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_CODE = 15


def _codewords() -> np.ndarray:
    """The codeword within one bit of each 15-bit word: the bit that the parity of set places names is flipped."""
    word = np.arange(1 << _CODE, dtype=np.uint64)
    syndrome = np.zeros_like(word)
    for place in range(1, _CODE + 1):
        syndrome ^= (word >> np.uint64(place - 1) & np.uint64(1)) * np.uint64(place)
    return np.where(syndrome > 0, word ^ (np.uint64(1) << (np.maximum(syndrome, 1) - np.uint64(1))), word)


_NEAREST = _codewords()


def home(segment: np.ndarray) -> np.ndarray:
    """The anchor that covers a segment."""
    low = segment & np.uint64((1 << _CODE) - 1)
    return segment ^ low ^ _NEAREST[low]


def anchors(fp: np.ndarray, replicate: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys: home anchors, or all anchors within the covering radius plus one bit."""
    rows, keys = [], []
    for k, (first, width) in enumerate(SEGMENTS):
        segment = fp >> np.uint64(first) & np.uint64((1 << width) - 1)
        near = [segment] + ([segment ^ np.uint64(1 << i) for i in range(width)] if replicate else [])
        found = np.sort(np.stack([home(s) for s in near], axis=1), axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        rows.append(np.nonzero(fresh)[0])
        keys.append(found[fresh] | np.uint64(k << 32))
    return np.concatenate(rows), np.concatenate(keys)


def _placed(fps: DataFrame, replicate: bool, name: str) -> DataFrame:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            for lo in range(0, len(fp), 2048):
                rows, keys = anchors(fp[lo : lo + 2048], replicate)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fp[lo + rows].view(np.int64))], ["anchor", name])

    return fps.select("fp").mapInArrow(place, f"anchor bigint, {name} bigint")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints that differ in ``max_bits`` (5 at most) bits or fewer."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    # Spark sizes both sides as it does the fingerprints, but one has 3 rows for each and the other about 42: neither is broadcast.
    at_home, around = _placed(fps, False, "a").hint("merge"), _placed(fps, True, "b").hint("merge")
    return at_home.join(around, "anchor").where((F.col("a") < F.col("b")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id (smallest reachable id) for every row of ``docs``."""
    plain = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = materialize(fingerprints(plain), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(links(distinct)).select(F.col("node").alias("fp"), "component")
    of = distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(of.join(ids, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id; null ids come last, ties go by hashes of text and row."""
    # Maps cannot be hashed; rows that differ in them alone count as equal.
    names = numbered(docs.columns)
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    cells = [F.col(f.name) for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    name, words = F.col(names[doc_id]), F.col(names[text])
    marks = F.xxhash64(words).alias("text_hash"), F.xxhash64(*cells, *[c.isNull() for c in cells]).alias("row_hash")
    marked = fingerprints(rows.select(name.isNull().alias("nameless"), name.alias("doc_id"), *marks, words.alias("text")))
    # A row per fingerprint first, so that a crowded fingerprint or component is a row per task.
    least = F.min(F.struct("nameless", "doc_id", "text_hash", "row_hash")).alias("least")
    distinct = materialize(marked.groupBy("fp").agg(least), "distinct-fingerprints")
    joined = components(links(distinct)).select(F.col("node").alias("fp"), "component")
    of = distinct.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    kept = of.groupBy("component").agg(F.min("least").alias("least")).select("least.text_hash", "least.row_hash")
    rows = rows.select("*", *marks).join(kept, ["text_hash", "row_hash"], "left_semi")
    # What is left double are equal rows; the key is a struct so that the join can be split where they are many.
    one = rows.withColumn("row", F.struct("text_hash", "row_hash")).dropDuplicates(["row"])
    return one.select(*[F.col(n).alias(c) for c, n in names.items()])
