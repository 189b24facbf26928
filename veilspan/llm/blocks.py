"""Numbers that travel between tasks in packed blocks, a few rows for many documents.

Documents are dealt to slots by a hash of their id. What tasks have found about documents goes to their slots as blocks of (doc_id,
values); a slot's blocks stand before its texts, so each text meets what was found about it in one pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots for each shuffle partition.
SLOTS_PER_PARTITION = 2

ROWS = "slot int, kind int, doc_id bigint, text string, extra string, block binary"
NAMES = ["slot", "kind", "doc_id", "text", "extra", "block"]
#: Kinds from this on are texts; below, blocks.
TEXT = 10


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], dtype="<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    lengths = np.frombuffer(blob, dtype="<i8", count=len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(lengths.tolist(), types, strict=True):
        out.append(np.frombuffer(blob, dtype=t, count=n, offset=at))
        at += n * np.dtype(t).itemsize
    return out


def dealt(part: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, indices) for the parts from 0 to n - 1 that occur."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(n + 1))
    for p in range(n):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def slot_column(n: int, doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("bigint")), F.lit(n)).cast("int")


def slots_of(ids: np.ndarray, n: int) -> np.ndarray:
    """slot_column() of ids."""
    unique, place = np.unique(ids, return_inverse=True)
    hashed = np.fromiter((xxhash.xxh64_intdigest(struct.pack("<q", i), 42) for i in unique.tolist()), dtype=np.uint64, count=len(unique))
    return (hashed.view(np.int64) % n)[place]


def by_slot(ids: np.ndarray, values: np.ndarray, kind: int, n: int) -> Iterator[pa.RecordBatch]:
    """ROWS of the values (one row each, of one or more numbers) of documents."""
    if not len(ids):
        return
    rows = [(p, pack(ids[own].astype("<i8"), values[own].astype("<i8").ravel())) for p, own in dealt(slots_of(ids, n), n)]
    m = len(rows)
    yield pa.RecordBatch.from_arrays(
        [pa.array([p for p, _ in rows], pa.int32()), pa.array([kind] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.array([b for _, b in rows], pa.binary())], names=NAMES
    )


def text_rows(documents: DataFrame, n: int, extra: Column | None = None) -> DataFrame:
    """ROWS of texts."""
    none = F.lit(None)
    return documents.select(slot_column(n).alias("slot"), F.lit(TEXT).alias("kind"), "doc_id", "text", (none if extra is None else extra).cast("string").alias("extra"), none.cast("binary").alias("block"))


def to_slots(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "slot").sortWithinPartitions("slot", "kind", "doc_id")


class Found:
    """What blocks of one kind say, by document."""

    def __init__(self, width: int):
        self.width, self.parts = width, []
        self.ids: np.ndarray | None = None

    def add(self, blob: bytes) -> None:
        ids, values = unpack(blob, "<i8", "<i8")
        self.parts.append((ids, values.reshape(-1, self.width)))

    def of(self, doc: int) -> np.ndarray:
        if self.ids is None:
            ids = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            self.values = np.concatenate([p[1] for p in self.parts])[order] if self.parts else np.zeros((0, self.width), dtype=np.int64)
            self.ids, self.parts = ids[order], []
        start, end = np.searchsorted(self.ids, [doc, doc + 1])
        return self.values[start:end]


def documents_of(batches: Iterable[pa.RecordBatch], widths: dict[int, int]) -> Iterator[tuple[int, str, str | None, dict[int, np.ndarray]]]:
    """From rows of to_slots(): each text with its document's values of each kind (widths: numbers in a value)."""
    slot, found = None, {}
    for b in batches:
        for s, kind, doc, text, extra, block in zip(*(b.column(c).to_pylist() for c in NAMES), strict=True):
            if s != slot:
                slot, found = s, {k: Found(w) for k, w in widths.items()}
            if kind < TEXT:
                found[kind].add(block)
            else:
                yield doc, text or "", extra, {k: f.of(doc) for k, f in found.items()}
