"""Helpers shared by the operators of this subpackage: scratch tables, Arrow batches, word codes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None

#: Texts of an Arrow batch are handled in slices of about this many bytes.
SLICE_BYTES = 2 << 20


#: Removes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir; where that is unset, under a local one that is set for it, on a local master alone."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="veilspan-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/veilspan-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends here, a lost executor costs nothing, and the shuffle files behind it go."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """The files of stored() tables go, once nothing that is still to be read depends on them."""
    for df in tables:
        spark = df.sparkSession
        if files := df.inputFiles():
            spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(files[0].rpartition("/")[0])


#: Bytes of an Arrow batch, where the session has Spark's default.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> None:
    """From now on the session sends texts to Python in batches of at most BATCH_BYTES, unless it has a limit of its own: texts may be long, and workers share the executor's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(key) == f"{64 << 20}b":
        df.sparkSession.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower case for A-Z alone; other letters stay."""
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each slice have at most about limit bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        released()


def released() -> None:
    """Memory that this process no longer uses goes back to the system: workers live from task to task beside the executor's heap, the driver's Python beside the driver's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def text_array(column) -> pa.Array:
    """Texts as one array of large strings without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lowered(texts: pa.Array) -> pa.Array:
    """Lower case for A-Z alone, of large strings without nulls. (Arrow's own kernel misreads arrays that start within a buffer.)"""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lowered = _LOWER[np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]]]
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(lowered))


def space_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words between ASCII white space: offsets of each text's words (n + 1), and all words, dictionary-encoded."""
    parts = pc.ascii_split_whitespace(texts)
    counts = np.asarray(pc.list_value_length(parts), dtype=np.int64)
    words = pc.list_flatten(parts)
    full = np.asarray(pc.not_equal(words, "")) if len(words) else np.zeros(0, dtype=bool)
    if not full.all():
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(owner, minlength=len(counts))
        words = words.filter(pa.array(full))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return offsets, pc.dictionary_encode(words)


def word_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """64-bit hash of each word: the mixed sum of mixed pairs of a byte and its place, which no other word of the same length shares but by chance."""
    unique = words.dictionary
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    _, offsets, data = unique.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[unique.offset : unique.offset + len(unique) + 1]
    at = ends[:-1] - ends[0]
    length = np.diff(ends)
    letters = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(at, length)
    sums = np.add.reduceat(mix(letters + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), at)
    return mix(sums + length.astype(np.uint64))[np.asarray(words.indices)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width codes; len(codes) - width + 1 of them, without regard to text ends."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += codes[k : k + n]
    return mix(out)


def document_shingles(offsets: np.ndarray, codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, as (offsets, hashes); a text of fewer words has its whole sequence as one, none has none."""
    counts = np.diff(offsets)
    per_text = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.cumsum(per_text)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    every = shingle_hashes(codes, width)
    if len(every):
        start = np.repeat(offsets[:-1] - (ends - per_text), per_text)
        at = start + np.arange(len(out))
        whole = np.repeat(counts >= width, per_text)
        out[whole] = every[at[whole]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        short = codes[offsets[i] : offsets[i + 1]]
        out[ends[i] - 1] = mix(shingle_hashes(short, len(short)) + np.uint64(len(short)))[0]
    owner = np.repeat(np.arange(len(counts)), per_text)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64), out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
