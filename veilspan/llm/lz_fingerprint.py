"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases: from each point the shortest run of symbols that is not yet in the dictionary of this text,
which it then joins. Symbols are words between ASCII white space, longer ones cut every 16 code points. The set of phrases is hashed
and kept as the minimum of each of 64 hash functions; the share of equal minima estimates the Jaccard similarity of two phrase sets,
which, like the gain of compressing two texts together, is high where they repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix, partitions, space_words, table, text_array, word_hashes

MINIMA = 64
SYMBOL_LETTERS = 16
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS_PER_PARTITION = 3

_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, 1001 + MINIMA, dtype=np.uint64))


def phrase_hashes(symbols: list[int]) -> list[int]:
    """Hashes of the distinct phrases that the parse of the symbols adds to its dictionary. A last run that is a phrase already adds none."""
    seen: set[int] = set()
    phrase = 0
    for s in symbols:
        phrase = (phrase * _STEP + s) & _MASK
        if phrase not in seen:
            seen.add(phrase)
            phrase = 0
    return list(seen)


def signatures(texts: list[str]) -> np.ndarray:
    """One row of MINIMA 32-bit minima per text; a text without words has the largest number throughout."""
    array = pa.array(texts, pa.large_string())
    offsets, words = space_words(array)
    if len(words) and pc.max(pc.utf8_length(words.dictionary)).as_py() > SYMBOL_LETTERS:
        offsets, words = space_words(pc.replace_substring_regex(array, rf"([^ \t-\r]{{{SYMBOL_LETTERS}}})", r"\1 "))
    codes = word_hashes(words).tolist()
    phrases = [phrase_hashes(codes[offsets[i] : offsets[i + 1]]) for i in range(len(texts))]
    counts = np.fromiter(map(len, phrases), dtype=np.int64, count=len(phrases))
    out = np.full((len(texts), MINIMA), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        flat = mix(np.fromiter((h for p in phrases for h in p), dtype=np.uint64, count=int(counts.sum())))
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        for k in range(MINIMA):
            out[full, k] = np.minimum.reduceat(((flat * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima, row by row."""
    return (a == b).mean(axis=1)


def fingerprint_strings(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u4")]


def fingerprint_documents(documents: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """documents with the fingerprint of a text column: hex of its minima. A null text counts as empty; a column named like output is replaced; equal texts have equal fingerprints."""
    fields = [f for f in documents.schema.fields if f.name != output]
    names = [f.name for f in fields]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*(part.column(f) for f in names), pa.array(fingerprint_strings(signatures(text_array(part.column(text)).to_pylist())))], names=[*names, output])

    return documents.select(*names).mapInArrow(run, type(documents.schema)(fields).add(output, "string"))


def with_successors(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) in buckets of consecutive ids, each with a copy (place 1) of the document that follows the bucket.

    The bounds of the buckets are quantiles of the ids; only they and the smallest id of each bucket reach the driver. Partitions
    hold whole buckets, sorted by bucket, place and id.
    """
    spark = documents.sparkSession
    n = partitions(spark)
    buckets = BUCKETS_PER_PARTITION * n
    bounds = np.unique(np.array(documents.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.1 / buckets) or [], dtype=np.float64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(dtype=np.float64), side="right").astype(np.int32))

    placed = documents.select("doc_id", "text").where("doc_id IS NOT NULL").withColumn("bucket", bucket_of("doc_id"))
    firsts = [(r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min("doc_id").alias("first")).orderBy("bucket").collect()]
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts) if first is not None]
    follows = F.broadcast(spark.createDataFrame(before, "doc_id bigint, previous int"))  # a row per bucket
    own, copy = F.struct("bucket", F.lit(0).alias("place")), F.struct(F.col("previous").alias("bucket"), F.lit(1).alias("place"))
    both = placed.join(follows, "doc_id", "left").withColumn("at", F.explode(F.when(F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    return both.select("doc_id", "text", "at.bucket", "at.place").repartition(n, "bucket").sortWithinPartitions("bucket", "place", "doc_id", "text")


def edited_text(text: str, following: str) -> str:
    """text with its last quarter (rounded down) replaced by the beginning of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """For each document: its fingerprint, that of its edited text, and its likeness to the edited text and to the next document by id.

    Null texts are empty; documents of equal id follow each other by text; rows with a null id are left out; the last document is followed by
    the first, a single one by itself; an empty table gives no rows; other columns are ignored.
    """

    def rows_of(batches) -> Iterator[tuple[int, int, int, str]]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield from zip(part.column("bucket").to_pylist(), part.column("place").to_pylist(), part.column("doc_id").to_pylist(), (t or "" for t in part.column("text").to_pylist()), strict=True)

    def flush(run: list[tuple[int, str]]) -> pa.RecordBatch:
        """All of the run but the last document, which only follows the one before it."""
        ids, texts = [d for d, _ in run[:-1]], [t for _, t in run]
        edited = [edited_text(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own = signatures(texts)
        changed = signatures(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(map(len, texts[:-1]), pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(fingerprint_strings(own[:-1]), pa.string()),
                pa.array(fingerprint_strings(changed), pa.string()),
                pa.array(likeness(own[:-1], changed)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            names=names,
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        pending: list[tuple[int, str]] = []
        size, bucket, closed = 0, None, False
        for b, place, doc, text in rows_of(batches):
            if b != bucket:
                pending, size, bucket, closed = [], 0, b, False
            if closed:
                continue  # a repeated row of the document that follows
            pending.append((doc, text))
            size += len(text)
            closed = place == 1
            if len(pending) > 1 and (closed or size > SLICE_BYTES // 2):
                yield flush(pending)
                pending, size = pending[-1:], len(text)

    return with_successors(documents).mapInArrow(run, RESULT)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
