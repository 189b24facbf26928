"""Repeated substrings of at least a number of words, by prefix-partitioned suffix trees.

A suffix that matters begins a window of `window` words that occurs twice. Each window is found through its anchor: of its runs of PREFIX
words the one with the smallest hash, at the same place in equal windows. Anchors that only one text has are dropped; the suffixes
around the others are dealt out by prefix. A prefix has the PREFIX words of the anchor, or the whole window where more than CROWDED
suffixes share the anchor; groups of prefixes, as many as the corpus needs, are held one at a time, and split by longer prefixes until a
subtree fits. A subtree is its suffixes in lexicographic order with the common prefix lengths of neighbours, up to `window`: a deeper
node removes nothing more. Its internal nodes of that depth are the repeats, and the first leaf of a node is the occurrence that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ROWS, SLOTS_PER_PARTITION, by_slot, dealt, documents_of, pack, slots_of, text_rows, to_slots, unpack
from .common import emptied, mix, partitions, shingle_hashes, slices, small_batches, space_words, stored, table, text_array, word_hashes
from .rare_prefix import grouped

WINDOW = 20
PREFIX = 8
#: An anchor of more suffixes than this takes the whole window as prefix.
CROWDED = 5000
#: Suffixes whose words are laid out at a time.
SUFFIXES_AT_ONCE = 50_000
#: Bytes of text that are taken together, and of the corpus for each group of anchors or prefixes.
TAKEN, GROUP_BYTES = 8 << 20, 64 << 20


def anchored_windows(offsets: np.ndarray, codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of several texts: for each anchor its hash, its place, the first window that it anchors, and how many (they follow each other)."""
    none = np.zeros(0, dtype=np.int64)
    if len(codes) < window:
        return none.view(np.uint64), none, none, none
    hashes = shingle_hashes(codes, PREFIX)
    n = len(codes) - window + 1
    best, at = hashes[:n].copy(), np.zeros(n, dtype=np.int8)
    for k in range(1, window - PREFIX + 1):
        other = hashes[k : k + n]
        lower = other < best
        at[lower] = k
        np.minimum(best, other, out=best)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(owner[:n] == owner[window - 1 :])
    if not len(starts):
        return none.view(np.uint64), none, none, none
    anchor = starts + at[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[starts[1:]] != owner[starts[:-1]])]))
    return best[starts[first]], anchor[first], starts[first], np.diff(np.append(first, len(starts)))


def _word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, words = space_words(texts)
    return offsets, word_hashes(words)


def _anchor_blocks(documents: DataFrame, window: int, n: int, groups: int) -> DataFrame:
    """(part, block): each task's anchors, dealt by hash; a block lists documents (id, digest) and anchors (hash, document, 2 * place + (1 if the document's first))."""

    def run(batches):
        for b in slices(batches, limit=TAKEN):
            texts = text_array(b.column("text"))
            ids = np.asarray(b.column("doc_id"), dtype=np.int64)
            digests = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in texts.to_pylist()), dtype=np.uint64, count=len(texts))
            offsets, codes = _word_codes(texts)
            hashes, places, _, _ = anchored_windows(offsets, codes, window)
            documents_of = np.searchsorted(offsets, places, side="right") - 1
            leads = np.concatenate([[True], documents_of[1:] != documents_of[:-1]])[: len(places)]
            parts, blobs = [], []
            for p, own in dealt((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(groups), groups):
                used, index = np.unique(documents_of[own], return_inverse=True)
                parts.append(p)
                blobs.append(pack(ids[used], digests[used], (hashes[own] >> np.uint64(32)).astype("<u4"), index.astype("<u4"), (2 * (places[own] - offsets[documents_of[own]]) + leads[own]).astype("<u4")))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block"])

    return documents.mapInArrow(run, "part int, block binary").repartition(n, "part").sortWithinPartitions("part")


def _shared_anchors(blocks: DataFrame, slots: int) -> DataFrame:
    """ROWS of kind 0: for each first document of a text the anchors that another text, or another place of it, has too, as 2 * place + (1 if crowded); of kind 1: documents that copy an earlier one's text."""

    def run(batches):
        for group in grouped(batches, "part"):
            hashes, ids, digests, places = [], [], [], []
            for blob in group.column("block").to_pylist():
                i, d, h, index, place = unpack(blob, "<i8", "<u8", "<u4", "<u4", "<u4")
                hashes.append(h), ids.append(i[index]), digests.append(d[index]), places.append(place)
            yield from shared(*(np.concatenate(x) for x in (hashes, ids, digests, places)))

    def shared(h, ids, digests, places):
        # within an anchor by text, place and document: equal texts have equal places, and the first of them stands for all
        order = np.lexsort((ids, places, digests, h))
        h, ids, digests, places = h[order], ids[order], digests[order], places[order]
        first = np.ones(len(h), dtype=bool)
        first[1:] = (h[1:] != h[:-1]) | (digests[1:] != digests[:-1]) | (places[1:] != places[:-1])
        base = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        copies = np.unique(ids[(places % 2 == 1) & (ids != ids[base])])
        yield from by_slot(copies, np.ones(len(copies), dtype=np.int64), 1, slots)
        h, ids, places = h[first], ids[first], places[first]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        sizes = np.repeat(size, size)
        several = sizes > 1
        yield from by_slot(ids[several], 2 * (places[several].astype(np.int64) // 2) + (sizes[several] > CROWDED), 0, slots)

    return blocks.mapInArrow(run, ROWS)


def _kept(text: str, starts: np.ndarray, window: int, everything: bool, digests: bool) -> tuple[int, int, str]:
    """Words, removed words and kept words (or their digest) of a text whose windows at starts go."""
    said = lambda kept: hashlib.sha256(b" ".join(kept)).hexdigest() if digests else b" ".join(kept).decode()
    words = text.encode().split()
    if everything and len(words) >= window:
        return len(words), len(words), said([])
    if not len(starts):
        return len(words), 0, said(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, len(words)), -1)
    keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return len(words), len(words) - len(keep), said([words[i] for i in keep.tolist()])


TABLE = "kind string, doc_id bigint, n_words bigint, n_removed bigint, kept string, text string, part int, block binary"
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]
_NAMES = ["kind", "doc_id", "n_words", "n_removed", "kept", "text", "part", "block"]


def _table_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _suffix_blocks(ids: np.ndarray, texts: list[str], marks: list[np.ndarray], window: int, groups: int, slots: int) -> Iterator[tuple]:
    """TABLE rows of the marked anchors of some documents: their suffixes, dealt by prefix, and what equal crowded windows among them decide at once."""
    offsets, codes = _word_codes(pa.array(texts, pa.large_string()))
    hashes, places, starts, counts = anchored_windows(offsets, codes, window)
    owner = np.searchsorted(offsets, places, side="right") - 1
    keys = owner * (1 << 40) + (places - offsets[owner])
    marked = np.concatenate([i * (1 << 40) + m // 2 for i, m in enumerate(marks)])
    crowded = np.concatenate([m % 2 for m in marks])
    order = np.argsort(marked)
    at = np.minimum(np.searchsorted(marked[order], keys), len(marked) - 1)
    hit = marked[order][at] == keys
    deep = hit & (crowded[order][at] == 1)
    plain = np.flatnonzero(hit & ~deep)
    hashes, starts, counts, deep_at = hashes[plain], starts[plain], counts[plain], np.flatnonzero(deep)
    words = codes.astype("<u4")  # the low half of each word's hash
    if len(deep_at):
        _, _, all_starts, all_counts = anchored_windows(offsets, codes, window)
        own = np.concatenate([np.arange(s, s + c) for s, c in zip(all_starts[deep_at].tolist(), all_counts[deep_at].tolist(), strict=True)])
        full = shingle_hashes(codes, window)[own]
        doc = np.searchsorted(offsets, own, side="right") - 1
        order = np.lexsort((own, ids[doc], full))
        own, full, doc = own[order], full[order], doc[order]
        first = np.ones(len(own), dtype=bool)
        first[1:] = full[1:] != full[:-1]
        base = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
        later = ~first & ((ids[doc] != ids[doc[base]]) | (own - offsets[doc] != own[base] - offsets[doc[base]]))
        for slot, mine in dealt(slots_of(ids[doc[later]], slots), slots):
            yield ("removed", None, None, None, None, None, slot, pack(ids[doc[later]][mine], (own[later] - offsets[doc[later]])[mine].astype("<i8")))
        hashes, starts, counts = np.concatenate([hashes, full[first]]), np.concatenate([starts, own[first]]), np.concatenate([counts, np.ones(first.sum(), dtype=np.int64)])
    for p, own in dealt((mix(hashes) >> np.uint64(17)) % np.uint64(groups), groups):
        length = counts[own] + window - 1
        ends = np.cumsum(length)
        flat = words[np.repeat(starts[own] - (ends - length), length) + np.arange(int(ends[-1]))]
        doc = np.searchsorted(offsets, starts[own], side="right") - 1
        yield ("suffixes", None, None, None, None, None, p, pack(ids[doc], (starts[own] - offsets[doc]).astype("<u4"), counts[own].astype("<u1"), flat))


def _judged(rows: DataFrame, window: int, groups: int, slots: int, digests: bool) -> DataFrame:
    """TABLE: documents that are done (no shared anchor, or copies), and the others with their suffixes."""

    def run(batches):
        out: list[tuple] = []
        ids, texts, marks, size = [], [], [], 0
        for doc, text, _, found in documents_of(batches, {0: 1, 1: 1}):
            values, copy = found[0].ravel(), len(found[1]) > 0
            if copy or not len(values):
                out.append(("done", doc, *_kept(text, values, window, copy, digests), None, None, None))
            else:
                out.append(("open", doc, None, None, None, text, None, None))
                ids.append(doc), texts.append(text), marks.append(values)
            size += len(text)
            if size > TAKEN // 2:
                if ids:
                    out += _suffix_blocks(np.array(ids), texts, marks, window, groups, slots)
                yield _table_batch(out)
                out, ids, texts, marks, size = [], [], [], [], 0
        if ids:
            out += _suffix_blocks(np.array(ids), texts, marks, window, groups, slots)
        if out:
            yield _table_batch(out)

    return rows.mapInArrow(run, TABLE)


def repeated_leaves(windows: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of suffixes (a row of words each, cut at the window): which are leaves below a node of the window's depth and not its first by document and start."""
    n, width = windows.shape
    text = np.ascontiguousarray(windows.astype(">u4")).view(f"S{4 * width}").ravel()
    by_place = np.lexsort((starts, ids))
    order = by_place[np.argsort(text[by_place], kind="stable")]
    same = np.zeros(n, dtype=bool)
    same[1:] = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)  # a common prefix of the whole window
    base = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    first = order[base]
    later = same & ((ids[order] != ids[first]) | (starts[order] != starts[first]))
    return order[later]


def subtrees(words: np.ndarray, at: np.ndarray, window: int, limit: int) -> Iterator[np.ndarray]:
    """The suffixes at the places `at` of words, as indices, in groups of at most limit that hold all of their prefixes; what is left over it
    shares prefixes of `window` words. A prefix grows by words until its group fits."""
    waiting = [(np.arange(len(at)), np.zeros(len(at), dtype=np.uint64), 0)]
    while waiting:
        own, hashes, depth = waiting.pop()
        if len(own) <= limit or depth == window:
            yield own
            continue
        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[at[own] + depth])
        bins = -(-2 * len(own) // limit)
        waiting += [(own[x], hashes[x], depth + 1) for _, x in dealt((hashes % np.uint64(bins)).astype(np.int64), bins)]


def _repeats(suffixes: DataFrame, window: int, slots: int) -> DataFrame:
    """ROWS of kind 0: the windows that a subtree shows to occur earlier. A group of prefixes at a time is held."""

    def run(batches):
        for group in grouped(batches, "part"):
            ids, starts, counts, flat = (np.concatenate(x) for x in zip(*(unpack(blob, "<i8", "<u4", "<u1", "<u4") for blob in group.column("block").to_pylist()), strict=True))
            counts = counts.astype(np.int64)
            length = counts + window - 1
            base = np.repeat(np.cumsum(length) - length, counts)
            k = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            ids, starts, at = np.repeat(ids, counts), np.repeat(starts, counts).astype(np.int64) + k, base + k
            found = []
            for own in subtrees(flat, at, window, SUFFIXES_AT_ONCE):
                found.append(own[repeated_leaves(flat[at[own][:, None] + np.arange(window)], ids[own], starts[own])])
            rows = np.concatenate(found)
            yield from by_slot(ids[rows], starts[rows], 0, slots)

    return suffixes.sortWithinPartitions("part").mapInArrow(run, ROWS)


def _finished(rows: DataFrame, window: int, digests: bool) -> DataFrame:
    def run(batches):
        out: list[tuple] = []
        size = 0
        for doc, text, _, found in documents_of(batches, {0: 1}):
            out.append(("done", doc, *_kept(text, found[0].ravel(), window, False, digests), None, None, None))
            size += len(text)
            if size > TAKEN // 2:
                yield _table_batch(out)
                out, size = [], 0
        if out:
            yield _table_batch(out)

    return rows.mapInArrow(run, TABLE)


def remove_repeated_windows(documents: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """documents (doc_id, text) as doc_id, n_words, n_removed, kept: without the words that a window covers whose words also start earlier.

    Words stand between ASCII white space; earlier means a smaller doc_id, or the same and an earlier start; windows are judged on the
    input. kept holds the kept words with single spaces, or with digests the SHA-256 of that. A null text is empty. Rows of equal doc_id and text are one document, returned
    as often; of several texts under one doc_id none is earlier than another at the same start. Rows with a null doc_id are left out; an
    empty table gives no rows; other columns are ignored. window is PREFIX + 1 at least.
    """
    if window <= PREFIX:
        raise ValueError(f"a window needs more than {PREFIX} words")
    small_batches(documents)
    n = partitions(documents.sparkSession)
    slots = SLOTS_PER_PARTITION * n
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = n * max(1, -(-size // (n * GROUP_BYTES)))
    shared = stored(_shared_anchors(_anchor_blocks(documents, window, n, groups), slots), "shared")
    judged = stored(_judged(to_slots(text_rows(documents, slots).unionByName(shared), n), window, groups, slots, digests), "judged")
    emptied(shared)
    repeats = stored(_repeats(judged.where("kind = 'suffixes'").select("part", "block").repartition(n, "part"), window, slots), "repeats")
    none = F.lit(None)
    decided = judged.where("kind = 'removed'").select(F.col("part").alias("slot"), F.lit(0).alias("kind"), none.cast("bigint").alias("doc_id"), none.cast("string").alias("text"), none.cast("string").alias("extra"), "block")
    opened = text_rows(judged.where("kind = 'open'"), slots)
    finished = _finished(to_slots(opened.unionByName(decided).unionByName(repeats), n), window, digests)
    return judged.where("kind = 'done'").unionByName(finished).select("doc_id", "n_words", "n_removed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), digests=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
