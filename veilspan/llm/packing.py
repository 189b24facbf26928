"""Best-fit packing of tokenized documents into sequences of fixed capacity by minimum bin slack.

Documents are cut into pieces of at most the capacity. Pieces differ only in length, so the packing is planned on the histogram of
lengths, which has at most `capacity` entries however many pieces there are: for each bin, subset-sum dynamic programming over a
bitset of reachable loads finds the fullest feasible combination with the longest remaining piece; the combination is taken as often as
the histogram allows, then removed. The plan, of a size bounded by the capacity, goes to all executors, where each piece finds its
place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, space_words, stored, table, text_array

END_ID = 0
#: Bytes of text that are taken together: a word costs once for all of them.
_TAKEN = 8 << 20
#: Words whose ids a worker keeps; beyond it the store starts anew.
CACHED_WORDS = 600_000

# The steps of a tokenizer that keep apart what ASCII white space separates, and lower-case letters before they are split.
WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}

#: Letters whose composed form and lower case are the same everywhere, then marks: each of both is one pre-token.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?]*)")


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def encodes_words(path: str) -> bool:
    """Whether the tokenizer's steps are WORD_STEPS and no added token has white space or takes it from around it."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    plain = all(not re.search(r"\s", t["content"]) and not t.get("lstrip") and not t.get("rstrip") for t in found.get("added_tokens", []))
    return plain and all(found.get(k) == v for k, v in WORD_STEPS.items())


class WordTokenizer:
    """Ids of texts. Where the tokenizer encodes_words(), each distinct word is encoded once, plain ones by the tokenizer's model directly, lower-cased and in byte letters; of any other, whole texts are encoded."""

    def __init__(self, path: str, words: int = CACHED_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words, self.words = encodes_words(path), words
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {"": []}
        self.starts, self.flat = array("q", [0]), array("I")

    def _part(self, text: str) -> list[int]:
        ids = self.parts.get(text)
        if ids is None:
            ids = self.parts[text] = [t.id for t in self.tokenizer.model.tokenize(text.lower().encode().decode("latin-1").translate(self.letters))]
        return ids

    def _learn(self, words: list[str]) -> None:
        others = []
        for word in words:
            found = _PLAIN.fullmatch(word)
            if found is None:
                others.append(word)
                continue
            self.known[word] = len(self.starts) - 1
            self.flat.extend(self._part(found[1]) + self._part(found[2]))
            self.starts.append(len(self.flat))
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[word] = len(self.starts) - 1
            self.flat.extend(found.ids)
            self.starts.append(len(self.flat))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids (n + 1), and all ids (uint32)."""
        if not self.by_words:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64), np.array([i for x in found for i in x], dtype=np.uint32)
        offsets, words = space_words(texts)
        if not len(words):
            return np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        unique = words.dictionary.to_pylist()
        if len(self.known) > self.words:
            self._forget()
        known = self.known
        self._learn([w for w in unique if w not in known])
        at = np.fromiter((known[w] for w in unique), dtype=np.int64, count=len(unique))[np.asarray(words.indices)]
        starts = np.array(self.starts)
        per_word = starts[at + 1] - starts[at]
        ends = np.cumsum(per_word)
        source = np.repeat(starts[at] - (ends - per_word), per_word) + np.arange(int(ends[-1]))
        return np.concatenate([[0], ends])[offsets], np.array(self.flat, dtype=np.uint32)[source]


@lru_cache(maxsize=2)
def word_tokenizer(path: str, words: int) -> WordTokenizer:
    """One for each worker process, kept from task to task."""
    return WordTokenizer(path, words)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"


def tokenized_pieces(documents: DataFrame, tokenizer_path: str, capacity: int, end_id: int = END_ID, keep_ids: bool = False, words: int = CACHED_WORDS) -> DataFrame:
    """Each document's ids, then end_id, cut at multiples of capacity. part and place: the task that cut a piece and the piece's rank there among those of its length."""

    def run(batches):
        encode = word_tokenizer(tokenizer_path, words)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, limit=_TAKEN):
            offsets, ids = encode(text_array(batch.column("text")))
            doc_ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, doc in enumerate(doc_ids):
                own = np.append(ids[offsets[i] : offsets[i + 1]], np.uint32(end_id)).astype("<u4")
                for k, start in enumerate(range(0, len(own), capacity)):
                    piece = own[start : start + capacity]
                    n = len(piece)
                    rows.append((doc, k, start, n, zlib.crc32(piece.tobytes()), part, int(seen[n]), *([piece] if keep_ids else [])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * keep_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return documents.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<bigint>" * keep_ids)


def fullest(counts: dict[int, int], slack: int) -> dict[int, int]:
    """The multiset of lengths, at most counts of each, whose sum comes closest to slack from below."""
    if slack <= 0:
        return {}
    mask = (1 << (slack + 1)) - 1
    reach = 1
    steps = []
    for length in sorted((n for n, c in counts.items() if c > 0 and n <= slack), reverse=True):
        left, take = min(counts[length], slack // length), 1
        while left > 0 and not reach >> slack & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            take *= 2
        if reach >> slack & 1:
            break
    load = reach.bit_length() - 1
    out: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> load & 1:
            out[length] += take
            load -= length * take
    return dict(out)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how many sequences, copies of each length in one) that place all pieces.

    A pattern is repeated while its pieces last, so a pattern ends with some length short of it: the number of patterns is bounded by
    the number of distinct lengths and their copies in a sequence, not by the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[n] // c for n, c in pattern.items())
        out.append((times, pattern))
        for n, c in pattern.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return out


def placements(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, copies in a sequence, offset of the first copy), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for n in sorted(pattern, reverse=True):
            out[n].append((used[n], sequence, pattern[n], offset))
            used[n] += times * pattern[n]
            offset += n * pattern[n]
        sequence += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = END_ID, keep_ids: bool = False, words: int = CACHED_WORDS) -> DataFrame:
    """documents (doc_id, text) as pieces with their sequence and their offset in it; with keep_ids also the pieces' ids. A worker keeps the ids of up to `words` words.

    A null or empty text is a document of the end id alone. Repeated rows are packed like others. An empty table gives no rows. Other
    columns are ignored. Which of several pieces of a length takes which place is arbitrary but fixed once the pieces are written.
    """
    spark = documents.sparkSession
    small_batches(documents)
    pieces = stored(tokenized_pieces(documents, tokenizer_path, capacity, end_id, keep_ids, words), "pieces")
    by_part = pieces.groupBy("part", "length").count()
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(placements(pack_lengths(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    columns = [c for c in pieces.columns if c not in ("part", "place")]

    def place(batches):
        for batch in batches:
            lengths, ranks = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                rows = plan.value[int(n)]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                within, slot = np.divmod(ranks[own] - row[:, 0], row[:, 2])
                sequence[own], offset[own] = row[:, 1] + within, row[:, 3] + slot * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select(*columns, (F.col("base") + F.col("place")).alias("rank"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())
