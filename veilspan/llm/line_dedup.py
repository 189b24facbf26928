"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity, that is by the counts of their hash buckets over all documents, then by
hash; two sets of Jaccard similarity t share a word among the first |x| - ceil(t |x|) + 1 of each. These prefixes are joined; pairs must
pass the length filter, the positional filter, and a bound on the symmetric difference from a parity sketch of 64 bits, or 256 if both are long. For each later line
the candidate that is closest by sketch is verified on both sets; where that fails and there are others, the line meets all of these anew,
those that a sketch of 256 bits rules out go, and the rest are verified. Of two similar lines the later one goes.

Texts move once to meet what was found about their lines; those with a line in doubt are kept and move again. All else that moves is
prefixes, places of lines, and the sets of lines that are verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ROWS, SLOTS_PER_PARTITION, by_slot, dealt, documents_of, pack, text_rows, to_slots, unpack
from .common import ascii_lowered, emptied, mix, partitions, slices, small_batches, space_words, stored, table, text_array, word_hashes
from .rare_prefix import grouped, similar_steps

#: Buckets of word counts, whatever the corpus: 4 MB where they are broadcast.
COUNT_BITS = 20
_COUNT_PARTS = 16
_COUNT_MASK = np.uint64((1 << COUNT_BITS) - 1)
_TAKEN = 4 << 20
#: Prefix entries that a task gathers before it deals them out, and words of the corpus for each group that is joined at a time: a fifth of them are entries.
_GATHERED, _GROUP_WORDS = 1_000_000, 5_000_000
#: Neighbours in a word's order by size that each line is compared with; of those further on, lines that fit no neighbour meet all the rest in the last step.
NEIGHBOURS = 512
#: Lines of more words have sketches of four words, whose exclusive or is the sketch of one.
LONG_LINE = 80
#: A line's address: 32 bits of its text's hash, which tells texts of one doc_id apart, and its number.
_LINE_BITS = 31
_LINE = (1 << _LINE_BITS) - 1


def text_mark(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF) << _LINE_BITS


def line_sets(texts: pa.Array, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts: text index, line number, offsets of their sets (n + 1), and the distinct word hashes of each line, by the counts of their buckets, if given, then by hash."""
    lines = pc.split_pattern(texts, "\n")
    per_text = np.asarray(pc.list_value_length(lines), dtype=np.int64)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    offsets, words = space_words(ascii_lowered(pc.list_flatten(lines)))
    if not len(words):
        return owner, number, np.zeros(len(owner) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = unique_hashes(words)
    order = np.argsort(hashes) if counts is None else np.lexsort((hashes, counts[hashes & _COUNT_MASK]))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    line = np.repeat(np.arange(len(owner)), np.diff(offsets))
    keys = np.sort(line * len(order) + rank[np.asarray(words.indices)])
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    line, place = np.divmod(keys, len(order))
    return owner, number, np.searchsorted(line, np.arange(len(owner) + 1)), hashes[order][place]


def unique_hashes(words: pa.DictionaryArray) -> np.ndarray:
    """word_hashes() of the dictionary."""
    return word_hashes(pa.DictionaryArray.from_arrays(pa.array(np.arange(len(words.dictionary), dtype=np.int32)), words.dictionary))


def word_counts(documents: DataFrame) -> np.ndarray:
    """How often words of each hash bucket occur in all documents; the result has a fixed size."""
    width = (1 << COUNT_BITS) // _COUNT_PARTS

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for b in slices(batches, limit=_TAKEN):
            _, words = space_words(ascii_lowered(text_array(b.column("text"))))
            if len(words):
                np.add.at(total, unique_hashes(words) & _COUNT_MASK, np.bincount(np.asarray(words.indices), minlength=len(words.dictionary)))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(_COUNT_PARTS), pa.int32()), pa.array([total[p * width : (p + 1) * width].tobytes() for p in range(_COUNT_PARTS)], pa.binary())], names=["part", "block"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for p, blob in zip(b.column("part").to_pylist(), b.column("block").to_pylist(), strict=True):
                sums[p] = sums.get(p, 0) + np.frombuffer(blob, dtype=np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "block"])

    out = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    sums = documents.select("text").mapInArrow(count, "part int, block binary").repartition(_COUNT_PARTS, "part").mapInArrow(add, "part int, block binary")
    for r in stored(sums, "counts").collect():  # _COUNT_PARTS rows of a fixed size
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["block"], dtype=np.int64)
    return out


def least_common(size: np.ndarray, percent: int) -> np.ndarray:
    """Words that a set of this size has in common with any set similar to it, at least."""
    return -(-percent * size // 100)


def parity_sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of sets of mixed hashes (offsets n + 1, none empty): four words of 64 parity bits each."""
    out = np.empty((len(offsets) - 1, 4), dtype=np.uint64)
    bit, word = np.uint64(1) << (hashes >> np.uint64(58)), (hashes >> np.uint64(56)) & np.uint64(3)
    for k in range(4):
        out[:, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), offsets[:-1])
    return out


def _posting_types(wide: bool) -> tuple[str, ...]:
    """token, digest, sketch, the further three words of long lines, then size, position, document and line, which mostly fit 16 bits."""
    return ("<u4", "<u8", "<u8", "<u8", *("<u4" if wide else "<u2",) * 4)


class _Entries:
    """Prefix entries of several slices of texts, and the documents that they belong to."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.marks: list[np.ndarray] = []
        self.columns: list[list[np.ndarray]] = []
        self.documents = self.rows = 0

    def add(self, ids: np.ndarray, marks: np.ndarray, token, digest, sketches, size, position, document, line) -> None:
        self.ids.append(ids), self.marks.append(marks)
        self.columns.append([token, digest, sketches, size.astype("<u4"), position.astype("<u4"), (document + self.documents).astype("<u4"), line.astype("<u4")])
        self.documents += len(ids)
        self.rows += len(token)

    def blocks(self, groups: int) -> Iterator[tuple[int, bytes]]:
        """(group, block), dealt by word."""
        if not self.rows:
            return
        ids, marks = np.concatenate(self.ids), np.concatenate(self.marks)
        token, digest, sketches, *small = (np.concatenate(x) for x in zip(*self.columns, strict=True))
        sketch = np.bitwise_xor.reduce(sketches, axis=1)
        for p, own in dealt((token & np.uint64(0xFFFFFFFF)) % np.uint64(groups), groups):
            used, index = np.unique(small[2][own], return_inverse=True)
            numbers = [small[0][own], small[1][own], index, small[3][own]]
            wide = max(int(x.max()) for x in numbers) > 0xFFFF
            columns = [token[own] >> np.uint64(32), digest[own], sketch[own], sketches[own[small[0][own] > LONG_LINE], 1:].ravel(), *numbers]
            yield p, bytes([wide]) + pack(ids[used], marks[used], *(x.astype(t) for x, t in zip(columns, _posting_types(wide), strict=True)))


def _prefix_blocks(documents: DataFrame, counts: np.ndarray, percent: int, n: int, groups: int) -> DataFrame:
    """(part, kind, block): kind 0 the prefixes of each task's distinct sets, dealt by word; kind 1 the lines that repeat a set of the task."""
    shared = documents.sparkSession.sparkContext.broadcast(np.minimum(counts, (1 << 32) - 1).astype(np.uint32))

    def run(batches):
        entries = _Entries()
        again: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            rows = [(p, 0, blob) for p, blob in entries.blocks(groups)]
            if again:
                rows.append((int(again[0][0][0] % groups), 1, pack(*(np.concatenate(x) for x in zip(*again, strict=True)))))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "kind", "block"])

        for b in slices(batches, limit=_TAKEN):
            ids, texts = np.asarray(b.column("doc_id"), dtype="<i8"), text_array(b.column("text"))
            owner, number, offsets, hashes = line_sets(texts, shared.value)
            if not len(hashes):
                continue
            marks = np.fromiter(map(text_mark, texts.to_pylist()), dtype="<i8", count=len(texts))
            size = np.diff(offsets)
            full = np.flatnonzero(size)
            mixed = mix(hashes)
            digest, sketches = np.zeros(len(size), dtype=np.uint64), np.zeros((len(size), 4), dtype=np.uint64)
            digest[full] = np.add.reduceat(mixed, offsets[:-1][full])
            sketches[full] = parity_sketches(mixed, np.append(offsets[:-1][full], offsets[-1]))
            sketch = np.bitwise_xor.reduce(sketches, axis=1)
            # of equal sets the first line by document and number stands for all
            order = full[np.lexsort((number[full], ids[owner[full]], sketch[full], digest[full]))]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (digest[order[1:]] != digest[order[:-1]]) | (sketch[order[1:]] != sketch[order[:-1]])
            copy = order[~new]
            base = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))][~new]
            copy = copy[(ids[owner[copy]] != ids[owner[base]]) | (number[copy] != number[base])]
            if len(copy):
                again.append((ids[owner[copy]], marks[owner[copy]] | number[copy]))
            taken = np.zeros(len(size), dtype=bool)
            taken[order[new]] = True
            length = np.where(taken, size - least_common(size, percent) + 1, 0)
            line = np.repeat(np.arange(len(size)), length)
            position = np.arange(len(line)) - np.repeat(np.cumsum(length) - length, length)
            entries.add(ids, marks, mixed[offsets[:-1][line] + position], digest[line], sketches[line], size[line], position, owner[line], number[line])
            if entries.rows >= _GATHERED:
                yield flush()
                entries, again = _Entries(), []
        if entries.rows or again:
            yield flush()

    return documents.mapInArrow(run, "part int, kind int, block binary").repartition(n, "part").sortWithinPartitions("part")


def _candidates(blocks: DataFrame, percent: int, slots: int) -> DataFrame:
    """ROWS for documents: kind 0 lines that repeat an earlier set; kind 1 for each later line and word the candidate that is closest by
    sketch, as (line, bits between the sketches, earlier document, earlier line, whether there are others); kind 2 all lines of candidates. A group at a time is held."""

    def run(batches):
        for group in grouped(batches, "part"):
            columns: list[list[np.ndarray]] = []
            for kind, blob in zip(group.column("kind").to_pylist(), group.column("block").to_pylist(), strict=True):
                if kind == 1:
                    yield from by_slot(*unpack(blob, "<i8", "<i8"), 0, slots)
                else:
                    ids, marks, token, digest, sketch, more, size, position, index, line = unpack(blob[1:], "<i8", "<i8", *_posting_types(bool(blob[0])))
                    wide = np.zeros((len(token), 4), dtype=np.uint64)
                    wide[size > LONG_LINE, 1:] = more.reshape(-1, 3)
                    wide[:, 0] = sketch ^ np.bitwise_xor.reduce(wide, axis=1)
                    columns.append([token, digest, sketch, wide, size, position, ids[index], marks[index] | line])
            if columns:
                yield from joined(*(np.concatenate(x) for x in zip(*columns, strict=True)))

    def joined(token, digest, sketch, wide, size, position, doc, line):
        order = np.lexsort((line & _LINE, doc, sketch, digest, size, token))
        token, digest, sketch, wide, size, position, doc, line = (x[order] for x in (token, digest, sketch, wide, size, position, doc, line))
        first = np.ones(len(token), dtype=bool)
        first[1:] = (token[1:] != token[:-1]) | (digest[1:] != digest[:-1]) | (sketch[1:] != sketch[:-1]) | (size[1:] != size[:-1])
        base = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        copies = ~first & (position == 0) & ((doc != doc[base]) | ((line ^ line[base]) & _LINE != 0))
        yield from by_slot(doc[copies], line[copies], 0, slots)
        token, sketch, wide, size, position, doc, line = (x[first] for x in (token, sketch, wide, size, position, doc, line))

        def away(a, b):
            bits = np.bitwise_count(sketch[a] ^ sketch[b]).astype(np.int64)
            both = np.flatnonzero((size[a] > LONG_LINE) & (size[b] > LONG_LINE))
            bits[both] = np.bitwise_count(wide[a[both]] ^ wide[b[both]]).sum(axis=1)
            return bits

        order = np.lexsort((line & _LINE, doc))
        place = np.empty(len(order), dtype=np.int64)  # by document and number; lines of one place are not earlier than one another
        place[order] = np.cumsum(np.concatenate([[0], (doc[order[1:]] != doc[order[:-1]]) | ((line[order[1:]] ^ line[order[:-1]]) & _LINE != 0)])) if len(order) else 0
        none = np.iinfo(np.int64).max
        best, partner, met, involved = np.full(len(token), none), np.zeros(len(token), dtype=np.int64), np.zeros(len(token), dtype=np.int32), np.zeros(len(token), dtype=bool)
        for a, b, bits in similar_steps(token, size, position, away, percent, NEIGHBOURS):
            if a is b:  # all lines with one of these words may have others beyond their neighbours
                crowded = np.flatnonzero(np.isin(token, token[a]))
                first_of = np.flatnonzero(np.concatenate([[True], token[crowded[1:]] != token[crowded[:-1]]])) if len(crowded) else crowded
                least = np.minimum.reduceat(place[crowded], first_of) if len(crowded) else crowded
                lead = order[np.searchsorted(place[order], np.repeat(least, np.diff(np.append(first_of, len(crowded)))))]
                involved[crowded], met[crowded] = True, 2
                alone = (best[crowded] == none) & (place[lead] < place[crowded])
                best[crowded[alone]], partner[crowded[alone]] = 256 << 48, lead[alone]
                continue
            involved[a], involved[b] = True, True
            for later, earlier, key in ((a, b, (bits << 48) + place[b]), (b, a, (bits << 48) + place[a])):
                own = place[earlier] < place[later]
                later, earlier, key = later[own], earlier[own], key[own]
                met[later] += 1
                closer = key < best[later]
                best[later[closer]], partner[later[closer]] = key[closer], earlier[closer]
        later = np.flatnonzero(best < none)
        earlier = partner[later]
        yield from by_slot(doc[later], np.stack([line[later], best[later] >> 48, doc[earlier], line[earlier], met[later] > 1], axis=1), 1, slots)
        yield from by_slot(doc[involved], line[involved], 2, slots)

    return blocks.mapInArrow(run, ROWS)


TABLE = "kind string, doc_id bigint, n_lines bigint, n_removed bigint, text string, extra string, line bigint, other_doc bigint, other_line bigint, several boolean, block binary"
_NAMES = ["kind", "doc_id", "n_lines", "n_removed", "text", "extra", "line", "other_doc", "other_line", "several", "block"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]


def _table_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _without(text: str, removed: set[int], digests: bool) -> tuple[int, int, str]:
    lines = text.split("\n")
    kept = [x for i, x in enumerate(lines) if i not in removed]
    left = "\n".join(kept)
    return len(lines), len(lines) - len(kept), hashlib.sha256(left.encode()).hexdigest() if digests else left


def _of_text(values: np.ndarray, text: str) -> np.ndarray:
    """The distinct values (of one or more numbers, an address first) that belong to the text, with the line's number for its address."""
    if not len(values):
        return values
    own = np.unique(values[values[:, 0] & ~_LINE == text_mark(text)], axis=0)
    own[:, 0] &= _LINE
    return own


def _judged(rows: DataFrame, counts: np.ndarray, digests: bool) -> DataFrame:
    """TABLE: documents without a later line of a pair are done; the others stay open; the closest pair of each such line, with its set; and the sets of all lines of pairs, by rarity."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def set_rows(wanted: list[tuple[int, int, str, tuple | None]]) -> list[tuple]:
        if not wanted:
            return []
        _, _, offsets, hashes = line_sets(pa.array([x[2] for x in wanted], pa.large_string()), shared.value)
        out = []
        for i, (doc, line, _, pair) in enumerate(wanted):
            block = hashes[offsets[i] : offsets[i + 1]].tobytes()
            out.append(("member", doc, None, None, None, None, line, None, None, None, block))
            if pair:
                out.append(("pair", doc, None, None, None, None, line, *pair, block))
        return out

    def run(batches):
        empty = (None,) * 5
        out: list[tuple] = []
        wanted: list[tuple[int, int, str, tuple | None]] = []
        size, before, told = 0, None, set()
        for doc, text, extra, found in documents_of(batches, {0: 1, 1: 5, 2: 1}):
            removed, pairs, members = (_of_text(found[k], text) for k in (0, 1, 2))
            size += len(text)
            if len(pairs):
                out.append(("open", doc, None, None, text, extra, *empty))
            else:
                out.append(("done", doc, *_without(text, set(removed.ravel().tolist()), digests), extra, *empty))
            if doc != before:
                before, told = doc, set()
            if len(members) and (mark := text_mark(text)) not in told:
                told.add(mark)
                if len(pairs) and len(removed):
                    out.append(("removed", None, None, None, None, None, None, None, None, None, pack(np.full(len(removed), doc, dtype="<i8"), removed.ravel() | mark)))
                closest: dict[int, tuple[int, int, bool]] = {}
                for line, _, other, other_line, several in pairs.tolist():  # the closest of a line comes first
                    first = closest.setdefault(line, (other, other_line, bool(several)))
                    if several or first[:2] != (other, other_line):
                        closest[line] = (*first[:2], True)
                lines = text.split("\n")
                wanted += [(doc, line | mark, lines[line], closest.get(line)) for line in members.ravel().tolist()]
            if size > _TAKEN:
                yield _table_batch(out + set_rows(wanted))
                out, wanted, size = [], [], 0
        if out:
            yield _table_batch(out + set_rows(wanted))

    return rows.mapInArrow(run, TABLE)


def _again(removed: DataFrame, slots: int) -> DataFrame:
    """ROWS of kind 0 from blocks that documents have kept."""

    def run(batches):
        for b in batches:
            held = [unpack(x, "<i8", "<i8") for x in b.column("block").to_pylist()]
            if held:
                yield from by_slot(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), 0, slots)

    return removed.select("block").mapInArrow(run, ROWS)


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line) of the pairs (doc_id, line, x, y) whose sets x and y are similar."""

    def run(batches):
        for b in batches:
            fits = pa.array([_similar(x, y, percent) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("line")], names=["doc_id", "line"]).filter(fits)

    return pairs.select("doc_id", "line", "x", "y").mapInArrow(run, "doc_id bigint, line bigint").distinct()


#: Prefix words of lines in doubt are broadcast up to so many rows (of under 100 bytes); more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified_rest(members: DataFrame, left: DataFrame, percent: int) -> DataFrame:
    """(doc_id, line) of the lines left (doc_id, line) that are similar to an earlier one of the members (doc_id, line, block)."""
    own_columns = ["item", "doc_id", "line", "size", "position", "s0", "s1", "s2", "s3"]

    def prefixes(batches):
        """A row for each prefix word, with all that rules a pair out."""
        for b in batches:
            sets = [np.frombuffer(x, dtype=np.int64) for x in b.column("block").to_pylist()]
            if sets:
                size = np.array([len(x) for x in sets])
                length = size - least_common(size, percent) + 1
                position = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                sketches = parity_sketches(mix(np.concatenate(sets).view(np.uint64)), np.concatenate([[0], np.cumsum(size)])).view(np.int64)
                places = [np.repeat(np.asarray(b.column(c)), length) for c in ("item", "doc_id", "line")]
                columns = [np.concatenate([x[:n] for x, n in zip(sets, length.tolist(), strict=True)]), *places, np.repeat(size, length), position, *np.repeat(sketches, length, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", *own_columns])

    members = members.withColumn("item", F.xxhash64("doc_id", "line"))
    own = stored(members.join(left, ["doc_id", "line"], "left_semi"), "own")
    if not own.head(1):
        return left.limit(0)
    kind = ", ".join(f"{c} bigint" for c in ["token", *own_columns])
    doubt = stored(own.select("block", "item", "doc_id", "line").mapInArrow(prefixes, kind).withColumnsRenamed({c: f"a_{c}" for c in own_columns}), "doubt")
    away = sum((F.bit_count(F.col(f"a_s{k}").bitwiseXOR(F.col(f"s{k}"))) for k in range(4)), F.lit(0))
    number, a_number = F.col("line").bitwiseAND(_LINE), F.col("a_line").bitwiseAND(_LINE)
    earlier = (F.col("doc_id") < F.col("a_doc_id")) | ((F.col("doc_id") == F.col("a_doc_id")) & (number < a_number))
    both, further = F.col("size") + F.col("a_size"), F.least(F.col("size") - F.col("position"), F.col("a_size") - F.col("a_position"))
    fits = earlier & (100 * F.least("size", "a_size") >= percent * F.greatest("size", "a_size")) & (further * (100 + percent) >= percent * both) & (away <= both - 2 * F.ceil(percent * both / (100 + percent)))
    met = members.select("block", "item", "doc_id", "line").mapInArrow(prefixes, kind).join(_bounded(doubt), "token").where(fits)
    near = stored(met.select(F.col("a_item").alias("a"), F.col("item").alias("b")).distinct(), "near")
    emptied(doubt)
    blocks = near.join(own.select(F.col("item").alias("a"), "doc_id", "line", F.col("block").alias("x")), "a").join(members.select(F.col("item").alias("b"), F.col("block").alias("y")), "b")
    found = stored(_verified(blocks, percent), "rest")
    emptied(near, own)
    return found


def _line_blocks(lines: DataFrame, slots: int) -> DataFrame:
    """ROWS of kind 0 of lines (doc_id, line)."""

    def run(batches):
        for b in batches:
            yield from by_slot(np.asarray(b.column("doc_id")), np.asarray(b.column("line")), 0, slots)

    return lines.select("doc_id", "line").mapInArrow(run, ROWS)


def _finished(rows: DataFrame, digests: bool) -> DataFrame:
    def run(batches):
        out: list[tuple] = []
        size = 0
        for doc, text, extra, found in documents_of(batches, {0: 1}):
            out.append(("done", doc, *_without(text, set(_of_text(found[0], text).ravel().tolist()), digests), extra, *(None,) * 5))
            size += len(text)
            if size > _TAKEN:
                yield _table_batch(out)
                out, size = [], 0
        if out:
            yield _table_batch(out)

    return rows.mapInArrow(run, TABLE)


def remove_similar_lines(documents: DataFrame, percent: int = 80, extra: str | None = None, digests: bool = False) -> DataFrame:
    """documents (doc_id, text) as doc_id, n_lines, n_removed, kept, extra: without the lines that are similar to an earlier line of any document.

    Lines end at \\n; a line is the set of its words between ASCII white space, A-Z lower-cased. Lines without words stay. Lines are
    similar where 100 * intersection >= percent * union; earlier means a smaller doc_id, or the same and a smaller line number, whether
    or not the earlier line itself goes. kept joins the other lines, or with digests is the SHA-256 of that,
    so that no text has to be written that is not open to a second look. extra names a string column that is passed through. A null text is
    one empty line. Rows of equal doc_id and text are one document, returned as often; of several texts under one doc_id, lines of equal
    number are not earlier than one another. Rows with a null doc_id are left out; an empty table gives no rows.
    """
    small_batches(documents)
    n = partitions(documents.sparkSession)
    passed = F.col(extra).cast("string") if extra else F.lit(None).cast("string")
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", passed.alias("extra")).where("doc_id IS NOT NULL")
    slots = SLOTS_PER_PARTITION * n
    counts = word_counts(documents)
    groups = n * max(1, -(-int(counts.sum()) // (n * _GROUP_WORDS)))
    candidates = stored(_candidates(_prefix_blocks(documents.select("doc_id", "text"), counts, percent, n, groups), percent, slots), "candidates")
    judged = stored(_judged(to_slots(text_rows(documents, slots, F.col("extra")).unionByName(candidates), n), np.minimum(counts, (1 << 32) - 1).astype(np.uint32), digests), "judged")
    emptied(candidates)
    members = judged.where("kind = 'member'").select("doc_id", "line", "block")
    pairs = judged.where("kind = 'pair'")
    partner = members.select(F.col("doc_id").alias("other_doc"), F.col("line").alias("other_line"), F.col("block").alias("y"))
    closest = pairs.select("doc_id", "line", "other_doc", "other_line", F.col("block").alias("x")).join(partner, ["other_doc", "other_line"])
    resolved = stored(_verified(closest, percent), "resolved")
    left = pairs.where("several").select("doc_id", "line").join(resolved, ["doc_id", "line"], "left_anti")
    rest = _verified_rest(members, left, percent)
    removed = _again(judged.where("kind = 'removed'"), slots).unionByName(_line_blocks(resolved.unionByName(rest), slots))
    finished = _finished(to_slots(text_rows(judged.where("kind = 'open'"), slots, F.col("extra")).unionByName(removed), n), digests)
    return judged.where("kind = 'done'").unionByName(finished).select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept"), "extra")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_similar_lines(table(spark, sf_dir, "documents"), digests=True).select("doc_id", "n_lines", "n_removed", F.col("kept").alias("kept_sha256"))
