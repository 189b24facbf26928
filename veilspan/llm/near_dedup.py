"""Near-duplicate documents by MinHash and an LSH forest, confirmed on full shingle sets.

Each document is the set of its distinct word shingles. Sets that are equal form a class at once. A class's signature is the minimum of
each of 64 hash functions; the forest has 21 trees, each a sorted order of the signatures that starts at another place. Classes that agree
on the first three minima of an order share a region, whatever its size, so a pair at the threshold of 0.8 is missed by all trees in
about 3 of 10 million cases.

Round one walks a crowded order from neighbour to neighbour: blocks of classes with the longest common prefixes are confirmed and
joined. Round two takes each region anew and finds the classes with a partner that their signatures admit and that is not yet
connected: in a sparse region all that there is, in a crowded one what the walk has not reached, so depth adapts to the region and
nothing is capped. Of these, pairs are tried that share one of the rarest shingles which two linked sets must share. Every link is
confirmed on both sets. Pairs whose signatures agree on less than LEAST_AGREEMENT are not tried: another 2 of 10 billion at 0.8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lowered, document_shingles, emptied, mix, partitions, slices, small_batches, space_words, stored, table, text_array, word_hashes
from .components import UnionFind, connected_components
from .rare_prefix import grouped, rare_prefix_pairs

MINIMA, TREES, DEPTH = 64, 21, 3
#: Classes of a walked block; the last of a block is the first of the next.
BLOCK = 48
#: Members of a region that one task compares with those outside its largest component.
PART = 1000
#: Orders in which a class is walked: those in which most others share its region.
WALKED = 2
#: Pairs whose signatures agree on a smaller share are not tried: seven standard deviations below 0.8, where a pair at 0.8 is passed over with probability 2e-10.
LEAST_AGREEMENT = 0.45
#: Partners that one confirming block holds besides its centre.
PARTNERS = 64

_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(501, 501 + MINIMA, dtype=np.uint64))


def text_shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: words between ASCII white space, A-Z lower-cased."""
    offsets, words = space_words(ascii_lowered(texts))
    return document_shingles(offsets, word_hashes(words), width)


def minima(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Signature rows of 16-bit parts of the minima; an empty set has zeros."""
    out = np.zeros((len(offsets) - 1, MINIMA), dtype="<u2")
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for k in range(MINIMA):
            low = np.minimum.reduceat((hashes * _FACTORS[k] + _SHIFTS[k]) >> np.uint64(16), starts)
            out[full, k] = (mix(low) & np.uint64(0xFFFF)).astype("<u2")
    return out


def set_signatures(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, n_shingles, digest of the set, signature) of each document (doc_id, mark, text)."""

    def run(batches):
        for b in slices(batches):
            offsets, hashes = text_shingles(text_array(b.column("text")), width)
            rows = minima(offsets, hashes)
            digests = [xxhash.xxh3_128_digest(hashes[offsets[i] : offsets[i + 1]].tobytes()) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(np.diff(offsets)), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "mark", "n_shingles", "digest", "signature"])

    return documents.select("doc_id", "mark", "text").mapInArrow(run, "doc_id bigint, mark bigint, n_shingles bigint, digest binary, signature binary")


def _signature_rows(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(-1, MINIMA).copy()


def region_keys(signatures: np.ndarray) -> np.ndarray:
    """The region of each signature in each tree: hashes of the tree and the first DEPTH minima of its order."""
    out = np.empty((len(signatures), TREES), dtype=np.int64)
    for t in range(TREES):
        key = np.full(len(signatures), t + 1, dtype=np.uint64)
        for k in range(DEPTH):
            key = (key << np.uint64(16)) | signatures[:, t * DEPTH + k].astype(np.uint64)
        out[:, t] = mix(key).view(np.int64)
    return out


def forest_regions(classes: DataFrame) -> DataFrame:
    """(region, tree, doc_id, members) for the regions of at least two classes."""

    def run(batches):
        for b in batches:
            keys = region_keys(_signature_rows(b.column("signature")))
            ids = np.repeat(np.asarray(b.column("doc_id")), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(keys))), pa.array(ids)], names=["region", "tree", "doc_id"])

    keys = classes.select("doc_id", "signature").mapInArrow(run, "region bigint, tree int, doc_id bigint")
    return keys.withColumn("members", F.count("*").over(Window.partitionBy("region"))).where("members > 1")


def _walk_blocks(members: DataFrame) -> DataFrame:
    """(block, center, doc_id) from members (region, tree, doc_id, signature): runs of BLOCK neighbours in the region's order. A crowded region is spread over tasks, each with a part of its order."""

    def ordered(batches):
        for b in batches:
            rows, trees = _signature_rows(b.column("signature")), np.asarray(b.column("tree"))
            for t in np.unique(trees):
                rows[trees == t] = np.roll(rows[trees == t], -int(t) * DEPTH, axis=1)
            yield pa.RecordBatch.from_arrays([b.column("region"), b.column("doc_id"), pa.array([r.tobytes() for r in rows.astype(">u2")], pa.binary())], names=["region", "doc_id", "place"])

    def run(batches):
        held: list[int] = []
        at = None
        ids, blocks = [], []

        def close():
            if len(held) > 1:
                ids.append(np.array(held, dtype=np.int64))
                blocks.append(np.full(len(held), xxhash.xxh3_64_intdigest(ids[-1].tobytes()), dtype=np.uint64).view(np.int64))

        for b in batches:
            for region, doc in zip(b.column("region").to_pylist(), b.column("doc_id").to_pylist(), strict=True):
                if region != at:
                    close()
                    held, at = [], region
                held.append(doc)
                if len(held) == BLOCK:
                    close()
                    held = held[-1:]
            if len(ids) > 500:
                yield batch_of(ids, blocks)
                ids, blocks = [], []
        close()
        if ids:
            yield batch_of(ids, blocks)

    def batch_of(ids, blocks):
        n = sum(map(len, ids))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(blocks)), pa.array(np.zeros(n, dtype=bool)), pa.array(np.concatenate(ids))], names=["block", "center", "doc_id"])

    placed = members.select("region", "tree", "doc_id", "signature").mapInArrow(ordered, "region bigint, doc_id bigint, place binary")
    return placed.repartitionByRange(partitions(members.sparkSession), "region", "place").sortWithinPartitions("region", "place").select("region", "doc_id").mapInArrow(run, "block bigint, center boolean, doc_id bigint")


def _unconnected(members: DataFrame, share: float) -> DataFrame:
    """(doc_id, component) of members (region, doc_id, n_shingles, signature, component) that have, in some region, an unconnected class whose size and signature admit the threshold.

    Regions of one component have none. Of any other, the members outside its largest component meet all members, which stand in parts of
    about PART, by a hash: a copy of the former goes to each part.
    """

    def run(batches):
        for group in grouped(batches, "part"):
            apart = np.asarray(group.column("apart"))
            component = np.asarray(group.column("component"))
            sizes, ids, rows = np.asarray(group.column("n_shingles")), np.asarray(group.column("doc_id")), _signature_rows(group.column("signature"))
            flags = np.zeros(len(ids), dtype=bool)
            for i in np.flatnonzero(apart):
                other = np.flatnonzero((component != component[i]) & (np.minimum(sizes, sizes[i]) >= share * np.maximum(sizes, sizes[i]) - 1e-9))
                hit = other[(rows[other] == rows[i]).mean(axis=1) >= LEAST_AGREEMENT]
                flags[hit] = True
                flags[i] |= len(hit) > 0
            if flags.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[flags]), pa.array(component[flags])], names=["doc_id", "component"])

    sizes = members.groupBy("region", "component").agg(F.count("*").alias("n"))
    regions = sizes.groupBy("region").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).where("top.n < all")
    regions = stored(regions.select("region", F.col("top.component").alias("main"), F.ceil(F.col("all") / PART).cast("int").alias("parts")), "mixed")
    mixed = members.join(regions, "region").withColumn("apart", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    dealt = mixed.withColumn("salt", F.explode(F.when(F.col("apart"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))))
    rows = dealt.select(F.xxhash64("region", "salt").alias("part"), "apart", "doc_id", "n_shingles", "signature", "component")
    return rows.repartition(partitions(members.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, "doc_id bigint, component bigint").distinct()


def _prefix_pairs(documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b), a < b, of documents (doc_id, component, text) of different components that share one of their rarest shingles."""

    def shingles(batches):
        for b in slices(batches):
            offsets, hashes = text_shingles(text_array(b.column("text")), width)
            counts = np.diff(offsets)
            owner = np.repeat(np.arange(b.num_rows), counts)
            columns = [hashes.view(np.int64), np.asarray(b.column("doc_id"))[owner], np.asarray(b.column("component"))[owner], counts[owner]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "item", "component", "size"])

    return rare_prefix_pairs(documents.mapInArrow(shingles, "token bigint, item bigint, component bigint, size bigint"), percent)


def _center_blocks(pairs: DataFrame) -> DataFrame:
    """Blocks of a class and at most about PARTNERS of the classes it is paired with."""
    degrees = pairs.groupBy("a").count()
    dealt = pairs.join(degrees, "a").withColumn("block", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / PARTNERS))))
    return dealt.select("block", F.lit(False).alias("center"), F.col("b").alias("doc_id")).unionByName(dealt.select("block", F.lit(True).alias("center"), F.col("a").alias("doc_id")).distinct())


def confirmed_links(blocks: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of pairs within the blocks that are links by their full sets: each class with the block's centre, or, without one, pairs enough to connect what is linked."""

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches):
        for group in grouped(batches, "block"):
            offsets, hashes = text_shingles(text_array(group.column("text")), width)
            sets = [hashes[offsets[i] : offsets[i + 1]] for i in range(group.num_rows)]
            ids = np.asarray(group.column("doc_id"))
            centers = np.flatnonzero(np.asarray(group.column("center")))
            found = []
            if len(centers):
                found = [(ids[c], ids[i]) for c in centers for i in range(len(ids)) if i not in centers and linked(sets[c], sets[i])]
            else:
                rows = minima(offsets, hashes)
                agree = np.array([(rows == r).mean(axis=1) for r in rows]) >= LEAST_AGREEMENT
                joined = UnionFind(len(ids))
                order = sorted(zip(*np.nonzero(np.triu(agree, 1)), strict=True), key=lambda p: p[1] - p[0])
                for i, j in order:
                    if joined.find(i) != joined.find(j) and linked(sets[i], sets[j]):
                        joined.union(i, j)
                        found.append((ids[i], ids[j]))
            if found:
                a, b = np.array(found, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    rows = blocks.join(texts, "doc_id").select("block", "center", "doc_id", "text")
    return rows.repartition(partitions(blocks.sparkSession), "block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document (doc_id, text): doc_id, mark (a hash of its text), n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= percent * union of their distinct shingles of `width` words; component_id is the
    smallest doc_id that links reach, and kept says whether the document is the first of those by doc_id, then by mark. A document of
    fewer words has one shingle, a null or blank one has none and is linked with nothing. Repeated rows each return; several texts of one
    doc_id are documents each; rows with a null doc_id are left out; an empty table gives no rows; other columns are ignored.
    """
    small_batches(documents)
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).where("doc_id IS NOT NULL")
    signatures = stored(set_signatures(documents, width), "signatures")
    classes = signatures.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    # from here on, doc_id numbers the classes
    classes = stored(classes.withColumn("doc_id", F.monotonically_increasing_id()), "classes")
    regions = stored(forest_regions(classes), "regions")
    near = classes.join(regions.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("least.doc_id").alias("least"), F.col("least.mark").alias("mark"))
    texts = stored(documents.withColumnRenamed("doc_id", "least").join(near, ["least", "mark"]).select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")
    wide = classes.select("doc_id", "n_shingles", "signature")
    walked = regions.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("members"), "region"))).where(F.col("k") <= WALKED)
    blocks = _walk_blocks(walked.join(wide, "doc_id").select("region", "tree", "doc_id", "signature"))
    links = stored(confirmed_links(blocks, texts, width, percent), "links")
    joined = connected_components(links)
    labelled = regions.join(wide, "doc_id").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = stored(_unconnected(labelled.select("region", "doc_id", "n_shingles", "signature", "component"), percent / 100), "apart")
    emptied(regions)
    pairs = stored(_prefix_pairs(texts.join(apart, "doc_id"), width, percent), "pairs")
    more = stored(confirmed_links(_center_blocks(pairs), texts, width, percent), "links")
    emptied(texts, pairs)
    components = connected_components(links.unionByName(more)) if more.head(1) else joined
    of_class = classes.select("digest", "least", "doc_id").join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", "least", F.coalesce("component", "doc_id").alias("component"))
    first = stored(of_class.groupBy("component").agg(F.min("least").alias("first")), "first")
    of_class = stored(of_class.join(first, "component").select("digest", "first"), "labels")
    alone = F.col("n_shingles") == 0
    return signatures.select("doc_id", "mark", "n_shingles", "digest").join(of_class, "digest", "left").select(
        "doc_id", "mark", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.mark") == F.col("mark")))).alias("kept")
    )


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4).drop("mark")
