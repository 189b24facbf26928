"""Pairs of sets that share one of the rarest tokens which any two similar ones must share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions


def grouped(batches, key: str):
    """Tables of the rows of one key each, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = np.asarray(batch.column(key))
        if not len(values):
            continue
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        if held and np.asarray(held[-1].column(key))[-1] != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for cut in cuts:
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def runs(batches, key: str):
    """Tables of whole keys, of about a batch each, from batches sorted by the key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = np.asarray(batch.column(key))
        if not len(values):
            continue
        last = int(np.searchsorted(values, values[-1]))
        if held and (last or np.asarray(held[-1].column(key))[-1] != values[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def similar_steps(token: np.ndarray, size: np.ndarray, position: np.ndarray, away, percent: int, steps: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows, sorted by token and size, that share a token and pass the length and positional filters and the bound on how many
    tokens they differ in, of which away(a, b) says the least number: those that stand 1, 2, .. rows apart, in turn, with that number.
    After `steps` of them, come the rows that still have others further on, with themselves."""
    token, size, position = token.astype(np.int64), size.astype(np.int64), position.astype(np.int64)
    # the smaller set of a pair meets the other within a shorter prefix
    active = np.flatnonzero(position <= size - -(-2 * percent * size // (100 + percent)))
    shift = 0
    while len(active):
        shift += 1
        active = active[active + shift < len(token)]
        other = active + shift
        alike = (token[other] == token[active]) & (100 * size[active] >= percent * size[other])
        active, other = active[alike], other[alike]
        if steps is not None and shift > steps:
            yield active, active, np.zeros(len(active), dtype=np.int64)
            return
        both = size[active] + size[other]
        needed = -(-percent * both // (100 + percent))
        reachable = np.minimum(size[active] - position[active], size[other] - position[other])
        kept = np.flatnonzero(reachable >= needed)
        bits = away(active[kept], other[kept])
        near = bits <= (both - 2 * needed)[kept]
        yield active[kept[near]], other[kept[near]], bits[near]


def similar_candidates(token: np.ndarray, size: np.ndarray, position: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of similar_steps(), by parity sketches of 64 bits."""
    found = [(np.zeros(0, dtype=np.int64),) * 3, *similar_steps(token, size, position, lambda a, b: np.bitwise_count(sketch[a] ^ sketch[b]).astype(np.int64), percent)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def rare_prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of items of different components that may be similar, from rows (token, item, component, size): an item's distinct tokens.

    Tokens are ordered by their exact count among the items. A token of one item alone can't be shared; such tokens only take the first
    places of its order, so an item that has too many of them meets nobody.
    """

    def pairs(batches):
        for group in runs(batches, "token"):
            token, size, position = (np.asarray(group.column(c)) for c in ("token", "size", "position"))
            a, b = similar_candidates(np.unique(token, return_inverse=True)[1], size, position, np.zeros(len(token), dtype=np.uint64), percent)
            component, items = np.asarray(group.column("component")), np.asarray(group.column("item"))
            apart = component[a] != component[b]
            x, y = items[a[apart]], items[b[apart]]
            found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    shared = rows.withColumn("count", F.count("*").over(Window.partitionBy("token"))).where("count > 1")
    of_item = Window.partitionBy("item")
    placed = shared.withColumn("position", F.col("size") - F.count("*").over(of_item) + F.row_number().over(of_item.orderBy("count", "token")) - 1)
    prefix = placed.where(F.col("position") <= F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100)).select("token", "item", "component", "size", "position")
    return prefix.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token", "size").mapInArrow(pairs, "a bigint, b bigint").distinct()
