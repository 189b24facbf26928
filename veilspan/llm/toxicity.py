"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words and their beginnings, each hashed to one of 2^18 slots. The score is the logistic function of
a bias, a weight per slot, and the inner products of the factor vectors of all pairs of slots that occur together: pairs such as an
insult and the mention of a group count beyond the sum of their own weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, slices, small_batches, space_words, table, text_array

SLOT_BITS = 18
FACTORS = 4
#: The root of the sum of the squared shares of a text: at 1, a pair of a long text weighs too little to be learnt.
SHARE_NORM = 2
#: A slot's factors move at half speed if it occurs in so many documents, slower if in fewer: pairs of rare slots would learn their few documents by heart.
STEADY_DOCUMENTS = 200
#: Word beginnings that are terms of their own, by number of letters.
BEGINNINGS = (4, 6)
#: The machine is fitted on at most so many labelled documents: those whose ids have the smallest hashes.
FIT_DOCUMENTS = 8000
#: A slot takes part if it occurs in so many of them.
LEAST_DOCUMENTS = 3


@dataclass
class FactorizationMachine:
    """weights: of a slot's presence. factors: of its share of a text, which is SHARE_NORM times its rarity over the norm of all rarities of the text, so that long texts don't drown in pairs."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    rarity: np.ndarray

    def scores(self, offsets: np.ndarray, slots: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(offsets))
        total = np.full(n, self.bias) + np.bincount(owner, self.weights[slots], minlength=n)
        share = shares(self.rarity[slots], owner, n)
        for k in range(self.factors.shape[1]):
            own = self.factors[slots, k] * share
            total += 0.5 * (np.bincount(owner, own, minlength=n) ** 2 - np.bincount(owner, own * own, minlength=n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def shares(rarity: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    norm = np.sqrt(np.bincount(owner, rarity.astype(np.float64) ** 2, minlength=n))
    return SHARE_NORM * rarity / np.where(norm > 0, norm, 1)[owner]


def _slots(strings: pa.Array, seed: int) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(s, seed) & (1 << SLOT_BITS) - 1 for s in strings.to_pylist()), dtype=np.int64, count=len(strings))


def term_slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and, for each text, the distinct slots of its terms in ascending order."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")
    offsets, words = space_words(plain)
    n = len(texts)
    if not len(words):
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = np.asarray(words.indices).astype(np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    pairs = np.unique(owner * len(words.dictionary) + codes)  # distinct words of each text
    owner, codes = np.divmod(pairs, len(words.dictionary))
    kinds = [_slots(words.dictionary, 0)[codes]]
    for length in BEGINNINGS:
        begin = pc.dictionary_encode(pc.utf8_slice_codeunits(words.dictionary, 0, length))
        kinds.append(_slots(begin.dictionary, length)[np.asarray(begin.indices)][codes])
    keys = np.unique(np.concatenate([owner << SLOT_BITS | k for k in kinds]))
    return np.searchsorted(keys >> SLOT_BITS, np.arange(n + 1)).astype(np.int64), keys & (1 << SLOT_BITS) - 1


def fit_machine(documents: list[np.ndarray], labels: np.ndarray, epochs: int = 6, rate: float = 0.2, sparsity: float = 2.0, decay: float = 1e-2, batch: int = 32, seed: int = 7) -> FactorizationMachine:
    """Fits slot sets to labels: follow-the-regularized-leader with an L1 penalty for the weights, AdaGrad for the factors.

    The penalty leaves slots without clear evidence at zero. Slots of fewer than LEAST_DOCUMENTS documents take no part. Without both
    labels the bias alone is fitted.
    """
    size = 1 << SLOT_BITS
    machine = FactorizationMachine(0.0, np.zeros(size, dtype=np.float32), np.zeros((size, FACTORS), dtype=np.float32), np.zeros(size, dtype=np.float32))
    labels = np.asarray(labels, dtype=np.float64)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    machine.bias = float(np.log(prior / (1 - prior)))
    if not len(labels) or labels.min() == labels.max():
        return machine
    seen = np.bincount(np.concatenate(documents), minlength=size)
    frequent = seen >= LEAST_DOCUMENTS
    used = np.flatnonzero(frequent)
    rarity = np.log(len(labels) / seen[used])
    dense = np.cumsum(frequent) - 1
    rows = [dense[d[frequent[d]]].astype(np.int32) for d in documents]
    random = np.random.default_rng(seed)
    w, z, nw = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    v = random.normal(0, 0.1, (len(used), FACTORS))
    speed = rate * (seen[used] / (seen[used] + STEADY_DOCUMENTS))[:, None]
    gv, gb = np.full(v.shape, 1e-3), 1e-2
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            lengths = np.array([len(rows[i]) for i in own])
            if not lengths.sum():
                continue
            f = np.concatenate([rows[i] for i in own])
            n = len(own)
            owner = np.repeat(np.arange(n), lengths)
            x = shares(rarity[f], owner, n)
            vx = v[f] * x[:, None]
            sums = np.stack([np.bincount(owner, vx[:, k], minlength=n) for k in range(FACTORS)], axis=1)
            squares = np.bincount(owner, (vx * vx).sum(axis=1), minlength=n)
            score = machine.bias + np.bincount(owner, w[f], minlength=n) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[own]
            unique, place = np.unique(f, return_inverse=True)
            slope = np.bincount(place, error[owner])
            step = (np.sqrt(nw[unique] + slope**2) - np.sqrt(nw[unique])) / rate
            z[unique] += slope - step * w[unique]
            nw[unique] += slope**2
            zu = z[unique]
            w[unique] = np.where(np.abs(zu) <= sparsity, 0, (np.sign(zu) * sparsity - zu) / ((1 + np.sqrt(nw[unique])) / rate))
            slope = error[owner, None] * x[:, None] * (sums[owner] - vx)
            slope = np.stack([np.bincount(place, slope[:, k]) for k in range(FACTORS)], axis=1) + decay * v[unique]
            gv[unique] += slope**2
            v[unique] -= speed[unique] * slope / np.sqrt(gv[unique])
            gb += error.sum() ** 2
            machine.bias -= 0.1 * rate * error.sum() / np.sqrt(gb)
    machine.weights[used], machine.factors[used], machine.rarity[used] = w, v, rarity
    return machine


def train_toxicity(documents: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS) -> FactorizationMachine:
    """The machine for labels (doc_id, toxic) of documents (doc_id, text), fitted on at most limit labelled documents.

    Null labels don't count; of several labels of a document the highest counts, of several texts each is an example.
    """
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches):
        for b in slices(batches):
            offsets, slots = term_slots(text_array(b.column("text")))
            packed = slots.astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array([packed[offsets[i] : offsets[i + 1]].tobytes() for i in range(b.num_rows)], pa.binary())], names=["toxic", "slots"])

    joined = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # at most `limit` rows of two numbers are broadcast
    rows = joined.mapInArrow(run, "toxic int, slots binary").toArrow().sort_by([("slots", "ascending"), ("toxic", "ascending")])
    toxic, sets = np.asarray(rows.column("toxic")), [np.frombuffer(x, dtype="<i4") for x in rows.column("slots").to_pylist()]
    del rows
    machine = fit_machine(sets, toxic)
    del sets
    released()
    return machine


def score_toxicity(documents: DataFrame, machine: FactorizationMachine, output: str = "score") -> DataFrame:
    """documents with a score from 0 to 1, higher for texts that are likelier toxic. A null or empty text has the score of no terms; a column named like output is replaced; repeated rows stay. Only texts leave the JVM."""
    small_batches(documents)
    model = documents.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        parts = [model.value.scores(*term_slots(text_array(b.column("text")))) for b in slices([pa.RecordBatch.from_arrays([texts], names=["text"])])]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    kept = [F.col("`" + c.replace("`", "``") + "`") for c in documents.columns if c != output]
    return documents.select(*kept, scores(F.col("text")).alias(output))


HELD_OUT = "crc32(encode(CAST(doc_id AS STRING), 'UTF-8')) % 4 = 2"
THRESHOLD = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train_toxicity(documents, table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})"))
    scored = score_toxicity(documents, machine)
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
