"""The corpus pipeline: toxic documents go, then repeated lines, near copies and contaminated documents; the rest is packed.

Each stage takes (spark, docs, sf_dir), docs with at least doc_id and text, and works on all rows. All but the last return the columns
of docs as they are, of whatever type; n_chars, where there is one, follows the text. Several texts under one doc_id are documents each,
except that decontamination drops all of them if one has a benchmark passage; rows that repeat a doc_id and text are one document from
the second stage on, and the near-copy stage returns one of them. Rows with a null doc_id are judged for toxicity, pass the middle
stages as they are and are packed. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import stored, table
from veilspan.llm.decontamination import contamination
from veilspan.llm.line_dedup import remove_similar_lines
from veilspan.llm.near_dedup import near_duplicates
from veilspan.llm.packing import pack_documents, tokenizer_file
from veilspan.llm.toxicity import HELD_OUT, THRESHOLD, score_toxicity, train_toxicity


#: Words that a packing worker keeps: fewer than by itself, as the workers of all stages share the executors' memory.
WORDS = 150_000


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays under the threshold; the machine is fitted on labels of docs outside the held-out quarter."""
    machine = train_toxicity(docs, table(spark, sf_dir, "labels").where(f"NOT ({HELD_OUT})"))
    score = _free("toxicity_score", docs)
    return score_toxicity(docs, machine, score).where(F.col(score) < THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are similar to an earlier one; a document goes if that takes all its words. The other columns of a document meet its lines by doc_id and a hash of the text."""
    mark, kept, shorter = (_free(c, docs) for c in ("text_mark", "kept_text", "shorter"))
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = remove_similar_lines(docs.select("doc_id", "text", hashed.cast("string").alias("mark")), extra="mark").where("n_removed = 0 OR kept RLIKE '[^ \\\\t-\\\\r]'")
    lines = lines.select("doc_id", F.col("extra").cast("bigint").alias(mark), F.when(F.col("n_removed") > 0, F.col("kept")).alias(kept), (F.col("n_removed") > 0).alias(shorter)).dropDuplicates(["doc_id", mark])
    both = docs.where("doc_id IS NOT NULL").withColumn(mark, hashed).join(lines, ["doc_id", mark])
    value = {"text": F.when(F.col(shorter), F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(F.col(shorter), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    judged = both.select(*[value.get(c, _column(c)).alias(c) for c in docs.columns])
    return judged.unionByName(docs.where("doc_id IS NULL"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by doc_id, then by a hash of the text."""
    mark = _free("text_mark", docs)
    kept = near_duplicates(docs).where("kept").select("doc_id", F.col("mark").alias(mark))
    marked = docs.where("doc_id IS NOT NULL").withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    return marked.join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).drop(mark).select(*map(_column, docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id")
    return docs.join(found, "doc_id", "left_anti").select(*map(_column, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack_documents(docs, tokenizer_file(), words=WORDS)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL cannot express the stages' hashing and fitting; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
