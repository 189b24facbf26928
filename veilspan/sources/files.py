"""Text, tokenizer and evaluation files, and the sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokenizer import LONGEST_TOKEN, Tokenizer, byte_alphabet, token_bytes

EVAL_SCHEMA = "text string, spans array<struct<label:string,start:int,end:int,text:string>>, lang string"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): one row per file, doc_id by path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def text_frame(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def read_eval(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Samples with their true spans; blank lines don't count."""
    rows = spark.read.schema(EVAL_SCHEMA).json(path).where("text IS NOT NULL")
    return rows if limit is None else rows.limit(limit)


def write_eval(samples: DataFrame, path: str) -> None:
    samples.select("text", "spans", "lang").write.json(path)


def read_tokenizer(spark: SparkSession, path: str, size: int | None = None) -> Tokenizer:
    """From a byte-level tokenizer.json whose merges are ignored. Special added tokens come first, in file order."""
    import json

    found = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one file
    model = found.get("model", found)
    if not model.get("ignore_merges", found.get("ignore_merges")):
        raise ValueError("the tokenizer needs ignore_merges: true")
    alphabet = byte_alphabet()
    vocabulary = {token_bytes(t, alphabet): i for t, i in model["vocab"].items() if len(t) <= LONGEST_TOKEN}
    specials = [(t["content"].encode(), t["id"]) for t in found.get("added_tokens", []) if t.get("special")]
    return Tokenizer(vocabulary, specials, size)


def vocabulary_frame(spark: SparkSession, tokenizer: Tokenizer) -> DataFrame:
    rows = [(bytearray(t), i, False) for t, i in tokenizer.vocabulary.items()] + [(bytearray(t), i, True) for t, i in tokenizer.specials]
    return spark.createDataFrame(rows, "token binary, id int, special boolean")


def write_redacted(df: DataFrame, path: str, column: str = "redacted") -> None:
    df.select(column).write.text(path)


def write_spans(df: DataFrame, path: str, spans: str = "spans") -> None:
    """One JSON array of spans (or tokens) per row."""
    df.select(F.to_json(spans).alias("value")).write.text(path)


def write_masked(df: DataFrame, path: str, masked: str = "masked") -> None:
    df.select(f"{masked}.*").write.json(path)
