"""Precision, recall and F1 of predicted spans against true ones."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import Provider, detect_bytes, span_rows
from .scanner import text_bytes
from .spans import SPAN_TYPE, iou

LEAST_IOU = 0.5


def match_spans(truth: DataFrame, predicted: DataFrame, threshold: float = LEAST_IOU) -> DataFrame:
    """(doc_id, truth_no, predicted_no) pairs of spans (doc_id, span_no, label, start, end) of equal label and an IoU of the threshold or more.

    True spans are taken in order, and each takes the first predicted one that fits and that none before it has taken.
    """
    t = truth.select("doc_id", "label", F.col("span_no").alias("truth_no"), F.col("start").alias("ts"), F.col("end").alias("te"))
    p = predicted.select("doc_id", "label", F.col("span_no").alias("predicted_no"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    near = t.join(p, ["doc_id", "label"]).where(iou(F.col("ts"), F.col("te"), F.col("ps"), F.col("pe")) >= threshold)
    pairs = near.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list(F.struct("truth_no", "predicted_no"))).alias("pairs"))  # those of a document
    free = lambda taken, x: ~F.exists(taken, lambda y: (y["truth_no"] == x["truth_no"]) | (y["predicted_no"] == x["predicted_no"]))
    taken = F.aggregate("pairs", F.slice("pairs", 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return pairs.select("doc_id", F.explode(taken).alias("x")).select("doc_id", "x.truth_no", "x.predicted_no")


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


def evaluate(truth: DataFrame, predicted: DataFrame, by: list[str] | None = None, threshold: float = LEAST_IOU) -> DataFrame:
    """One row per group (columns of both, such as label or lang; none: overall) with tp, fp, fn, precision, recall and f1.

    Documents without predictions, failed ones among them, count all their true spans as missed.
    """
    by = by or []
    matched = match_spans(truth, predicted, threshold)
    t = truth.join(matched.select("doc_id", F.col("truth_no").alias("span_no"), F.lit(1).alias("hit")), ["doc_id", "span_no"], "left")
    p = predicted.join(matched.select("doc_id", F.col("predicted_no").alias("span_no"), F.lit(1).alias("hit")), ["doc_id", "span_no"], "left")
    zero = F.lit(0)
    rows = t.select(*by, F.coalesce("hit", zero).alias("tp"), zero.alias("fp"), (1 - F.coalesce("hit", zero)).alias("fn")).unionByName(p.select(*by, zero.alias("tp"), (1 - F.coalesce("hit", zero)).alias("fp"), zero.alias("fn")))
    sums = rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), zero.cast("bigint")).alias(c) for c in ("tp", "fp", "fn")])
    return sums.select(*by, "tp", "fp", "fn", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def compare(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """F1 of two evaluations side by side, and the gain of the second; a group that one lacks counts 0 there."""
    a, b = first.select(*by, F.col("f1").alias("first_f1")), second.select(*by, F.col("f1").alias("second_f1"))
    both = a.join(b, by, "full_outer").select(*by, F.coalesce("first_f1", F.lit(0.0)).alias("first_f1"), F.coalesce("second_f1", F.lit(0.0)).alias("second_f1"))
    return both.withColumn("gain", F.col("second_f1") - F.col("first_f1"))


PREDICTION = f"spans {SPAN_TYPE}, error string, ms double"


def predict(samples: DataFrame, provider: Provider | None = None, use_rules: bool = True) -> DataFrame:
    """samples (text and other columns) without the text, with the spans of each, or the error that it ended in, and the milliseconds that it took. A null text has no spans."""

    @F.pandas_udf(f"struct<{PREDICTION.replace('spans ', 'spans:', 1).replace('error ', 'error:').replace('ms ', 'ms:')}>")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            began, b, spans, error = time.perf_counter(), text_bytes(text or ""), [], None
            try:
                spans = span_rows(b, detect_bytes(b, provider, use_rules))
            except Exception as e:  # one document's failure is its own
                error = f"{type(e).__name__}: {e}"
            rows.append((spans, error, (time.perf_counter() - began) * 1000))
        return pd.DataFrame(rows, columns=["spans", "error", "ms"])

    kept = [c for c in samples.columns if c not in ("text", "spans", "error", "ms")]
    return samples.select(*kept, predicted("text").alias("x")).select(*kept, "x.*")


def report(samples: DataFrame, predictions: DataFrame, threshold: float = LEAST_IOU) -> DataFrame:
    """Rows (scope, name, tp, fp, fn, precision, recall, f1) overall, by label and by language of samples (doc_id, lang, spans) against predictions (doc_id, lang, spans, error, ms).

    A document that failed counts all its true spans as missed, whatever spans it has. The overall row also has the number of samples and
    of errors and the mean and total time; the others have nulls there.
    """
    flat = lambda df: df.select("doc_id", "lang", F.posexplode("spans").alias("span_no", "s")).select("doc_id", "lang", "span_no", "s.label", "s.start", "s.end")
    truth, found = flat(samples), flat(predictions.where("error IS NULL"))
    times = predictions.agg(F.count("*").alias("samples"), F.count("error").alias("errors"), F.avg("ms").alias("avg_ms"), (F.sum("ms") / 1000).alias("total_s"))
    none = [F.lit(None).cast(t).alias(c) for c, t in times.dtypes]
    rows = evaluate(truth, found, threshold=threshold).crossJoin(times).select(F.lit("overall").alias("scope"), F.lit("").alias("name"), "tp", "fp", "fn", "precision", "recall", "f1", *times.columns)  # one row each
    for scope in ("label", "lang"):
        rows = rows.unionByName(evaluate(truth, found, [scope], threshold).select(F.lit(scope).alias("scope"), F.col(scope).alias("name"), "tp", "fp", "fn", "precision", "recall", "f1", *none))
    return rows


def write_report(rows: DataFrame, path: str) -> None:
    """A JSON object per row of a report, in one file."""
    rows.coalesce(1).sortWithinPartitions("scope", "name").write.json(path)
