"""Detection for SQL: register(spark) gives pii_spans(text), a table function for LATERAL, and pii_redact(text)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect_bytes, span_rows
from ..operators.render import redact_bytes
from ..operators.scanner import text_bytes


@F.udtf(returnType="label string, start int, `end` int, text string")
class PiiSpans:
    def eval(self, text: str):
        b = text_bytes(text or "")
        for s in span_rows(b, detect_bytes(b)):
            yield s["label"], s["start"], s["end"], s["text"]


@F.pandas_udf("string")
def pii_redact(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else redact_bytes(b := text_bytes(t), detect_bytes(b)).decode("utf-8", "replace") for t in texts], dtype=object)


def register(spark: SparkSession) -> None:
    spark.udtf.register("pii_spans", PiiSpans)
    spark.udf.register("pii_redact", pii_redact)
