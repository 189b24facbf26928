"""Detection of labelled byte spans in a text column, by a span provider and the rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scanner import candidates, text_bytes
from .segments import SHORT_BYTES, segment_bytes, segment_spans
from .spans import SPAN_TYPE, Span, admitted, normalized, tightened

#: A provider maps the bytes of one segment to spans within it. It must be picklable; models load lazily in the worker.
#: One that has a method many(segments) is given the segments of several texts at once.
Provider = Callable[[bytes], Sequence[Span]]
#: Bytes of text whose segments go to a provider together.
TOGETHER = 1 << 16


def provided_spans(texts: Sequence[bytes], provider: Provider | None) -> Iterator[list[Span]]:
    """For each text the provider's spans of all its segments, as offsets in the text."""
    if provider is None:
        yield from ([] for _ in texts)
        return
    many = getattr(provider, "many", None) or (lambda segments: [provider(x) for x in segments])
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= TOGETHER):
            size += len(texts[to])
            to += 1
        ranges = [(i, span) for i in range(at, to) for span in segment_spans(texts[i])]
        out: list[list[Span]] = [[] for _ in range(at, to)]
        for (i, (first, _)), found in zip(ranges, many([segment_bytes(texts[i], span) for i, span in ranges]), strict=True):
            out[i - at] += [(start + first, min(end + first, len(texts[i])), label) for start, end, label in found]
        yield from out
        at = to


def detect_many(texts: Sequence[bytes], provider: Provider | None = None, use_rules: bool = True) -> Iterator[list[Span]]:
    """detect_bytes() of each text."""
    for b, spans in zip(texts, provided_spans(texts, provider), strict=True):
        yield merged(b, spans, use_rules)


def detect_bytes(b: bytes, provider: Provider | None = None, use_rules: bool = True) -> list[Span]:
    """Sorted, disjoint spans of a text. Texts under SHORT_BYTES have space trimmed from rule spans too."""
    return next(detect_many([b], provider, use_rules))


def merged(b: bytes, spans: list[Span], use_rules: bool) -> list[Span]:
    """A provider's spans of a text and those of the rules."""
    if use_rules:
        spans = tightened(b, admitted(candidates(b), spans))
    return normalized(spans, b if len(b) < SHORT_BYTES else None)


def span_rows(b: bytes, spans: Sequence[Span]) -> list[dict]:
    return [{"label": label, "start": start, "end": end, "text": b[start:end].decode("utf-8", "replace")} for start, end, label in spans]


def spans_udf(provider: Provider | None = None, use_rules: bool = True) -> Callable[[Column | str], Column]:
    """A scalar Pandas UDF: filters and column pruning pass it on their way to the scan."""

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        data = [text_bytes(text) if text else b"" for text in texts]
        return pd.Series([span_rows(b, found) for b, found in zip(data, detect_many(data, provider, use_rules), strict=True)])

    return spans


def detect(df: DataFrame, text: str = "text", provider: Provider | None = None, use_rules: bool = True, output: str = "spans") -> DataFrame:
    """df with an array of (label, start, end, text), offsets in UTF-8 bytes, end exclusive. A null or empty text has none."""
    return df.withColumn(output, spans_udf(provider, use_rules)(F.col(text)))


def explode_spans(df: DataFrame, spans: str = "spans") -> DataFrame:
    """One row per span, with its place in the array."""
    kept = [c for c in df.columns if c != spans]
    return df.select(*kept, F.posexplode(spans).alias("span_no", "span")).select(*kept, "span_no", "span.*")


def detect_json(spans: Column) -> Column:
    return F.to_json(spans)
