"""Renderings of detected spans: redacted text, reversibly masked text, and back."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import OTHER_PREFIX, PREFIXES
from .detect import Provider, detect_many
from .scanner import text_bytes
from .spans import Span

REDACTED = b"<REDACTED>"
ENTITY_TYPE = "array<struct<uid:string,label:string,text:string>>"
MASKED_TYPE = f"struct<masked_text:string,entities:{ENTITY_TYPE}>"


def spliced(b: bytes, spans: Sequence[Span], pieces: Sequence[bytes]) -> bytes:
    """b with each span replaced by its piece; a span that begins before the one before it ends is skipped."""
    out, at = [], 0
    for (start, end, _), piece in zip(spans, pieces, strict=True):
        if start < at:
            continue
        out += [b[at:start], piece]
        at = end
    return b"".join([*out, b[at:]])


def redact_bytes(b: bytes, spans: Sequence[Span]) -> bytes:
    return spliced(b, spans, [REDACTED] * len(spans))


def mask_bytes(b: bytes, spans: Sequence[Span]) -> tuple[bytes, list[tuple[str, str, str]]]:
    """Masked text and an entity (uid, label, text) per span: spans of equal label and bytes share a uid, numbered within their type by where
    the text first has the value, even inside a longer word; of two in one place the shorter goes first.

    Numbers whose placeholder the text itself has are passed over, so unmasking gives the text back whatever it holds.
    """
    firsts: dict[tuple[str, bytes], int] = {}
    for i, (start, end, label) in enumerate(spans):
        firsts.setdefault((label, b[start:end]), i)
    uids: dict[tuple[str, bytes], str] = {}
    counts: dict[str, int] = {}
    for label, value in sorted(firsts, key=lambda k: (b.find(k[1], 0, spans[firsts[k]][1]), k[1]) if k[0] in PREFIXES else (firsts[k], b"")):
        prefix = PREFIXES.get(label)
        kind = prefix or OTHER_PREFIX
        counts[kind] = counts.get(kind, 0) + 1 if prefix else max(firsts[label, value] + 1, counts.get(kind, 0) + 1)
        while f"<{kind}_{counts[kind]}>".encode() in b:
            counts[kind] += 1
        uids[label, value] = f"{kind}_{counts[kind]}"
    entities, pieces = [], []
    for start, end, label in spans:
        uid = uids[label, b[start:end]]
        entities.append((uid, label, b[start:end].decode("utf-8", "replace")))
        pieces.append(f"<{uid}>".encode())
    return spliced(b, spans, pieces), entities


def unmask_text(masked: str, entities: Sequence[tuple[str, str, str]]) -> str:
    """Each entity in turn takes the place of the first placeholder of its uid."""
    for uid, _, text in entities:
        masked = masked.replace(f"<{uid}>", text, 1)
    return masked


def redact(df: DataFrame, text: str = "text", provider: Provider | None = None, output: str = "redacted") -> DataFrame:
    """df with the redacted text; null stays null. Rules are always used."""

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        data = [text_bytes(t or "") for t in texts]
        done = (redact_bytes(b, found).decode("utf-8", "replace") for b, found in zip(data, detect_many(data, provider), strict=True))
        return pd.Series([None if t is None else x for t, x in zip(texts, done, strict=True)], dtype=object)

    return df.withColumn(output, redacted(F.col(text)))


def mask(df: DataFrame, text: str = "text", provider: Provider | None = None, output: str = "masked") -> DataFrame:
    """df with (masked_text, entities), one entity per masked span in text order; null becomes an empty text. Rules are always used."""

    @F.pandas_udf(MASKED_TYPE)
    def masked(texts: pd.Series) -> pd.DataFrame:
        rows = []
        data = [text_bytes(t or "") for t in texts]
        for b, found in zip(data, detect_many(data, provider), strict=True):
            done, entities = mask_bytes(b, found)
            rows.append((done.decode("utf-8", "replace"), [{"uid": u, "label": lab, "text": x} for u, lab, x in entities]))
        return pd.DataFrame(rows, columns=["masked_text", "entities"])

    return df.withColumn(output, masked(F.col(text)))


def replace_first(text: Column, what: Column, by: Column) -> Column:
    at = F.call_function("locate", what, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), by, F.substring(text, at + F.length(what), F.length(text)))).otherwise(text)


def unmask_column(masked: Column) -> Column:
    """The text of a masked struct, as an expression."""
    return F.aggregate(masked["entities"], masked["masked_text"], lambda acc, e: replace_first(acc, F.concat(F.lit("<"), e["uid"], F.lit(">")), e["text"]))


def unmask(df: DataFrame, masked: str = "masked", output: str = "unmasked") -> DataFrame:
    return df.withColumn(output, unmask_column(F.col(masked)))


def mask_json(masked: Column) -> Column:
    return F.to_json(masked)


def from_mask_json(text: Column) -> Column:
    return F.from_json(text, MASKED_TYPE)


def collides(text: Column) -> Column:
    """Whether a text already has something like a placeholder, which unmasking could take for one."""
    return text.rlike("<(?:" + "|".join([*PREFIXES.values(), OTHER_PREFIX]) + ")_[0-9]+>")


def scoped_uids(spans: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """Rows (scope columns, label, text, order columns) with a uid that is stable within the scope, such as a whole conversation: numbered by first appearance within the type."""
    first = spans.groupBy(*scope, "label", "text").agg(F.min(F.struct(*order)).alias("first"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy(*scope, "label").orderBy("first", "text")))
    prefix = F.coalesce(F.create_map(*[F.lit(x) for pair in PREFIXES.items() for x in pair])[F.col("label")], F.lit(OTHER_PREFIX))
    return spans.join(numbered.select(*scope, "label", "text", F.concat_ws("_", prefix, "n").alias("uid")), [*scope, "label", "text"])
