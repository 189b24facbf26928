"""Redaction and masking of streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import OTHER_PREFIX, PREFIXES
from ..operators.detect import Provider, detect_bytes
from ..operators.render import redact, spliced
from ..operators.scanner import text_bytes


def redact_stream(messages: DataFrame, text: str = "text", provider: Provider | None = None) -> DataFrame:
    """A stream (or table) with its redacted text; no state."""
    return redact(messages, text, provider)


MASKED = "conversation string, position long, masked_text string, uids array<string>"


def mask_stream(messages: DataFrame, provider: Provider | None = None) -> DataFrame:
    """Masks messages (conversation string, position long, text string) with placeholders that are stable within each conversation.

    State per conversation: the uid of each (label, text) seen, and a count per type. Messages of a batch are taken by position.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labels, texts, uids = (list(x) for x in state.get) if state.exists else ([], [], [])
        known = {(label, text): uid for label, text, uid in zip(labels, texts, uids, strict=True)}
        counts: dict[str, int] = {}
        for label, _ in known:
            counts[label] = counts.get(label, 0) + 1
        rows = []
        messages = sorted((r for f in frames for r in zip(f["position"], f["text"], strict=True)), key=lambda r: r[0])
        for position, text in messages:
            b = text_bytes(text or "")
            spans = detect_bytes(b, provider)
            own = []
            for start, end, label in spans:
                key_of = label, b[start:end].decode("utf-8", "replace")
                if key_of not in known:
                    counts[label] = counts.get(label, 0) + 1
                    known[key_of] = f"{PREFIXES.get(label, OTHER_PREFIX)}_{counts[label]}"
                own.append(known[key_of])
            rows.append((key[0], position, spliced(b, spans, [f"<{u}>".encode() for u in own]).decode("utf-8", "replace"), own))
        state.update(([k[0] for k in known], [k[1] for k in known], list(known.values())))
        yield pd.DataFrame(rows, columns=["conversation", "position", "masked_text", "uids"])

    keyed = messages.select(F.col("conversation").cast("string"), F.col("position").cast("long"), "text")
    return keyed.groupBy("conversation").applyInPandasWithState(run, MASKED, "labels array<string>, texts array<string>, uids array<string>", "append", GroupStateTimeout.NoTimeout)
