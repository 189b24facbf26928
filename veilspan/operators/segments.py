"""Sentence-like segments of a text, by bytes, for the span model; short texts are one segment."""

from __future__ import annotations

import re

from ..functions.patterns import SPACE

SHORT_BYTES = 256
# Abbreviations after which a full stop ends no sentence (besides any single letter).
ABBREVIATIONS = ["Dr", "Mr", "Ms", "St", "Jr", "Sr", "vs", "No", "Mrs", "Ave", "Inc", "Prof", "Blvd", "Corp"]

_STOP = re.compile(rb"[\n\r]|[?!](?= )|\.(?= [A-Z])")
_LETTERS = re.compile(rb"[A-Za-z]*\Z")


def _abbreviated(b: bytes, start: int, stop: int) -> bool:
    word = _LETTERS.search(b[max(start, stop - 5) : stop])[0]
    return len(word) == 1 or word.decode() in ABBREVIATIONS


def segment_spans(b: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the segments. A segment ends after `?` or `!` before a space, after `.` before a space and a capital unless it
    abbreviates, or before a line end; space around it doesn't belong to it."""
    if len(b) < SHORT_BYTES:
        return [(0, len(b))] if b else []
    out = []
    start = 0
    while start < len(b):
        while start < len(b) and b[start] in SPACE:
            start += 1
        end, at = len(b), start
        while m := _STOP.search(b, at):
            if m[0] == b"." and _abbreviated(b, start, m.start()):
                at = m.end()
                continue
            end = m.start() if m[0] in b"\n\r" else m.end()
            break
        last = end
        while last > start and b[last - 1] in SPACE:
            last -= 1
        if last > start:
            out.append((start, last))
        start = max(end, start + 1) if start < len(b) else start
    return out


def segment_bytes(b: bytes, span: tuple[int, int]) -> bytes:
    """What the model sees of a segment: a segment of a long text ends with a line end."""
    return b[span[0] : span[1]] + (b"" if len(b) < SHORT_BYTES else b"\n")
