"""Span algebra: admission, tightening, order and overlap; as plain functions for the scan and as column expressions."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P
from .scanner import Candidate

Span = tuple[int, int, str]
SPAN_TYPE = "array<struct<label:string,start:int,end:int,text:string>>"


def admitted(found: Sequence[Candidate], existing: Sequence[Span] = ()) -> list[Span]:
    """existing spans and, in order, the candidates that don't overlap one (or, for those that say so, don't lie within one)."""
    out = list(existing)
    known, added = _Taken(), _Taken()
    for start, end, _ in sorted(existing, key=lambda s: s[0]):
        known.add(start, end)
    for c in found:
        before, reach = (c.start + 1, c.end) if c.within else (c.end, c.start + 1)
        if max(known.furthest(before), added.furthest(before)) < reach:
            out.append((c.start, c.end, c.label))
            added.add(c.start, c.end)
    return out


class _Taken:
    """Spans by start, with the furthest end up to each; quick to add to near the end."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.tops: list[int] = []

    def add(self, start: int, end: int) -> None:
        at = bisect_right(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        del self.tops[at:]
        for e in self.ends[at:]:
            self.tops.append(max(e, self.tops[-1]) if self.tops else e)

    def furthest(self, before: int) -> int:
        """The furthest end of the spans that start before a place."""
        at = bisect_left(self.starts, before)
        return self.tops[at - 1] if at else -1


def tightened(b: bytes, spans: Sequence[Span]) -> list[Span]:
    """E-mail spans cut down to the address around their first `@`; one at offset 0 or without a local part stays as it is."""
    out = []
    for start, end, label in spans:
        at = b.find(b"@", start, end) if label == "private_email" else -1
        if at > 0:
            local = at
            while local > start and P.LOCAL_PART.fullmatch(b, local - 1, local):
                local -= 1
            domain = P.DOMAIN_PART.match(b, at + 1, end)[0].rstrip(b".-")
            if local < at and domain:
                start, end = local, at + 1 + len(domain)
        out.append((start, end, label))
    return out


def trimmed(b: bytes, span: Span) -> Span:
    start, end, label = span
    while start < end and b[start] in P.SPACE:
        start += 1
    while end > start and b[end - 1] in P.SPACE:
        end -= 1
    return start, end, label


def normalized(spans: Sequence[Span], b: bytes | None = None) -> list[Span]:
    """Spans by start, longer first, without empty ones and those that begin before the last kept one ends; trimmed first if the text is given."""
    if b is not None:
        spans = [trimmed(b, s) for s in spans]
    out: list[Span] = []
    last = 0
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[0] < s[1] and s[0] >= last:
            out.append(s)
            last = s[1]
    return out


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (outer["end"] >= inner["end"])


def iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Intersection over hull of two spans; 0 if they are apart."""
    common = F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0))
    hull = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when(hull > 0, common / hull).otherwise(0.0)


def normalize_column(spans: Column, kind: str = "array<struct<label:string,start:int,end:int>>") -> Column:
    """normalized() as an expression over an array of (label, start, end)."""
    keyed = F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s, i: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), i.alias("i"), s.alias("span")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["span"])
    empty = F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("kept"))
    return F.aggregate(
        ordered, empty, lambda acc, s: F.when(s["start"] >= acc["last"], F.struct(s["end"].alias("last"), F.concat(acc["kept"], F.array(s)).cast(kind).alias("kept"))).otherwise(acc), lambda acc: acc["kept"]
    )


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of a text."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")
