"""Chat formatting with a template that is known by its output alone.

A template maps turns to a string. Rendering the turns' prefixes one after the other and comparing consecutive outputs locates each
turn's span; an output that does not begin with the one before shows a template that rewrites history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Of a concatenative template, turns before the last so many are rendered no more.
REMEMBERED = 32

_CONTROL = re.compile(r"[\\#<]")
_ROLE_CONTROL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.)*)</turn>\n", re.S)


def marked_template(turns: list[Turn]) -> str:
    """`### role: text</turn>` lines; a backslash before each backslash, # and < of a text (and : of a role) keeps control strings apart."""
    return "".join(f"### {_ROLE_CONTROL.sub(lambda m: chr(92) + m[0], role)}: {_CONTROL.sub(lambda m: chr(92) + m[0], text)}</turn>\n" for role, text in turns)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_marked(piece: str) -> tuple[Turn, tuple[int, int]]:
    """The turn that a piece of marked_template's output holds, and where in it the escaped text stands."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not the output of marked_template for one turn")
    return (unescaped(found[1]), unescaped(found[2])), found.span(2)


@dataclass
class Piece:
    """What one turn added to the output, from start on. rewrites: the output before was not kept; then text is all that follows the common part."""

    role: str
    start: int
    text: str
    rewrites: bool


def common_length(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def rendered_pieces(turns: Iterable[Turn], template: Template, concatenative: bool | None = None) -> Iterator[Piece]:
    """Renders successive prefixes and cuts the outputs where they first differ.

    concatenative: the template writes each turn by itself, whatever stands before, and nothing besides. Only then do the last turns
    stand for all: a conversation of any length is held to REMEMBERED turns, and the pieces and spans are those of the whole output. Of any
    other template each prefix is the whole conversation so far, which is held, and n turns cost n renderings. By default marked_template
    alone counts as concatenative.
    """
    if concatenative is None:
        concatenative = template is marked_template
    prefix: list[Turn] = []
    before, forgotten = "", 0
    for turn in turns:
        if concatenative and len(prefix) >= REMEMBERED:
            prefix, before, forgotten = [], "", forgotten + len(before)
        prefix.append(turn)
        now = template(list(prefix))  # a template may change its list
        kept = now.startswith(before)
        at = len(before) if kept else common_length(before, now)
        yield Piece(turn[0], forgotten + at, now[at:], not kept)
        before = now


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[Turn]]]:
    """Rows sorted by conversation, as (conv_id, its turns). The turns are a stream; a conversation is never held whole."""
    rows = ((c, r or "", t or "") for b in batches for c, r, t in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = ahead[0]

        def turns() -> Iterator[Turn]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                row = ahead[1:]
                ahead = next(rows, None)
                yield row

        yield conv, turns()


def _by_conversation(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


PIECES = "conv_id bigint, position bigint, role string, start bigint, `end` bigint, piece string, in_loss boolean, rewrites_history boolean"


def format_conversations(conversations: DataFrame, template: Template = marked_template, loss_roles: tuple[str, ...] = ("assistant",), concatenative: bool | None = None) -> DataFrame:
    """One row per turn: its position, the span [start, end) it has in the output up to this turn, the text of that span, whether it is under
    the loss mask, and whether the template rewrote what stood before. An opening that the template writes before any turn belongs to the first.

    Rows are ordered by turn, then role, then text. Null roles and texts count as empty; a null conv_id is a conversation of its own;
    repeated rows are turns like others; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for conv, turns in _conversations(batches):
            rows: list[tuple] = []
            for position, p in enumerate(rendered_pieces(turns, template, concatenative)):
                rows.append((conv, position, p.role, p.start, p.start + len(p.text), p.text, p.role in loss_roles, p.rewrites))
                if len(rows) >= 1000:
                    yield _batch(rows, names, types)
                    rows = []
            if rows:
                yield _batch(rows, names, types)

    names = ["conv_id", "position", "role", "start", "end", "piece", "in_loss", "rewrites_history"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    return _by_conversation(conversations).mapInArrow(run, PIECES)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites_history boolean"


def conversation_digests(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Formats each conversation with marked_template and reads it back: one row per conversation of digests of what was read.

    The digests are taken as the pieces come, so the longest conversation needs no more memory than REMEMBERED turns.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches):
        rows: list[tuple] = []
        for conv, turns in _conversations(batches):
            every, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            rewrites = False
            for p in rendered_pieces(turns, marked_template):
                (role, _), (start, end) = read_marked(p.text)
                text = unescaped(p.text[start:end])
                every.update(f"{role}\n{text}\n".encode())
                if role in loss_roles:
                    loss.update(text.encode())
                    loss_chars += len(text)
                n, chars, rewrites = n + 1, chars + len(p.text), rewrites or p.rewrites
            rows.append((conv, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars, rewrites))
            if len(rows) >= 5000:
                yield _batch(rows, names, types)
                rows = []
        if rows:
            yield _batch(rows, names, types)

    return _by_conversation(conversations).mapInArrow(run, DIGESTS)


#: A conversation that quotes the template's own control strings.
QUOTING = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(QUOTING).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(turns.unionByName(extra)).drop("rewrites_history")


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) AS escaped, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) AS escaped_role FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + escaped_role + 2 + escaped + 8) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
