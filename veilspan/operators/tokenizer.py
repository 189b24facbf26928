"""Longest-match tokenization over bytes with a byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..llm.common import slices
from .scanner import text_bytes

TOKEN_TYPE = "array<struct<id:int,start:int,end:int,text:string>>"
LONGEST_TOKEN = 256
#: Texts are turned into tokens in slices of about this many bytes.
SLICE_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(token: str, alphabet: dict[str, int]) -> bytes:
    return bytes(alphabet[c] for c in token)


class Tokenizer:
    """At each place the first special token that fits, in order, else the longest token of the vocabulary. Specials are (text, id)."""

    def __init__(self, vocabulary: dict[bytes, int], specials: list[tuple[bytes, int]] = (), size: int | None = None):
        for token, i in vocabulary.items():
            if not 0 < len(token) <= LONGEST_TOKEN or i < 0 or (size is not None and i >= size):
                raise ValueError(f"token {token!r} with id {i} is out of bounds")
        self.vocabulary, self.specials = vocabulary, list(specials)
        lengths: dict[bytes, set[int]] = {}
        for token in vocabulary:
            lengths.setdefault(token[:2], set()).add(len(token))
        #: By the first two bytes, the lengths of tokens that begin so, longest first.
        self.lengths = {start: tuple(sorted(found, reverse=True)) for start, found in lengths.items() if len(start) == 2}
        #: The same starts as a table by both bytes, and the ids of single bytes (-1 for none).
        self.begins, self.single = np.zeros(1 << 16, dtype=bool), np.full(256, -1, dtype=np.int64)
        self.begins[[s[0] << 8 | s[1] for s in self.lengths]] = True
        for token, i in vocabulary.items():
            if len(token) == 1:
                self.single[token[0]] = i

    def __call__(self, b: bytes) -> list[tuple[int, int, int]]:
        """(id, start, end) that cover the bytes; a byte that no token begins with is an error."""
        out, at, known, lengths = [], 0, self.vocabulary.get, self.lengths.get
        while at < len(b):
            end, found = at, None
            for token, i in self.specials:
                if token and b.startswith(token, at):
                    end, found = at + len(token), i
                    break
            else:
                for n in lengths(b[at : at + 2], ()):
                    found = known(b[at : at + n])
                    if found is not None:
                        end = min(at + n, len(b))
                        break
                if found is None:
                    end, found = at + 1, known(b[at : at + 1])
            if found is None:
                raise ValueError(f"no token begins at byte {at}")
            out.append((found, at, end))
            at = end
        return out

    def arrays(self, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same as arrays of ids, starts and ends. Bytes that begin no longer token are looked up all at once."""
        data = np.frombuffer(b, dtype=np.uint8)
        places = np.flatnonzero(self.begins[data[:-1].astype(np.uint16) << 8 | data[1:]])
        if self.specials or 2 * len(places) > len(b):
            return tuple(np.array(self(b), dtype=np.int64).reshape(-1, 3).T)
        at, longer, known, lengths = 0, [], self.vocabulary.get, self.lengths
        for i in places.tolist():
            if i >= at:
                for n in lengths[b[i : i + 2]]:
                    if (found := known(b[i : i + n])) is not None:
                        at = min(i + n, len(b))
                        longer.append((found, i, at))
                        break
        ids, size, inside = self.single[data], np.ones(len(b), dtype=np.int64), np.zeros(len(b) + 1, dtype=np.int8)
        if longer:
            found, first, last = np.array(longer, dtype=np.int64).T
            ids[first], size[first] = found, last - first
            inside[first + 1], inside[last] = 1, -1
        starts = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) == 0)
        ids, ends = ids[starts], starts + size[starts]
        if len(ids) and ids.min() < 0:
            raise ValueError(f"no token begins at byte {starts[ids < 0][0]}")
        return ids, starts, ends

    def parts(self, texts: Sequence[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
        """arrays() of each text, as 32-bit numbers; None for one that has a byte with which no token begins."""
        out = []
        for b in texts:
            try:
                out.append(tuple(x.astype(np.int32) for x in self.arrays(b)))
            except ValueError:
                out.append(None)
        return out


_NONE = (np.zeros(0, dtype=np.int32),) * 3


def _lists(parts: Sequence, values: pa.Array) -> pa.Array:
    ends = np.cumsum([0, *(len(p[0]) if p else 0 for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([p is None for p in parts], pa.bool_()))


def _pieces(data: bytes, starts: np.ndarray) -> pa.Array:
    """Texts of tokens that lie end to end in the data; each distinct one is decoded once."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return pa.array([x.decode("utf-8", "replace") for x in found.dictionary.to_pylist()], pa.string()).take(found.indices)


def _sliced(batches: Iterator[pa.Array]) -> Iterator[list[bytes]]:
    """The texts, about SLICE_BYTES at a time: their tokens take many times as much."""
    for x in slices((pa.record_batch([texts], ["text"]) for texts in batches), limit=SLICE_BYTES):
        yield [text_bytes(t or "") for t in x.column("text").to_pylist()]


def tokens_udf(tokenizer: Tokenizer) -> Callable[[Column | str], Column]:
    @F.arrow_udf(TOKEN_TYPE)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for data in _sliced(batches):
            parts = tokenizer.parts(data)
            own, whole = [p or _NONE for p in parts], [b if p else b"" for b, p in zip(data, parts, strict=True)]
            ids, starts, ends = (np.concatenate(x) for x in zip(_NONE, *own, strict=True))
            first = np.cumsum([0, *map(len, whole)])
            pieces = _pieces(b"".join(whole), starts + np.repeat(first[:-1], [len(p[0]) for p in own]))
            yield _lists(parts, pa.StructArray.from_arrays([pa.array(ids), pa.array(starts), pa.array(ends), pieces], names=["id", "start", "end", "text"]))

    return tokens


def tokens(df: DataFrame, tokenizer: Tokenizer, text: str = "text", output: str = "tokens") -> DataFrame:
    """df with an array of (id, start, end, text) of the text's bytes; null has none, and a text with a byte with which no token begins gets null."""
    return df.withColumn(output, tokens_udf(tokenizer)(F.col(text)))


def token_ids(df: DataFrame, tokenizer: Tokenizer, text: str = "text", output: str = "tokens") -> DataFrame:
    """df with an array of the ids alone; null for a text that has a byte with which no token begins."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for data in _sliced(batches):
            parts = tokenizer.parts(data)
            yield _lists(parts, pa.array(np.concatenate([_NONE[0], *((p or _NONE)[0] for p in parts)])))

    return df.withColumn(output, ids(F.col(text)))
