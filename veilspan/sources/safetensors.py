"""Tensor files: 8 bytes of header length, a JSON header, then the payload; BF16 and F32."""

from __future__ import annotations

import json
import struct
from collections import OrderedDict
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LARGEST_RANK = 4
_BYTES = {"BF16": 2, "F32": 4}


class TensorEntry(NamedTuple):
    name: str
    dtype: str
    shape: list[int]
    offset: int
    nbytes: int


def tensor_entries(path: str | Path) -> list[TensorEntry]:
    """The file's tensors by name; offsets from the file's start. Other kinds, ranks over 4 and sizes that don't agree are errors."""
    with open(path, "rb") as f:
        (length,) = struct.unpack("<Q", f.read(8))
        header = json.loads(f.read(length))
    out = []
    for name, entry in header.items():
        if name == "__metadata__":
            continue
        start, end = entry["data_offsets"]
        if entry["dtype"] not in _BYTES or len(entry["shape"]) > LARGEST_RANK:
            raise ValueError(f"{name}: {entry['dtype']} of rank {len(entry['shape'])} is not supported")
        if int(np.prod(entry["shape"], dtype=np.int64)) * _BYTES[entry["dtype"]] != end - start:
            raise ValueError(f"{name}: its shape and its offsets disagree")
        out.append(TensorEntry(name, entry["dtype"], list(entry["shape"]), 8 + length + start, end - start))
    return sorted(out)


def bf16_to_f32(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((*raw.shape, 2), dtype="<u2")
    out[..., 1] = raw  # the upper half of each number
    return out.view("<f4")[..., 0]


class TensorFile(Mapping):
    """Tensors by name, mapped from the file and decoded when asked for; rows cost no more than themselves. What was decoded last stays, up to `kept` bytes."""

    def __init__(self, path: str | Path, kept: int = 512 << 20):
        self.path, self.kept = str(path), kept
        self.entries = {e.name: e for e in tensor_entries(path)}
        self.mappings: dict[str, np.ndarray] = {}
        self.decoded: OrderedDict[tuple[str, int | None], np.ndarray] = OrderedDict()
        self.held = 0

    def shape(self, name: str) -> list[int]:
        return self.entries[name].shape

    def mapped(self, name: str) -> np.ndarray:
        if name not in self.mappings:
            e = self.entries[name]
            self.mappings[name] = np.memmap(self.path, dtype="<u2" if e.dtype == "BF16" else "<f4", mode="r", offset=e.offset, shape=tuple(e.shape)).view(np.ndarray)
        return self.mappings[name]

    def rows(self, name: str, index) -> np.ndarray:
        """Part of a tensor along its first axis; that of a single number is kept."""
        if isinstance(index, int):
            return self._kept(name, index)
        raw = self.mapped(name)[index]
        return bf16_to_f32(raw) if raw.dtype == np.uint16 else np.asarray(raw)

    def _kept(self, name: str, index: int | None) -> np.ndarray:
        key = name, index
        if key in self.decoded:
            self.decoded.move_to_end(key)
            return self.decoded[key]
        raw = self.mapped(name) if index is None else self.mapped(name)[index]
        out = bf16_to_f32(raw) if raw.dtype == np.uint16 else raw
        self.decoded[key] = out
        self.held += out.nbytes
        while self.held > self.kept and len(self.decoded) > 1:
            self.held -= self.decoded.popitem(last=False)[1].nbytes
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        return self._kept(name, None)

    def __iter__(self) -> Iterator[str]:
        return iter(self.entries)

    def __len__(self) -> int:
        return len(self.entries)


def write_tensors(path: str | Path, tensors: Mapping[str, np.ndarray], bf16: bool = False) -> None:
    header, blobs, at = {}, [], 0
    for name, x in tensors.items():
        raw = (x.astype("<f4").view("<u4") >> 16).astype("<u2") if bf16 else x.astype("<f4")
        blobs.append(raw.tobytes())
        header[name] = {"dtype": "BF16" if bf16 else "F32", "shape": list(x.shape), "data_offsets": [at, at + len(blobs[-1])]}
        at += len(blobs[-1])
    head = json.dumps(header).encode()
    Path(path).write_bytes(struct.pack("<Q", len(head)) + head + b"".join(blobs))


class SafetensorsSource(DataSource):
    """spark.read.format("safetensors").load(path): a row per tensor (name, dtype, shape, offset, nbytes). The file is one that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "safetensors"

    def schema(self) -> str:
        return "name string, dtype string, shape array<bigint>, offset bigint, nbytes bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        for e in tensor_entries(self.path):
            yield tuple(e)
