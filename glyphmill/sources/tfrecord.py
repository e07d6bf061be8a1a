"""A data source for record files of length-prefixed, checksummed Example messages.

spark.dataSource.register(RecordSource); spark.read.format("records").load(folder) gives id (file__place) and
data; df.write.format("records").save(folder) writes the binary column data. example and parse_example turn
features into messages and back.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _table()


def _slices(n: int) -> np.ndarray:
    """Contribution of a byte with k bytes after it, for k below n."""
    out = np.zeros((n, 256), np.uint32)
    out[0] = _TABLE
    for k in range(1, n):
        out[k] = out[k - 1] >> 8 ^ out[0][out[k - 1] & 255]
    return out


_BLOCK = 512
_SLICES = _slices(_BLOCK)


def crc32c(data: bytes) -> int:
    """Blocks at once: the state is mixed into a block's first bytes, then each byte contributes by its place."""
    crc, values = 0xFFFFFFFF, np.frombuffer(data, np.uint8)
    for start in range(0, len(values), _BLOCK):
        block = values[start : start + _BLOCK].astype(np.int64)
        if len(block) < 4:
            for b in block.tolist():
                crc = crc >> 8 ^ _TABLE[(crc ^ b) & 255]
        else:
            block[:4] ^= np.frombuffer(struct.pack("<I", crc), np.uint8)
            crc = int(np.bitwise_xor.reduce(_SLICES[np.arange(len(block) - 1, -1, -1), block]))
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def records(path: str) -> Iterator[bytes]:
    """The records of a file; a wrong checksum or a cut record is an error."""
    with open(path, "rb") as f:
        while head := f.read(12):
            if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
                raise ValueError(f"broken record length in {path}")
            (size,) = struct.unpack("<Q", head[:8])
            body = f.read(size + 4)
            if len(body) < size + 4 or struct.unpack("<I", body[size:])[0] != masked(body[:size]):
                raise ValueError(f"broken record in {path}")
            yield body[:size]


def _varint(n: int) -> bytes:
    out, n = b"", n & (1 << 64) - 1
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def example(features: dict[str, list[bytes] | list[int] | list[float]]) -> bytes:
    """A message of named lists of bytes, whole numbers or floats."""
    entries = b""
    for name, values in features.items():
        if values and isinstance(values[0], int):
            body = _field(3, _field(1, b"".join(map(_varint, values))))
        elif values and isinstance(values[0], float):
            body = _field(2, _field(1, struct.pack(f"<{len(values)}f", *values)))
        else:
            body = _field(1, b"".join(_field(1, v) for v in values))
        entries += _field(1, _field(1, name.encode()) + _field(2, body))
    return _field(1, entries)


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif key & 7 == 5:
            yield key >> 3, data[at : at + 4]
            at += 4
        else:
            raise ValueError("unknown field type")


def parse_example(data: bytes) -> dict[str, list]:
    out: dict[str, list] = {}
    for _, features in _fields(data):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            values: list = []
            for kind, body in _fields(parts.get(2, b"")):
                for _, v in _fields(body):
                    if kind == 1:
                        values.append(v)
                    elif kind == 2:
                        values += struct.unpack(f"<{len(v) // 4}f", v)
                    elif isinstance(v, int):
                        values.append(v - (1 << 64) if v >> 63 else v)
                    else:
                        values += [n - (1 << 64) if n >> 63 else n for n in _packed(v)]
            out[parts[1].decode()] = values
    return out


def _packed(data: bytes) -> Iterator[int]:
    n = shift = 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b < 128:
            yield n
            n = shift = 0


@dataclass
class FilePart(InputPartition):
    path: str


class RecordReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        found = sorted(glob.glob(os.path.join(self.path, "*.tfrecord*"))) if os.path.isdir(self.path) else [self.path]
        return [FilePart(p) for p in found]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        name = os.path.basename(partition.path)
        for place, data in enumerate(records(partition.path)):
            yield f"{name}__{place}", data


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    rows: int


class RecordWriter(DataSourceWriter):
    """Each task writes a temporary file; the commit renames them to shards."""

    def __init__(self, path: str, column: int):
        self.path, self.column = path, column

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name, n = os.path.join(self.path, f".{uuid.uuid4().hex}.tmp"), 0
        with open(name, "wb") as out:
            for row in rows:
                out.write(framed(bytes(row[self.column])))
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None and m.rows]
        for m in messages:
            if m is not None and not m.rows:
                os.unlink(m.temporary)
        for i, m in enumerate(done):
            os.replace(m.temporary, os.path.join(self.path, f"dataset-train.tfrecord-{i:05d}-of-{len(done):05d}"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.temporary):
                os.unlink(m.temporary)


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        return "id string, data binary"

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(self.options["path"], schema.fieldNames().index("data"))
