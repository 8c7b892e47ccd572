"""Fixed-size row blocks as a Spark data source, ``format("rowblock")``.

A block holds rows from its first byte on and, in its last two bytes, their number, little-endian;
rows do not span blocks.  Numbers are little-endian, strings end with a zero byte.  Reading is
split into ranges of blocks, one task each; only whole ranges are held in memory.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK = 4096
#: Blocks of one task.
RANGE = 4096
NUMBERS = {T.IntegerType: "<i", T.LongType: "<q", T.FloatType: "<f", T.DoubleType: "<d"}


def encode_row(row: Sequence, kinds: Sequence[T.DataType]) -> bytes:
    out = bytearray()
    for x, kind in zip(row, kinds, strict=True):
        if x is None:
            raise ValueError("row blocks hold no nulls")
        if isinstance(kind, T.StringType):
            raw = x.encode()
            if b"\0" in raw:
                raise ValueError("row blocks hold no strings with a zero byte")
            out += raw + b"\0"
        else:
            out += struct.pack(NUMBERS[type(kind)], x)
    return bytes(out)


def encode_blocks(rows: Iterator[Sequence], kinds: Sequence[T.DataType], size: int = BLOCK) -> Iterator[bytes]:
    body, count = bytearray(), 0

    def block() -> bytes:
        return bytes(body) + bytes(size - 2 - len(body)) + struct.pack("<H", count)

    for row in rows:
        raw = encode_row(row, kinds)
        if len(raw) > size - 2:
            raise ValueError(f"a row of {len(raw)} bytes does not fit a block of {size}")
        if len(body) + len(raw) > size - 2 or count == 0xFFFF:
            yield block()
            body, count = bytearray(), 0
        body += raw
        count += 1
    if count:
        yield block()


def decode_block(block: bytes, kinds: Sequence[T.DataType], columns: list[list]) -> None:
    """Append a block's rows to ``columns``."""
    (count,) = struct.unpack_from("<H", block, len(block) - 2)
    at = 0
    for _ in range(count):
        for kind, column in zip(kinds, columns, strict=True):
            if isinstance(kind, T.StringType):
                end = block.index(b"\0", at, len(block) - 2)
                column.append(block[at:end].decode())
                at = end + 1
            else:
                code = NUMBERS[type(kind)]
                column.append(struct.unpack_from(code, block, at)[0])
                at += struct.calcsize(code)


class Blocks(InputPartition):
    def __init__(self, path: str, first: int, end: int) -> None:
        self.path, self.first, self.end = path, first, end


class RowBlockReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.fields, self.path, self.size = schema.fields, options["path"], int(options.get("blocksize", BLOCK))

    def partitions(self) -> Sequence[InputPartition]:
        files = [os.path.join(self.path, f) for f in sorted(os.listdir(self.path)) if f.endswith(".blocks")] if os.path.isdir(self.path) else [self.path]
        out = []
        for f in files:
            n = os.path.getsize(f) // self.size
            out += [Blocks(f, i, min(n, i + RANGE)) for i in range(0, n, RANGE)]
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [f.dataType for f in self.fields]
        names, types = [f.name for f in self.fields], [to_arrow_type(k) for k in kinds]
        if partition.first == partition.end:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.first * self.size)
            for at in range(partition.first, partition.end, 256):
                columns: list[list] = [[] for _ in kinds]
                for _ in range(at, min(at + 256, partition.end)):
                    decode_block(f.read(self.size), kinds, columns)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


class RowBlockWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.kinds, self.path, self.size, self.overwrite = [f.dataType for f in schema.fields], options["path"], int(options.get("blocksize", BLOCK)), overwrite

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        with open(name, "wb") as f:
            for block in encode_blocks(iterator, self.kinds, self.size):
                f.write(block)
        return Written(name, context.partitionId())

    def commit(self, messages: list) -> None:
        if self.overwrite:
            for f in os.listdir(self.path):
                if f.endswith(".blocks"):
                    os.remove(os.path.join(self.path, f))
        taken = len([f for f in os.listdir(self.path) if f.endswith(".blocks")])
        for m in messages:
            if m is not None:
                os.replace(m.name, os.path.join(self.path, f"part-{taken + m.part:05d}.blocks"))

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.name):
                os.remove(m.name)


class Written(WriterCommitMessage):
    def __init__(self, name: str, part: int) -> None:
        self.name, self.part = name, part


class RowBlockSource(DataSource):
    """Options: path, a file or a folder of .blocks files on a shared file system; blocksize."""

    @classmethod
    def name(cls) -> str:
        return "rowblock"

    def schema(self) -> T.StructType:
        raise ValueError("row blocks do not describe themselves: give a schema")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return RowBlockReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return RowBlockWriter(schema, self.options, overwrite)
