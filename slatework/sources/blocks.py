"""Block files: fixed-size blocks of packed rows, the number of rows in each block's last two bytes (little-endian).

Numbers are little-endian, 4 or 8 bytes; strings are UTF-8 with a zero byte at the end, so they can't hold one. There are no
nulls. A row that doesn't fit a block raises. Encoding and decoding run on the executors, one Arrow batch at a time.
"""

from __future__ import annotations

import struct
from pathlib import Path
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import PlanError
from .catalog import catalog_type

BLOCK_SIZE = 4096
#: Struct codes of the number types.
CODES = {"Int32": "i", "Int64": "q", "Float32": "f", "Float64": "d"}
COUNT, COUNT_BYTES = "<H", 2
#: Blocks that one record of a file read holds: files are cut into records of this many blocks.
BATCH_BLOCKS = 32


def _runs(schema: T.StructType) -> list[tuple[struct.Struct | None, int]]:
    """Neighbouring numbers as one struct, strings alone (None)."""
    out: list[tuple[str, int]] = []
    for f in schema.fields:
        code = CODES.get(catalog_type(f.dataType))
        if code is None:
            out.append(("", 1))
        elif out and out[-1][0]:
            out[-1] = out[-1][0] + code, out[-1][1] + 1
        else:
            out.append((code, 1))
    return [(struct.Struct(f"<{codes}") if codes else None, n) for codes, n in out]


class RowCodec:
    def __init__(self, schema: T.StructType):
        self.runs = _runs(schema)

    def encode(self, row: tuple) -> bytes:
        out, at = [], 0
        for run, n in self.runs:
            values = row[at : at + n]
            if any(v is None for v in values):
                raise PlanError("block files hold no nulls")
            if run is None:
                data = values[0].encode()
                if b"\0" in data:
                    raise PlanError("block files hold no strings with a zero byte")
                out.append(data + b"\0")
            else:
                out.append(run.pack(*values))
            at += n
        return b"".join(out)

    def decode_block(self, block: bytes) -> list[tuple]:
        rows, at = [], 0
        for _ in range(struct.unpack_from(COUNT, block, len(block) - COUNT_BYTES)[0]):
            row: list = []
            for run, _n in self.runs:
                if run is None:
                    end = block.index(b"\0", at)
                    row.append(block[at:end].decode("utf-8", "replace"))
                    at = end + 1
                else:
                    row += run.unpack_from(block, at)
                    at += run.size
            rows.append(tuple(row))
        return rows


def encode(df: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """Blocks (part int, seq long, data binary): the rows of each partition in their order."""
    schema, names = df.schema, [f"_v{i}" for i in range(len(df.columns))]
    room = block_size - COUNT_BYTES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, held, size, seq = RowCodec(schema), [], 0, 0

        def block() -> bytes:
            return b"".join(held).ljust(room, b"\0") + struct.pack(COUNT, len(held))

        for batch in batches:
            done, part = [], 0
            for part, *row in batch.itertuples(index=False, name=None):
                data = codec.encode(tuple(row))
                if len(data) > room:
                    raise PlanError(f"a row of {len(data)} bytes doesn't fit a block of {block_size}")
                if size + len(data) > room or len(held) == 0xFFFF:
                    done.append((part, seq, block()))
                    held, size, seq = [], 0, seq + 1
                held.append(data)
                size += len(data)
            yield pd.DataFrame(done, columns=["part", "seq", "data"])
        if held:
            yield pd.DataFrame([(part, seq, block())], columns=["part", "seq", "data"])

    numbered = df.toDF(*names).select(F.spark_partition_id().alias("_part"), *names)
    return numbered.mapInPandas(run, "part int, seq bigint, data binary")


def decode(blocks: DataFrame, schema: T.StructType, block_size: int = BLOCK_SIZE, column: str = "data") -> DataFrame:
    """The rows of a binary column of one or more whole blocks."""
    names = [f"_v{i}" for i in range(len(schema))]
    plain = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, schema.fields)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = RowCodec(schema)
        for batch in batches:
            for data in batch["data"]:
                if len(data) % block_size:
                    raise PlanError(f"{len(data)} bytes aren't a multiple of the block size {block_size}")
                rows = [r for i in range(0, len(data), block_size) for r in codec.decode_block(data[i : i + block_size])]
                yield pd.DataFrame(rows, columns=names)

    return blocks.select(F.col(column).alias("data")).mapInPandas(run, plain).toDF(*schema.fieldNames())


def read(spark: SparkSession, path: str, schema: T.StructType, block_size: int = BLOCK_SIZE) -> DataFrame:
    """A block file, cut into records that tasks share."""
    records = spark.sparkContext.binaryRecords(path, block_size)
    return decode(records.map(lambda data: (bytearray(data),)).toDF("data binary"), schema, block_size)


def write(df: DataFrame, path: str | Path, block_size: int = BLOCK_SIZE) -> int:
    """One local block file; blocks stream through the driver, a partition at a time. Gives the number of blocks."""
    blocks = encode(df, block_size).select("data")
    n = 0
    with open(path, "wb") as out:
        for row in blocks.toLocalIterator():
            out.write(row[0])
            n += 1
    return n
