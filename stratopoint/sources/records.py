"""Fixed-size binary records to Arrow, and the table layouts of the point formats."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import InputPartition

BATCH = 100_000


@dataclass
class Column:
    """One stored field: name, numpy type, items per record."""

    name: str
    dtype: str
    count: int = 1


@dataclass
class Layout:
    """What the header of a point file says."""

    columns: list[Column]
    points: int
    body: int                     # offset of the first record
    mode: str                     # ascii, binary, compressed or sequential
    before: list = field(default_factory=list)   # elements stored ahead of the points

    def dtype(self) -> np.dtype:
        return np.dtype([(f"f{i}", c.dtype, (c.count,)) for i, c in enumerate(self.columns)])


@dataclass
class Chunk(InputPartition):
    path: str
    start: int        # first record (binary) or first byte (ascii)
    end: int
    first_id: int = 0  # point_id of the first record
    take: int = -1     # records to read at most, -1: all


# What an integer of each stored type becomes (Spark has no unsigned types).
SPARK_TYPES = {
    "i1": T.ByteType(), "u1": T.ShortType(), "i2": T.ShortType(), "u2": T.IntegerType(), "i4": T.IntegerType(),
    "u4": T.LongType(), "i8": T.LongType(), "u8": T.DecimalType(20, 0), "f4": T.FloatType(), "f8": T.DoubleType(),
}
ARROW_TYPES = {
    "i1": pa.int8(), "u1": pa.int16(), "i2": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "u4": pa.int64(),
    "i8": pa.int64(), "u8": pa.decimal128(20, 0), "f4": pa.float32(), "f8": pa.float64(),
}


def kind(dtype: str) -> str:
    return dtype.lstrip("<>")


def chunks(path: str, n: int, stride: int, target_bytes: int) -> list[Chunk]:
    """Record ranges of about ``target_bytes``."""
    per = max(1, target_bytes // stride)
    return [Chunk(path, a, min(n, a + per), a) for a in range(0, n, per)] or [Chunk(path, 0, 0, 0)]


def to_arrow(values: np.ndarray, dtype: str) -> pa.Array:
    """Values of one field (n or n x count) as an Arrow array of the mapped type."""
    k = kind(dtype)
    target = ARROW_TYPES[k]
    if values.ndim == 2 and values.shape[1] > 1:
        flat = to_arrow(values.reshape(-1), dtype)
        return pa.FixedSizeListArray.from_arrays(flat, values.shape[1]).cast(pa.list_(target))
    v = values.reshape(-1)
    v = v.astype(v.dtype.newbyteorder("="))
    if k == "u8":
        return pa.array([int(i) for i in v], pa.uint64()).cast(target)
    return pa.array(v.astype(np.dtype(target.to_pandas_dtype())), target)


def unpack_colour(values: np.ndarray, dtype: str) -> list[np.ndarray]:
    """0x00RRGGBB held in an integer or in the bits of a float -> three channels."""
    v = values.reshape(-1)
    v = v.astype(v.dtype.newbyteorder("="))
    packed = v.astype(np.float32).view(np.uint32) if kind(dtype).startswith("f") else v.astype(np.int64)
    return [((packed >> s) & 255).astype(np.int16) for s in (16, 8, 0)]


def batches(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, BATCH):
        yield a, min(n, a + BATCH)
