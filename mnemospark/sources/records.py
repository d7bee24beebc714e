"""The fixed-width binary record files of single-process stores, read and written as DataFrames.

A file is a header, then records of one size: scalars (little-endian), padding to four bytes, the latent
and, if the store has actions, the action as 32-bit floats.  A torn last record is dropped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .experience import SCHEMA

# The header (magic, version, dim, action_dim or -1, record count) and the scalars of a record.
HEADER = "<4sIIiQ"
HEADER_SIZE = struct.calcsize(HEADER)
MAGIC, VERSION = b"MVKA", 1
SCALARS = (("id", "<u8"), ("episode_id", "<u8"), ("seq_no", "<u4"), ("timestamp_ns", "<u8"), ("pred_err", "<f4"), ("flags", "u1"))
ALIGN = 4


@dataclass(frozen=True)
class Layout:
    dim: int
    action_dim: int | None = None

    @property
    def dtype(self) -> np.dtype:
        scalars = np.dtype(list(SCALARS))
        pad = -scalars.itemsize % ALIGN
        fields = [*SCALARS, *([("pad", f"V{pad}")] if pad else []), ("z", "<f4", (self.dim,))]
        return np.dtype(fields + ([("action", "<f4", (self.action_dim,))] if self.action_dim else []))

    @property
    def size(self) -> int:
        return self.dtype.itemsize


def pack(rows: pd.DataFrame, layout: Layout) -> bytes:
    """Records of rows with the columns of the experience table."""
    out = np.zeros(len(rows), layout.dtype)
    for name, _ in SCALARS:
        out[name] = rows[name].to_numpy()
    for name, n in (("z", layout.dim), ("action", layout.action_dim)):
        if n:
            values = rows[name].tolist()
            if any(v is None or len(v) != n for v in values):
                raise ValueError(f"{name} must have {n} elements on every row")
            out[name] = np.array(values, np.float32).reshape(len(rows), n)
    return out.tobytes()


def unpack(data: bytes, layout: Layout, torn: bool = False) -> pd.DataFrame:
    """The rows of concatenated records; a torn tail is an error unless torn is True."""
    rest = len(data) % layout.size
    if rest and not torn:
        raise ValueError(f"{len(data)} bytes are not a whole number of records of {layout.size}")
    a = np.frombuffer(data[: len(data) - rest], layout.dtype)
    out = {name: a[name].astype(np.float64 if name == "pred_err" else np.int64) for name, _ in SCALARS}
    out["z"] = [x.astype(np.float64) for x in a["z"]]
    out["action"] = [x.astype(np.float64) for x in a["action"]] if layout.action_dim else [None] * len(a)
    return pd.DataFrame(out)


def header(layout: Layout, count: int) -> bytes:
    return struct.pack(HEADER, MAGIC, VERSION, layout.dim, layout.action_dim or -1, count)


def read_header(data: bytes) -> tuple[Layout, int]:
    if len(data) < HEADER_SIZE:
        raise ValueError("the file is shorter than its header")
    magic, version, dim, action_dim, count = struct.unpack(HEADER, data[:HEADER_SIZE])
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a record file of the known version")
    return Layout(dim, None if action_dim < 0 else action_dim), count


def read(spark: SparkSession, path: str, torn: bool = True) -> DataFrame:
    """Experience rows of the record files under path; a row that two files hold (sealed and logged) comes once."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                layout, count = read_header(data)
                out = unpack(data[HEADER_SIZE:], layout, torn)
                if count and len(out) < count:
                    raise ValueError(f"{len(out)} records of {count}")
                yield out[SCHEMA.names].astype({"flags": "int32"})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, SCHEMA).dropDuplicates(["id"])


def as_bytes(df: DataFrame, layout: Layout) -> DataFrame:
    """(id, record): each row of df as one binary record."""

    @F.pandas_udf("binary")
    def record(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([pack(rows.iloc[i : i + 1], layout) for i in range(len(rows))])

    return df.select("id", record(F.struct(*SCHEMA.names)).alias("record"))
