"""The surprise gate over ordered error streams, one stream per key.

State: moving mean m and variance v with step s, count, last error.  The first error sets m; later ones
d = e - m, m += s d, v = (1 - s)(v + s d d).  A row retrieves while fewer than warmup errors have been seen,
and after that if its error (or, causally, the error before it) exceeds m + lam sqrt(v) of the state before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


@dataclass(frozen=True)
class Surprise:
    smoothing: float = 0.1
    lam: float = 1.5
    warmup: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.smoothing <= 1:
            raise ValueError("smoothing must be in (0, 1]")
        if self.warmup < 0:
            raise ValueError("warmup must not be negative")


def _gate_rows(setting: Surprise, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, lam, warm = setting.smoothing, setting.lam, setting.warmup
        current, m, v, n, last = (), 0.0, 0.0, 0, 0.0
        for batch in batches:
            keys, errors = batch.column("key").to_pylist(), batch.column("error").to_pylist()
            means, deviations, counts, now, causal = [], [], [], [], []
            for k, e in zip(keys, errors, strict=True):
                if (k,) != current:
                    current, m, v, n, last = (k,), 0.0, 0.0, 0, 0.0
                deviation = math.sqrt(v)
                limit, free = m + lam * deviation, n == 0 or n < warm
                means.append(m)
                deviations.append(deviation)
                counts.append(n)
                now.append(free or e > limit)
                causal.append(free or last > limit)
                d = e - m
                m, v = (e, 0.0) if n == 0 else (m + s * d, (1 - s) * (v + s * d * d))
                n, last = n + 1, e
            state = [pa.array(x, f.type) for x, f in zip((means, deviations, counts, now, causal), list(schema)[3:], strict=True)]
            yield pa.record_batch([*(batch.column(c) for c in ("key", "ord", "error")), *state], schema=schema)

    return run


def gate(stream: DataFrame, setting: Surprise = Surprise(), key: str = "key", order: str = "ord", error: str = "error") -> DataFrame:
    """(key, ord, error, ema_mean, ema_std, count, retrieve, retrieve_causal): the state before each row and both decisions.

    Rows are dealt by key and sorted within partitions; a task passes over its rows once and holds the state of
    one key, so the time is linear in the rows and the memory that of an Arrow batch, however long a key's
    stream is.  A key is a stream, sequential by definition.  Rows without an error are no part of a stream."""
    rows = stream.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(error).cast("double").alias("error")).where("error is not null")
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, t) for c, t in (("ema_mean", T.DoubleType()), ("ema_std", T.DoubleType()), ("count", T.IntegerType()), ("retrieve", T.BooleanType()), ("retrieve_causal", T.BooleanType())))])
    return rows.repartition("key").sortWithinPartitions("key", "ord", "error").mapInArrow(_gate_rows(setting, to_arrow_schema(schema)), schema)
