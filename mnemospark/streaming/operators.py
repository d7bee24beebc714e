"""Structured Streaming forms: ingest with ids, the surprise gate per key, feedback joined by token.

The reference semantics have no event time; watermarks here are an extension that bounds state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.search import assign_lists
from ..operators.trigger import Surprise
from ..sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Append each micro-batch to the store with dense ids, in the given order within the batch.

    A batch's number becomes part of the store's pointer together with its rows, so that a batch that is tried
    again after a failure is skipped if it was appended, and appended once if it wasn't."""

    def append(batch: DataFrame, number: int) -> None:
        done = store.meta.get("last_batch", -1)
        if number > done and not batch.isEmpty():
            store.append_new(batch.withColumn("flags", F.lit(0)), order, {"last_batch": number})

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_lists(batch: DataFrame, centroids: DataFrame) -> DataFrame:
    """A batch with the inverted-file list of each row; centroids are static and small."""
    return assign_lists(batch, centroids)


GATE_SCHEMA = "key long, ord long, error double, ema_mean double, ema_std double, count int, retrieve boolean, retrieve_causal boolean"


def gate_stream(stream: DataFrame, setting: Surprise = Surprise()) -> DataFrame:
    """The surprise gate as keyed state over a stream (key, ord, error); rows of a batch are taken in order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m, v, n, last = state.get if state.exists else (0.0, 0.0, 0, 0.0)
        rows = pd.concat([p for p in parts if len(p)]).sort_values("ord")
        out = []
        for o, e in zip(rows["ord"], rows["error"], strict=True):
            limit, free = m + setting.lam * v**0.5, n == 0 or n < setting.warmup
            out.append((key[0], o, e, m, v**0.5, n, free or e > limit, free or last > limit))
            if n == 0:
                m, v = e, 0.0
            else:
                d = e - m
                m, v = m + setting.smoothing * d, (1 - setting.smoothing) * (v + setting.smoothing * d * d)
            n, last = n + 1, e
        state.update((float(m), float(v), int(n), float(last)))
        yield pd.DataFrame(out, columns=["key", "ord", "error", "ema_mean", "ema_std", "count", "retrieve", "retrieve_causal"])

    return stream.groupBy("key").applyInPandasWithState(step, GATE_SCHEMA, "m double, v double, n int, last double", "append", GroupStateTimeout.NoTimeout)


def feedback_stream(used: DataFrame, outcomes: DataFrame, within: str = "1 hour") -> DataFrame:
    """(id, helped): used (token, id, used_at) joined with outcomes (token, helped, told_at) by token.

    The watermark bounds how long a token waits for its verdict."""
    u = used.withWatermark("used_at", within).alias("u")
    o = outcomes.withWatermark("told_at", within).alias("o")
    near = (F.col("o.told_at") >= F.col("u.used_at")) & (F.col("o.told_at") <= F.col("u.used_at") + F.expr(f"INTERVAL {within}"))
    return u.join(o, (F.col("u.token") == F.col("o.token")) & near).select("u.id", "o.helped")
