"""Recall and error measurements, episode split, verdicts."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from .search import exact_topk, ivf_topk


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the true ids that were found; 1 for an empty truth.

    found, truth: (query_id, id); every query of truth or found has a row."""
    t = truth.groupBy("query_id").agg(F.collect_set("id").alias("t"))
    f = found.groupBy("query_id").agg(F.collect_set("id").alias("f"))
    both = t.join(f, "query_id", "full")
    none = F.expr("CAST(array() AS array<bigint>)")
    size = F.size(F.coalesce("t", none))
    return both.select("query_id", F.when(size == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.coalesce("t", none), F.coalesce("f", none))) / size).alias("recall"))


#: Jobs that queries are dealt into when their time is taken.
LATENCY_BATCHES = 20


def latencies(ask: Callable[[DataFrame], DataFrame], queries: DataFrame, batches: int = LATENCY_BATCHES) -> dict[str, float]:
    """mean_ms, p50_ms, p95_ms and p99_ms per query of ask(queries), which is run for one batch after the other."""
    samples = []
    for b in range(batches):
        mine = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b)
        n = mine.count()
        if n:
            began = time.perf_counter()
            ask(mine).count()
            samples.append((time.perf_counter() - began) * 1000 / n)
    at = np.percentile(samples, [50, 95, 99]).tolist() if samples else [0.0] * 3
    return {"mean_ms": float(np.mean(samples)) if samples else 0.0, "p50_ms": at[0], "p95_ms": at[1], "p99_ms": at[2]}


def sweep_nprobe(corpus: DataFrame, assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobes: list[int], timed: bool = False) -> DataFrame:
    """(nprobe, mean_recall, and mean_ms, p50_ms, p95_ms, p99_ms if timed) in ascending order of nprobe.

    Spark answers a batch, there is no latency of one query: the queries are asked in LATENCY_BATCHES jobs, a
    job's time per query is a sample, and mean and percentiles (linear interpolation) are those of the samples."""
    truth = exact_topk(corpus, queries, k).select("query_id", "id").cache()
    out = None
    for p in sorted(set(nprobes)):
        found = ivf_topk(corpus, assigned, centroids, queries, k, p)
        part = recall_at_k(found, truth).agg(F.avg("recall").alias("mean_recall")).select(F.lit(p).alias("nprobe"), "mean_recall")
        if timed:
            ms = latencies(lambda q, p=p: ivf_topk(corpus, assigned, centroids, q, k, p), queries)
            for name, value in ms.items():
                part = part.withColumn(name, F.lit(value))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("nprobe")


def prediction_error(predicted: Column, actual: Column) -> Column:
    return vec.mean_squared_error(predicted, actual)


def error_stats(errors: DataFrame, error: str = "error", *keys: str) -> DataFrame:
    """mean, median and 90th percentile (linear interpolation) and number of errors, by keys if given."""
    e = F.col(error)
    return errors.groupBy(*keys).agg(F.avg(e).alias("mean_error"), F.percentile(e, 0.5).alias("median_error"), F.percentile(e, 0.9).alias("p90_error"), F.count(e).alias("n_steps"))


def split_episodes(episodes: DataFrame, holdout: float = 0.2, seed: int = 0) -> DataFrame:
    """(episode_id, held_out): round(n * holdout) episodes, the least by a hash with the seed, are held out."""
    ids = episodes.select("episode_id").distinct()
    n = round(ids.count() * holdout)
    chosen = ids.orderBy(F.xxhash64(F.lit(seed).cast("long"), "episode_id"), "episode_id").limit(n).withColumn("held_out", F.lit(True))
    return ids.join(chosen, "episode_id", "left").select("episode_id", F.coalesce("held_out", F.lit(False)).alias("held_out"))


def significant(mean_a: Column, std_a: Column, mean_b: Column, std_b: Column, least: float = 0.0, spread: bool = True) -> Column:
    """Is b's error smaller than a's by at least `least`, and, if wanted, by more than both deviations?"""
    gap = mean_a - mean_b
    better = (gap > 0) & (gap >= least)
    return better & (gap > std_a + std_b) if spread else better


def condition_stats(per_seed: DataFrame) -> DataFrame:
    """(condition, mean_error, std_error): over seeds; the deviation is that of the population."""
    return per_seed.groupBy("condition").agg(F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error"), F.sum("n_steps").alias("n_steps"), F.array_sort(F.collect_list(F.struct("seed", "error"))).alias("per_seed"))


def format_table(rows: list[dict], columns: list[str]) -> str:
    """A fixed-width text table of a small report."""
    cells = [[c for c in columns]] + [[f"{r[c]:.6f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]
    width = [max(len(x[i]) for x in cells) for i in range(len(columns))]
    return "\n".join("  ".join(v.rjust(w) for v, w in zip(x, width, strict=True)) for x in cells)
