"""Re-ranking, context assembly and fusion, for batches of queries keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .graph import expand
from .log import with_outcome
from .search import exact_topk, rank


def rerank(candidates: DataFrame, log: DataFrame, queries: DataFrame, w_sim: float = 1.0, w_action: float = 0.5, w_recency: float = 0.2) -> DataFrame:
    """(query_id, id, score, rank): a weighted mean of similarity, action similarity and recency (the id).

    Each signal is scaled to 0..1 within the query's candidates (0.5 if constant).  Without an action on the
    query or on any candidate the action's weight goes to the others; if the weights of the signals that are
    left sum to 0, these signals weigh equally; a lone candidate keeps its raw score.  candidates: (query_id, id, score); queries: (query_id, action).
    """
    acts = log.select("id", F.col("action").alias("a"))
    rows = candidates.join(acts, "id").join(queries.select("query_id", F.col("action").alias("qa")), "query_id")
    rows = rows.withColumn("act", F.when(F.col("a").isNotNull() & F.col("qa").isNotNull(), vec.cosine(F.col("qa"), F.col("a"))))
    w = Window.partitionBy("query_id")
    span = lambda c: vec.min_max(c.cast("double"), F.min(c.cast("double")).over(w), F.max(c.cast("double")).over(w))
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("whole", F.count("act").over(w) == F.col("n"))
    rows = rows.withColumn("s1", span(F.col("score"))).withColumn("s2", span(F.coalesce("act", F.lit(0.0)))).withColumn("s3", span(F.col("id")))
    wa = F.when(F.col("whole"), F.lit(float(w_action))).otherwise(F.lit(0.0))
    total = F.lit(float(w_sim)) + wa + F.lit(float(w_recency))
    equal = (F.col("s1") + F.when(F.col("whole"), F.col("s2")).otherwise(F.lit(0.0)) + F.col("s3")) / F.when(F.col("whole"), F.lit(3.0)).otherwise(F.lit(2.0))
    weighted = (w_sim * F.col("s1") + wa * F.col("s2") + w_recency * F.col("s3")) / F.when(total == 0, F.lit(1.0)).otherwise(total)
    blended = F.when(total == 0, equal).otherwise(weighted)
    scored = rows.select("query_id", "id", F.when(F.col("n") == 1, F.col("score")).otherwise(blended).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(by))


def with_expansion(candidates: DataFrame, edges: DataFrame, depth: int, max_nodes: int = 50) -> DataFrame:
    """candidates (query_id, id, score, rank) and what a breadth-first search finds from them; a found node
    scores the weight of the edge that found it times half per level."""
    found = expand(candidates, edges, depth, max_nodes)
    new = found.where(~F.col("is_seed")).select("query_id", "id", (F.col("weight") * vec.depth_decay(F.col("depth"))).alias("score"))
    return candidates.select("query_id", "id", "score").unionByName(new)


def recall(log: DataFrame, queries: DataFrame, k: int, *, action_scale: float = 0.0, scored: bool = False, edges: DataFrame | None = None, depth: int = 0, max_nodes: int = 50, fetch_factor: int = 5, weights: tuple[float, float, float] = (1.0, 0.5, 0.2), include_deleted: bool = True) -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, z, action).

    Without re-ranking the index order is the result, and the graph isn't used.  With it, k * fetch_factor
    rows are fetched, expanded over the graph, scored and cut to k.  Tombstoned rows are found until a
    compaction removes them, unless include_deleted is False."""
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    rows = log if include_deleted else log.where(F.col("flags").bitwiseAND(1) == 0)
    if action_scale:
        if not queries.where("action is null").isEmpty():
            raise ValueError("with an action scale every query needs an action")
        keyed = rows.select("id", vec.action_key(F.col("z"), F.col("action"), action_scale).alias("z"))
        asked = queries.select("query_id", vec.action_key(F.col("z"), F.col("action"), action_scale).alias("z"))
    else:
        keyed, asked = rows.select("id", "z"), queries.select("query_id", "z")
    if not scored:
        return exact_topk(keyed, asked, k)
    candidates = exact_topk(keyed, asked, k * fetch_factor)
    if edges is not None and depth > 0:
        candidates = with_expansion(candidates, edges, depth, max_nodes)
    return rerank(candidates, log, queries, *weights).where(F.col("rank") <= k)


def build_context(found: DataFrame, log: DataFrame, queries: DataFrame, k: int, dim: int, action_dim: int | None = None) -> DataFrame:
    """(query_id, pos, mem_z, mem_action, mem_outcome, mem_score, mask): exactly k rows per query.

    A candidate that is the last of its episode has no outcome: its row stays in place, zero and masked out,
    as do the rows that pad to k.  found: (query_id, id, score, rank)."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("pos"))
    known = with_outcome(log).select("id", "z", "action", "z_next")
    rows = found.where(F.col("rank") <= k).join(known, "id").select("query_id", F.col("rank").alias("pos"), "score", "z", "action", "z_next")
    rows = slots.join(rows, ["query_id", "pos"], "left")
    ok = F.col("z_next").isNotNull()
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    action = F.when(ok & F.col("action").isNotNull(), F.col("action")).otherwise(zeros(action_dim)) if action_dim else F.expr("CAST(array() AS array<double>)")
    return rows.select(
        "query_id", "pos", F.when(ok, F.col("z")).otherwise(zeros(dim)).alias("mem_z"), action.alias("mem_action"), F.when(ok, F.col("z_next")).otherwise(zeros(dim)).alias("mem_outcome"),
        F.when(ok, F.col("score")).otherwise(F.lit(0.0)).alias("mem_score"), ok.alias("mask"),
    )


def memory_mean(context: DataFrame) -> DataFrame:
    """(query_id, memory): outcomes averaged with weight score - least score + 1e-8; null without a valid row."""
    w = Window.partitionBy("query_id")
    rows = context.where("mask").withColumn("w", F.col("mem_score") - F.min("mem_score").over(w) + F.lit(1e-8))
    rows = rows.withColumn("w", F.col("w") / F.sum("w").over(w))
    parts = rows.select("query_id", "w", F.posexplode("mem_outcome").alias("d", "x")).groupBy("query_id", "d").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    mean = parts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("query_id", F.col("v.x").alias("memory"))
    return context.select("query_id").distinct().join(mean, "query_id", "left")


def fuse(base: Column, memory: Column, alpha: float) -> Column:
    """The model's prediction and the memory's mean as one: the model alone, as it is, at alpha 0 or without
    memory; the memory at length 1 at alpha 1; else the mix of both at length 1."""
    if alpha == 0:
        return F.transform(base, lambda x: x.cast("double"))
    blended = vec.normalize(memory) if alpha == 1 else vec.normalize(vec.mix(base, memory, alpha))
    return F.when(memory.isNull(), F.transform(base, lambda x: x.cast("double"))).otherwise(blended)


def predict(queries: DataFrame, context: DataFrame, alpha: float, base: str = "base") -> DataFrame:
    """(query_id, prediction) for queries (query_id, base): base is the model's own prediction."""
    return queries.join(memory_mean(context), "query_id", "left").select("query_id", fuse(F.col(base), F.col("memory"), alpha).alias("prediction"))


__all__ = ["build_context", "fuse", "memory_mean", "predict", "rank", "recall", "rerank", "with_expansion"]
