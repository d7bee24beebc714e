"""The multi-seed ablation: what each part of the memory adds to a model's predictions.

Held-out steps of all episodes are one batch of queries; a condition is a way to find rows for them, and its
error is the mean squared error of the fused prediction.  The best fusion weight of the full system is kept
for the conditions that build on it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MemoryConfig
from ..sources.synthetic import WorldModel, model_steps, trajectories
from . import evaluate as ev
from . import graph, lifecycle, retrieve
from .components import checkpointed
from .trigger import Surprise, gate

CONDITIONS = ("no_memory", "appearance_only", "action_conditioned", "action_conditioned_scorer", "full_system", "full_system_no_graph", "full_system_graph_depth1", "full_system_graph_depth2", "full_system_with_maintenance")


@dataclass(frozen=True)
class Settings:
    holdout: float = 0.2
    scale: float = 2.0
    alpha: float = 0.5
    alphas: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    weights: tuple[float, float, float] = (1.0, 0.5, 0.2)
    fetch_factor: int = 5
    degree: int = 8
    n_analogous: int = 4
    threshold: float = 0.3
    max_nodes: int = 200
    cadence: int = 10
    capacity: int | None = None  # four fifths of the memory's steps
    compaction_threshold: int | None = None  # half of them


def prepared(spark: SparkSession, model: WorldModel, n_episodes: int, length: int, holdout: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """The memory's rows, with ids in the order of episodes, and the held-out steps as queries with the model's prediction."""
    steps = trajectories(spark, model, n_episodes, length)
    split = checkpointed(ev.split_episodes(spark.range(n_episodes).select(F.col("id").alias("episode_id")), holdout, seed))
    rows = checkpointed(steps.join(split, "episode_id").withColumn("id", F.col("episode_id") * length + F.col("seq_no")))
    memory = rows.where("not held_out").select("id", "episode_id", "seq_no", F.col("id").alias("timestamp_ns"), "pred_err", F.lit(0).alias("flags"), "z", "action")
    asked = model_steps(rows.where("held_out").select(F.col("id").alias("query_id"), "z", "action", "z_next", "episode_id", "seq_no"), model)
    return memory, checkpointed(asked)


def fused_errors(found: DataFrame, memory: DataFrame, asked: DataFrame, k: int, dim: int, action_dim: int | None, alphas: tuple[float, ...]) -> DataFrame:
    """(alpha, query_id, error) of predictions from the found rows at each fusion weight."""
    context = retrieve.build_context(found, memory, asked, k, dim, action_dim)
    rows = checkpointed(asked.join(retrieve.memory_mean(context), "query_id", "left"))
    parts = [rows.select(F.lit(float(a)).alias("alpha"), "query_id", ev.prediction_error(retrieve.fuse(F.col("base"), F.col("memory"), a), F.col("z_next")).alias("error")) for a in alphas]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gated_errors(asked: DataFrame, fused: DataFrame, setting: Surprise = Surprise()) -> DataFrame:
    """(query_id, retrieve, error): the fused error where the surprise gate opens on the model's own error, else that.

    asked: (query_id, base, z_next), taken in order of query_id; fused: (query_id, error)."""
    own = asked.select("query_id", ev.prediction_error(F.col("base"), F.col("z_next")).alias("own"))
    opened = gate(own.select(F.lit(0).cast("long").alias("key"), F.col("query_id").alias("ord"), F.col("own").alias("error")), setting).select(F.col("ord").alias("query_id"), "retrieve")
    both = own.join(opened, "query_id").join(fused.select("query_id", "error"), "query_id")
    return both.select("query_id", "retrieve", F.when(F.col("retrieve"), F.col("error")).otherwise(F.col("own")).alias("error"))


def _maintained(spark: SparkSession, memory: DataFrame, asked: DataFrame, k: int, dim: int, action_dim: int | None, s: Settings, now_ns: int):
    """The memory filled a few episodes at a time with a maintenance step after each part, and what it finds."""
    from ..memory import Maintenance, Memory, Options

    steps = memory.count()
    m = Memory(spark, MemoryConfig(dim, action_dim), Options(scored=True, weights=s.weights, fetch_factor=s.fetch_factor, degree=s.degree), policy=lifecycle.EvictionPolicy())
    worker = Maintenance(m, s.capacity or max(1, steps * 4 // 5), s.compaction_threshold or max(1, steps // 2))
    episodes = [r.episode_id for r in memory.select("episode_id").distinct().orderBy("episode_id").collect()]
    for i in range(0, len(episodes), s.cadence):
        part = memory.where(F.col("episode_id").isin(episodes[i : i + s.cadence])).select("episode_id", "timestamp_ns", "pred_err", "z", "action")
        m.observe(part, ["timestamp_ns"])
        m.train_if_needed()
        worker.step(now_ns)
    return m, checkpointed(m.recall(asked, k))


def run_experiment(spark: SparkSession, model: Callable[[int], WorldModel], n_episodes: int, length: int, k: int, seeds: tuple[int, ...], settings: Settings = Settings()) -> DataFrame:
    """(condition, seed, error, n_steps): the mean error of each condition on the same held-out steps, per seed."""
    s, rows = settings, []
    for seed in seeds:
        world = model(seed)
        dim, action_dim = world.dim, world.action_dim
        memory, asked = prepared(spark, world, n_episodes, length, s.holdout, seed)
        memory = checkpointed(memory)

        def errors(found: DataFrame, alphas: tuple[float, ...], of: DataFrame = memory, q: DataFrame = asked, d: int = dim, a: int | None = action_dim) -> dict[float, tuple[float, int]]:
            got = fused_errors(found, of, q, k, d, a, alphas).groupBy("alpha").agg(F.avg("error").alias("e"), F.count("*").alias("n"))
            return {r.alpha: (r.e, r.n) for r in got.collect()}  # a row per weight

        own = asked.select(ev.prediction_error(F.col("base"), F.col("z_next")).alias("e")).agg(F.avg("e").alias("e"), F.count("*").alias("n")).first()
        here = {"no_memory": (own.e, own.n)}
        here["appearance_only"] = errors(checkpointed(retrieve.recall(memory, asked, k)), (s.alpha,))[s.alpha]
        here["action_conditioned"] = errors(checkpointed(retrieve.recall(memory, asked, k, action_scale=s.scale)), (s.alpha,))[s.alpha]
        scored = checkpointed(retrieve.recall(memory, asked, k, action_scale=s.scale, scored=True, fetch_factor=s.fetch_factor, weights=s.weights))
        grid = errors(scored, tuple(sorted({*s.alphas, s.alpha})))
        here["action_conditioned_scorer"] = grid[s.alpha]
        best = min(s.alphas, key=lambda a: grid[a][0])  # the first of equals
        here["full_system"] = here["full_system_no_graph"] = grid[best]
        edges = checkpointed(graph.bounded_edges(graph.upserts_of(memory, graph.analogous_edges(memory, s.n_analogous, s.threshold, s.fetch_factor)), s.degree))
        for depth in (1, 2):
            found = retrieve.recall(memory, asked, k, action_scale=s.scale, scored=True, edges=edges, depth=depth, max_nodes=s.max_nodes, fetch_factor=s.fetch_factor, weights=s.weights)
            here[f"full_system_graph_depth{depth}"] = errors(checkpointed(found), (best,))[best]
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", UserWarning)
            m, found = _maintained(spark, memory, asked, k, dim, action_dim, s, n_episodes * length)
        here["full_system_with_maintenance"] = errors(found, (best,), m.log)[best]
        rows += [(name, seed, *here[name]) for name in CONDITIONS]
    return spark.createDataFrame(rows, "condition string, seed int, error double, n_steps long")


def report(per_seed: DataFrame) -> list[dict]:
    """Conditions in their order, with mean, deviation and improvement over the model alone in percent."""
    stats = {r.condition: r for r in ev.condition_stats(per_seed).collect()}
    base = stats["no_memory"].mean_error
    return [{"condition": c, "mean_error": stats[c].mean_error, "std_error": stats[c].std_error, "improvement_pct": 100 * (base - stats[c].mean_error) / base if base else 0.0} for c in CONDITIONS]


def memory_helps(per_seed: DataFrame, least: float = 0.0, spread: bool = True) -> bool:
    """Is the full system better than the model alone?"""
    return _better(per_seed, "no_memory", ("full_system",), least, spread)


def graph_helps(per_seed: DataFrame, least: float = 0.0, spread: bool = True) -> bool:
    """Is a graph of either depth better than none?"""
    return _better(per_seed, "full_system_no_graph", ("full_system_graph_depth1", "full_system_graph_depth2"), least, spread)


def _better(per_seed: DataFrame, worse: str, names: tuple[str, ...], least: float, spread: bool) -> bool:
    st = ev.condition_stats(per_seed)
    a = st.where(F.col("condition") == worse).select(F.col("mean_error").alias("m"), F.col("std_error").alias("sd"))
    b = st.where(F.col("condition").isin(*names))
    return not b.crossJoin(a).where(ev.significant(F.col("m"), F.col("sd"), F.col("mean_error"), F.col("std_error"), least, spread)).isEmpty()  # one row beside a few
