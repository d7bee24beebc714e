"""The front door: a memory table with its index, graph, tiers, feedback and maintenance.

A Memory holds DataFrames and options.  Reads build plans; a write or a rebuild swaps in new frames, so a
reader that holds the old ones isn't disturbed.  One recall answers a batch of queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MemoryConfig
from .functions import vec
from .operators import lifecycle, log, retrieve, search
from .operators.components import checkpointed, scratch_folder
from .sources.experience import FLAG_DELETED, FLAG_PINNED, SCHEMA, validated, with_dense_ids
from .sources.store import Store


@dataclass(frozen=True)
class Options:
    """action_scale: weight of the action in keys; nprobe and n_lists: an inverted-file index is used once it
    has been trained (nprobe None: it probes until no list can hold a better row); inverted: train_if_needed()
    trains it; hot_capacity: rows of the hot tier, None for no tiers."""

    action_scale: float = 0.0
    scored: bool = False
    weights: tuple[float, float, float] = (1.0, 0.5, 0.2)
    expansion_depth: int = 0
    max_nodes: int = 50
    fetch_factor: int = 5
    n_lists: int = 100
    nprobe: int | None = 1
    inverted: bool = False
    seed: int = 0
    degree: int = 8
    hot_capacity: int | None = None
    include_deleted: bool = True

    def __post_init__(self) -> None:
        if self.hot_capacity is not None and self.action_scale:
            raise ValueError("tiers need an action scale of 0")


#: What can be plugged in. Frames are those of operators/: found rows are (query_id, id, score, rank).
Scorer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]  # candidates, log, queries -> found
Index = Callable[[DataFrame, DataFrame, int], DataFrame]  # keys (id, z), asked (query_id, z), k -> found
Expander = Callable[[DataFrame, DataFrame, int], DataFrame]  # found, edges, depth -> (query_id, id, score)
Predictor = Callable[[DataFrame, DataFrame], DataFrame]  # queries (query_id, base, ...), context -> (query_id, prediction)


class Memory:
    def __init__(
        self, spark: SparkSession, config: MemoryConfig, options: Options = Options(), store: Store | None = None, policy: lifecycle.EvictionPolicy | None = None,
        scorer: Scorer | None = None, index: Index | None = None, expander: Expander | None = None, predictor: Predictor | None = None,
    ):
        """scorer, index, expander, predictor: take the place of re-ranking (and turn it on), of the search, of
        the breadth-first search and of alpha fusion."""
        if options.action_scale and config.action_dim is None:
            raise ValueError("an action scale needs actions")
        if index is not None and options.hot_capacity is not None:
            raise ValueError("tiers have indexes of their own")
        # without a store of its own it has one in the shared folder, which goes with the session
        self.store = store or Store(spark, scratch_folder(spark, "memory"), config)
        self.spark, self.config, self.options, self.policy = spark, config, options, policy
        self.scorer, self.index, self.expander, self.predictor = scorer, index, expander, predictor
        self.log = self.store.read()
        self.edges: DataFrame | None = None
        self.centroids: DataFrame | None = None
        self.lists: DataFrame | None = None  # (id, list_id, distance) of every row, once there are centroids
        self.baseline: DataFrame | None = None  # (baseline,): mean distance of the rows that the lists were learnt from
        self.tiers: DataFrame | None = None if options.hot_capacity is None else self.log.select("id", F.lit("hot").alias("tier"))
        self.used = spark.createDataFrame([], "token long, id long")
        self.outcomes = spark.createDataFrame([], "token long, helped boolean, now_ns long, ord long")
        self.facts = spark.createDataFrame([], "id long, helped boolean, now_ns long, ord long")

    def count(self) -> int:
        return self.log.count()

    def get(self, id: int) -> DataFrame:
        return log.point_lookup(self.log, id)

    def observe(self, rows: DataFrame, order: list[str]) -> int:
        """Append rows (episode_id, timestamp_ns, pred_err, z, action) in the given order; the first new id.

        Everything is checked before anything is written; latents are stored at length 1."""
        first = self.log.agg(F.max("id")).first()[0]
        first = 0 if first is None else first + 1
        sizes = self.log.groupBy("episode_id").agg(F.count("*").alias("size"))
        new = with_dense_ids(validated(rows, self.config.dim, self.config.action_dim), first, order, sizes)
        new = new.withColumn("z", vec.normalize(F.col("z"))).withColumn("flags", F.lit(0)).select(*SCHEMA.names)
        new = checkpointed(new)
        self.store.append(new)
        self.log = self.store.read()
        if self.tiers is not None:
            self.tiers = self.tiers.unionByName(new.select("id", F.lit("hot").alias("tier")))
        if self.centroids is not None:  # only new rows are assigned
            self.lists = self.lists.unionByName(checkpointed(search.assign_lists(self._keys(new), self.centroids)))
        return first

    def train_index(self) -> None:
        """Learn the lists of an inverted file from the keys that the table has."""
        if self.centroids is not None:
            raise RuntimeError("the index has been trained")
        self._learn(self._keys())

    def train_if_needed(self) -> bool:
        """Train the index if the options want one, there is none yet and there are rows; was it trained?"""
        if not self.options.inverted or self.centroids is not None or self.index is not None or self._keys().isEmpty():
            return False
        self.train_index()
        return True

    def _learn(self, keys: DataFrame) -> None:
        """Lists from these keys, and the list of every row, as tables."""
        self.centroids = checkpointed(search.train_centroids(keys, self.options.n_lists, self.options.seed))
        self.lists = checkpointed(search.assign_lists(self._keys(every=True), self.centroids))
        learnt = self.lists.join(keys.select("id"), "id", "left_semi")
        self.baseline = checkpointed(learnt.agg(F.avg("distance").alias("baseline")))

    def index_state(self) -> dict:
        """Has the index been trained, its number of lists and of rows."""
        if self.centroids is None:
            return {"trained": False, "lists": 0, "rows": 0}
        return {"trained": True, "lists": self.centroids.count(), "rows": self.lists.count()}

    def index_health(self, window: int = 1000) -> DataFrame:
        """(imbalance, drift, needs_retrain) of the trained index."""
        if self.centroids is None:
            raise RuntimeError("the index hasn't been trained")
        return search.index_health(self.lists, self.centroids, self.baseline, window)

    def _keys(self, rows: DataFrame | None = None, every: bool = False) -> DataFrame:
        rows = self.log if rows is None else rows
        if not (every or self.options.include_deleted):
            rows = rows.where(log.live())
        if not self.options.action_scale:
            return rows.select("id", "z")
        return rows.select("id", vec.action_key(F.col("z"), F.col("action"), self.options.action_scale).alias("z"))

    def recall(self, queries: DataFrame, k: int | None = None, token: int | None = None) -> DataFrame:
        """(query_id, id, score, rank) for queries (query_id, z, action); with a token the ids are noted for feedback."""
        o, k = self.options, self.config.k if k is None else k
        if k <= 0:
            raise ValueError(f"k must be positive, not {k}")
        scored = o.scored or self.scorer is not None
        if o.action_scale and not queries.where("action is null").isEmpty():
            raise ValueError("with an action scale every query needs an action")
        asked = queries.select("query_id", vec.action_key(F.col("z"), F.col("action"), o.action_scale).alias("z")) if o.action_scale else queries.select("query_id", "z")
        out = self._search(asked, k * o.fetch_factor if scored else k)
        if scored:
            if self.edges is not None and o.expansion_depth:
                out = self.expander(out, self.edges, o.expansion_depth) if self.expander else retrieve.with_expansion(out, self.edges, o.expansion_depth, o.max_nodes)
            out = (self.scorer(out, self.log, queries) if self.scorer else retrieve.rerank(out, self.log, queries, *o.weights)).where(F.col("rank") <= k)
        if token is not None:
            self.used = checkpointed(self.used.unionByName(out.select(F.lit(token).cast("long").alias("token"), "id").distinct()))
        return out

    def _search(self, asked: DataFrame, k: int) -> DataFrame:
        keys, o = self._keys(), self.options
        if self.index is not None:
            return self.index(keys, asked, k)
        if self.centroids is None:
            return search.exact_topk(keys, asked, k)
        if self.tiers is None:
            return search.ivf_topk(keys, self.lists, self.centroids, asked, k, o.nprobe)
        hot, cold = (keys.join(self.tiers.where(F.col("tier") == t).select("id"), "id", "left_semi") for t in ("hot", "cold"))
        assigned = self.lists.join(cold.select("id"), "id", "left_semi")
        return search.tiered_topk(hot, cold, assigned, self.centroids, asked, k, o.nprobe).drop("tier")

    def context(self, queries: DataFrame, k: int | None = None, token: int | None = None) -> DataFrame:
        """The context of what is recalled for the queries: see retrieve.build_context."""
        k = self.config.k if k is None else k
        return retrieve.build_context(self.recall(queries, k, token), self.log, queries, k, self.config.dim, self.config.action_dim)

    def predict(self, queries: DataFrame, k: int | None = None, alpha: float = 0.5) -> DataFrame:
        """(query_id, prediction) for queries (query_id, z, action, base), by the predictor or by alpha fusion."""
        context = self.context(queries, k)
        return self.predictor(queries, context) if self.predictor else retrieve.predict(queries, context, alpha)

    def tombstone(self, ids: DataFrame) -> None:
        self.store.flag(ids, FLAG_DELETED)
        self.log = self.store.read()

    def pin(self, ids: DataFrame) -> None:
        self.store.flag(ids, FLAG_PINNED)
        self.log = self.store.read()

    def tag_outcome(self, token: int, helped: bool, now_ns: int) -> None:
        """A verdict on what a token returned; unknown tokens and second verdicts change nothing."""
        n = self.outcomes.count()
        self.outcomes = checkpointed(self.outcomes.unionByName(self.spark.createDataFrame([(token, helped, now_ns, n)], self.outcomes.schema)))

    def drain_feedback(self) -> int:
        """Turn tagged tokens into facts once; the number of ids that they cover."""
        new = checkpointed(lifecycle.feedback_facts(self.used, self.outcomes))
        n = new.count()
        done = checkpointed(self.outcomes.select("token").distinct())
        self.facts = checkpointed(self.facts.unionByName(new))
        self.used = checkpointed(self.used.join(done, "token", "left_anti"))
        self.outcomes = self.outcomes.limit(0)
        return n

    def compact(self, threshold: float = 0.98, merge: bool = True, allow_cross_episode: bool = False) -> dict:
        self._no_tiers()
        return self._take(lifecycle.compact(self.log, self.edges, threshold, merge, allow_cross_episode, self.options.degree))

    def evict(self, capacity: int, now_ns: int) -> dict:
        self._no_tiers()
        if self.policy is None:
            raise ValueError("eviction needs a policy")
        return self._take(lifecycle.evict_to_capacity(self.log, self.policy, capacity, now_ns, lifecycle.utility_of(self.facts), self.edges, self.options.degree))

    def migrate(self, now_ns: int) -> dict:
        if self.tiers is None:
            raise ValueError("migration needs tiers")
        tiers, report = lifecycle.migrate(self.tiers, self.log, self.policy or lifecycle.EvictionPolicy(), self.options.hot_capacity, now_ns, lifecycle.utility_of(self.facts))
        self.tiers = checkpointed(tiers)
        if self.centroids is None and report["migrated"]:
            self._learn(self.log.join(self.tiers.where("tier = 'cold'").select("id"), "id", "left_semi").select("id", "z"))
        return report

    def tier_of(self, id: int) -> str:
        if self.tiers is None:
            raise ValueError("there are no tiers")
        found = self.tiers.where(F.col("id") == id).first()
        if found is None:
            raise ValueError(f"unknown id {id}")
        return found.tier

    def tier_counts(self) -> dict[str, int]:
        if self.tiers is None:
            raise ValueError("there are no tiers")
        return {"hot": 0, "cold": 0} | {r.tier: r["count"] for r in self.tiers.groupBy("tier").count().collect()}

    def promote(self, id: int) -> None:
        if self.tiers is None:
            raise ValueError("promotion needs tiers")
        self.tiers = checkpointed(lifecycle.promote(self.tiers, id))

    def _no_tiers(self) -> None:
        if self.tiers is not None:
            raise ValueError("a tiered memory is migrated, not compacted or evicted")

    def _take(self, new: lifecycle.Rebuilt) -> dict:
        if new.log is not self.log:
            self.facts = checkpointed(lifecycle.remapped_feedback(self.facts, new.id_map))
            kept = new.id_map.where("new_id is not null")
            self.used = checkpointed(self.used.join(kept, self.used.id == kept.old_id).select("token", F.col("new_id").alias("id")))
            self._swap(new.log)
            self.edges = new.edges
            if self.centroids is not None:
                self.centroids = None
                self.train_index()  # all ids are new
        return new.stats

    def _swap(self, rows: DataFrame) -> None:
        self.store.replace(rows)
        self.log = self.store.read()


@dataclass
class Maintenance:
    """One step in a fixed order: feedback, compaction from a row count on, eviction, migration."""

    memory: Memory
    capacity: int | None = None
    compaction_threshold: int | None = None
    enabled: bool = True
    similarity: float = 0.98
    reports: list[dict] = field(default_factory=list)

    def step(self, now_ns: int) -> dict:
        report = {"feedback_events_applied": 0, "compaction": None, "eviction": None, "migration": None}
        if self.enabled:
            m = self.memory
            report["feedback_events_applied"] = m.drain_feedback()
            if m.tiers is None:
                if self.compaction_threshold is not None and m.count() >= self.compaction_threshold:
                    report["compaction"] = m.compact(self.similarity)
                if m.policy is not None and self.capacity is not None:
                    report["eviction"] = m.evict(self.capacity, now_ns)
            else:
                report["migration"] = m.migrate(now_ns)
        self.reports.append(report)
        return report


def with_options(memory: Memory, **changes) -> Memory:
    """The same tables under other options."""
    out = Memory.__new__(Memory)
    out.__dict__ |= memory.__dict__ | {"options": replace(memory.options, **changes)}
    return out
