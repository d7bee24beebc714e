"""Keeping a memory small: near-duplicate compaction, eviction, tiers, feedback, and one maintenance step.

Every operator returns new frames; a caller swaps them in (see memory.Memory).  Flags and usefulness move
with rows through an id map, so pins and feedback outlive a compaction.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.experience import FLAG_DELETED, FLAG_PINNED, SCHEMA
from .components import checkpointed, least_labels
from .graph import bounded_edges
from .log import live, pinned
from .search import STEP, as_matrix, exact_topk, ivf_topk

#: Nodes, and bytes of their vectors, of one chunk of an episode in a similarity join.
CHUNK_NODES, CHUNK_BYTES = 4096, 16 << 20


@dataclass(frozen=True)
class EvictionPolicy:
    w_decay: float = 1.0
    w_utility: float = 1.0
    w_pred_err: float = 1.0
    decay_constant_s: float = 86400.0
    pin_threshold: float | None = None

    def __post_init__(self) -> None:
        if self.w_decay + self.w_utility + self.w_pred_err == 0:
            raise ValueError("the weights must not sum to 0")


def utility_of(feedback: DataFrame) -> DataFrame:
    """(id, utility, last_useful_ns) from facts (id, helped, now_ns, ord): helpful uses, and when the last came."""
    good = feedback.where("helped")
    return good.groupBy("id").agg(F.count("*").cast("double").alias("utility"), F.max_by("now_ns", "ord").alias("last_useful_ns"))


def feedback_facts(used: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, helped, now_ns, ord): each id that a token returned shares the token's first verdict; tokens
    without a verdict and verdicts without a token give nothing."""
    first = outcomes.groupBy("token").agg(F.min_by("helped", "ord").alias("helped"), F.min_by("now_ns", "ord").alias("now_ns"), F.min("ord").alias("ord"))
    return used.join(first, "token").select("id", "helped", "now_ns", "ord")


def remapped_feedback(facts: DataFrame, id_map: DataFrame) -> DataFrame:
    """facts under the new ids of a compaction; those of dropped rows go."""
    return facts.join(id_map.where("new_id is not null"), facts.id == id_map.old_id).select(F.col("new_id").alias("id"), "helped", "now_ns", "ord")


def keep_scores(rows: DataFrame, policy: EvictionPolicy, now_ns: int, utility: DataFrame | None = None) -> DataFrame:
    """(id, keep): the weighted mean of time decay, utility and prediction error, each scaled to 0..1 over rows.

    The extremes are one small aggregate that is joined back as a single row, not an unpartitioned window."""
    if utility is None:
        facts = rows.select("id", "timestamp_ns", "pred_err", F.lit(0.0).alias("utility"), F.col("timestamp_ns").alias("last"))
    else:
        facts = rows.join(utility, "id", "left").select("id", "timestamp_ns", "pred_err", F.coalesce("utility", F.lit(0.0)).alias("utility"), F.coalesce("last_useful_ns", "timestamp_ns").alias("last"))
    raw = facts.select("id", vec.time_decay(now_ns, F.col("last"), policy.decay_constant_s).alias("s0"), F.col("utility").alias("s1"), F.col("pred_err").alias("s2"))
    ends = raw.agg(*(f(c).alias(f"{n}{c}") for c in ("s0", "s1", "s2") for n, f in (("lo_", F.min), ("hi_", F.max))))
    weights = (policy.w_decay, policy.w_utility, policy.w_pred_err)
    parts = [w * vec.min_max(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}")) for w, c in zip(weights, ("s0", "s1", "s2"), strict=True)]
    return raw.crossJoin(F.broadcast(ends)).select("id", ((parts[0] + parts[1] + parts[2]) / float(sum(weights))).alias("keep"))


def auto_pinned(log: DataFrame, threshold: float | None) -> DataFrame:
    """log with the pin flag set where the prediction error exceeds the threshold."""
    if threshold is None:
        return log
    return log.withColumn("flags", F.when(live() & (F.col("pred_err") > threshold), F.col("flags").bitwiseOR(FLAG_PINNED)).otherwise(F.col("flags")))


def lowest(scores: DataFrame, n: int) -> DataFrame:
    """The n rows of least keep score, ties by id."""
    return scores.orderBy("keep", "id").limit(n)


def near_duplicate_pairs(log: DataFrame, threshold: float, allow_cross_episode: bool = False, k: int | None = None, index: tuple[DataFrame, DataFrame, int | None] | None = None) -> DataFrame:
    """(a, b, score), a < b: live rows at the threshold or more, in one episode unless allowed otherwise.

    Without k all of them: see similar_pairs.  With k only those one of which is among the other's k nearest of
    all rows, where the row itself, tombstoned rows and other episodes take up places too; groups of more than k
    rows can fall apart.  Every live row asks: exactly, the work is that of all pairs.  With k and index
    (assigned, centroids, nprobe) a row asks its nearest lists only, an equi-join whose work grows with the rows
    of a list."""
    alive = log.where(live())
    if k is None:
        if index is not None:
            raise ValueError("an index is asked for the k nearest: k is missing")
        return similar_pairs(alive, threshold, allow_cross_episode)
    k = min(max(alive.count(), 1), k)
    asked = alive.select(F.col("id").alias("query_id"), "z")
    found = exact_topk(log.select("id", "z"), asked, k) if index is None else ivf_topk(log.select("id", "z"), index[0], index[1], asked, k, index[2])
    eps = alive.select("id", "episode_id")
    pairs = found.where((F.col("id") != F.col("query_id")) & (F.col("score") >= threshold)).join(eps, "id").join(eps.select(F.col("id").alias("query_id"), F.col("episode_id").alias("qe")), "query_id")
    if not allow_cross_episode:
        pairs = pairs.where("episode_id = qe")
    return pairs.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def similar_pairs(rows: DataFrame, threshold: float, allow_cross_episode: bool = False, spanning: bool = False) -> DataFrame:
    """(a, b, score), a < b: all rows at the threshold or more, however many partners a row has.

    Copies of a vector (in one episode, unless pairs across are allowed) are one node, their least id, and are
    paired with that node only.  The nodes of an episode (of the log, if pairs across are allowed) are dealt into
    chunks of bounded size, and each two chunks are multiplied in one task, so that nodes of different episodes
    never meet and an episode that holds most rows is many tasks; a node is copied once per chunk of its episode.
    spanning: of each such product only links that connect the same nodes, no more than it has nodes, so that
    a large group doesn't make rows of all its pairs."""
    group = F.lit(0).cast("long") if allow_cross_episode else F.col("episode_id").cast("long")
    unit = rows.select(F.col("id").cast("long").alias("id"), group.alias("episode"), vec.normalize(F.col("z")).alias("v"))
    classes = checkpointed(unit.groupBy("episode", "v").agg(F.min("id").alias("id")))
    copies = unit.select("episode", "v", F.col("id").alias("b")).join(classes.withColumnRenamed("id", "a"), ["episode", "v"]).where("a <> b").select("a", "b", F.lit(1.0).alias("score"))
    if threshold > 1:
        copies = copies.limit(0)
    chunks = F.ceil(F.greatest(F.count("*") / CHUNK_NODES, F.sum(F.size("v")) * 8 / CHUNK_BYTES)).cast("int")
    sizes = checkpointed(classes.groupBy("episode").agg(chunks.alias("chunks"), F.count("*").alias("nodes")).where("nodes > 1"))
    dealt = classes.join(sizes, "episode").withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))
    dealt = dealt.select("episode", "id", "v", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    dealt = dealt.select("episode", "id", "v", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    return copies.unionByName(dealt.groupBy("episode", "lo", "hi").applyInArrow(_similar(threshold, spanning), "a long, b long, score double"))


def _similar(threshold: float, spanning: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).combine_chunks()  # one chunk, or two
        ids, chunk = group.column("id").to_numpy(), group.column("chunk").to_numpy()
        lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
        m = as_matrix(group.column("v").combine_chunks())
        theirs, other = ids[chunk == hi], m[chunk == hi].T
        mine, own = ids[chunk == lo], m[chunk == lo]
        for start in range(0, len(mine), STEP):  # bounds the score matrix to STEP rows
            part = slice(start, start + STEP)
            scores = own[part] @ other
            near = scores >= threshold
            if lo == hi:
                near &= theirs[None, :] > mine[part, None]
            i, j = _spanning(near) if spanning else np.nonzero(near)
            if len(i):
                a, b = mine[part][i], theirs[j]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(scores[i, j])], names=["a", "b", "score"])

    return run


def _spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that connect whatever near connects, fewer than it has rows and columns."""
    new_row, new_column = near.any(axis=1), near.any(axis=0)
    rows, columns = [], []
    for start in np.flatnonzero(new_row):
        if not new_row[start]:
            continue
        new_row[start], todo = False, [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & new_column):
                new_column[j] = False
                more = np.flatnonzero(near[:, j] & new_row)
                new_row[more] = False
                todo.extend(more)
                rows += [i, *more]
                columns += [j] * (1 + len(more))
    return np.array(rows, np.int64), np.array(columns, np.int64)


def duplicate_groups(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, label, representative): the components of pairs; the representative has the greatest prediction
    error, ties to the lowest id."""
    labels = least_labels(pairs).join(log.select("id", "pred_err"), "id")
    best = labels.groupBy("label").agg(F.max_by("id", F.struct("pred_err", -F.col("id"))).alias("representative"))
    return labels.join(best, "label").select("id", "label", "representative")


def dense_ranks(ids: DataFrame) -> DataFrame:
    """(old_id, new_id): ids renumbered from 0 in their order, by per-partition offsets of a range sort."""
    ranged = checkpointed(ids.select("id").repartitionByRange("id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n"), F.min("m").alias("lo"))  # a row per partition
    starts = sizes.select("p", "lo", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "p").select(F.col("id").alias("old_id"), (F.col("start") + F.col("m") - F.col("lo")).alias("new_id"))


def compaction_map(log: DataFrame, threshold: float = 0.98, merge: bool = True, allow_cross_episode: bool = False, k: int | None = None) -> DataFrame:
    """(old_id, new_id): tombstoned rows have none, near-duplicates that of their representative.  k as in
    near_duplicate_pairs."""
    alive = log.where(live()).select("id")
    if merge:
        pairs = similar_pairs(log.where(live()), threshold, allow_cross_episode, spanning=True) if k is None else near_duplicate_pairs(log, threshold, allow_cross_episode, k)
        groups = checkpointed(duplicate_groups(log, pairs).select("id", "representative"))
        target = alive.join(groups, "id", "left").select("id", F.coalesce("representative", "id").alias("target"))
    else:
        target = alive.select("id", F.col("id").alias("target"))
    target = checkpointed(target)
    ranks = dense_ranks(target.where("id = target").select("id"))
    kept = target.join(ranks.withColumnRenamed("old_id", "target"), "target").select(F.col("id").alias("old_id"), "new_id")
    return log.select(F.col("id").alias("old_id")).join(kept, "old_id", "left")


def apply_map(log: DataFrame, id_map: DataFrame) -> DataFrame:
    """The surviving rows under their new ids: time and errors kept, seq_no packed, pins carried over."""
    pins = log.join(id_map.withColumnRenamed("old_id", "id"), "id").where("new_id is not null").groupBy("new_id").agg(F.bit_or(F.col("flags").bitwiseAND(FLAG_PINNED)).cast("int").alias("pin"))
    rows = log.where(live()).join(id_map.withColumnRenamed("old_id", "id"), "id").join(pins, "new_id")
    best = Window.partitionBy("new_id").orderBy(F.col("pred_err").desc(), "id")
    rows = rows.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    seq = (F.row_number().over(Window.partitionBy("episode_id").orderBy("new_id")) - 1).cast("long")
    return rows.select(F.col("new_id").alias("id"), "episode_id", seq.alias("seq_no"), "timestamp_ns", "pred_err", F.col("pin").alias("flags"), "z", "action")


def remapped_edges(edges: DataFrame, id_map: DataFrame, degree: int) -> DataFrame:
    """edges between surviving rows, upserted anew in the order of old source, type and slot."""
    a, b = (id_map.where("new_id is not null").select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}")) for c in ("src", "dst"))
    moved = edges.join(a, "src").join(b, "dst")
    return bounded_edges(moved.select(F.struct("src", "edge_type", "slot").alias("ord"), F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), "weight", "edge_type"), degree)


@dataclass
class Rebuilt:
    log: DataFrame
    id_map: DataFrame
    edges: DataFrame | None
    stats: dict


def compact(log: DataFrame, edges: DataFrame | None = None, threshold: float = 0.98, merge: bool = True, allow_cross_episode: bool = False, degree: int = 8, k: int | None = None) -> Rebuilt:
    """Drop tombstoned rows, merge near-duplicates, renumber rows and rebuild edges."""
    id_map = checkpointed(compaction_map(log, threshold, merge, allow_cross_episode, k))
    new = checkpointed(apply_map(log, id_map))
    counts = id_map.agg(F.count("*").alias("old"), F.count("new_id").alias("alive"), F.count_distinct("new_id").alias("new")).first()
    stats = {"old_count": counts.old, "new_count": counts.new, "tombstones_dropped": counts.old - counts.alive, "records_merged": counts.alive - counts.new}
    return Rebuilt(new, id_map, None if edges is None else checkpointed(remapped_edges(edges, id_map, degree)), stats)


def eviction_victims(log: DataFrame, policy: EvictionPolicy, capacity: int, now_ns: int, utility: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(id, keep) of the rows to evict, and by how many rows the pinned ones exceed the capacity."""
    if capacity < 0:
        raise ValueError("capacity must not be negative")
    rows = auto_pinned(log, policy.pin_threshold).where(live())
    n = rows.agg(F.count("*").alias("live"), F.count_if(pinned()).alias("pinned")).first()
    excess = max(n.live - capacity, 0)
    free = n.live - n.pinned
    if excess > free:
        warnings.warn(f"{n.pinned} pinned rows exceed the capacity of {capacity}", UserWarning, stacklevel=2)
    return lowest(keep_scores(rows.where(~pinned()), policy, now_ns, utility), min(excess, free)), max(excess - free, 0)


def evict_to_capacity(log: DataFrame, policy: EvictionPolicy, capacity: int, now_ns: int, utility: DataFrame | None = None, edges: DataFrame | None = None, degree: int = 8) -> Rebuilt:
    """Tombstone the victims and compact without merging; a log within its capacity is returned as it is."""
    n = log.where(live()).count()
    if n <= capacity:
        same = log.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
        return Rebuilt(log, same, edges, {"evicted": 0, "pinned_over_capacity": 0, "old_count": n, "new_count": n})
    victims, over = eviction_victims(log, policy, capacity, now_ns, utility)
    victims = checkpointed(victims.select("id", F.lit(FLAG_DELETED).alias("_set")))
    marked = auto_pinned(log, policy.pin_threshold).join(F.broadcast(victims) if victims.count() <= 100_000 else victims, "id", "left")
    marked = marked.withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_set", F.lit(0)))).select(*SCHEMA.names)
    out = compact(checkpointed(marked), edges, merge=False, degree=degree)
    out.stats |= {"evicted": out.stats["tombstones_dropped"], "pinned_over_capacity": over}
    return out


def migrate(tiers: DataFrame, log: DataFrame, policy: EvictionPolicy, hot_capacity: int, now_ns: int, utility: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """tiers (id, tier) after moving the hot rows of least keep score to cold until hot_capacity is met; pinned rows stay hot."""
    hot = log.join(tiers.where("tier = 'hot'").select("id"), "id", "left_semi")
    n = hot.agg(F.count("*").alias("hot"), F.count_if(pinned()).alias("pinned")).first()
    excess, free = max(n.hot - hot_capacity, 0), n.hot - n.pinned
    if excess > free:
        warnings.warn(f"{n.pinned} pinned rows exceed the hot capacity of {hot_capacity}", UserWarning, stacklevel=2)
    moved = lowest(keep_scores(hot.where(~pinned()), policy, now_ns, utility), min(excess, free)).select("id", F.lit("cold").alias("to"))
    out = tiers.join(moved, "id", "left").select("id", F.coalesce("to", "tier").alias("tier"))
    return out, {"migrated": min(excess, free), "pinned_over_target": max(excess - free, 0)}


def promote(tiers: DataFrame, id: int) -> DataFrame:
    """tiers with one row hot again; an error if there is no such row."""
    if tiers.where(F.col("id") == id).isEmpty():
        raise ValueError(f"no row {id}")
    return tiers.select("id", F.when(F.col("id") == id, F.lit("hot")).otherwise(F.col("tier")).alias("tier"))
