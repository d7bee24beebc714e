"""The registered queries: each applies one operator to the driver's whole tables.

Searches ask for every row whose id is divisible by 20, against all rows.  The model is the identity
(its prediction of the next latent is the latent), so that SQL can express what depends on a model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import evaluate as ev
from ..operators import experiment, graph, lifecycle, log, retrieve, search, trigger
from ..operators.components import checkpointed, scratch_folder
from ..sources import records, synthetic
from ..sources.experience import FLAG_DELETED, FLAG_PINNED, SCHEMA, from_tables
from ..sources.store import Store

K = 10
NOW_NS = 1_800_000_000_000_000_000
POLICY = lifecycle.EvictionPolicy(decay_constant_s=3e7)
NEAR = 0.3
DEGREE = 4
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _asked(e: DataFrame) -> DataFrame:
    return e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "z", "action")


def _r(name: str, out: str | None = None):
    return F.round(F.col(name), 6).alias(out or name)


def _mix(array: str, digits: int = 4):
    """The sum of a vector's elements times their places: it changes with any element and with their order."""
    return F.round(F.aggregate(F.transform(F.col(array), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), digits)


def _ends(array: str):
    """The first and last elements of a vector, its length, and a sum over all elements."""
    a = F.col(array)
    return F.round(a[0], 6).alias("first"), F.round(F.element_at(a, -1), 6).alias("last"), F.round(vec.norm(a), 6).alias("norm"), _mix(array).alias("mix")


def _centroids(e: DataFrame) -> DataFrame:
    return search.mean_centroids(e, "episode_id")


def _upserts(e: DataFrame) -> DataFrame:
    return graph.upserts_of(e, graph.analogous_edges(e, 4, NEAR))


def _edges(e: DataFrame) -> DataFrame:
    return checkpointed(graph.bounded_edges(_upserts(e), DEGREE))


def _found(out: DataFrame) -> DataFrame:
    return out.select("query_id", "id", _r("score"), "rank")


# log


@query
def normalize(s, d):
    return from_tables(s, d).select("id", vec.normalize(F.col("z")).alias("v")).select("id", *_ends("v"))


@query
def point_lookup(s, d):
    return log.point_lookup(from_tables(s, d), 7).select("id", "episode_id", "seq_no", "timestamp_ns", _r("pred_err"), "flags")


@query
def log_range_scan(s, d):
    return log.range_scan(from_tables(s, d), 100, 300).select("id", "episode_id", "seq_no", "timestamp_ns", _r("pred_err"), "flags")


@query
def log_flags(s, d):
    e = from_tables(s, d)
    events = log.flag_events(e.where("id % 7 = 0"), FLAG_DELETED).unionByName(log.flag_events(e.where("id % 11 = 0"), FLAG_PINNED))
    return log.with_flags(e, events).select("id", "flags", log.live().alias("live"), log.pinned().alias("pinned"))


@query
def episode_next_prev(s, d):
    return log.neighbours(from_tables(s, d))


@query
def episode_walk(s, d):
    e = from_tables(s, d)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return log.walk_forward(e, 3).select("id", text("walk").alias("forward")).join(log.walk_back(e, 3).select("id", text("walk").alias("back")), "id")


@query
def episode_lengths(s, d):
    e = from_tables(s, d)
    return log.episode_lengths(e).join(log.episode_ids(e), "episode_id")


@query
def episode_rows(s, d):
    return log.episode(from_tables(s, d), 3).select("id", "seq_no")


# search


@query
def dot_topk_single(s, d):
    e = from_tables(s, d)
    return _found(search.exact_topk(e, e.where("id = 0").select(F.col("id").alias("query_id"), "z"), K))


@query
def dot_topk_batch(s, d):
    e = from_tables(s, d)
    return _found(search.exact_topk(e, _asked(e), K))


@query
def action_key_topk(s, d):
    e = from_tables(s, d)
    return _found(retrieve.recall(e, _asked(e), K, action_scale=2.0))


@query
def ivf_assign(s, d):
    e = from_tables(s, d)
    return search.assign_lists(e, _centroids(e)).select("id", "list_id", _r("distance"))


@query
def ivf_probe(s, d):
    e = from_tables(s, d)
    return search.probe_lists(_asked(e), _centroids(e), 3).select("query_id", "list_id", _r("distance"), "probe")


@query
def ivf_probe_topk(s, d):
    e = from_tables(s, d)
    c = _centroids(e)
    return _found(search.ivf_topk(e, checkpointed(search.assign_lists(e, c)), c, _asked(e), K, None))


@query
def ivf_bucket_sizes(s, d):
    e = from_tables(s, d)
    c = _centroids(e)
    return search.bucket_sizes(search.assign_lists(e, c), c)


@query
def ivf_health(s, d):
    e = from_tables(s, d)
    c = _centroids(e)
    a = checkpointed(search.assign_lists(e, c))
    baseline = a.agg(F.avg("distance").alias("baseline"))  # the centroids come from all rows
    return search.index_health(a, c, baseline).select(_r("imbalance"), _r("drift"), "needs_retrain")


@query
def kmeans_one_lloyd_step(s, d):
    e = from_tables(s, d)
    return search.lloyd_step(e, _centroids(e)).select("list_id", *_ends("centroid"))


@query
def kmeans_train(s, d):
    e = from_tables(s, d)
    c = checkpointed(search.train_centroids(e, 16))
    return search.bucket_sizes(search.assign_lists(e, c), c)


@query
def recall_at_k_by_nprobe(s, d):
    e = from_tables(s, d)
    c = _centroids(e)
    return ev.sweep_nprobe(e, checkpointed(search.assign_lists(e, c)), c, _asked(e), K, [1, 2, 5, 10]).select("nprobe", _r("mean_recall"))


# graph


@query
def temporal_edges(s, d):
    return graph.temporal_edges(from_tables(s, d))


@query
def analogous_edges(s, d):
    return graph.analogous_edges(from_tables(s, d), 4, NEAR).select("src", "dst", _r("weight"), "edge_type")


@query
def bounded_degree_edges(s, d):
    return graph.bounded_edges(_upserts(from_tables(s, d)), DEGREE).select("src", "slot", "dst", _r("weight"), "edge_type")


@query
def out_degree(s, d):
    e = from_tables(s, d)
    return graph.out_degree(e, _edges(e))


def _expanded(s, d, depth):
    e = from_tables(s, d)
    seeds = search.exact_topk(e, _asked(e), 3)
    return graph.expand(seeds, _edges(e), depth, 12).select("query_id", "id", "is_seed", "depth", "edge_type", _r("weight"), "place")


@query
def expand_d1(s, d):
    return _expanded(s, d, 1)


@query
def expand_d2(s, d):
    return _expanded(s, d, 2)


# retrieval


@query
def scorer_rerank(s, d):
    e = from_tables(s, d)
    q = _asked(e)
    return _found(retrieve.rerank(search.exact_topk(e, q, 20), e, q))


@query
def scorer_equal_weights(s, d):
    """Re-ranking with weights that sum to 0: all signals weigh equally."""
    e = from_tables(s, d)
    q = _asked(e)
    return _found(retrieve.rerank(search.exact_topk(e, q, 20), e, q, 0, 0, 0))


@query
def recall_scored(s, d):
    e = from_tables(s, d)
    return _found(retrieve.recall(e, _asked(e), K, action_scale=2.0, scored=True))


def _recall_expanded(s, d, depth):
    e = from_tables(s, d)
    return _found(retrieve.recall(e, _asked(e), 5, scored=True, edges=_edges(e), depth=depth, max_nodes=40))


@query
def recall_expanded_d1(s, d):
    return _recall_expanded(s, d, 1)


@query
def recall_expanded_d2(s, d):
    return _recall_expanded(s, d, 2)


def _context(e):
    q = _asked(e)
    return q, retrieve.build_context(search.exact_topk(e, q, 5), e, q, 5, 64, 4)


@query
def build_context(s, d):
    _, c = _context(from_tables(s, d))
    return c.select("query_id", "pos", "mask", _r("mem_score"), _mix("mem_z").alias("z"), _mix("mem_action").alias("action"), _mix("mem_outcome").alias("outcome"))


@query
def score_weighted_mean(s, d):
    _, c = _context(from_tables(s, d))
    return retrieve.memory_mean(c).select("query_id", *_ends("memory"))


def _fused(s, d, alpha):
    e = from_tables(s, d)
    q, c = _context(e)
    return retrieve.predict(q.withColumnRenamed("z", "base"), c, alpha).select("query_id", *_ends("prediction"))


@query
def fusion_alpha_0(s, d):
    return _fused(s, d, 0)


@query
def fusion_alpha_05(s, d):
    return _fused(s, d, 0.5)


@query
def fusion_alpha_1(s, d):
    return _fused(s, d, 1)


# trigger


def _errors(s, d):
    v = s.read.parquet(f"{d}/events.parquet").select("user_id", "ts", "event_id", "value")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.select(F.col("user_id").cast("long").alias("key"), place.cast("long").alias("ord"), F.col("value").cast("double").alias("error"))


def _gated(g):
    return g.select("key", "ord", _r("ema_mean"), _r("ema_std"), "count", "retrieve", "retrieve_causal")


@query
def surprise_gate(s, d):
    return _gated(trigger.gate(_errors(s, d)))


@query
def gated_eval(s, d):
    """Per user: the share of rows that retrieve, and the mean error if a retrieval halves a row's error."""
    g = trigger.gate(_errors(s, d))
    used = F.when(F.col("retrieve"), F.col("error") / 2).otherwise(F.col("error"))
    return g.groupBy("key").agg(F.avg(F.col("retrieve").cast("double")).alias("retrieval_rate"), F.avg(used).alias("mean_error")).select("key", _r("retrieval_rate"), _r("mean_error"))


# lifecycle


def _feedback(e):
    used = search.exact_topk(e, _asked(e), 3).select(F.col("query_id").alias("token"), "id")
    told = _asked(e).where("query_id % 50 <> 0").select(F.col("query_id").alias("token"), (F.col("query_id") % 3 != 0).alias("helped"), (F.lit(NOW_NS - 10**15) + F.col("query_id") * 10**9).alias("now_ns"), F.col("query_id").alias("ord"))
    return lifecycle.feedback_facts(used, told)


@query
def feedback_utility(s, d):
    return lifecycle.utility_of(_feedback(from_tables(s, d)))


@query
def keep_scores(s, d):
    e = from_tables(s, d)
    return lifecycle.keep_scores(e, POLICY, NOW_NS, lifecycle.utility_of(_feedback(e))).select("id", _r("keep"))


def _capacity(e):
    return e.count() * 4 // 5


@query
def evict_victims(s, d):
    e = from_tables(s, d)
    return lifecycle.eviction_victims(e, POLICY, _capacity(e), NOW_NS)[0].select("id", _r("keep"))


@query
def pinned_protection(s, d):
    """Victims when every row with a prediction error above 1.35 is pinned."""
    e = from_tables(s, d)
    policy = lifecycle.EvictionPolicy(decay_constant_s=3e7, w_pred_err=-0.5, pin_threshold=1.35)
    return lifecycle.eviction_victims(e, policy, _capacity(e), NOW_NS)[0].select("id", _r("keep"))


def _rows(e):
    return e.select("id", "episode_id", "seq_no", "timestamp_ns", _r("pred_err"), "flags", _mix("z").alias("z"), _mix("action").alias("action"))


@query
def evict_result(s, d):
    e = from_tables(s, d)
    return _rows(lifecycle.evict_to_capacity(e, POLICY, _capacity(e), NOW_NS).log)


def _marked(e):
    """Some rows tombstoned, some pinned."""
    return e.withColumn("flags", F.when(F.col("id") % 13 == 0, FLAG_DELETED).when(F.col("id") % 17 == 0, FLAG_PINNED).otherwise(0))


@query
def near_dup_pairs(s, d):
    return lifecycle.near_duplicate_pairs(_marked(from_tables(s, d)), NEAR).select("a", "b", _r("score"))


@query
def dup_components(s, d):
    e = _marked(from_tables(s, d))
    return lifecycle.duplicate_groups(e, lifecycle.near_duplicate_pairs(e, NEAR))


@query
def compact_idmap(s, d):
    return lifecycle.compaction_map(_marked(from_tables(s, d)), NEAR)


@query
def compact_rows(s, d):
    return _rows(lifecycle.compact(_marked(from_tables(s, d)), threshold=NEAR).log)


@query
def compact_edges(s, d):
    e = from_tables(s, d)
    edges = checkpointed(graph.temporal_edges(e).select(F.col("dst").alias("ord"), "src", "dst", "weight", "edge_type"))
    out = lifecycle.compact(_marked(e), graph.bounded_edges(edges, DEGREE), threshold=NEAR, degree=DEGREE)
    return out.edges.select("src", "slot", "dst", "weight", "edge_type")


@query
def compact_stats(s, d):
    st = lifecycle.compact(_marked(from_tables(s, d)), threshold=NEAR).stats
    return s.createDataFrame([(st["old_count"], st["new_count"], st["tombstones_dropped"], st["records_merged"])], "old_count long, new_count long, tombstones_dropped long, records_merged long")


def _tiers(e):
    return lifecycle.migrate(e.select("id", F.lit("hot").alias("tier")), _marked(e), POLICY, 200, NOW_NS)[0]


@query
def tier_migrate(s, d):
    return _tiers(from_tables(s, d))


@query
def tier_promote(s, d):
    tiers = checkpointed(_tiers(from_tables(s, d)))
    return lifecycle.promote(tiers, 1).groupBy("tier").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query
def tiered_topk(s, d):
    e = from_tables(s, d)
    tiers = checkpointed(_tiers(e))
    hot, cold = (e.join(tiers.where(F.col("tier") == t).select("id"), "id", "left_semi") for t in ("hot", "cold"))
    c = checkpointed(_centroids(e))
    return search.tiered_topk(hot, cold, checkpointed(search.assign_lists(cold, c)), c, _asked(e), K, None).select("query_id", "id", _r("score"), "tier", "rank")


# evaluation


def _steps(e):
    return log.with_outcome(e).where("z_next is not null").select("episode_id", ev.prediction_error(F.col("z"), F.col("z_next")).alias("error"))


@query
def eval_error_stats(s, d):
    return ev.error_stats(_steps(from_tables(s, d)), "error", "episode_id").select("episode_id", _r("mean_error"), _r("median_error"), _r("p90_error"), "n_steps")


@query
def split_episodes(s, d):
    return ev.split_episodes(from_tables(s, d)).groupBy("held_out").agg(F.count("*").alias("n_episodes"))


@query
def significance(s, d):
    """Is an episode's error smaller than that of the next episode, by more than their deviations?"""
    st = _steps(from_tables(s, d)).groupBy("episode_id").agg(F.avg("error").alias("m"), F.stddev_pop("error").alias("sd"))
    nxt = st.select((F.col("episode_id") - 1).alias("episode_id"), F.col("m").alias("m2"), F.col("sd").alias("sd2"))
    a = [F.col("m2"), F.col("sd2"), F.col("m"), F.col("sd")]
    return st.join(nxt, "episode_id").select("episode_id", ev.significant(*a).alias("by_spread"), ev.significant(*a, least=0.0, spread=False).alias("plain"))


@query
def condition_stats(s, d):
    per = _steps(from_tables(s, d)).groupBy((F.col("episode_id") % 3).alias("condition"), F.col("episode_id").alias("seed")).agg(F.avg("error").alias("error"), F.count("*").alias("n_steps"))
    return ev.condition_stats(per).select("condition", _r("mean_error"), _r("std_error"), "n_steps")


@query
def experiment_conditions(s, d):
    """The nine conditions of the ablation over synthetic episodes."""
    out = experiment.run_experiment(s, lambda seed: synthetic.SyntheticWorld(8, 2, seed), 10, 6, 3, (0, 1))
    return ev.condition_stats(out).select("condition", _r("mean_error"), _r("std_error"), "n_steps")


@query
def gated_retrieval(s, d):
    """Per row that asks: does the surprise gate open on the model's error, and the error after it."""
    e = from_tables(s, d)
    q, c = _context(log.with_outcome(e))
    asked = q.join(log.with_outcome(e).select(F.col("id").alias("query_id"), "z_next"), "query_id").where("z_next is not null").withColumnRenamed("z", "base")
    fused = retrieve.predict(asked, c, 0.5).join(asked.select("query_id", "z_next"), "query_id").select("query_id", ev.prediction_error(F.col("prediction"), F.col("z_next")).alias("error"))
    return experiment.gated_errors(asked, fused, trigger.Surprise(warmup=3)).select("query_id", "retrieve", _r("error"))


# sources, sinks and streams


def _scratch(s, name):
    return scratch_folder(s, name)


@query
def record_round_trip(s, d):
    """Rows as binary records and back: errors and vectors at 32 bits."""
    layout = records.Layout(64, 4)

    def back(frames):
        import pandas as pd

        for f in frames:
            yield pd.concat([records.unpack(bytes(r), layout) for r in f["record"]])[SCHEMA.names].astype({"flags": "int32"}) if len(f) else f

    out = records.as_bytes(from_tables(s, d), layout).select("record").mapInPandas(back, SCHEMA)
    return out.select("id", "episode_id", "seq_no", "timestamp_ns", F.round("pred_err", 4).alias("pred_err"), "flags", _mix("z", 3).alias("z"), _mix("action", 3).alias("action"))


@query
def store_round_trip(s, d):
    """Rows appended to a store in two parts, rewritten without tombstones, and scanned from id 50 on."""
    from ..config import MemoryConfig

    e = from_tables(s, d)
    path = _scratch(s, "store")
    store = Store(s, path, MemoryConfig(64, 4))
    store.append(e.where("id < 200"))
    store.append(e.where("id >= 200"))
    store.replace(_marked(store.read()).where(log.live()))
    return _rows(Store(s, path).scan(50))


@query
def append_dense_ids(s, d):
    """New rows get ids after the table's, in order of time, and count on in their episodes."""
    from ..sources.experience import with_dense_ids

    e = from_tables(s, d)
    new = e.select("episode_id", "timestamp_ns", F.col("id").alias("old_id"))
    sizes = e.groupBy("episode_id").agg(F.count("*").alias("size"))
    return with_dense_ids(new, e.count(), ["timestamp_ns", "old_id"], sizes).select("id", "episode_id", "seq_no", "old_id")


@query
def synthetic_trajectories(s, d):
    return synthetic.trajectories(s, synthetic.SyntheticWorld(8, 2), 12, 10).groupBy("episode_id").agg(F.count("*").alias("steps"), F.round(F.avg("pred_err"), 6).alias("mean_err"))


def _as_stream(s, rows, name, parts=3):
    """rows as a file stream of several micro-batches."""
    path = _scratch(s, name)
    rows.repartition(parts).write.parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_ingest_equals_batch(s, d):
    from ..config import MemoryConfig
    from ..streaming.operators import ingest

    e = from_tables(s, d)
    store = Store(s, _scratch(s, "ingest"), MemoryConfig(64, 4))
    rows = e.select("episode_id", "timestamp_ns", "pred_err", "z", "action")
    ingest(_as_stream(s, rows, "arrivals"), store, _scratch(s, "offsets"), ["timestamp_ns"]).awaitTermination()
    return store.read().groupBy("episode_id").agg(F.count("*").alias("length"), F.max("seq_no").alias("last_seq"), F.round(F.sum("pred_err"), 4).alias("err"))


@query
def stream_trigger_equals_batch(s, d):
    from ..streaming.operators import GATE_SCHEMA, gate_stream

    rows = _errors(s, d)
    path = _scratch(s, "errors")
    for lo, hi in ((1, 20), (21, 50), (51, 10**9)):  # files arrive in order of time
        rows.where(F.col("ord").between(lo, hi)).coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = _scratch(s, "gate")
    gate_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", _scratch(s, "offsets")).trigger(availableNow=True).start().awaitTermination()
    return _gated(s.read.schema(GATE_SCHEMA).parquet(out))
