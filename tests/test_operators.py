import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.config import MemoryConfig
from mnemospark.functions import vec
from mnemospark.operators import evaluate as ev
from mnemospark.operators import graph, lifecycle, log, retrieve, search, trigger
from mnemospark.operators.components import least_labels
from mnemospark.sources.experience import FLAG_DELETED, FLAG_PINNED, SCHEMA, validated

NOW = 1_000_000_000_000


def experience(spark, n=60, dim=8, episodes=5, action_dim=2, seed=0, near=None):
    rng = np.random.default_rng(seed)
    rows = []
    seq = {}
    for i in range(n):
        e = i % episodes
        z = rng.standard_normal(dim) if near is None or i % near or not i else rows[0][6] + 1e-4 * rng.standard_normal(dim)
        z = np.asarray(z, float)
        rows.append((i, e, seq.get(e, 0), NOW + i * 1000, float(rng.random()), 0, (z / np.linalg.norm(z)).tolist(), rng.standard_normal(action_dim).tolist() if action_dim else None))
        seq[e] = seq.get(e, 0) + 1
    return rows, spark.createDataFrame(rows, SCHEMA)


def as_queries(df, ids):
    return df.where(F.col("id").isin(ids)).select(F.col("id").alias("query_id"), "z", "action")


# vectors


def test_vector_functions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>, o array<double>")
    r = row.select(vec.normalize(F.col("a")).alias("n"), vec.dot(F.col("a"), F.col("b")).alias("d"), vec.cosine(F.col("a"), F.col("o")).alias("c0"), vec.cosine(F.col("a"), F.col("b")).alias("c"), vec.mean_squared_error(F.col("a"), F.col("b")).alias("m"), vec.action_key(F.col("a"), F.col("b"), 2.0).alias("k")).first()
    assert r.n == pytest.approx([0.6, 0.8]) and r.d == 3.0 and r.c0 == 0.0 and r.c == pytest.approx(0.6) and r.m == pytest.approx(10.0)
    assert r.k == pytest.approx(np.array([3, 4, 2, 0]) / np.sqrt(29))
    with pytest.raises(Exception, match="zero vector"):
        row.select(vec.normalize(F.col("o"))).collect()
    one = row.select(vec.action_key(F.col("a"), F.lit(None).cast("array<double>"), 2.0).alias("k")).first()
    assert len(one.k) == 2


def test_config_is_validated():
    for bad in ({"dim": 0}, {"dim": True}, {"dim": 4, "action_dim": 0}, {"dim": 4, "k": -1}, {"dim": 4, "latency_budget_ms": 0}, {"dim": 2.5}):
        with pytest.raises(ValueError):
            MemoryConfig(**bad)
    assert MemoryConfig(4).k == 8


def test_rows_are_validated(spark):
    _, e = experience(spark, 4)
    assert validated(e, 8, 2).count() == 4
    for dim, action in ((7, 2), (8, 3), (8, None)):
        with pytest.raises(Exception):
            validated(e, dim, action).collect()


# log


def test_log_reads(spark):
    rows, e = experience(spark)
    assert log.point_lookup(e, 3).first().id == 3
    with pytest.raises(ValueError):
        log.point_lookup(e, 999)
    with pytest.raises(ValueError):
        log.episode(e, 77)
    assert [r.id for r in log.range_scan(e, 5, 9).collect()] == [5, 6, 7, 8]
    assert [r.walk for r in log.walk_back(e, 2).where("id = 17").collect()] == [[12, 7]]
    assert [r.walk for r in log.walk_forward(e, 2).where("id = 52").collect()] == [[57]]
    assert [r.episode_id for r in log.episode_ids(e).collect()] == [0, 1, 2, 3, 4]
    flagged = log.with_flags(e, log.flag_events(e.where("id in (1, 2)"), FLAG_DELETED).unionByName(log.flag_events(e.where("id = 2"), FLAG_PINNED)))
    assert {r.id: r.flags for r in flagged.where("flags > 0").collect()} == {1: 1, 2: 3}
    assert flagged.count() == len(rows)


# search


def brute_topk(rows, q, k, ids=None):
    m = np.array([r[6] for r in rows])
    s = m / np.linalg.norm(m, axis=1, keepdims=True) @ (np.array(q) / np.linalg.norm(q))
    keep = range(len(rows)) if ids is None else ids
    return sorted(((-s[i], rows[i][0]) for i in keep))[:k]


def test_exact_topk(spark, monkeypatch):
    rows, e = experience(spark, 80)
    monkeypatch.setattr(search, "BLOCK", 7)  # several blocks
    got = {}
    for r in search.exact_topk(e.repartition(5), as_queries(e, list(range(20))), 6).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q in range(20):
        want = brute_topk(rows, rows[q][6], 6)
        assert [i for _, i, _ in sorted(got[q])] == [i for _, i in want]
        assert [s for *_, s in sorted(got[q])] == pytest.approx([-s for s, _ in want], abs=1e-9)
    with pytest.raises(ValueError):
        search.exact_topk(e, as_queries(e, [0]), 0)
    assert search.exact_topk(e.limit(0), as_queries(e, [0]), 3).count() == 0
    assert search.exact_topk(e, as_queries(e, []), 3).count() == 0
    assert search.exact_topk(e, as_queries(e, [0]), 500).count() == 80


def test_inverted_file_probes_until_no_list_can_hold_a_better_row(spark):
    _, e = experience(spark, 120)
    c = search.mean_centroids(e, "episode_id")  # lists that say little about nearness
    a = search.assign_lists(e, c)
    q = as_queries(e, list(range(0, 120, 10)))
    pairs = lambda found: sorted((r.query_id, r.id, r["rank"]) for r in found.collect())
    exact = pairs(search.exact_topk(e, q, 8))
    assert pairs(search.ivf_topk(e, a, c, q, 8, 3)) != exact
    assert pairs(search.ivf_topk(e, a, c, q, 8, None)) == exact
    hot, cold = e.where("id < 20"), e.where("id >= 20")
    found = search.tiered_topk(hot, cold, search.assign_lists(cold, c), c, q, 8, None)
    assert pairs(found) == exact
    near = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "list_id int, centroid array<double>")
    tight = spark.createDataFrame([(i, i % 2, 0.01) for i in range(6)], "id long, list_id int, distance double")
    first = spark.createDataFrame([(7, 0, 0.99), (7, 2, 0.98)], "query_id long, id long, score double")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, z array<double>")
    probes = search.probe_lists(asked, near, 2).where("probe > 1")
    assert search.open_lists(first, tight, probes, 2).count() == 0 and search.open_lists(first, tight, probes, 3).count() == 1


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, 0, i, NOW, 0.0, 0, [1.0, 0.0], None) for i in range(9)]
    e = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert [r.id for r in search.exact_topk(e, as_queries(e, [5]), 4).orderBy("rank").collect()] == [0, 1, 2, 3]


def test_inverted_file(spark):
    rows, e = experience(spark, 120)
    c = spark.createDataFrame(search.train_centroids(e, 6).collect(), "list_id int, centroid array<double>")
    assert c.count() == 6
    a = search.assign_lists(e, c)
    sizes = {r.list_id: r["size"] for r in search.bucket_sizes(a, c).collect()}
    assert sum(sizes.values()) == 120 and len(sizes) == 6
    q = as_queries(e, [1, 2, 3])
    exact = sorted((r.query_id, r.id) for r in search.exact_topk(e, q, 5).collect())
    assert sorted((r.query_id, r.id) for r in search.ivf_topk(e, a, c, q, 5, 6).collect()) == exact  # all lists: exact
    sweep = [r.mean_recall for r in ev.sweep_nprobe(e, a, c, q, 5, [6, 1, 3]).collect()]
    assert sweep == sorted(sweep) and sweep[-1] == 1.0
    cent = np.array([r.centroid for r in c.orderBy("list_id").collect()])
    for r in a.collect():
        d = ((cent - np.array(rows[r.id][6])) ** 2).sum(axis=1)
        assert r.list_id == d.argmin() and r.distance == pytest.approx(d.min(), abs=1e-9)
    assert search.train_centroids(e.limit(1), 5).count() == 1
    h = search.index_health(a.limit(0), c, spark.createDataFrame([(1.0,)], "baseline double")).first()
    assert (h.imbalance, h.drift, h.needs_retrain) == (1.0, 1.0, False)


# graph


class Slots:
    """The bounded upsert in plain Python."""

    def __init__(self, degree):
        self.degree, self.out = degree, {}

    def add(self, src, dst, w, t):
        if src == dst:
            return
        s = self.out.setdefault(src, [])
        for i, e in enumerate(s):
            if e[0] == dst:
                s[i] = (dst, w, t)
                return
        if len(s) < self.degree:
            s.append((dst, w, t))
            return
        low = min(range(len(s)), key=lambda i: s[i][1])
        if w > s[low][1]:
            s[low] = (dst, w, t)


def test_bounded_edges_equal_a_fold(spark):
    rng = random.Random(1)
    ups = [(i, rng.randrange(5), rng.randrange(8), float(rng.randrange(6)), rng.randrange(2)) for i in range(300)]
    want = Slots(3)
    for _, a, b, w, t in ups:
        want.add(a, b, w, t)
    got = graph.bounded_edges(spark.createDataFrame(ups, "ord long, src long, dst long, weight double, edge_type int").repartition(6), 3)
    assert sorted((r.src, r.slot, r.dst, r.weight, r.edge_type) for r in got.collect()) == sorted((s, i, *e) for s, es in want.out.items() for i, e in enumerate(es))


def test_expand_equals_a_queue(spark):
    rng = random.Random(2)
    edges = [(s, i, d, round(rng.random(), 3), rng.randrange(2)) for s in range(40) for i, d in enumerate(rng.sample(range(40), 3)) if d != s]
    frame = spark.createDataFrame(edges, "src long, slot int, dst long, weight double, edge_type int")
    seeds = [(0, 3, 1), (0, 7, 2), (0, 3, 3), (1, 5, 1)]
    for depth, cap, types in ((0, 9, None), (1, 50, None), (2, 8, None), (3, 50, [1, 0]), (2, 50, [1])):
        got = graph.expand(spark.createDataFrame(seeds, "query_id long, id long, rank int"), frame, depth, cap, types).orderBy("query_id", "place").collect()
        for q in (0, 1):
            order = list(dict.fromkeys(i for a, i, _ in seeds if a == q))
            found = [(i, 0, None) for i in order]
            level, n = order, len(order)
            for d in range(1, depth + 1):
                nxt = []
                for node in level:
                    for t in types or [0, 1]:
                        for s, _, dst, w, et in sorted(e for e in edges if e[0] == node and e[4] == t):
                            if dst not in {f[0] for f in found}:
                                found.append((dst, d, w))
                                nxt.append(dst)
                level = nxt
            want = found[: max(cap, n)]
            assert [(r.id, r.depth, r.weight) for r in got if r.query_id == q] == want


def test_analogous_edges_look_back_only(spark):
    _, e = experience(spark, 60)
    got = graph.analogous_edges(e, 3, 0.2).collect()
    episode = {r.id: r.episode_id for r in e.collect()}
    assert got and all(r.dst < r.src and episode[r.dst] != episode[r.src] and r.weight >= 0.2 for r in got)
    assert graph.analogous_edges(e, 0).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (20, 1)], "a long, b long")
    assert {r.id: r.label for r in least_labels(edges).collect()} == {5: 1, 4: 1, 3: 1, 1: 1, 20: 1, 9: 8, 8: 8}


# retrieval


def test_a_lone_candidate_keeps_its_score_and_missing_actions_drop_out(spark):
    _, e = experience(spark, 10, action_dim=None)
    q = as_queries(e, [0, 1])
    one = spark.createDataFrame([(0, 3, 0.25), (1, 2, 0.9), (1, 4, 0.1), (1, 8, 0.5)], "query_id long, id long, score double")
    got = {(r.query_id, r.id): r.score for r in retrieve.rerank(one, e, q).collect()}
    assert got[0, 3] == 0.25
    assert got[1, 2] == pytest.approx(1 / 1.2) and got[1, 8] == pytest.approx((0.5 + 0.2) / 1.2) and got[1, 4] == pytest.approx(0.2 * (2 / 6) / 1.2)
    zero = retrieve.rerank(one, e, q, 0, 0, 0).where("query_id = 1").collect()
    assert {r.id: r.score for r in zero} == pytest.approx({2: 0.5, 4: 1 / 6, 8: 0.75})  # the signals that are left weigh equally
    action_only = retrieve.rerank(one, e, q, 0, 0.5, 0).where("query_id = 1").collect()
    assert {r.id: r.score for r in action_only} == pytest.approx({2: 0.5, 4: 1 / 6, 8: 0.75})


def test_fusion_ends(spark):
    _, e = experience(spark, 40)
    q = as_queries(e, [0, 1, 2])
    ctx = retrieve.build_context(search.exact_topk(e, q, 4), e, q, 6, 8, 2)
    assert ctx.count() == 18 and ctx.where("pos > 4 and mask").count() == 0
    asked = q.withColumnRenamed("z", "base")
    base = {r.query_id: r.base for r in asked.collect()}
    assert {r.query_id: r.prediction for r in retrieve.predict(asked, ctx, 0).collect()} == base
    for r in retrieve.predict(asked, ctx, 1).collect():
        assert np.linalg.norm(r.prediction) == pytest.approx(1)
    none = retrieve.build_context(search.exact_topk(e, q, 4).limit(0), e, q, 3, 8, 2)
    assert {r.query_id: r.prediction for r in retrieve.predict(asked, none, 1).collect()} == base


def test_recall_modes(spark):
    _, e = experience(spark, 60)
    q = as_queries(e, [7, 8])
    plain = retrieve.recall(e, q, 5)
    assert sorted((r.query_id, r.id) for r in plain.collect()) == sorted((r.query_id, r.id) for r in search.exact_topk(e, q, 5).collect())
    dead = e.withColumn("flags", F.when(F.col("id") == 7, 1).otherwise(0))
    assert retrieve.recall(dead, q, 1).where("id = 7").count() == 1
    assert retrieve.recall(dead, q, 1, include_deleted=False).where("id = 7").count() == 0
    edges = graph.bounded_edges(graph.upserts_of(e, graph.analogous_edges(e, 2, 0.1)), 3)
    deep0 = retrieve.recall(e, q, 5, scored=True, edges=edges, depth=0).collect()
    assert sorted(map(tuple, deep0)) == sorted(map(tuple, retrieve.recall(e, q, 5, scored=True).collect()))
    with pytest.raises(ValueError):
        retrieve.recall(e, q, 0)
    with pytest.raises(ValueError):
        retrieve.recall(e, q.withColumn("action", F.lit(None).cast("array<double>")), 2, action_scale=1.0)


# trigger


def test_gate_over_one_long_stream_and_null_keys(spark):
    rows = spark.range(300_000).select(F.when(F.col("id") < 250_000, F.lit(1)).when(F.col("id") < 260_000, None).otherwise(F.col("id") % 7 + 5).cast("long").alias("key"), F.col("id").alias("ord"), F.when(F.col("id") % 1000 != 999, (F.hash("id") % 1000) / 100.0).alias("error"))
    got = trigger.gate(rows)
    stats = {r.key: r for r in got.groupBy("key").agg(F.count("*").alias("n"), F.max("count").alias("last"), F.min("count").alias("first")).collect()}
    assert {k: r.n for k, r in stats.items()} == {r.key: r.n for r in rows.where("error is not null").groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert all(r.first == 0 and r.last == r.n - 1 for r in stats.values())
    assert trigger.gate(rows.limit(0)).count() == 0


def test_has_edge_and_neighbours(spark):
    edges = spark.createDataFrame([(1, 0, 2, 0.5, 0), (1, 1, 3, 0.7, 1), (2, 0, 1, 1.0, 0)], "src long, slot int, dst long, weight double, edge_type int")
    assert graph.has_edge(edges, 1, 3) and graph.has_edge(edges, 1, 3, graph.ANALOGOUS) and not graph.has_edge(edges, 1, 3, graph.TEMPORAL) and not graph.has_edge(edges, 3, 1)
    assert [(r.dst, r.weight) for r in graph.neighbours_of(edges, 1).collect()] == [(2, 0.5), (3, 0.7)]
    assert [r.dst for r in graph.neighbours_of(edges, 1, graph.ANALOGOUS).collect()] == [3] and graph.neighbours_of(edges, 9).isEmpty()


def test_latencies(spark):
    rows, e = experience(spark, 40)
    q = as_queries(e, list(range(30)))
    c = search.train_centroids(e, 3)
    got = ev.sweep_nprobe(e, search.assign_lists(e, c), c, q, 3, [1, 3], timed=True).collect()
    assert [r.nprobe for r in got] == [1, 3] and got[1].mean_recall == 1.0
    assert all(0 < r.p50_ms <= r.p95_ms <= r.p99_ms and r.mean_ms > 0 for r in got)
    assert ev.latencies(lambda x: x, q.limit(0)) == dict.fromkeys(("mean_ms", "p50_ms", "p95_ms", "p99_ms"), 0.0)


def test_inverted_file_with_empty_lists_unknown_probes_and_no_rows(spark):
    rows, e = experience(spark, 50)
    c = search.train_centroids(e, 5)
    a = search.assign_lists(e, c)
    q = as_queries(e, [1, 2, 3])
    assert search.ivf_topk(e, a, c, q.limit(0), 4, 2).count() == 0 and search.ivf_topk(e.limit(0), a.limit(0), c, q, 4, 2).count() == 0
    probed = {(r.query_id, r.list_id) for r in search.probe_lists(q, c, 2).collect()}
    lists = {r.id: r.list_id for r in a.collect()}
    z = {r[0]: np.array(r[6]) for r in rows}
    got = {(r.query_id, r.rank): (r.id, r.score) for r in search.ivf_topk(e, a, c, q, 4, 2).collect()}
    for i in (1, 2, 3):
        want = sorted(((-float(z[i] @ z[j]), j) for j in z if (i, lists[j]) in probed))[:4]
        assert [got[i, k + 1][0] for k in range(len(want))] == [j for _, j in want]
        assert [got[i, k + 1][1] for k in range(len(want))] == pytest.approx([-s for s, _ in want])


def test_gate_equals_a_loop(spark):
    rng = random.Random(3)
    errors = [(k, i, abs(rng.gauss(1, 0.3)) + 5 * (rng.random() < 0.05)) for k in range(4) for i in range(80)]
    got = {(r.key, r.ord): r for r in trigger.gate(spark.createDataFrame(errors, "key long, ord long, error double").repartition(5)).collect()}
    for k in range(4):
        m = v = n = last = 0
        for i in range(80):
            e = errors[k * 80 + i][2]
            r = got[k, i]
            assert r.retrieve == (n < 10 or e > m + 1.5 * v**0.5) and r.retrieve_causal == (n < 10 or last > m + 1.5 * v**0.5)
            assert r.ema_mean == pytest.approx(m) and r.ema_std == pytest.approx(v**0.5)
            if n == 0:
                m = e
            else:
                d = e - m
                m, v = m + 0.1 * d, 0.9 * (v + 0.1 * d * d)
            n, last = n + 1, e
    always = trigger.gate(spark.createDataFrame(errors, "key long, ord long, error double"), trigger.Surprise(lam=-1000))
    assert always.where("not retrieve and count > 10").count() == 0
    with pytest.raises(ValueError):
        trigger.Surprise(smoothing=0)


# lifecycle


def test_compaction_merges_and_renumbers(spark):
    rows, e = experience(spark, 30, near=10)  # rows 0, 10 and 20 are near copies
    e = e.withColumn("flags", F.when(F.col("id") == 4, FLAG_DELETED).when(F.col("id") == 10, FLAG_PINNED).otherwise(0))
    out = lifecycle.compact(e, threshold=0.999, allow_cross_episode=True)
    assert out.stats == {"old_count": 30, "new_count": 27, "tombstones_dropped": 1, "records_merged": 2}
    got = {r.id: r for r in out.log.collect()}
    assert sorted(got) == list(range(27))
    id_map = {r.old_id: r.new_id for r in out.id_map.collect()}
    assert id_map[4] is None and id_map[0] == id_map[10] == id_map[20]
    best = max((0, 10, 20), key=lambda i: (rows[i][4], -i))
    assert got[id_map[0]].pred_err == pytest.approx(rows[best][4]) and got[id_map[0]].flags == FLAG_PINNED  # pins go along
    for ep in range(5):
        assert sorted(r.seq_no for r in got.values() if r.episode_id == ep) == list(range(sum(r.episode_id == ep for r in got.values())))
    assert lifecycle.compact(e, threshold=0.999, merge=False).stats["records_merged"] == 0


@pytest.mark.parametrize("chunk_nodes", [4096, 7])
def test_compaction_links_groups_of_any_size(spark, monkeypatch, chunk_nodes):
    monkeypatch.setattr(lifecycle, "CHUNK_NODES", chunk_nodes)
    rng = np.random.default_rng(3)
    a, b = np.eye(8)[0], np.eye(8)[0] * 0.9 + np.eye(8)[1] * np.sqrt(1 - 0.81)
    vectors = [a] * 15 + [b] * 15 + [v / np.linalg.norm(v) for v in a + 0.02 * rng.standard_normal((40, 8))] + [np.eye(8)[5]] * 2
    rows = [(i, i // 71, i % 71, NOW, float(rng.random()), FLAG_DELETED if i % 20 == 19 else 0, v.tolist(), None) for i, v in enumerate(vectors)]
    e = spark.createDataFrame(rows, SCHEMA).repartition(3)
    live_rows = [r for r in rows if not r[5]]
    score = lambda x, y: float(np.dot(x[6], y[6]))
    want = {(x[0], y[0]) for x in live_rows for y in live_rows if x[0] < y[0] and x[1] == y[1] and score(x, y) >= 0.85}
    parent = {r[0]: r[0] for r in live_rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in sorted(want):
        parent[max(find(x), find(y))] = min(find(x), find(y))
    labels = lambda pairs: {r.id: r.label for r in least_labels(pairs).collect()}
    linked = {i: find(i) for p in want for i in p}
    pairs = lifecycle.near_duplicate_pairs(e, 0.85)
    got = {(r.a, r.b) for r in pairs.collect()}
    assert got <= want and labels(pairs) == linked
    copies = [{i for i in range(*g) if not rows[i][5]} for g in ((0, 15), (15, 30))]
    assert want - got <= {(x, y) for g in copies for x in g for y in range(72) if (x, y) in want} | {(y, x) for g in copies for x in g for y in range(72)}
    assert {p for p in want if min(p) >= 30} <= got
    few = lifecycle.similar_pairs(e.where(log.live()), 0.85, spanning=True)
    assert few.count() < len(got) and labels(few) == linked
    assert lifecycle.compact(e, threshold=0.85).stats["records_merged"] == len(linked) - len(set(linked.values()))
    assert labels(lifecycle.near_duplicate_pairs(e, 0.85, k=10)) != linked


@pytest.mark.parametrize("across", [False, True])
def test_pairs_of_one_hot_episode_and_of_chunks_of_it(spark, monkeypatch, across):
    rng = np.random.default_rng(11)
    vectors = rng.standard_normal((90, 4))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, 0 if i < 60 else i // 3, i, NOW, 0.5, 0, v.tolist(), None) for i, v in enumerate(vectors)]
    e = spark.createDataFrame(rows, SCHEMA).repartition(5)
    scores = vectors @ vectors.T
    want = {(i, j): scores[i, j] for i in range(90) for j in range(i + 1, 90) if scores[i, j] >= 0.6 and (across or rows[i][1] == rows[j][1])}
    monkeypatch.setattr(lifecycle, "CHUNK_BYTES", 4 * 8 * 11)  # eleven vectors a chunk
    got = [(r.a, r.b, r.score) for r in lifecycle.similar_pairs(e, 0.6, across).collect()]
    assert len(got) == len(want) and {(a, b): pytest.approx(s) for a, b, s in got} == want
    assert lifecycle.similar_pairs(e.limit(0), 0.6, across).isEmpty()


def test_eviction_keeps_errors_pins_and_useful_rows(spark):
    rows, _ = experience(spark, 20)
    rows = [(*r[:3], NOW, i / 100, *r[5:]) for i, r in enumerate(rows)]
    e = spark.createDataFrame(rows, SCHEMA)
    policy = lifecycle.EvictionPolicy()
    assert sorted(r.id for r in lifecycle.eviction_victims(e, policy, 10, NOW)[0].collect()) == list(range(10))
    used = lifecycle.utility_of(spark.createDataFrame([(0, True, NOW, 0), (1, False, NOW, 1)], "id long, helped boolean, now_ns long, ord long"))
    assert 0 not in {r.id for r in lifecycle.eviction_victims(e, policy, 10, NOW, used)[0].collect()}
    pinned = lifecycle.evict_to_capacity(e, lifecycle.EvictionPolicy(w_pred_err=-0.5, pin_threshold=0.15), 6, NOW)
    assert pinned.log.count() == 6 and {0.16, 0.17, 0.18, 0.19} <= {r.pred_err for r in pinned.log.collect()}
    assert lifecycle.evict_to_capacity(e, policy, 50, NOW).log is e
    with pytest.warns(UserWarning):
        over = lifecycle.evict_to_capacity(e, lifecycle.EvictionPolicy(pin_threshold=-1.0), 5, NOW)
    assert over.stats["pinned_over_capacity"] == 15 and over.log.count() == 20


def test_tiers(spark):
    rows, e = experience(spark, 12)
    e = spark.createDataFrame([(*r[:3], NOW, i / 100, *r[5:]) for i, r in enumerate(rows)], SCHEMA)
    tiers, report = lifecycle.migrate(e.select("id", F.lit("hot").alias("tier")), e, lifecycle.EvictionPolicy(), 5, NOW)
    assert report["migrated"] == 7 and sorted(r.id for r in tiers.where("tier = 'cold'").collect()) == list(range(7))
    assert lifecycle.promote(tiers, 2).where("id = 2").first().tier == "hot"
    with pytest.raises(ValueError):
        lifecycle.promote(tiers, 99)


def test_feedback(spark):
    used = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 9)], "token long, id long")
    told = spark.createDataFrame([(0, True, 5, 0), (0, False, 6, 1), (1, True, 7, 2), (8, True, 9, 3)], "token long, helped boolean, now_ns long, ord long")
    facts = lifecycle.feedback_facts(used, told)
    assert {r.id: (r.utility, r.last_useful_ns) for r in lifecycle.utility_of(facts).collect()} == {1: (1.0, 5), 2: (2.0, 7)}
    moved = lifecycle.remapped_feedback(facts, spark.createDataFrame([(1, 0), (2, None)], "old_id long, new_id long"))
    assert [r.id for r in moved.collect()] == [0]


def test_evaluation(spark):
    f = lambda rows: spark.createDataFrame(rows, "query_id long, id long")
    got = {r.query_id: r.recall for r in ev.recall_at_k(f([(0, 1), (0, 2), (2, 5)]), f([(0, 1), (0, 3), (1, 4)])).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 1.0}
    errors = [0.3, 0.1, 0.9, 0.5]
    s = ev.error_stats(spark.createDataFrame([(x,) for x in errors], "error double")).first()
    assert (s.mean_error, s.median_error, s.p90_error, s.n_steps) == pytest.approx((0.45, np.median(errors), np.percentile(errors, 90), 4))
    eps = spark.range(10).select(F.col("id").alias("episode_id"))
    assert ev.split_episodes(eps).where("held_out").count() == 2
    assert ev.split_episodes(eps, seed=1).collect() == ev.split_episodes(eps, seed=1).collect()
    lit = lambda *x: [F.lit(float(v)) for v in x]
    r = spark.range(1).select(ev.significant(*lit(1, 0.1, 0.5, 0.1)).alias("a"), ev.significant(*lit(1, 0.3, 0.5, 0.3)).alias("b"), ev.significant(*lit(1, 0.3, 0.5, 0.3), spread=False).alias("c")).first()
    assert tuple(r) == (True, False, True)
    assert "nprobe" in ev.format_table([{"nprobe": 1, "r": 0.5}], ["nprobe", "r"])


def test_experiment(spark):
    from mnemospark.operators import experiment as ex
    from mnemospark.sources.synthetic import SyntheticWorld

    got = ex.run_experiment(spark, lambda s: SyntheticWorld(6, 2, s), 10, 4, 2, (3,), ex.Settings(alphas=(0.0,), alpha=0.0))
    errors = {r.condition: r for r in got.collect()}
    assert set(errors) == set(ex.CONDITIONS) and {r.n_steps for r in errors.values()} == {8}
    assert len({round(r.error, 12) for r in errors.values()}) == 1  # without fusion every condition is the model alone
    assert not ex.memory_helps(got) and not ex.graph_helps(got)
    assert [r["condition"] for r in ex.report(got)] == list(ex.CONDITIONS)
    asked = spark.createDataFrame([(i, [1.0, 0.0], [1.0, float(i == 7)]) for i in range(12)], "query_id long, base array<double>, z_next array<double>")
    gated = {r.query_id: r for r in ex.gated_errors(asked, asked.select("query_id", F.lit(9.0).alias("error")), trigger.Surprise(warmup=2)).collect()}
    assert [q for q in sorted(gated) if gated[q].retrieve] == [0, 1, 7] and gated[7].error == 9.0 and gated[8].error == 0.0
