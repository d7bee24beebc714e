import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemospark.config import MemoryConfig
from mnemospark.memory import Maintenance, Memory, Options
from mnemospark.operators import lifecycle
from mnemospark.sources import records, synthetic
from mnemospark.sources.experience import SCHEMA, with_dense_ids
from mnemospark.sources.store import Store
from mnemospark.streaming.operators import feedback_stream, gate_stream, ingest

NOW = 1_000_000_000_000


def rows(n, dim=4, action_dim=2, episodes=3, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, i % episodes, i // episodes, NOW + i, float(np.float32(rng.random())), 0, rng.standard_normal(dim).astype(np.float32).astype(float).tolist(), rng.standard_normal(action_dim).astype(np.float32).astype(float).tolist() if action_dim else None) for i in range(n)]


def test_record_layout_and_round_trip():
    assert records.Layout(1024, 7).size == 4160
    assert records.Layout(2).dtype.fields["z"][1] == 36 and records.Layout(2).dtype.fields["timestamp_ns"][1] == 20
    for action_dim in (None, 3):
        layout = records.Layout(5, action_dim)
        df = pd.DataFrame(rows(7, 5, action_dim), columns=SCHEMA.names)
        back = records.unpack(records.pack(df, layout), layout)
        assert back["id"].tolist() == list(range(7)) and back["pred_err"].tolist() == df["pred_err"].tolist()
        assert np.array_equal(np.stack(back["z"]), np.stack(df["z"]))
        assert back["action"].isna().all() if action_dim is None else np.array_equal(np.stack(back["action"]), np.stack(df["action"]))
    with pytest.raises(ValueError):
        records.unpack(b"x" * 10, layout)
    with pytest.raises(ValueError):
        records.pack(df.assign(z=[[1.0]] * 7), layout)
    with pytest.raises(ValueError):
        records.read_header(b"abc")
    with pytest.raises(ValueError):
        records.read_header(b"XXXX" + records.header(layout, 0)[4:])


def test_record_files(spark, tmp_path):
    layout = records.Layout(4, 2)
    df = pd.DataFrame(rows(25), columns=SCHEMA.names)
    (tmp_path / "seg_00000.dat").write_bytes(records.header(layout, 10) + records.pack(df[:10], layout))
    (tmp_path / "seg_00001.dat").write_bytes(records.header(layout, 10) + records.pack(df[10:20], layout))
    (tmp_path / "wal.dat").write_bytes(records.header(layout, 0) + records.pack(df[18:], layout) + b"torn re")  # the first two are sealed as well
    got = records.read(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(25)) and got[24].z == df["z"][24]
    (tmp_path / "seg_00001.dat").write_bytes(records.header(layout, 10) + records.pack(df[10:15], layout))
    with pytest.raises(Exception, match="5 records of 10"):
        records.read(spark, str(tmp_path)).collect()


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    with pytest.raises(ValueError):
        Store(spark, path)
    store = Store(spark, path, MemoryConfig(4, 2))
    assert store.count() == 0
    df = spark.createDataFrame(rows(10), SCHEMA)
    store.append(df)
    assert store.append_new(spark.createDataFrame(rows(5, seed=2), SCHEMA).drop("id", "seq_no"), ["timestamp_ns"]) == 10
    again = Store(spark, path, MemoryConfig(4, 2))
    assert [r.id for r in again.scan(8).collect()] == list(range(8, 15))
    assert {(r.episode_id, r.seq_no) for r in again.scan(10).collect()} == {(0, 4), (1, 3), (2, 3), (0, 5), (1, 4)}
    with pytest.raises(ValueError):
        Store(spark, path, MemoryConfig(5, 2))
    with pytest.raises(Exception, match="4 elements"):
        store.append(spark.createDataFrame(rows(1, 3), SCHEMA))
    assert again.count() == 15  # nothing of the failed append is there
    old = again.read()
    again.replace(again.read().where("id % 2 = 0"))
    assert Store(spark, path).count() == 8 and old.count() == 15  # readers of the old version see it still


def test_flags_are_facts_beside_the_rows(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = Store(spark, path, MemoryConfig(4, 2))
    store.append(spark.createDataFrame(rows(10), SCHEMA))
    before = store.meta["parts"]
    store.flag(spark.createDataFrame([(1,), (2,)], "id long"), 1)
    store.flag(spark.createDataFrame([(2,), (99,)], "id long"), 2)
    assert store.meta["parts"] == before
    store.append(spark.createDataFrame(rows(12)[10:], SCHEMA))
    assert {r.id: r.flags for r in Store(spark, path).read().collect()} == dict.fromkeys(range(12), 0) | {1: 1, 2: 3}
    store.replace(store.read())
    assert {r.id: r.flags for r in Store(spark, path).read().where("flags > 0").collect()} == {1: 1, 2: 3} and store.meta["flags"] == []


def test_pointers_of_a_store(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store, other = Store(spark, path, MemoryConfig(4, 2)), Store(spark, path)
    for k in range(5):
        store.append(spark.createDataFrame(rows(2, seed=k), SCHEMA), notes={"k": k})
    assert store.count() == 10 and Store(spark, path).meta["k"] == 4 and len(store._pointers()) == 3
    with pytest.raises(RuntimeError, match="someone else"):
        other.number = store.number - 1  # it has seen the pointer before the last one
        other.append(spark.createDataFrame(rows(2), SCHEMA))
    assert Store(spark, path).count() == 10  # its rows are listed nowhere


def test_ingest_that_fails_between_rows_and_pointer_appends_once(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s", MemoryConfig(4, 2))
    src = arrivals(spark, 12)
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    write = Store._write_pointer

    def fails(self, meta):
        raise OSError("lost after the rows, before the pointer")

    monkeypatch.setattr(Store, "_write_pointer", fails)
    with pytest.raises(Exception, match="lost after the rows"):
        ingest(stream, store, f"{tmp_path}/cp", ["timestamp_ns"]).awaitTermination()
    monkeypatch.setattr(Store, "_write_pointer", write)
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.count() == 0
    for _ in range(2):
        ingest(stream, store, f"{tmp_path}/cp", ["timestamp_ns"]).awaitTermination()
    assert Store(spark, f"file://{tmp_path}/s").count() == 12
    # the offsets are lost after the append: the batch comes again under its number
    ingest(stream, Store(spark, f"file://{tmp_path}/s"), f"{tmp_path}/cp2", ["timestamp_ns"]).awaitTermination()
    assert Store(spark, f"file://{tmp_path}/s").count() == 12


def test_plugged_in_parts_take_the_place_of_built_in_ones(spark):
    calls = []

    def index(keys, asked, k):
        calls.append(("index", k))
        return asked.select("query_id", F.explode(F.expr("array(3L, 5L)")).alias("id")).withColumn("score", F.lit(0.5)).withColumn("rank", F.lit(1))

    def expander(found, edges, depth):
        calls.append(("expander", depth))
        return found.select("query_id", "id", "score").unionByName(found.select("query_id", F.lit(7).cast("long").alias("id"), F.lit(0.1).alias("score")).distinct())

    def scorer(candidates, log_, queries):
        calls.append("scorer")
        return candidates.select("query_id", "id", (-F.col("id")).cast("double").alias("score"), (F.col("id") - 2).cast("int").alias("rank"))

    def predictor(queries, context):
        calls.append("predictor")
        return queries.select("query_id", F.col("base").alias("prediction"))

    m = Memory(spark, MemoryConfig(4, 2), Options(expansion_depth=2), scorer=scorer, index=index, expander=expander, predictor=predictor)
    m.observe(arrivals(spark, 20), ["timestamp_ns"])
    m.edges = spark.createDataFrame([], "src long, slot int, dst long, weight double, edge_type int")
    q = m.log.where("id in (1, 2)").select(F.col("id").alias("query_id"), "z", "action", F.col("z").alias("base"))
    assert sorted((r.query_id, r.id) for r in m.recall(q, 5).collect()) == [(1, 3), (1, 5), (1, 7), (2, 3), (2, 5), (2, 7)]
    assert calls == [("index", 25), ("expander", 2), "scorer"]
    assert m.context(q, 5).where("mask").count() == 6 and m.predict(q, 5).where("prediction is not null").count() == 2 and calls[-1] == "predictor"
    assert not m.train_if_needed()


def test_state_of_the_index_and_tiers(spark):
    m = Memory(spark, MemoryConfig(4, 2), Options(n_lists=3, nprobe=3, inverted=True))
    assert not m.train_if_needed() and m.index_state() == {"trained": False, "lists": 0, "rows": 0}
    with pytest.raises(RuntimeError):
        m.index_health()
    m.observe(arrivals(spark, 20), ["timestamp_ns"])
    assert m.train_if_needed() and not m.train_if_needed()
    assert m.index_state() == {"trained": True, "lists": 3, "rows": 20} and not m.index_health().first().needs_retrain
    m.observe(arrivals(spark, 9, 5), ["timestamp_ns"])  # assigned when they come, not when they are searched
    assert m.index_state()["rows"] == 29
    q = m.log.where("id in (3, 25)").select(F.col("id").alias("query_id"), "z", "action")
    exact = Memory(spark, MemoryConfig(4, 2))
    exact.log = m.log
    assert sorted((r.query_id, r.id) for r in m.recall(q, 4).collect()) == sorted((r.query_id, r.id) for r in exact.recall(q, 4).collect())
    with pytest.raises(ValueError):
        m.tier_counts()
    t = Memory(spark, MemoryConfig(4, 2), Options(hot_capacity=5, n_lists=2, nprobe=2))
    t.observe(arrivals(spark, 8), ["timestamp_ns"])
    assert t.tier_counts() == {"hot": 8, "cold": 0}
    t.migrate(NOW)
    assert t.tier_counts() == {"hot": 5, "cold": 3} and {t.tier_of(i) for i in range(8)} == {"hot", "cold"}
    with pytest.raises(ValueError):
        t.tier_of(99)


def test_dense_ids(spark):
    df = spark.createDataFrame([(e, t) for t, e in enumerate([2, 0, 1, 2, 2, 0] * 20)], "episode_id long, timestamp_ns long").repartition(7)
    got = with_dense_ids(df, 100, ["timestamp_ns"], spark.createDataFrame([(2, 5)], "episode_id long, size long")).orderBy("id").collect()
    assert [r.id for r in got] == list(range(100, 220)) and [r.timestamp_ns for r in got] == list(range(120))
    assert [r.seq_no for r in got if r.episode_id == 2] == list(range(5, 65)) and [r.seq_no for r in got if r.episode_id == 0] == list(range(40))
    assert with_dense_ids(df.limit(0), 3, ["timestamp_ns"]).count() == 0


def test_synthetic_trajectories_are_deterministic(spark):
    model = synthetic.SyntheticWorld(6, 2, seed=4)
    a = synthetic.trajectories(spark, model, 6, 5)
    key = lambda df: sorted((r.episode_id, r.seq_no, tuple(r.z), tuple(r.z_next), r.pred_err) for r in df.collect())
    assert key(a) == key(synthetic.trajectories(spark, model, 6, 5).repartition(3)) and a.count() == 30
    one = {(r.episode_id, r.seq_no): r for r in a.collect()}
    assert one[2, 1].z == one[2, 0].z_next and np.linalg.norm(one[0, 0].z) == pytest.approx(1)
    assert one[2, 1].pred_err == pytest.approx(np.linalg.norm(np.array(one[2, 1].z_next) - np.array(one[2, 1].z)))
    same = synthetic.model_steps(a, model).where(F.col("base") != F.col("z_next"))
    assert same.count() == 0  # the model's noise is keyed by episode and step
    with pytest.raises(ValueError):
        model.step(np.zeros(6), None)


def arrivals(spark, n, seed=0, episodes=3):
    return spark.createDataFrame([(e, t, p, z, a) for _, e, _, t, p, _, z, a in rows(n, seed=seed, episodes=episodes)], "episode_id long, timestamp_ns long, pred_err double, z array<double>, action array<double>")


def test_memory_from_observation_to_maintenance(spark, tmp_path):
    m = Memory(spark, MemoryConfig(4, 2), Options(n_lists=4, nprobe=4), Store(spark, f"file://{tmp_path}/m", MemoryConfig(4, 2)), lifecycle.EvictionPolicy())
    assert m.observe(arrivals(spark, 30), ["timestamp_ns"]) == 0 and m.observe(arrivals(spark, 6, 1), ["timestamp_ns"]) == 30
    assert m.count() == 36 and np.linalg.norm(m.get(35).first().z) == pytest.approx(1)
    q = m.log.where("id in (3, 4)").select(F.col("id").alias("query_id"), "z", "action")
    exact = sorted((r.query_id, r.id) for r in m.recall(q, 3, token=0).collect())
    m.train_index()
    assert sorted((r.query_id, r.id) for r in m.recall(q, 3).collect()) == exact  # every list is probed
    with pytest.raises(RuntimeError):
        m.train_index()
    m.tag_outcome(0, True, NOW)
    m.tag_outcome(0, False, NOW)
    m.tag_outcome(7, True, NOW)
    m.pin(m.log.where("id = 5").select("id"))
    m.tombstone(m.log.where("id = 6").select("id"))
    worker = Maintenance(m, capacity=20, compaction_threshold=10)
    report = worker.step(NOW)
    assert report["feedback_events_applied"] == len({i for _, i in exact}) and report["compaction"]["tombstones_dropped"] == 1
    assert report["eviction"]["new_count"] == 20 and m.count() == 20 and report["migration"] is None
    assert m.log.where("flags = 2").count() == 1  # the pin outlived both rebuilds
    assert m.facts.join(m.log, "id").count() == m.facts.count()  # feedback moved to the new ids
    assert Store(spark, f"file://{tmp_path}/m").count() == 20
    assert worker.step(NOW)["feedback_events_applied"] == 0
    assert Maintenance(m, capacity=1, enabled=False).step(NOW)["eviction"] is None
    with pytest.raises(ValueError):
        m.migrate(NOW)
    with pytest.raises(ValueError):
        Memory(spark, MemoryConfig(4), Options(action_scale=1.0))
    with pytest.raises(Exception):
        m.observe(arrivals(spark, 2).withColumn("action", F.lit(None).cast("array<double>")), ["timestamp_ns"])
    assert m.count() == 20


def test_tiered_memory(spark):
    m = Memory(spark, MemoryConfig(4, 2), Options(hot_capacity=8, n_lists=3, nprobe=3))
    m.observe(arrivals(spark, 20), ["timestamp_ns"])
    report = m.migrate(NOW)
    assert report["migrated"] == 12 and {r.tier: r["count"] for r in m.tiers.groupBy("tier").count().collect()} == {"hot": 8, "cold": 12}
    q = m.log.where("id in (1, 2)").select(F.col("id").alias("query_id"), "z", "action")
    exact = Memory(spark, MemoryConfig(4, 2))
    exact.log = m.log
    assert sorted((r.query_id, r.id) for r in m.recall(q, 4).collect()) == sorted((r.query_id, r.id) for r in exact.recall(q, 4).collect())
    m.promote(m.tiers.where("tier = 'cold'").first().id)
    assert m.tiers.where("tier = 'hot'").count() == 9
    for bad in (m.compact, lambda: m.evict(3, NOW)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Options(hot_capacity=3, action_scale=1.0)


def test_streams(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", MemoryConfig(4, 2))
    src = arrivals(spark, 30)
    for lo in (0, 10, 20):
        src.where(F.col("timestamp_ns").between(NOW + lo, NOW + lo + 9)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        ingest(stream, store, f"{tmp_path}/cp", ["timestamp_ns"]).awaitTermination()
    assert [(r.id, r.timestamp_ns - NOW) for r in store.scan().collect()] == [(i, i) for i in range(30)]
    from mnemospark.operators.trigger import gate

    errors = spark.createDataFrame([(k, i, float((i * 7 + k) % 11)) for k in range(3) for i in range(40)], "key long, ord long, error double")
    for lo in (0, 20):
        errors.where(F.col("ord").between(lo, lo + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/err")
    q = gate_stream(spark.readStream.schema(errors.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/err")).writeStream.format("memory").queryName("gated").trigger(availableNow=True).start()
    q.awaitTermination()
    r6 = lambda df: sorted((r.key, r.ord, round(r.ema_mean, 9), r.retrieve, r.retrieve_causal) for r in df.collect())
    assert r6(spark.table("gated")) == r6(gate(errors))
    ts = "timestamp'2024-01-01 00:00:00'"
    spark.sql(f"SELECT id AS token, id * 10 AS id, {ts} AS used_at FROM range(4)").write.parquet(f"{tmp_path}/used")
    spark.sql(f"SELECT id AS token, id = 2 AS helped, {ts} + INTERVAL 1 MINUTE AS told_at FROM range(2, 6)").write.parquet(f"{tmp_path}/told")
    read = lambda p: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{p}").schema).parquet(f"{tmp_path}/{p}")
    q = feedback_stream(read("used"), read("told")).writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.id, r.helped) for r in spark.table("told").collect()) == [(20, True), (30, False)]
