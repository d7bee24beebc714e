"""Exact and inverted-file cosine search for batches of queries.

Queries are the stated, smaller side.  They are taken in blocks of bounded size; a block is broadcast as a
matrix and multiplied with each Arrow batch of the corpus, STEP queries at a time.  A task keeps the k best
rows of each query of the block, so it returns at most k rows per query and holds no more than that and one
score matrix.  The final ranking sees ids and scores only, never vectors.  Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from .components import checkpointed

#: Queries of one broadcast block (8 MB at 64 elements), and of one matrix product.
BLOCK, STEP = 16_384, 256


def as_matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    if (n == 0).any():
        raise ValueError("cannot normalise a zero vector")
    return m / n


def merge_top(best_s: np.ndarray, best_i: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row of (best so far, new scores), best first, ties to the smaller id."""
    s = np.concatenate((best_s, scores), axis=1)
    i = np.concatenate((best_i, np.broadcast_to(ids, scores.shape)), axis=1)
    if s.shape[1] > k:
        at = np.argpartition(-s, k - 1, axis=1)[:, :k]
        cut = np.take_along_axis(s, at, axis=1).min(axis=1)
        for row in np.flatnonzero(((s >= cut[:, None]).sum(axis=1) > k) & (cut > -np.inf)):  # a tie at the border
            at[row] = np.lexsort((i[row], -s[row]))[:k]
        s, i = np.take_along_axis(s, at, axis=1), np.take_along_axis(i, at, axis=1)
    order = np.lexsort((i, -s), axis=1)
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def _scorer(sent, k: int, upto: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = sent.value
        best_s, best_i = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), np.int64)
        for b in batches:
            if not len(b) or not len(q):
                continue
            ids, m = b.column("id").to_numpy(), _unit(as_matrix(b.column("v")))
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"vectors have {m.shape[1]} elements, queries {q.shape[1]}")
            parts = []
            for lo in range(0, len(q), STEP):  # bounds the score matrix to STEP rows
                scores = q[lo : lo + STEP] @ m.T
                if upto:
                    scores[ids[None, :] > query_ids[lo : lo + STEP, None]] = -np.inf
                parts.append(merge_top(best_s[lo : lo + STEP], best_i[lo : lo + STEP], scores, ids, k))
            best_s, best_i = (np.concatenate(x) for x in zip(*parts, strict=True))
        row, at = np.nonzero(best_s > -np.inf)
        yield pa.record_batch([pa.array(query_ids[row]), pa.array(best_i[row, at]), pa.array(best_s[row, at])], names=["query_id", "id", "score"])

    return run


def rank(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """found with a rank from 1 to k within keys, by score, ties by id."""
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_topk(corpus: DataFrame, queries: DataFrame, k: int, vector: str = "z", query_vector: str | None = None, upto: bool = False) -> DataFrame:
    """(query_id, id, score, rank): the k rows of corpus most similar to each query.

    corpus: (id, vector); queries: (query_id, vector).  All vectors are brought to length 1.
    upto: a query sees the rows with ids up to its own only, those that were there when it came."""
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(query_vector or vector).alias("v"))
    rows = corpus.select(F.col("id").cast("long").alias("id"), F.col(vector).alias("v"))
    found = None
    for t in _query_blocks(q):
        sent = corpus.sparkSession.sparkContext.broadcast((t.column("query_id").to_numpy(), _query_matrix(t)))
        part = rows.mapInArrow(_scorer(sent, k, upto), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    return rank(found, k, "query_id")


def _query_blocks(q: DataFrame) -> Iterator[pa.Table]:
    """The queries (query_id, v, ...) in blocks of about BLOCK rows."""
    blocks = max(1, -(-q.count() // BLOCK))
    for b in range(blocks):
        mine = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        yield mine.toArrow().combine_chunks()


def _query_matrix(t: pa.Table) -> np.ndarray:
    m = as_matrix(t.column("v").combine_chunks() if len(t) else pa.array([], pa.list_(pa.float64())))
    return _unit(m) if len(m) else m


# inverted file


def train_centroids(vectors: DataFrame, n_lists: int, seed: int = 0, iterations: int = 25, vector: str = "z") -> DataFrame:
    """(list_id, centroid) by k-means over vectors of length 1; fewer lists if there are fewer rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(vec.normalize(F.col(vector))).alias("features"))
    k = min(n_lists, rows.count())
    if k < 1:
        raise ValueError("no vectors to train on")
    if k == 1:
        means = vectors.select(F.posexplode(vec.normalize(F.col(vector))).alias("d", "x")).groupBy("d").agg(F.avg("x").alias("x"))
        return means.agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c")).select(F.lit(0).alias("list_id"), F.col("c.x").alias("centroid"))
    model = KMeans(k=k, initMode="random", maxIter=iterations, seed=seed).fit(rows)
    return vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "list_id int, centroid array<double>")


def mean_centroids(rows: DataFrame, group: str, vector: str = "z") -> DataFrame:
    """(list_id, centroid): the mean vector of each group, by partial aggregation per element."""
    means = rows.select(F.col(group).cast("int").alias("list_id"), F.posexplode(vector).alias("d", "x")).groupBy("list_id", "d").agg(F.avg("x").alias("x"))
    return means.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("c")).select("list_id", F.col("c.x").alias("centroid"))


def _nearest(sent, keep: str, n: int, as_query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        list_ids, c = sent.value
        for b in batches:
            if not len(b):
                continue
            m = _unit(as_matrix(b.column("v")))
            d = (m * m).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * m @ c.T
            order = np.lexsort((np.broadcast_to(list_ids, d.shape), d), axis=1)[:, :n]
            row = np.repeat(np.arange(len(m)), order.shape[1])
            at = order.ravel()
            exact = ((m[row] - c[at]) ** 2).sum(axis=1)
            yield pa.record_batch([pa.array(b.column(keep).to_numpy()[row]), pa.array(list_ids[at].astype(np.int32)), pa.array(exact), pa.array(np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(m)))], names=[keep, "list_id", "distance", "probe"])

    return run


def _lists(rows: DataFrame, centroids: DataFrame, keep: str, n: int, vector: str) -> DataFrame:
    """The n nearest lists of each row. Centroids are a table of fixed size (n_lists)."""
    got = centroids.orderBy("list_id").collect()
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r.list_id for r in got], np.int64), np.array([r.centroid for r in got], np.float64)))
    return rows.select(F.col(keep).cast("long").alias(keep), F.col(vector).alias("v")).mapInArrow(_nearest(sent, keep, n, False), f"{keep} long, list_id int, distance double, probe int")


def assign_lists(rows: DataFrame, centroids: DataFrame, vector: str = "z") -> DataFrame:
    """(id, list_id, distance): the nearest list of each row and its squared distance, ties to the lower list."""
    return _lists(rows, centroids, "id", 1, vector).drop("probe")


def probe_lists(queries: DataFrame, centroids: DataFrame, nprobe: int, vector: str = "z") -> DataFrame:
    """(query_id, list_id, distance, probe): the nprobe nearest lists of each query, at least one."""
    return _lists(queries, centroids, "query_id", max(1, nprobe), vector)


def _list_scorer(sent, k: int):
    """As _scorer, but rows of a list are multiplied with the queries that probe the list only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q, askers = sent.value
        best_s, best_i = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            if not len(b) or not len(q):
                continue
            lists = b.column("list_id").to_numpy()
            order = np.argsort(lists, kind="stable")
            ids, m, cuts = b.column("id").to_numpy()[order], _unit(as_matrix(b.column("v")))[order], np.flatnonzero(np.diff(lists[order])) + 1
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"vectors have {m.shape[1]} elements, queries {q.shape[1]}")
            for lo, hi in zip((0, *cuts), (*cuts, len(ids)), strict=True):
                who = askers.get(int(lists[order[lo]]), np.zeros(0, np.int64))
                for step in range(0, len(who), STEP):  # bounds the score matrix to STEP rows
                    mine = who[step : step + STEP]
                    best_s[mine], best_i[mine] = merge_top(best_s[mine], best_i[mine], q[mine] @ m[lo:hi].T, ids[lo:hi], k)
        row, at = np.nonzero(best_s > -np.inf)
        yield pa.record_batch([pa.array(query_ids[row]), pa.array(best_i[row, at]), pa.array(best_s[row, at])], names=["query_id", "id", "score"])

    return run


def ivf_topk(corpus: DataFrame, assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int | None = 1, vector: str = "z") -> DataFrame:
    """Top k of each query among the rows of its nprobe nearest lists; it may find fewer than k and miss better
    rows elsewhere.  With nprobe None it finds what an exact search finds.

    Blocks of queries with the lists that they probe are broadcast; each Arrow batch of the corpus is multiplied
    list by list with the queries that probe the list, and a task keeps k rows per query.  So rows aren't dealt
    by list, and a hot list is read by as many tasks as its rows are."""
    if k <= 0:
        raise ValueError(f"k must be positive, not {k}")
    members = corpus.select(F.col("id").cast("long").alias("id"), F.col(vector).alias("v")).join(assigned.select("id", F.col("list_id").cast("int").alias("list_id")), "id")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("v"))

    def searched(lists: DataFrame) -> DataFrame:
        found = None
        for t in _query_blocks(asked.join(lists.groupBy("query_id").agg(F.collect_list("list_id").alias("lists")), "query_id")):
            probes = t.column("lists").combine_chunks() if len(t) else pa.array([], pa.list_(pa.int32()))
            row = np.repeat(np.arange(len(t)), pc.list_value_length(probes).to_numpy(zero_copy_only=False).astype(np.int64))
            which = probes.flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(which, kind="stable")
            names, first = np.unique(which[order], return_index=True)
            askers = dict(zip(names.tolist(), np.split(row[order], first[1:]), strict=True)) if len(names) else {}
            sent = corpus.sparkSession.sparkContext.broadcast((t.column("query_id").to_numpy(), _query_matrix(t), askers))
            part = members.mapInArrow(_list_scorer(sent, k), "query_id long, id long, score double")
            found = part if found is None else found.unionByName(part)
        return found

    if nprobe is not None:
        return rank(searched(probe_lists(queries, centroids, nprobe, vector).select("query_id", "list_id")), k, "query_id")
    first = checkpointed(rank(searched(probe_lists(queries, centroids, 1, vector).select("query_id", "list_id")), k, "query_id").drop("rank"))
    more = open_lists(first, assigned, probe_lists(queries, centroids, centroids.count(), vector).where("probe > 1"), k)
    return rank(first.unionByName(searched(more)), k, "query_id")


def open_lists(found: DataFrame, assigned: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, list_id): the probes whose list may hold a row as good as the k-th that was found.

    A list's rows are within its radius of its centroid, so none is nearer to a query than the centroid's
    distance less the radius; between vectors of length 1 a distance d is a score of 1 - d * d / 2."""
    radius = assigned.groupBy("list_id").agg(F.sqrt(F.max("distance")).alias("radius"))  # a row per list
    least = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    nearest = F.greatest(F.sqrt("distance") - F.col("radius"), F.lit(0.0))
    reach = probes.join(F.broadcast(radius), "list_id").join(least.select("query_id", "least"), "query_id", "left")
    return reach.where(F.col("least").isNull() | (1 - nearest * nearest / 2 >= F.col("least") - 1e-9)).select("query_id", "list_id")


def bucket_sizes(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(list_id, size), empty lists with 0."""
    return centroids.select("list_id").join(assigned.groupBy("list_id").agg(F.count("*").alias("size")), "list_id", "left").select("list_id", F.coalesce("size", F.lit(0)).alias("size"))


def index_health(assigned: DataFrame, centroids: DataFrame, baseline: DataFrame, window: int = 1000, imbalance: float = 3.0, drift: float = 2.0) -> DataFrame:
    """(imbalance, drift, needs_retrain): largest over mean list size; mean distance of the last `window` rows
    over that of the training rows (baseline: (baseline,)). 1 where nothing has been added. Advice only."""
    sizes = bucket_sizes(assigned, centroids).agg(F.max("size").alias("m"), F.avg("size").alias("a"), F.sum("size").alias("n"))
    recent = assigned.orderBy(F.col("id").desc()).limit(window).agg(F.avg("distance").alias("recent"))
    both = sizes.crossJoin(recent).crossJoin(baseline)  # one row each
    i = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("m") / F.col("a"))
    d = F.when(F.col("recent").isNull(), F.lit(1.0)).when(F.col("baseline") == 0, F.when(F.col("recent") == 0, F.lit(1.0)).otherwise(F.lit(float("inf")))).otherwise(F.col("recent") / F.col("baseline"))
    return both.select(i.alias("imbalance"), d.alias("drift"), ((i >= imbalance) | (d >= drift)).alias("needs_retrain"))


def lloyd_step(rows: DataFrame, centroids: DataFrame, vector: str = "z") -> DataFrame:
    """(list_id, centroid) after one round of k-means; a list without rows keeps its centroid."""
    unit = rows.select("id", vec.normalize(F.col(vector)).alias("z"))
    moved = mean_centroids(unit.join(assign_lists(unit, centroids).select("id", "list_id"), "id"), "list_id")
    return centroids.select("list_id", F.col("centroid").alias("old")).join(moved, "list_id", "left").select("list_id", F.coalesce("centroid", "old").alias("centroid"))


def tiered_topk(hot: DataFrame, cold: DataFrame, assigned: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, nprobe: int | None = 1, vector: str = "z") -> DataFrame:
    """Top k over a hot tier searched exactly and a cold tier searched by its lists, exactly with nprobe None."""
    found = exact_topk(hot, queries, k, vector).drop("rank").withColumn("tier", F.lit("hot"))
    found = found.unionByName(ivf_topk(cold, assigned, centroids, queries, k, nprobe, vector).drop("rank").withColumn("tier", F.lit("cold")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("tier").desc(), "id")  # hot first on ties
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
