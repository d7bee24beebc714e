"""The typed, degree-bounded graph over experiences: edges, upserts, breadth-first expansion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.experience import by_episode
from .components import checkpointed
from .search import exact_topk, rank

TEMPORAL, ANALOGOUS = 0, 1


def temporal_edges(log: DataFrame, weight: float = 1.0) -> DataFrame:
    """(src, dst, weight, edge_type): each row's predecessor in its episode points to it."""
    prev = F.lag("id").over(by_episode())
    return log.select(prev.alias("src"), F.col("id").alias("dst"), F.lit(float(weight)).alias("weight"), F.lit(TEMPORAL).alias("edge_type")).where("src is not null")


def analogous_edges(log: DataFrame, n: int = 3, threshold: float = 0.5, fetch_factor: int = 5, vector: str = "z") -> DataFrame:
    """Edges to the n most similar rows of other episodes that were there when the row came.

    The n * fetch_factor most similar rows up to and including the row itself are fetched first; the row,
    its episode and scores below the threshold are removed after that, so fewer than n may be left.  The
    fetch is a blocked search: it returns that many rows per row, never all pairs.
    """
    if n <= 0:
        return log.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("weight"), F.lit(ANALOGOUS).alias("edge_type")).where("false")
    fetched = exact_topk(log.select("id", F.col(vector).alias("v")), log.select(F.col("id").alias("query_id"), F.col(vector).alias("v")), n * fetch_factor, "v", upto=True)
    ends = log.select("id", "episode_id")
    both = fetched.where("id <> query_id").where(F.col("score") >= threshold).join(ends.withColumnRenamed("episode_id", "eb"), "id").join(ends.select(F.col("id").alias("query_id"), F.col("episode_id").alias("ea")), "query_id")
    kept = rank(both.where("ea <> eb").drop("rank"), n, "query_id")
    return kept.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("weight"), F.lit(ANALOGOUS).alias("edge_type"))


def _fold_rows(degree: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, slots, done = None, [], []
        for batch in batches:
            for s, dst, weight, kind in zip(*(batch.column(c).to_pylist() for c in ("src", "dst", "weight", "edge_type")), strict=True):
                if s != src:
                    done += [(src, i, *slot) for i, slot in enumerate(slots)]
                    src, slots = s, []
                at = next((i for i, slot in enumerate(slots) if slot[0] == dst), len(slots))
                if at == degree:  # full, and a new dst
                    at = min(range(degree), key=lambda i: slots[i][1]) if degree else 0
                    if not degree or weight <= slots[at][1]:
                        continue
                slots[at : at + 1] = [(dst, weight, kind)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in done], schema=schema)
            done = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (src, i, *slot), strict=True)) for i, slot in enumerate(slots)], schema=schema)

    return run


def bounded_edges(upserts: DataFrame, degree: int) -> DataFrame:
    """(src, slot, dst, weight, edge_type) after applying upserts (ord, src, dst, weight, edge_type) in order.

    A known dst is overwritten in its slot; a free slot is taken; else the first slot of least weight is
    replaced if the new weight is strictly greater.  Self-loops are ignored.  Upserts are dealt by source and
    sorted within partitions; a task passes over its rows once and holds the slots of one source, however many
    upserts a source has."""
    rows = upserts.where("src <> dst").select("src", "ord", "dst", F.col("weight").cast("double").alias("weight"), F.col("edge_type").cast("int").alias("edge_type"))
    rows = rows.repartition("src").sortWithinPartitions("src", "ord", "dst", "weight", "edge_type").select("src", "dst", "weight", "edge_type")
    kind = "src long, slot int, dst long, weight double, edge_type int"
    return rows.mapInArrow(_fold_rows(degree, to_arrow_schema(T.StructType.fromDDL(kind))), kind)


def upserts_of(log: DataFrame, analogous: DataFrame, temporal_weight: float = 1.0) -> DataFrame:
    """Edges in the order in which rows came: the temporal edge into a row, then its analogous ones, best first."""
    t = temporal_edges(log, temporal_weight).select(F.struct(F.col("dst").alias("row"), F.lit(0.0).alias("less"), F.col("dst").alias("tie")).alias("ord"), "src", "dst", "weight", "edge_type")
    a = analogous.select(F.struct(F.col("src").alias("row"), (2 - F.col("weight")).alias("less"), F.col("dst").alias("tie")).alias("ord"), "src", "dst", "weight", "edge_type")
    return t.unionByName(a)


def out_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node, 0 for nodes without edges."""
    return nodes.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def has_edge(edges: DataFrame, src: int, dst: int, edge_type: int | None = None) -> bool:
    """Is there an edge from src to dst, of any type or of the given one?"""
    found = edges.where((F.col("src") == src) & (F.col("dst") == dst))
    return not (found if edge_type is None else found.where(F.col("edge_type") == edge_type)).isEmpty()


def neighbours_of(edges: DataFrame, src: int, edge_type: int | None = None) -> DataFrame:
    found = edges.where(F.col("src") == src)
    return (found if edge_type is None else found.where(F.col("edge_type") == edge_type)).orderBy("slot")


def expand(seeds: DataFrame, edges: DataFrame, depth: int, max_nodes: int, edge_types: list[int] | None = None) -> DataFrame:
    """(query_id, id, is_seed, depth, edge_type, weight, place): breadth-first from each query's seeds.

    seeds: (query_id, id, rank).  Seeds come first and are never cut; a node is discovered once, by the
    first edge in the order of its parent's place, edge type and slot; the total is cut at max_nodes.
    A level is one equi-join with the bounded-degree edges, so rows grow by at most the degree."""
    types = edge_types if edge_types is not None else [TEMPORAL, ANALOGOUS]
    order = F.element_at(F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(i))]), F.col("edge_type"))
    out_edges = edges.where(F.col("edge_type").isin(types)).select("src", "dst", F.col("weight").alias("w"), F.col("edge_type").alias("t"), F.struct(order, "slot").alias("turn"))
    first = Window.partitionBy("query_id", "id").orderBy("rank")
    seen = seeds.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    place = Window.partitionBy("query_id").orderBy("rank")
    seen = seen.select("query_id", "id", F.lit(True).alias("is_seed"), F.lit(0).alias("depth"), F.lit(None).cast("int").alias("edge_type"), F.lit(None).cast("double").alias("weight"), F.row_number().over(place).alias("place"))
    seen = frontier = checkpointed(seen) if depth else seen
    for d in range(1, depth + 1):
        met = frontier.select("query_id", "place", F.col("id").alias("src")).join(out_edges, "src")
        new = met.withColumnRenamed("dst", "id").join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
        once = Window.partitionBy("query_id", "id").orderBy("place", "turn")
        new = new.withColumn("_n", F.row_number().over(once)).where("_n = 1")
        sizes = seen.groupBy("query_id").agg(F.max("place").alias("before"))
        new = new.join(sizes, "query_id").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("query_id").orderBy("place", "turn")))
        frontier = new.select("query_id", "id", F.lit(False).alias("is_seed"), F.lit(d).alias("depth"), F.col("t").alias("edge_type"), F.col("w").alias("weight"), "place")
        frontier = checkpointed(frontier)  # it is read three times by the next level
        seen = seen.unionByName(frontier)
    # a capped search is the uncapped one cut at its place, for the seeds are never cut
    return seen.where(F.col("is_seed") | (F.col("place") <= max_nodes))


