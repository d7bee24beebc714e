"""Near-duplicate detection by MinHash with tensored banding.

A document's set holds its distinct word shingles; documents are linked when 100 |A and B| is at least
80 |A or B|.  Instead of the hashes of every table being drawn anew, COLLECTIONS small collections of
ROWS minhashes each are drawn, and a table's key combines the keys of two collections: 20 collections of
3 give 190 tables of 6 rows from 60 minhashes instead of 1140.  A pair of similarity 0.8 agrees in a
collection with probability 0.512, and is missed only if it agrees in fewer than two: 1.3 in 100,000.

1. Documents with equal sets are one node (its least id), so copies cost one row each.
2. Only collections in which a node agrees with another node count: a node with fewer than two of them is
   in no shared table.  The others make their table keys from pairs of those collections.
3. In each bucket of a table every node is paired with the bucket's least node.  Pairs are filtered by size
   (a bound on the similarity) and confirmed on the full sets.  Confirmed links give components; buckets whose nodes are then in one component are settled.
4. In unsettled buckets of up to SMALL nodes, all nodes outside the bucket's largest component are paired
   with all nodes of other components, and confirmed as above.
5. The nodes of larger unsettled buckets are grouped by the key of the bucket's first collection, the groups
   dealt into chunks of bounded bytes, and each two chunks compared in one task, set against set (a product
   of incidence matrices over the shingles that two of them share at least); two chunks of the group's largest
   component aren't.  A pair is compared only in the
   group of the first collection that it agrees in, and only if it agrees in two or more and its components
   differ; a task returns which components are linked, not pairs.

So every pair that shares a table is either confirmed or refused on its full sets, or in one component by
other links, and no step makes rows of all the pairs of a bucket.

Defined results: words are what stands between white space, lower-cased in A-Z; a text of fewer words than
a shingle has one shingle of all its words; a null text or one without words has an empty set and is linked
with nothing; rows that share an id are separate; in near_duplicates rows with a null id are linked with
nothing, have a null component and are kept; drop_near_duplicates judges every row by its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, stored, text_chunks
from .components import connected_components
from .tokens import Words, mix64

COLLECTIONS, ROWS = 20, 3
#: Nodes of an unsettled bucket up to which its pairs are made in a join.
SMALL = 16
#: Nodes, and bytes of their sets, of one chunk of a large group.
CHUNK_NODES, CHUNK_BYTES = 1024, 8 << 20
PERCENT = 80

_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 2**64, COLLECTIONS * ROWS, np.uint64)
_TIMES = _rng.integers(0, 2**64, COLLECTIONS * ROWS, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a batch: ascending distinct shingle hashes, text after text, and their bounds."""
    w = Words(texts, lower=True)
    length = np.minimum(w.n, size)
    count = np.where(w.n > 0, w.n - length + 1, 0)
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + w.first[:-1][doc]
    h = np.empty(len(at), np.uint64)
    whole = length[doc] == size
    h[whole] = w.window_hash(at[whole], size)
    h[~whole] = w.run_hash(at[~whole], length[doc[~whole]])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def minhashes(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """[text, COLLECTIONS * ROWS] minhashes; empty sets have the greatest value throughout."""
    out = np.full((len(bounds) - 1, COLLECTIONS * ROWS), 2**64 - 1, np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(COLLECTIONS * ROWS):
            out[full, k] = np.minimum.reduceat((sets ^ _FLIP[k]) * _TIMES[k], bounds[full])
    return out


def collection_keys(mins: np.ndarray) -> np.ndarray:
    """[text, COLLECTIONS]: one key for the ROWS minhashes of each collection."""
    part = mins.reshape(len(mins), COLLECTIONS, ROWS)
    key = np.broadcast_to(np.arange(1, COLLECTIONS + 1, dtype=np.uint64), part.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part[:, :, r])
    return key


def _sketch_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            sets, bounds = shingle_sets(part.column("text").to_pylist(), size)
            n = np.diff(bounds)
            mins = minhashes(sets, bounds)
            keys = collection_keys(mins).view(np.int64)
            # a digest of the set: two order-free sums of independently mixed members
            parts = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(c))))) for c in (0x1D8E4E27C47D124F, 0x9FB21C651E98DF25)]
            d1, d2 = ((p[bounds[1:]] - p[bounds[:-1]]).view(np.int64) for p in parts)
            yield pa.record_batch(
                [part.column("rid"), part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * COLLECTIONS), pa.array(keys.ravel()))],
                names=["rid", "doc_id", "n", "d1", "d2", "keys"],
            )

    return run


def _set_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            sets, bounds = shingle_sets(part.column("text").to_pylist(), size)
            yield pa.record_batch([part.column("node"), pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["node", "members"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _linked(x: dict, y: dict, percent: int, first: int, same: bool) -> list[tuple[int, int]]:
    """Linked components of two chunks of a group: pairs of labels whose nodes agree in collection `first`
    before any other, in one more at least, and are similar enough on their full sets."""
    nx = len(x["label"])
    members = [np.frombuffer(m, np.uint64) for m in (x["members"] if same else [*x["members"], *y["members"]])]
    size = np.array([len(m) for m in members])
    keys = np.array(x["keys"] if same else [*x["keys"], *y["keys"]], np.int64)
    label = np.array(x["label"] if same else [*x["label"], *y["label"]], np.int64)
    left, right = slice(0, nx), slice(0, nx) if same else slice(nx, None)
    small, large = np.minimum(size[left, None], size[None, right]), np.maximum(size[left, None], size[None, right])
    wanted = (label[left, None] != label[None, right]) & (100 * small >= percent * large)
    agree = np.zeros(wanted.shape, np.int8)
    for c in range(keys.shape[1]):
        equal = keys[left, c][:, None] == keys[None, right, c]
        agree += equal
        if c < first:
            wanted &= ~equal
    wanted &= agree >= 2
    if not wanted.any():
        return []
    # only shingles that two of the sets share can count
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), size)
    _, shingle, n = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.where(n > 1, np.cumsum(n > 1) - 1, -1)
    column = number[shingle]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros(wanted.shape, np.float32)
    step = 4096
    for lo in range(0, int(number.max()) + 1, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        block = np.zeros((len(members), step), np.float32)
        block[owner[a:b], column[a:b] - lo] = 1
        both += block[left] @ block[right].T
    union = size[left, None] + size[None, right] - both
    i, j = np.nonzero(wanted & (100 * both >= percent * union))
    return list({(int(a), int(b)) for a, b in zip(np.minimum(label[left][i], label[right][j]), np.maximum(label[left][i], label[right][j]), strict=True)})


def _compared(percent: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        first, _, lo, hi = (k.as_py() for k in key)
        side = lambda chunk: group.filter(pa.array(group.column("chunk").to_numpy() == chunk)).select(["label", "keys", "members"]).to_pydict()
        x = side(lo)
        found = _linked(x, x if lo == hi else side(hi), percent, first, lo == hi)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


class _Finder:
    """The tables that candidate pairs are confirmed against, and the components found so far."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent
        self.labels: DataFrame | None = None  # (node, label) of linked nodes

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), a stored table."""
        side = lambda c: self.sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}"))
        full = pairs.join(side("a"), "a").join(side("b"), "b")
        return stored(full.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(self.percent), "a long, b long"), "links", batch_rows=500)

    def add(self, pairs: DataFrame) -> None:
        """Confirm pairs and unite the components that they link."""
        links = self.confirm(pairs)
        if links.isEmpty():
            return
        if self.labels is None:
            self.labels = connected_components(links)
            return
        of = self.labels
        lifted = links.join(of.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        self.unite(lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))

    def unite(self, links: DataFrame) -> None:
        """Unite components, given as pairs (a, b) of labels; the label of an unlinked node is the node."""
        between = stored(links.where("a <> b").distinct(), "between")
        if between.isEmpty():
            return
        top = connected_components(between).select(F.col("node").alias("label"), F.col("label").alias("best"))
        if self.labels is None:
            self.labels = top.select(F.col("label").alias("node"), F.col("best").alias("label"))
            return
        lone = top.join(self.labels.select("label").distinct(), "label", "left_anti").select(F.col("label").alias("node"), F.col("best").alias("label"))
        moved = self.labels.join(top, "label", "left").select("node", F.coalesce("best", "label").alias("label"))
        self.labels = stored(moved.unionByName(lone), "labels")

    def labelled(self, rows: DataFrame) -> DataFrame:
        if self.labels is None:
            return rows.withColumn("label", F.col("node"))
        return rows.join(self.labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _pairs(df: DataFrame, x: str, nx: str, y: str, ny: str, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, whose sizes allow the similarity."""
    fits = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
    return df.where((F.col(x) != F.col(y)) & fits).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _keyed(docs: DataFrame, null_ids: bool, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(rid, doc_id, text) of the rows, and whether rid tells all rows apart: it is the id if no id repeats,
    else a hash of id and text, so that rows that are equal in both share it.  null_ids: rows without an id get a rid too."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    unsure = (F.col("count") > 1) | F.col("doc_id").isNull()
    unique = (base if null_ids else base.where("doc_id is not null")).groupBy("doc_id").count().where(unsure).isEmpty()
    rid = F.col("doc_id") if unique else F.xxhash64("doc_id", "text")
    return base.withColumn("rid", rid if null_ids else F.when(F.col("doc_id").isNotNull(), rid)), unique


def _components(base: DataFrame, unique: bool, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (rid, doc_id, text): (rid, doc_id, n, ...) of every row, and (rid, doc_id, label) of those with a rid and a set.

    Rows are linked if their labels are equal.
    """
    sketches = stored(base.mapInArrow(_sketch_rows(size), "rid long, doc_id long, n long, d1 long, d2 long, keys array<long>"), "sketches")
    real = sketches.where("rid is not null and n > 0")
    # what is joined back to the rows it was counted from is stored first: then the join is between two
    # plain exchanges, and Spark splits its hot keys
    classes = stored(real.groupBy("n", "d1", "d2").agg(F.min("rid").alias("node")), "classes")
    members = stored(real.select("rid", "doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("rid", "doc_id", "node"), "members")
    # rows of one rid are equal, so that a node has one sketch, however often its row stands in the table
    heads = real if unique else real.dropDuplicates(["rid"])
    nodes = stored(heads.join(classes.select("node"), F.col("rid") == F.col("node"), "left_semi").select(F.col("rid").alias("node"), "n", "keys"), "nodes")

    # collections in which a node agrees with another node
    flat = nodes.select("node", F.posexplode("keys").alias("c", "key"))
    shared = stored(flat.groupBy("c", "key").agg(F.count("*").alias("agree")).where("agree > 1").select("c", "key"), "shared")
    alive = flat.join(shared, ["c", "key"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "key"))).alias("own")).where(F.size("own") >= 2)
    alive = stored(alive.join(nodes.select("node", "n", "keys"), "node"), "alive")
    texts = base.where("rid is not null").select(F.col("rid").alias("node"), "text")
    sets = stored((texts if unique else texts.dropDuplicates(["node"])).join(alive.select("node"), "node", "left_semi").mapInArrow(_set_rows(size), "node long, members binary"), "sets")

    finder = _Finder(sets, percent)
    two = alive.select("node", "n", "own", F.posexplode("own").alias("i", "x")).select("node", "n", "x", F.explode(F.slice("own", F.col("i") + 2, COLLECTIONS)).alias("y"))
    rows = two.select(F.xxhash64("x.c", "x.key", "y.c", "y.key").alias("bucket"), "node", "n", F.col("x.c").alias("c"), F.col("x.key").alias("key"))
    many = stored(rows.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("centre"), F.min_by("n", "node").alias("centre_n")).where("size > 1"), "many")
    full = stored(rows.join(many, "bucket"), "buckets")
    finder.add(_pairs(full, "node", "n", "centre", "centre_n", percent))

    now = finder.labelled(full.select("bucket", "node", "n", "c", "key", "size"))
    each = now.groupBy("bucket", "label").agg(F.count("*").alias("k"))
    open_ = stored(each.groupBy("bucket").agg(F.max_by("label", "k").alias("main"), F.count("*").alias("labels")).where("labels > 1").select("bucket", "main"), "unsettled")
    todo = stored(now.join(open_, "bucket"), "open")
    small = todo.where(F.col("size") <= SMALL)
    x = small.where("label <> main").select("bucket", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"))
    y = small.select("bucket", F.col("node").alias("y"), F.col("n").alias("ny"), F.col("label").alias("ly"))
    finder.add(_pairs(x.join(y, "bucket").where("lx <> ly"), "x", "nx", "y", "ny", percent))

    large = stored(finder.labelled(todo.where(F.col("size") > SMALL).select("c", "key", "node", "n").distinct()), "large")
    if not large.isEmpty():
        # a group's largest component is dealt apart from the other nodes: its own chunks aren't compared with each
        # other, and its nodes are copied once per chunk of the others only
        chunks = lambda k, n: F.greatest(F.ceil(F.col(k) / CHUNK_NODES), F.ceil(F.col(n) * 8 / CHUNK_BYTES)).cast("int")
        parts = large.groupBy("c", "key", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        groups = parts.groupBy("c", "key").agg(F.max(F.struct("k", "n", "label")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("labels")).where("labels > 1")
        groups = groups.select("c", "key", "main.label", "main.k", "main.n", F.expr("k - main.k").alias("rest_k"), F.expr("n - main.n").alias("rest_n"))
        groups = stored(groups.select("c", "key", F.col("label").alias("main"), chunks("rest_k", "rest_n").alias("rest"), (chunks("rest_k", "rest_n") + chunks("k", "n")).alias("all")), "groups")
        dealt = large.join(groups, ["c", "key"]).withColumn("h", F.xxhash64("node"))
        others = F.col("label") != F.col("main")
        chunk = F.when(others, F.pmod("h", "rest")).otherwise(F.col("rest") + F.pmod("h", F.col("all") - F.col("rest"))).cast("int")
        against = F.explode(F.sequence(F.lit(0), F.when(others, F.col("all")).otherwise(F.col("rest")) - 1))
        dealt = dealt.withColumn("chunk", chunk).join(alive.select("node", "keys"), "node").join(sets, "node").select("c", "key", "chunk", "label", "keys", "members", against.alias("other"))
        dealt = dealt.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other")
        finder.unite(stored(dealt.groupBy("c", "key", "lo", "hi").applyInArrow(_compared(percent), "a long, b long"), "compared"))

    return sketches, finder.labelled(members).select("rid", "doc_id", "label")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable, its own included), kept."""
    base, unique = _keyed(docs, False, id_col, text_col)
    sketches, known = _components(base, unique, size, percent)
    least = stored(known.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    found = known.join(least, "label").select("rid", "component_id")
    found = found if unique else found.distinct()
    out = sketches.select("rid", "doc_id", "n").join(found, "rid", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.col("doc_id").isNull() | (F.col("doc_id") == component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the least id.

    Rows are judged by their own texts, whatever their ids: those without an id come after all others, and of
    rows that share id and text one is kept.  Rows without words are linked with nothing and all kept.
    """
    base, unique = _keyed(docs, True, id_col, text_col)
    _, known = _components(base, unique, size, percent)
    key = fresh_name(docs, "rid")
    known = known if unique else known.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.count("*").alias("rows"))
    known = stored(known, "known")
    first = stored(known.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid"))["rid"].alias("first")), "first")
    gone = known.join(first, F.col("rid") == F.col("first"), "left_anti").select(F.col("rid").alias(key))
    if unique:
        return docs.withColumn(key, F.col(id_col).cast("long")).join(gone, key, "left_anti").select(*docs.columns)
    again = known.where("rows > 1").join(first, F.col("rid") == F.col("first"), "left_semi").select(F.col("rid").alias(key))
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), text_col))
    rest = keyed.join(stored(gone.unionByName(again), "settled"), key, "left_anti")
    return rest.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key])).select(*docs.columns)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4)
