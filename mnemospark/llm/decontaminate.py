"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a shard is a bounded run of documents and holds its vocabulary and,
for each term, the ascending list of its positions (numbered through the shard).  `build_index` stores the
shards as a table; `search` answers phrase queries on it and `near` proximity queries.  A phrase is looked
up from its rarest term in the shard: that term's postings, less the term's offset, are the candidate
starts, and the offset-adjusted lists of the other terms, rarest first, are intersected with them.  Terms
are compared as words, not as hashes.  Postings never leave their shard, so there is no shuffle of them
and a hot source or passage can't gather in one task; a shard's lists are only unpacked if it holds all
terms of some phrase.

The benchmark is the stated query set.  It is cut into pieces on executors (an item of any length gives
pieces of bounded size, which overlap by a window less one word) and dealt into blocks of bounded size.
One block at a time is broadcast, its occurrences are written to a table, and the broadcast is dropped.
Blocks and pieces leave no trace in the results: occurrences are united by row, whatever their number.

Defined results: a null text has no words (n_words 0, nothing hit); a benchmark row with null or empty
text gives no window; a null item_id still marks words as hit but is no item; repeated benchmark rows
count once; rows are judged one by one, also those that share a doc_id or have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, new_folder, stored, text_chunks, write_stored
from .tokens import Words, mix64

WINDOW = 10
#: Characters of benchmark text in one broadcast block.
BLOCK_CHARS = 4_000_000
#: Words of a piece of an item, without its overlap with the next.
PIECE_WORDS = 4096
#: Candidate starts that one step of a search holds.
CANDIDATES = 1 << 20

INDEX_SCHEMA = "shard string, n_docs long, docs binary, first binary, words binary, counts binary, positions binary"
HITS_SCHEMA = "shard string, row int, starts array<int>, ends array<int>, items array<string>"


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Positional postings of every word of every text: one row per shard of at most about 1 MB of text.

    words: the distinct words, separated by spaces, which no word holds; counts: how many postings each has;
    positions: the postings, list after list, each list ascending and delta-coded; first: where each document
    begins; shard: partition and position, so that equal shards are told apart.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.string()), ("n_docs", pa.int64())] + [(c, pa.binary()) for c in ("docs", "first", "words", "counts", "positions")])
        task = TaskContext.get()
        for number, part in enumerate(text_chunks(batches)):
            w = Words(part.column("text").to_pylist(), alnum=True, lower=True)
            h, h2 = w.hash(), w.hash(1)
            order = np.argsort(h, kind="stable")
            fresh = h[order][1:] != h[order][:-1]
            if (~fresh & (h2[order][1:] != h2[order][:-1])).any():  # different words of equal hash
                order = np.lexsort((h2, h))
                fresh = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            begin = np.flatnonzero(np.concatenate(([True], fresh))) if len(h) else np.zeros(0, np.int64)
            delta = np.diff(order, prepend=0).astype(np.int32)
            delta[begin] = order[begin]
            one = order[begin]  # an occurrence of each word
            size = w.end[one] - w.start[one] + 1
            at = np.repeat(w.start[one] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            words = w.buf[at].copy()
            words[np.cumsum(size) - 1] = 0x20
            ids = pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([("d", part.column("doc_id").type)]))
            ids.write_batch(pa.record_batch([part.column("doc_id")], names=["d"]))
            ids.close()
            name = f"{task.partitionId()}-{number}"
            row = [[name], [len(part)], [sink.getvalue().to_pybytes()], [_pack(w.first.astype(np.int64))], [_pack(words)], [_pack(np.diff(begin, append=len(h)).astype(np.int32))], [_pack(delta)]]
            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(shards, INDEX_SCHEMA)


class _Shard:
    """One index row; the lists are unpacked when they are first asked for."""

    def __init__(self, row: dict):
        self.name = row["shard"]
        self.first = _unpack(row["first"], np.int64)
        words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")[:-1]
        self.number = dict(zip(words, range(len(words)), strict=True))
        self.counts = _unpack(row["counts"], np.int32).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.counts)))
        self._packed, self._positions, self._places = row["positions"], None, None
        self._docs = row["docs"]

    def docs(self) -> pa.Array:
        return pa.ipc.open_stream(self._docs).read_all().column("d").combine_chunks()

    @property
    def positions(self) -> np.ndarray:
        """The postings, list after list."""
        if self._positions is None:
            total = np.cumsum(_unpack(self._packed, np.int32).astype(np.int64))
            base = np.concatenate(([0], total))[self.begin[:-1]]
            self._positions = total - np.repeat(base, self.counts)
        return self._positions

    def holds(self, which: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Is the position in the list? A search in all lists at once, which are one ascending sequence of (list, position)."""
        if self._places is None:
            self._places = np.repeat(np.arange(len(self.counts)), self.counts) * len(self.positions) + self.positions
        wanted = which * len(self._positions) + position
        return self._places[np.minimum(np.searchsorted(self._places, wanted), len(self._places) - 1)] == wanted

    def lists(self, words: list[bytes]) -> np.ndarray:
        """Number of the postings list of each word, -1 where the shard doesn't hold the word."""
        get = self.number.get
        return np.fromiter((get(x, -1) for x in words), np.int64, len(words))

    def phrases(self, lists: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase number, start) of every occurrence of the phrases, given as the lists of their terms, lists[q, :sizes[q]]."""
        length = np.where(np.arange(lists.shape[1]) < sizes[:, None], self.counts[np.maximum(lists, 0)], np.iinfo(np.int64).max)
        by_rarity = np.argsort(length, axis=1, kind="stable")
        rows = np.arange(len(lists))
        rarest = lists[rows, by_rarity[:, 0]]
        total = np.cumsum(self.counts[rarest])
        cuts = np.flatnonzero(np.diff((total - 1) // CANDIDATES)) + 1
        for mine in np.split(rows, cuts):
            n = self.counts[rarest[mine]]
            q = np.repeat(mine, n)
            at = self.positions[np.repeat(self.begin[rarest[mine]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] - by_rarity[q, 0]
            ok = (at >= 0) & (at + sizes[q] <= len(self.positions))
            q, at = q[ok], at[ok]
            for k in range(1, lists.shape[1]):
                offset = by_rarity[q, k]
                more = np.flatnonzero(k < sizes[q])
                ok = np.ones(len(q), bool)
                ok[more] = self.holds(lists[q[more], offset[more]], at[more] + offset[more])
                q, at = q[ok], at[ok]
            doc = np.searchsorted(self.first, at, side="right")
            ok = at + sizes[q] <= self.first[np.minimum(doc, len(self.first) - 1)]
            yield q[ok], at[ok]

    def proximity(self, words: list[bytes], span: int) -> np.ndarray:
        """Starts of the shortest runs of at most span tokens of one document that hold all the words."""
        lists = self.lists(sorted(set(words)))
        if not len(lists) or (lists < 0).any():
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(self.counts[lists], kind="stable")]
        near = [self.positions[self.begin[t] : self.begin[t + 1]] for t in lists]
        starts = []
        for p in near[0].tolist():  # of the rarest term
            doc = int(np.searchsorted(self.first, p, side="right"))
            lo, hi = max(p - span + 1, int(self.first[doc - 1])), min(p + span, int(self.first[doc]))
            inside = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in near]
            if all(len(x) for x in inside):
                for s in sorted({int(v) for x in inside for v in x}):
                    ends = [x[i] if (i := np.searchsorted(x, s)) < len(x) else hi + span for x in inside]
                    if max(ends) - s < span:
                        starts.append(s)
        return np.unique(np.array(starts, np.int64))


def benchmark_pieces(benchmark: DataFrame, window: int, item_col: str = "item_id", text_col: str = "text", piece_words: int = PIECE_WORDS) -> DataFrame:
    """(item, piece, words) of the items: at most piece_words words and the window - 1 that overlap the next piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            w = Words(part.column("text").to_pylist(), alnum=True, lower=True)
            items, numbers, words = [], [], []
            for i, item in enumerate(part.column("item").to_pylist()):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                for k, s in enumerate(range(lo, max(lo + 1, hi - window + 1) if hi > lo else lo, piece_words)):
                    items.append(item)
                    numbers.append(k)
                    words.append(b" ".join(w.word_bytes(s, min(s + piece_words + window - 1, hi))))
            yield pa.record_batch([pa.array(items, pa.string()), pa.array(numbers, pa.int64()), pa.array(words, pa.binary())], names=["item", "piece", "words"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    return items.mapInArrow(run, "item string, piece long, words binary")


class _Block:
    """The distinct windows of some pieces."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int):
        number: dict[bytes, int] = {}
        split = [p.split(b" ") for _, p in pieces]
        self.tokens = np.fromiter((number.setdefault(x, len(number)) for p in split for x in p), np.int64, sum(map(len, split)))
        self.words = list(number)
        n = np.array([len(p) for p in split], np.int64)
        size = np.minimum(n, window)
        each = n - size + 1
        owner = np.repeat(np.arange(len(n)), each)
        start = np.repeat(np.cumsum(n) - n - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        size = size[owner]
        # equal windows become one, which all their items own; numbers of words, so 128 bits tell them apart
        keys = [np.full(len(start), seed, np.uint64) for seed in (1, 2)]
        for k in range(window):
            token = np.where(k < size, self.tokens[np.minimum(start + k, len(self.tokens) - 1)] + 1, 0).astype(np.uint64)
            keys = [mix64(x * np.uint64(0x9E3779B97F4A7C15) + token) for x in keys]
        order = np.lexsort((owner, keys[1], keys[0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (keys[0][order][1:] != keys[0][order][:-1]) | (keys[1][order][1:] != keys[1][order][:-1])
        self.start, self.size = start[order][fresh], size[order][fresh]
        self.owner = owner[order]
        self.owned = np.append(np.flatnonzero(fresh), len(order))
        self.items = [i for i, _ in pieces]

    def occurrences(self, shard: _Shard) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of all windows that the shard holds."""
        lists = shard.lists(self.words)[self.tokens]
        known = np.concatenate(([0], np.cumsum(lists >= 0)))
        possible = np.flatnonzero(known[self.start + self.size] - known[self.start] == self.size)
        if not len(possible):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, size = self.start[possible], self.size[possible]
        terms = lists[np.minimum(start[:, None] + np.arange(int(size.max())), len(lists) - 1)]
        found = list(shard.phrases(terms, size))
        q, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return possible[q], at

    def owners(self, windows: np.ndarray) -> list[str]:
        found = {self.items[k] for q in np.unique(windows).tolist() for k in self.owner[self.owned[q] : self.owned[q + 1]].tolist()}
        return sorted(found - {None})


def _searcher(sent, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for row in batch.to_pylist():
                block = block or _Block(sent.value, window)
                s = _Shard(row)
                q, at = block.occurrences(s)
                order = np.argsort(at, kind="stable")
                q, at = q[order], at[order]
                cut = np.searchsorted(at, s.first)
                rows, starts, ends, items = [], [], [], []
                for d in np.flatnonzero(np.diff(cut)).tolist():
                    mine = slice(cut[d], cut[d + 1])
                    a, z = at[mine], np.maximum.accumulate(at[mine] + block.size[q[mine]])
                    new = np.concatenate(([True], a[1:] > z[:-1]))  # overlapping occurrences become one range
                    rows.append(d)
                    starts.append((a[new] - s.first[d]).tolist())
                    ends.append((z[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(z) - 1]))] - s.first[d]).tolist())
                    items.append(block.owners(q[mine]))
                if rows:
                    yield pa.record_batch([pa.array([s.name] * len(rows), pa.string()), pa.array(rows, pa.int32()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["shard", "row", "starts", "ends", "items"])

    return run


def _indexed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = pa.ipc.open_stream(row["docs"]).read_all().column("d").combine_chunks()
            n = len(ids)
            yield pa.record_batch([pa.array([row["shard"]] * n, pa.string()), pa.array(range(n), pa.int32()), ids, pa.array(np.diff(_unpack(row["first"], np.int64)), pa.int64())], names=["shard", "row", "doc_id", "n_words"])


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, piece_words: int = PIECE_WORDS, id_type: str = "long") -> DataFrame:
    """One row per indexed document: its words, the hit word ranges [starts, ends), and the items found.

    id_type: the type of the ids that were indexed.
    """
    spark = index.sparkSession
    pieces = stored(benchmark_pieces(benchmark, window, item_col, text_col, piece_words), "benchmark")
    blocks = -(-(pieces.agg(F.sum(F.length("words"))).first()[0] or 0) // block_chars)
    folder = new_folder(spark, "hits")
    write_stored(spark.createDataFrame([], HITS_SCHEMA), f"{folder}/block=none")
    for b in range(blocks):  # the query set, one bounded block at a time
        mine = pieces.where(F.pmod(F.xxhash64("item", "piece", "words"), F.lit(blocks)) == b).select("item", "words").collect()
        if mine:
            sent = spark.sparkContext.broadcast([(r.item, bytes(r.words)) for r in mine])
            write_stored(index.mapInArrow(_searcher(sent, window), HITS_SCHEMA), f"{folder}/block={b}")
            sent.destroy()
    hits = spark.read.schema(HITS_SCHEMA).parquet(f"{folder}/*")
    whole = lambda c: F.flatten(F.collect_list(c)).alias(c)
    united = hits.groupBy("shard", "row").agg(whole("starts"), whole("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = index.select("shard", "docs", "first").mapInArrow(_indexed_rows, f"shard string, row int, doc_id {id_type}, n_words long")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.join(united, ["shard", "row"], "left").select("shard", "row", "doc_id", "n_words", none("starts", "int"), none("ends", "int"), none("items", "string"))


def near(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """Proximity search: (doc_id, start) where all terms stand within span tokens of one document."""
    w = Words([" ".join(terms)], alnum=True, lower=True)
    wanted = w.word_bytes(0, len(w.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = _Shard(row)
                at = s.proximity(wanted, span)
                doc = np.searchsorted(s.first, at, side="right") - 1
                yield pa.record_batch([pc.take(s.docs(), pa.array(doc)), pa.array(at - s.first[doc], pa.int64())], names=["doc_id", "start"])

    return index.mapInArrow(run, "doc_id long, start long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and the hit ranges)."""
    index = stored(build_index(docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.col(text_col).alias("text"))), "postings")
    hit = search(index, benchmark, window, block_chars=block_chars, id_type=id_type)
    # the ranges of different blocks may overlap: a word counts once
    n_hit = F.expr("aggregate(array_sort(arrays_zip(starts, ends)), named_struct('n', 0L, 'e', 0), (a, r) -> named_struct('n', a.n + greatest(r.ends - greatest(r.starts, a.e), 0), 'e', greatest(a.e, r.ends)), a -> a.n)")
    return hit.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"), "starts", "ends",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose own text holds no benchmark window, whatever their ids, with all their columns."""
    key = fresh_name(docs, "text_key")
    keyed = docs.withColumn(key, F.sha2(F.coalesce(text_col, F.lit("")), 256))
    bad = contamination(keyed, benchmark, window, key, text_col, "string", block_chars).where("contaminated").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).drop("starts", "ends")
