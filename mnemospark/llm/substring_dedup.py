"""Substring dedup with difference-cover anchors.

A difference cover D modulo v has, for any two positions i and j, a shift below v that brings both into
D.  So two equal runs of L words, wherever they begin, hold equal anchors of L - v + 1 words that begin at
cover positions in both documents.  Only the anchors at cover positions are hashed and shuffled (6 of 31
positions); anchors that occur in two documents or more mark the places where a run of L words can be
shared, and only the windows there are extended to L words and compared.

Steps: (1) anchors, pre-aggregated to (hash, least document and its position, greatest document), keep
the hashes of two documents or more; (2) the positions of those anchors, joined back (a hot anchor is a
skewed join, which Spark splits); (3) overlapping anchors that stand equally far apart in the same smaller
document are extended to one run: at L words or more, its windows are known to be repeated; (4) the other
windows of L words around a shared anchor are identified by two independent hashes (64 and 32 bits), and
for each the least document that has it is found; the least document of a window always takes part, as
no smaller one can make the window known.  (5) Words in a known run or in a window that a smaller document
also has are removed.  No step pairs documents, so a passage that a third of all documents share costs a
row per occurrence at most.

Defined results: a null text has no words; windows are taken within one row; rows of equal doc_id are one
document's rows, none of which is smaller than another, so copies that share an id stay; rows with a null
doc_id are returned unchanged and neither remove nor are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, text_chunks
from .tokens import Words

WINDOW = 50
#: Perfect difference sets, by modulus: every residue is a difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}


def period(window: int) -> int:
    """The largest modulus that leaves anchors of at least a third of the window."""
    return max(v for v in COVERS if window - v + 1 >= max(1, window // 3))


def _member(v: int) -> np.ndarray:
    out = np.zeros(v, bool)
    out[list(COVERS[v])] = True
    return out


def _anchor_rows(window: int):
    v = period(window)
    member, size = _member(v), window - v + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            w = Words(part.column("text").to_pylist())
            pos = np.arange(len(w.start)) - w.first[w.doc]
            at = np.flatnonzero(member[pos % v] & (pos + size <= w.n[w.doc]) & (w.n[w.doc] >= window))
            h = w.window_hash(at, size)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)[w.doc[at]]
            tie = part.column("tie").to_numpy(zero_copy_only=False)[w.doc[at]]
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(pos[at].astype(np.int32))], names=["h", "doc_id", "tie", "pos"])

    return run


def _list_fields(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of arrays of structs: the row of each element, and the fields of the elements."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(n)), n), [f.to_numpy(zero_copy_only=False) for f in flat.flatten()]


class _Marks:
    """The shared anchors of a batch: where windows can be shared, and runs known to be in a smaller document."""

    def __init__(self, w: Words, part: pa.RecordBatch, window: int, extend: bool):
        row, (pos, lo, lo_pos) = _list_fields(part.column("anchors"))
        order = np.lexsort((pos, row))
        row, pos, lo, lo_pos = row[order], pos[order].astype(np.int64), lo[order], lo_pos[order].astype(np.int64)
        self.w, self.window, self.at = w, window, w.first[row] + pos
        size = window - period(window) + 1
        doc = part.column("doc_id").to_numpy(zero_copy_only=False)
        later = (lo < doc[row]) & extend if len(row) else np.zeros(0, bool)
        # overlapping anchors that stand equally far apart in the same smaller document make one equal run
        linked = (row[1:] == row[:-1]) & later[1:] & (lo[1:] == lo[:-1]) & (pos[1:] - pos[:-1] == lo_pos[1:] - lo_pos[:-1]) & (pos[1:] - pos[:-1] <= size)
        head = np.concatenate(([True], ~linked))[: len(row)]
        begin = np.flatnonzero(head)
        end = np.concatenate((begin[1:] - 1, [len(row) - 1]))[: len(begin)]
        long = later[begin] & (pos[end] + size - pos[begin] >= window)
        self.run_start, self.run_end = self.at[begin[long]], self.at[end[long]] + size

    def _cover(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        step = np.zeros(len(self.w.start) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, end, -1)
        return np.cumsum(step[:-1]) > 0

    def open_windows(self) -> np.ndarray:
        """Word numbers where windows begin that hold a shared anchor and lie in no known run."""
        w, window = self.w, self.window
        row = np.searchsorted(w.first, self.at, side="right") - 1
        last = w.first[row] + w.n[row] - window + 1
        maybe = self._cover(np.maximum(self.at - period(window) + 1, w.first[row]), np.minimum(self.at + 1, last))
        return np.flatnonzero(maybe & ~self._cover(self.run_start, self.run_end - window + 1))

    def removed(self, part: pa.RecordBatch) -> np.ndarray:
        """For each word: is it in a known run or in one of the repeated windows?"""
        row, (pos,) = _list_fields(part.column("repeated"))
        at = self.w.first[row] + pos
        return self._cover(np.concatenate((self.run_start, at)), np.concatenate((self.run_end, at + self.window)))


def _window_rows(window: int, extend: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            w = Words(part.column("text").to_pylist())
            at = _Marks(w, part, window, extend).open_windows()
            h1, h2 = (w.window_hash(at, window, s) for s in (0, 1))
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)[w.doc[at]]
            tie = part.column("tie").to_numpy(zero_copy_only=False)[w.doc[at]]
            pos = (at - w.first[w.doc[at]]).astype(np.int32)
            yield pa.record_batch([pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(doc), pa.array(tie), pa.array(pos)], names=["h1", "h2", "doc_id", "tie", "pos"])

    return run


def _kept_rows(window: int, extend: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            w = Words(part.column("text").to_pylist())
            gone = _Marks(w, part, window, extend).removed(part)
            n_removed = np.add.reduceat(np.concatenate((gone, [False])), np.minimum(w.first[:-1], len(gone)), dtype=np.int64)
            n_removed = np.where(w.n > 0, n_removed, 0)
            digest, texts = [], []
            for i, k in enumerate(n_removed.tolist()):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                words = w.word_bytes(lo, hi)
                kept = b" ".join([x for x, g in zip(words, gone[lo:hi].tolist(), strict=True) if not g] if k else words)
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "surrogatepass"))
            yield pa.record_batch([part.column("doc_id"), pa.array(w.n.astype(np.int64)), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_windows(base: DataFrame, window: int = WINDOW, extend: bool = True) -> tuple[DataFrame, DataFrame]:
    """Of base (doc_id long, tie int, text string, without null ids), two frames keyed by (doc_id, tie):

    anchors: the shared anchors as (pos, lo, lo_pos), lo the least document that has the anchor;
    repeated: (pos,) of the windows in no run known from the anchors that also begin in a smaller document.
    """
    anchors = base.mapInArrow(_anchor_rows(window), "h long, doc_id long, tie int, pos int")
    # stored, so that the join back is between two plain exchanges, whose hot keys Spark splits
    shared = stored(anchors.groupBy("h").agg(F.min("doc_id").alias("lo"), F.min_by("pos", "doc_id").alias("lo_pos"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "shared")
    marked = stored(anchors.join(shared, "h").select("doc_id", "tie", "pos", "lo", "lo_pos"), "anchors")
    places = marked.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos", "lo", "lo_pos")).alias("anchors"))
    windows = stored(base.join(places, ["doc_id", "tie"]).mapInArrow(_window_rows(window, extend), "h1 long, h2 int, doc_id long, tie int, pos int"), "windows")
    first = stored(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h1", "h2", "lo"), "first")
    later = stored(windows.join(first, ["h1", "h2"]).where("doc_id > lo").select("doc_id", "tie", "pos"), "repeated")
    for done in (shared, windows, first):
        drop_stored(done)
    return places, later.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("pos")).alias("repeated"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words joined by a space)."""
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows that share an id are told apart by a hash of their text, and their anchors make no runs
    unique = every.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    every = every.withColumn("tie", F.lit(0) if unique else F.hash("text"))
    places, repeated = repeated_windows(every.where("doc_id is not null and text is not null"), window, unique)
    joined = every.join(places, ["doc_id", "tie"], "left").join(repeated, ["doc_id", "tie"], "left")
    return joined.mapInArrow(_kept_rows(window, unique), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
