"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs: lines, and within a line pieces that end after a word whose hash is 0
modulo a small number, so that a cut depends on nothing but the word before it and an edit changes few
pieces.  The distinct paragraph digests go into a sketch of cells (count, sum of digests, sum of check
values); a digest goes into one cell of each of three equal regions.  Subtracting the sketches of two
versions cancels what they share, and peeling pure cells recovers the digests of either side only.  When
peeling gets stuck the pair is tried again with a sketch four times as large, until it comes undone.  Likeness is |A and B| / |A or B| of the digest sets, from the recovered
differences.  All sketches of a batch lie in one array, so building, subtracting and peeling are a few
numpy passes per round over the whole batch.

The next document of a row is found by one range shuffle: documents are dealt into ranges of (doc_id, text
hash), one to a partition, and sorted within them, and the first document of a range is also dealt, as a tail,
to the range above.  An id that many rows share, and rows without an id, are split by the hash.

Defined results: a null text is an empty one, with no paragraphs; two empty texts have likeness 1, an
empty and a non-empty one 0.  Documents are ordered by descending doc_id, null ids last, ties by text
hash; a lone document is its own next one.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import Words, mix64

#: Cells of the sketch in a fingerprint; the first try of a comparison. A multiple of 3.
CELLS = 24
#: A piece ends after a word whose hash is 0 modulo this.
CUT = 4
#: Characters of text in one range of documents, about.
RANGE_CHARS = 8 << 20
#: Ranges at most; where each begins is broadcast (ids, not texts), under 10 MB. Larger inputs get larger ranges.
MAX_RANGES = 200_000


def paragraphs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paragraph digests of each text: (digests, bounds), text i has digests[bounds[i]:bounds[i+1]]."""
    w = Words(texts)
    n = len(texts)
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h = w.hash()
    lines = np.concatenate(([0], np.cumsum(w.buf == 0x0A)))
    last = np.empty(len(h), bool)
    last[:-1] = (lines[w.start[1:]] != lines[w.end[:-1]]) | (w.doc[1:] != w.doc[:-1])
    last[-1] = True
    last |= h % np.uint64(CUT) == 0
    end = np.flatnonzero(last) + 1
    begin = np.concatenate(([0], end[:-1]))
    digest = w.run_hash(begin, end - begin)
    doc = w.doc[begin]
    order = np.lexsort((digest, doc))
    doc, digest = doc[order], digest[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])))
    doc, digest = doc[new], digest[new]
    return digest, np.searchsorted(doc, np.arange(n + 1))


def _cells(digest: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The three cells of each digest in its sketch, which begins at base and has size cells."""
    third = (size // 3).astype(np.uint64)
    return np.concatenate([base + (k * (size // 3)) + (mix64(digest + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) % third).astype(np.int64) for k in range(3)])


def _check(digest: np.ndarray) -> np.ndarray:
    return mix64(digest ^ np.uint64(0x5851F42D4C957F2D))


class Sketches:
    """A batch of sketches of the given sizes (multiples of 3), one after the other."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        total = int(self.base[-1])
        self.count = np.zeros(total, np.int64)
        self.sum = np.zeros(total, np.uint64)
        self.check = np.zeros(total, np.uint64)

    def add(self, owner: np.ndarray, digest: np.ndarray, sign: int | np.ndarray = 1) -> None:
        at = _cells(digest, self.base[owner], self.sizes[owner])
        sign = np.broadcast_to(np.asarray(sign, np.int64), digest.shape)
        wrapped = sign.astype(np.uint64)  # -1 is 2**64 - 1
        np.add.at(self.count, at, np.tile(sign, 3))
        np.add.at(self.sum, at, np.tile(digest * wrapped, 3))
        np.add.at(self.check, at, np.tile(_check(digest) * wrapped, 3))

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recover what is in the sketches: (owner, digest, sign) and whether each sketch emptied."""
        owner_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(self.count)
        while len(look):
            c = self.count[look]
            pure = np.abs(c) == 1
            at, sign = look[pure], c[pure]
            digest = self.sum[at] * sign.astype(np.uint64)
            right = _check(digest) * sign.astype(np.uint64) == self.check[at]
            at, sign, digest = at[right], sign[right], digest[right]
            if not len(at):
                break
            owner = owner_of[at]
            order = np.lexsort((digest, owner))  # a digest may be alone in two or three of its cells
            owner, digest, sign = owner[order], digest[order], sign[order]
            first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (digest[1:] != digest[:-1])))
            owner, digest, sign = owner[first], digest[first], sign[first]
            found.append((owner, digest, sign))
            self.add(owner, digest, -sign)
            touched = np.unique(_cells(digest, self.base[owner], self.sizes[owner]))
            look = touched[self.count[touched] != 0]
        left = (self.count != 0) | (self.sum != 0)
        emptied = np.ones(len(self.sizes), bool)
        emptied[owner_of[left]] = False
        if not found:
            z = np.zeros(0, np.int64)
            return z, z.astype(np.uint64), z, emptied
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), emptied)

    def text(self, i: int, n: int) -> str:
        """Printable form of sketch i of a set of n digests."""
        s = slice(self.base[i], self.base[i + 1])
        cells = np.empty(self.sizes[i], np.dtype([("n", "<u2"), ("sum", "<u8"), ("check", "<u2")]))
        cells["n"], cells["sum"], cells["check"] = self.count[s], self.sum[s], self.check[s]
        return f"{n}:{base64.b64encode(cells.tobytes()).decode()}"


def _members(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into rows, index into the digests) of the digests of the given texts."""
    n = bounds[rows + 1] - bounds[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return owner, bounds[rows][owner] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def fingerprints(digest: np.ndarray, bounds: np.ndarray, cells: int = CELLS) -> list[str]:
    n = len(bounds) - 1
    s = Sketches(np.full(n, cells, np.int64))
    s.add(np.repeat(np.arange(n), np.diff(bounds)), digest)
    return [s.text(i, int(k)) for i, k in enumerate(np.diff(bounds))]


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Digests in a only and in b only, row by row, and the sketch size that sufficed for each row."""
    (da, ba), (db, bb) = a, b
    n = len(ba) - 1
    only_a: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    only_b = list(only_a)
    used = np.zeros(n, np.int64)
    todo, size = np.arange(n), cells
    while len(todo):
        s = Sketches(np.full(len(todo), size, np.int64))
        owner, at = _members(ba, todo)
        s.add(owner, da[at])
        owner, at = _members(bb, todo)
        s.add(owner, db[at], -1)
        owner, digest, sign, done = s.peel()
        order = np.lexsort((digest, sign, owner))
        owner, digest, sign = owner[order], digest[order], sign[order]
        lo, hi = np.searchsorted(owner, np.arange(len(todo))), np.searchsorted(owner, np.arange(len(todo)), side="right")
        mid = lo + np.bincount(owner[sign < 0], minlength=len(todo))
        for k in np.flatnonzero(done).tolist():
            only_b[todo[k]], only_a[todo[k]] = digest[lo[k] : mid[k]], digest[mid[k] : hi[k]]
            used[todo[k]] = size
        todo = todo[~done]
        size *= 4
    return only_a, only_b, used


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """|A and B| / |A or B| of the digest sets, from what peeling recovers; 1 for two empty sets."""
    only_a, only_b, _ = differences(a, b)
    na = np.diff(a[1])
    union = na + np.fromiter(map(len, only_b), np.int64, len(only_b))
    shared = na - np.fromiter(map(len, only_a), np.int64, len(only_a))
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


def edited_text(text: str, following: str) -> str:
    """text with its last floor(n/2) code points replaced by as many first ones (or all) of following."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_chars: int = RANGE_CHARS) -> DataFrame:
    """(rng, tail, doc_id, text), sorted within partitions so that a row's next document is the row below.

    Ranges are contiguous in doc_id and lie whole in a partition; each ends with a tail row, the first
    document of the range below it (of the highest range, for the lowest one).
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = base.withColumn("tie", F.xxhash64("text"))
    chars, rows, nulls = base.agg(F.sum(F.length("text").cast("long")), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n = min(max(1, -(-(chars or 0) // range_chars)), MAX_RANGES)
    bounds = []
    if n > 1:
        bounds = sorted(b for b in base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [] if b is not None)
    ranges = _Ranges(np.array(bounds, np.int64), -(-nulls * n // max(rows, 1)))
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((ranges, _places(spark, ranges.count)))

    @F.pandas_udf("long")
    def number(ids, ties):
        return pd.Series(sent.value[0].of(ids.isna().to_numpy(), ids.fillna(0).to_numpy(np.int64), ties.to_numpy(np.int64)))

    @F.pandas_udf("int")
    def place(rng):
        return pd.Series(sent.value[1][rng.to_numpy(np.int64)])

    ranged = key.withColumn("rng", number("doc_id", "tie"))
    firsts = ranged.groupBy("rng").agg(F.max(F.struct("doc_id", "tie")).alias("top")).orderBy("rng").collect()  # a row per range
    above = [(r.rng, firsts[(i + 1) % len(firsts)].rng, r.top.doc_id, r.top.tie) for i, r in enumerate(firsts)]
    tails = spark.createDataFrame(above, "rng long, above long, doc_id long, tie long")
    first_rows = ranged.alias("r").join(F.broadcast(tails).alias("t"), (F.col("r.rng") == F.col("t.rng")) & F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.tie") == F.col("t.tie")))
    tail_rows = first_rows.select(F.col("t.above").alias("rng"), F.lit(1).alias("tail"), "r.doc_id", "r.text", "r.tie").dropDuplicates(["rng"])  # copies of it count once
    every = ranged.select("rng", F.lit(0).alias("tail"), "doc_id", "text", "tie").unionByName(tail_rows)
    return every.repartition(ranges.count, place("rng")).sortWithinPartitions("rng", "tail", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())


class _Ranges:
    """Contiguous ranges of rows in ascending order of (doc_id, tie), null ids first.

    bounds: ids at which ranges begin, ascending; an id that is there more than once has so many rows that they
    are split by tie, as are those without an id, into so many ranges.
    """

    def __init__(self, bounds: np.ndarray, nulls: int):
        self.bounds, self.nulls = bounds, max(nulls, 1)
        self.count = len(bounds) + self.nulls

    def of(self, missing: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.bounds, ids, "left"), np.searchsorted(self.bounds, ids, "right")
        parts = np.where(missing, self.nulls, np.maximum(hi - lo, 1)).astype(np.uint64)
        unsigned = ties.view(np.uint64) ^ np.uint64(1 << 63)  # in the order of the signed ones
        step = np.uint64(2**64 - 1) // parts + np.uint64(1) * (parts > 1)
        part = np.where(parts > 1, unsigned // step, np.uint64(0)).astype(np.int64)
        return np.where(missing, part, self.nulls - 1 + lo + np.where(hi > lo, 1 + part, 0))


def _places(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers that Spark's hash partitioning into n partitions sends to the partitions 0, 1, 2, ... in turn, so
    that each has one range; where none was found, the number of the partition."""
    number = F.col("id").cast("int")
    found = spark.range(32 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("id")).collect()  # n rows
    out = np.arange(n, dtype=np.int32)
    for r in found:
        out[r.p] = r.id
    return out


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 1 << 20, range_chars: int = RANGE_CHARS) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likenesses."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def results(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, nexts = zip(*rows, strict=True)
        edited = [edited_text(t, x) for t, x in zip(texts, nexts, strict=True)]
        mine, other, theirs = paragraphs(list(texts)), paragraphs(edited), paragraphs(list(nexts))
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
        out = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), sha, fingerprints(*mine), fingerprints(*other), likeness(mine, other), likeness(mine, theirs)]
        return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row above, which waits for its next document
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for rng, tail, doc, text in zip(*(batch.column(c).to_pylist() for c in ("rng", "tail", "doc_id", "text")), strict=True):
                if held is not None and held[0] == rng:
                    rows.append((held[1], held[2], text))
                    size += len(held[2])
                    if size >= batch_chars:
                        yield results(rows)
                        rows, size = [], 0
                held = None if tail else (rng, doc, text)
        if rows:
            yield results(rows)

    return with_next(docs, id_col, text_col, range_chars).select("rng", "tail", "doc_id", "text").mapInArrow(run, schema)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
