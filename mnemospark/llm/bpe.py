"""Byte-level BPE encoding and decoding by speculating and verifying.

A word (a match of the pre-tokeniser's pattern) is cut greedily into the longest vocabulary entries.
That proposal is the true BPE result exactly when every adjacent pair of tokens is compatible, that is,
when merging the bytes of the two tokens alone would give back the same two tokens.  One vectorised pass
tests all adjacent pairs of all proposals; only the words with an incompatible pair are merged exactly.
Results of words are kept in a cache of bounded size, so a frequent word is proposed and tested once per
worker.

Defined results: a null text is an empty one: no tokens, decoded to the empty string.  The vocabulary's
special tokens are recognised inside texts, as the file declares them.  Every row is encoded on its own,
whole, so repeated rows and ids, clashing column names and texts of any length need no special case.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_chunks

# Fixed value: the pre-tokeniser's pattern of the byte-level vocabularies (runs taken possessively).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
_BITS = 20  # of a token id
_NEVER = 1 << 60
#: Words of one generation of a worker's cache; there are two, and words that are met again move to the younger.
CACHE_WORDS = 200_000


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable bytes are themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary file of the tokenizers library with a byte-level BPE model."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letter = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * self.size
        for t, i in vocab.items():
            if t not in self.special:
                self.bytes[i] = bytes(letter[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.ids = {b: i for i, b in enumerate(self.bytes) if b and i not in set(self.special.values())}
        self.packed = [i.to_bytes(4, "little") for i in range(self.size)]
        found: dict[bytes, set[int]] = {}
        for b in self.ids:
            if len(b) > 3:
                found.setdefault(b[:4], {1, 2, 3}).add(len(b))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}  # that tokens with these first four bytes have
        # merges by rank; a token made by no merge is a single byte
        n = self.size
        self.left, self.right, self.rank = np.arange(n), np.arange(n), np.full(n, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = vocab[a], vocab[b]
            made = vocab[a + b]
            if pair not in self.merge:
                self.merge[pair] = (r, made)
                if self.rank[made] < 0:
                    self.left[made], self.right[made], self.rank[made] = *pair, r
        keys = np.array([a * n + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_rank = np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.merges = len(spec["model"]["merges"])
        self.made = np.zeros(self.merges + 1, np.int64)  # by rank
        for r, made in self.merge.values():
            self.made[r] = made
        self.byte_ids = np.array([self.ids.get(bytes([b]), 0) for b in range(256)], np.int64)
        # for single words: (left, right) and (rank, result) as one number each
        self.joined = {a << _BITS | b: r << _BITS | made for (a, b), (r, made) in self.merge.items()}
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.reached = np.zeros(n, np.int8)  # 0: not tested, 1: merging its bytes gives the token, 2: it doesn't

    def greedy(self, word: bytes) -> list[int]:
        get, lengths, out, i, n = self.ids.get, self.lengths.get, [], 0, len(word)
        while i < n:
            for size in lengths(word[i : i + 4], (3, 2, 1)):
                t = get(word[i : i + size])
                if t is not None:
                    break
            out.append(t)
            i += size
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does BPE leave bytes(a) + bytes(b) as the two tokens a, b?

        Undo both tokens' merges from the last on.  Before each is undone, the two pieces that touch at
        the border must not have a merge that comes earlier than the ones still to be undone.
        """
        n = self.size
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        left, right = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        limit_strict = np.ones(len(a), bool)
        while len(live):
            key = left * n + right
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], np.iinfo(np.int64).max)
            # A merge across the border wins over one inside `left` when it is earlier, or the same rule
            # further left loses to it; inside `right` the same rule applies only after the border's.
            fails = (rank < limit) | ((rank == limit) & ~limit_strict & (rank != np.iinfo(np.int64).max))
            good[live[fails]] = False
            rl, rr = self.rank[left], self.rank[right]
            ended = (rl < 0) & (rr < 0)
            keep = ~fails & ~ended
            live, left, right, rl, rr = live[keep], left[keep], right[keep], rl[keep], rr[keep]
            in_left = rl > rr  # at equal ranks the left one was merged first, so the right one is undone first
            limit = np.where(in_left, rl, rr)
            limit_strict = in_left
            left, right = np.where(in_left, self.right[left], left), np.where(in_left, right, self.left[right])
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
        ids = self.ids
        parts = [ids[word[i : i + 1]] for i in range(len(word))]
        if len(parts) > 40:
            return self._exact_long(parts)
        get = self.joined.get
        ranks = [get(a << _BITS | b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [best & (1 << _BITS) - 1]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << _BITS | parts[i], _NEVER)
            if i < len(ranks):
                ranks[i] = get(parts[i] << _BITS | parts[i + 1], _NEVER)
        return parts

    def _exact_long(self, parts: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list of parts: n log n for a word without breaks."""
        parts = list(parts)
        n, merge = len(parts), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], parts[i], parts[i + 1]) for i in range(n - 1) if (m := merge.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge.get((made, parts[after[i]])):
                    heapq.heappush(heap, (m[0], i, m[1], made, parts[after[i]]))
            if (h := before[i]) >= 0 and (m := merge.get((parts[h], made))):
                heapq.heappush(heap, (m[0], h, m[1], parts[h], made))
        return [p for p in parts if p >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the merges of the pairs, by rank; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], self.merges)

    def exact_batch(self, words: list[bytes]) -> list[list[int]]:
        """exact() of many words at once: each round merges, in every word that has one, its leftmost pair of lowest rank."""
        out: list[list[int]] = [[]] * len(words)
        usual = []
        for i, w in enumerate(words):
            if 2 <= len(w) <= 40:
                usual.append(i)
            else:
                out[i] = self.exact(w)
        if not usual:
            return out
        size = np.array([len(words[i]) for i in usual], np.int64)
        token = self.byte_ids[np.frombuffer(b"".join(words[i] for i in usual), np.uint8)]
        owner = np.repeat(np.arange(len(usual)), size)
        rank = np.full(len(token), self.merges)  # of the pair that begins here; none at the end of a word
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._ranks(token[inner], token[inner + 1])
        while len(token):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank, first)
            n = np.diff(first, append=len(token))
            over = np.repeat(best == self.merges, n)
            if over.any():  # words without a merge are ready
                ready = np.split(token[over], np.cumsum(n[best == self.merges])[:-1])
                for k, ids in zip(owner[first[best == self.merges]].tolist(), ready, strict=True):
                    out[usual[k]] = ids.tolist()
                token, owner, rank = token[~over], owner[~over], rank[~over]
                n, best = n[best < self.merges], best[best < self.merges]
                if not len(token):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, n))
            at = hit[np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]
            token[at] = self.made[rank[at]]
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged tokens stand after the others have gone
            token, owner, rank = token[keep], owner[keep], rank[keep]
            changed = np.concatenate((moved, moved[moved > 0] - 1))
            changed = changed[changed + 1 < len(token)]
            rank[moved] = self.merges
            whole = owner[changed] == owner[changed + 1]
            rank[changed[~whole]] = self.merges
            changed = changed[whole]
            rank[changed] = self._ranks(token[changed], token[changed + 1])
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that the cache lacks: propose, test all adjacent pairs at once, merge the failing words."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        wrong = set(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]].tolist())
        for t in np.unique(flat[self.reached[flat] == 0]).tolist():
            self.reached[t] = 1 if self.exact(self.bytes[t]) == [t] else 2
        wrong |= set(owner[self.reached[flat] == 2].tolist())
        wrong = sorted(wrong)
        for i, ids in zip(wrong, self.exact_batch([raw[i] for i in wrong]), strict=True):
            proposed[i] = ids
        packed = self.packed
        for w, ids in zip(words, proposed, strict=True):
            self.cache[w] = b"".join([packed[t] for t in ids])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        pieces: list[list[str]] = []
        special: dict[str, bytes] = {}
        for t in texts:
            if self.cut and any(x in t for x in self.special):
                mine: list[str] = []
                for k, part in enumerate(self.cut(t)):
                    if k % 2:  # a key that no word has: words hold no NUL beside other characters of this kind
                        mine.append(key := f"\0{part}")
                        special[key] = self.packed[self.special[part]]
                    else:
                        mine += self.split(part)
                pieces.append(mine)
            else:
                pieces.append(self.split(t))
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        new = {w for p in pieces for w in p if w not in self.cache}
        if special:
            new.difference_update(special)
        known = {w: v for w in new if (v := self.older.get(w)) is not None}
        self.cache.update(known)
        self.learn(list(new.difference(known)))
        get = (self.cache | special).__getitem__ if special else self.cache.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def _loaded(name: str) -> ByteBPE:
    with open(SparkFiles.get(name), encoding="utf-8") as f:
        return ByteBPE(f.read())


def _model(spark: SparkSession, vocabulary: str):
    """Hand the vocabulary file to the executors; a worker reads and parses it once."""
    spark.sparkContext.addFile(vocabulary)
    return vocabulary.rpartition("/")[2]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs with a column ids (array of int): the tokens of the whole text."""
    name = _model(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def ids(texts):
        column = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
        found = [x for part in text_chunks(iter([column])) for x in _loaded(name).encode_batch([t or "" for t in part.column("text").to_pylist()])]
        return pd.Series([np.frombuffer(x, "<i4") for x in found], index=texts.index)

    return docs.withColumn("ids", ids(F.col(text_col)))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """df with a column decoded: the text that the ids stand for, special tokens included."""
    name = _model(df.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: "" if x is None else _loaded(name).decode(np.asarray(x, "<u4").tobytes()))

    return df.withColumn("decoded", text(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again: counts and digests per row, and the ids if wanted."""
    name = _model(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(name)
        for part in text_chunks(batches):
            ids = bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])
            sha = [hashlib.sha256(x).hexdigest() for x in ids]
            back = [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(n), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
            if keep_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.record_batch(list(out.values()), names=list(out))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
