"""Vectorised tokenising and hashing of whole texts, shared by the word-level operators.

A batch of texts is laid out as one byte buffer with a separator byte after each text; word bounds,
word hashes and hashes of word windows then come from a handful of numpy passes, without a Python loop
over words.  Hashes have 64 bits.  A word's is a sum over its 8-byte blocks, a window's a sum over its
words; every block or word goes with its place through a bit mixer before it is added, so that no shape of
words (such as Thue-Morse words, which collide in any polynomial modulo 2**64) gives equal hashes by
construction.  A second seed mixes the same blocks differently; where a match of 64 bits decides
something, operators compare both seeds or the words themselves.
"""

from __future__ import annotations

import numpy as np

# The bytes of [\x20\x09-\x0D], and those of [\x00-\x2F\x3A-\x60\x7B-\x7F].
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NOT_ALNUM = np.zeros(256, bool)
_NOT_ALNUM[list(range(0x00, 0x30)) + list(range(0x3A, 0x61)) + list(range(0x7B, 0x80))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4D))
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0xA0761D6478BD642F)
_LOW_BYTES = np.array([2**64 - 1, *(2 ** (8 * k) - 1 for k in range(1, 8))], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _placed(values: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """Values mixed with their places (0 for the first)."""
    return mix64((values ^ _SEEDS[seed]) + (place.astype(np.uint64) + np.uint64(1)) * _PLACE)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]; no run may be empty."""
    return np.add.reduceat(values, first) if len(first) else np.zeros(0, np.uint64)


class Words:
    """The words of a batch of texts.

    start, end: byte bounds in buf of every word; doc: index of its text; first[i]:first[i+1] are the
    words of text i; hash(seed): 64-bit word hashes.
    """

    def __init__(self, texts: list[str | None], *, alnum: bool = False, lower: bool = False):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw_len = np.fromiter((len(r) for r in raw), np.int64, len(raw))
        joined = b" ".join(raw) + b" "
        buf = np.frombuffer(joined, np.uint8)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        sep = (_NOT_ALNUM if alnum else _SPACE)[buf]
        inside = ~sep
        edge = np.empty(len(buf) + 1, bool)
        edge[0] = inside[0]
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[-1] = inside[-1]
        bounds = np.flatnonzero(edge)
        self.start, self.end = bounds[0::2], bounds[1::2]
        self.offset = np.concatenate(([0], np.cumsum(self.raw_len + 1)))
        self.first = np.searchsorted(self.start, self.offset)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(raw)), self.n)
        self._bytes = buf.tobytes() if lower else joined
        self._eights = np.ndarray(len(joined), "<u8", self._bytes + bytes(8), strides=(1,))  # the 8 bytes from each byte on
        self._hash: dict[int, np.ndarray] = {}

    def hash(self, seed: int = 0) -> np.ndarray:
        if seed not in self._hash:
            self._hash[seed] = self.part_hash(self.start, self.end, seed)
        return self._hash[seed]

    def part_hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of the byte ranges [start, end) of buf; a range must not be empty."""
        size = end - start
        head = self._eights[start] & _LOW_BYTES[np.where(size < 8, size, 0)]
        total = _placed(head, np.zeros(1, np.int64), seed)
        long = np.flatnonzero(size > 8)  # the blocks after the first
        if len(long):
            blocks = (size[long] - 1) // 8
            begin = np.cumsum(blocks) - blocks
            place = np.arange(1, int(blocks.sum()) + 1) - np.repeat(begin, blocks)
            owner = np.repeat(long, blocks)
            left = size[owner] - 8 * place
            block = self._eights[start[owner] + 8 * place] & _LOW_BYTES[np.where(left < 8, left, 0)]
            total[long] += _sums(_placed(block, place, seed), begin)
        return mix64(total + size.astype(np.uint64) * _LENGTH)

    def run_hash(self, begin: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
        """Hashes of runs of words of any length of at least one: words begin[i]..begin[i] + size[i]."""
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        words = self.hash(seed)[np.repeat(begin, size) + place]
        return mix64(_sums(_placed(words, place, seed), first) + size.astype(np.uint64) * _LENGTH)

    def window_hash(self, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        """Hashes of the windows of `size` words that begin at word numbers `at` (of the batch).

        Runs of 1, 2, 4, ... words are hashed for every place, each from two halves; a window is put
        together from such runs, so its cost grows with the logarithm of its size.
        """
        run, length, offset = self.hash(seed), 1, 0
        out = np.full(len(at), size, np.uint64) * _LENGTH
        while True:
            if size & length:
                out = mix64(out * _PLACE + run[at + offset])
                offset += length
            length *= 2
            if length > size or len(run) <= length // 2:
                return out
            run = mix64(run[: -(length // 2)] * _SEEDS[1 - seed] + (run[length // 2 :] ^ _SEEDS[seed]))

    def word_bytes(self, lo: int, hi: int) -> list[bytes]:
        data = self._bytes
        return [data[s:e] for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]
