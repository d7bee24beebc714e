import random
import re

import numpy as np
import pytest

from mnemospark.llm import decontaminate as dc
from mnemospark.llm import near_duplicates as nd
from mnemospark.llm import substring_dedup as sd
from mnemospark.llm.tokens import Words


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


@pytest.mark.parametrize("seed", [0, 1])
def test_words_and_their_hashes(seed):
    rng = random.Random(seed)
    texts = [None, "", " \n", "a", "x" * 7, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "xxxxxxxx" + "\0", *(" ".join("".join(rng.choice("abé\0") for _ in range(rng.randint(1, 40))) for _ in range(30)) for _ in range(9))]
    w = Words(texts)
    want = [x for t in texts for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert w.word_bytes(0, len(w.start)) == want
    by_word = {}
    for x, h in zip(want, w.hash(seed).tolist(), strict=True):
        assert by_word.setdefault(x, h) == h
    assert len(set(by_word.values())) == len(by_word)
    for x in want[:50]:  # alone, and in another place of the buffer
        assert Words([x.decode()]).hash(seed)[0] == by_word[x] == Words(["q q", "zz " + x.decode()]).hash(seed)[-1]


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 20, 31, 50])
def test_equal_windows_and_runs_have_equal_hashes_and_others_not(size):
    rng = random.Random(size)
    words = [rng.choice("abc") for _ in range(400)]
    w = Words([" ".join(words)])
    at = np.arange(len(words) - size + 1)
    for h in (w.window_hash(at, size), w.window_hash(at, size, 1), w.run_hash(at, np.full(len(at), size)), w.run_hash(at, np.full(len(at), size), 1)):
        found = {}
        for i, x in enumerate(h.tolist()):
            assert found.setdefault(tuple(words[i : i + size]), x) == x
        assert len(set(found.values())) == len(found)
    assert len(w.window_hash(np.zeros(0, np.int64), 1000)) == 0


@pytest.mark.parametrize("n", [8, 64, 1024, 4096, 1 << 17])
@pytest.mark.parametrize("letters", ["ab", "\x01\x02"])
def test_thue_morse_words_differ(n, letters):
    a, b = letters
    x, y = thue_morse(n, a, b), thue_morse(n, b, a)
    for seed in (0, 1):
        h = Words([x, y, f"{x} {y} {x}"]).hash(seed).tolist()
        assert h[0] != h[1] and h[2:] == [h[0], h[1], h[0]]
    blocks = thue_morse(n // 8, "aaaaaaaa", "bbbbbbbb"), thue_morse(n // 8, "bbbbbbbb", "aaaaaaaa")
    h = Words(list(blocks)).hash().tolist()
    assert h[0] != h[1]


def test_thue_morse_runs_differ():
    x, y = thue_morse(1 << 14, "a ", "b "), thue_morse(1 << 14, "b ", "a ")
    w = Words([x, y])
    h = w.run_hash(np.array([0, 1 << 14]), np.array([1 << 14, 1 << 14]))
    assert h[0] != h[1]


@pytest.mark.parametrize("n", [1024, 8192])
def test_operators_tell_thue_morse_words_apart(spark, n):
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    left = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*left[:30], x, *left[31:]])), (2, " ".join([*left[:30], y, *left[31:]]))]
    out = sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.n_removed for r in out] == [0, 0]
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    items = spark.createDataFrame([(1, y)], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in dc.contamination(docs, items).collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(docs).collect()} == {1: 1, 2: 2}
