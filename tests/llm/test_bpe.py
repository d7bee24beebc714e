import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from mnemospark.llm.bpe import ByteBPE, decode, default_vocabulary, encode, round_trip


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return ByteBPE(open(path, encoding="utf-8").read()), Tokenizer.from_file(str(path))


def ids(bpe, text):
    import numpy as np

    return np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist()


def test_equals_the_library_on_every_character_of_the_basic_plane(both):
    bpe, lib = both
    for lo in range(0, 0x10000, 64):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}b" for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000)
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids(bpe, text) == want, hex(lo)


def test_equals_the_library_on_random_texts(both):
    bpe, lib = both
    rng = random.Random(5)
    tokens = [b.decode("utf-8", "ignore") for b in bpe.bytes[256:]]
    for _ in range(3000):
        text = "".join(rng.choice(tokens) if rng.random() < 0.7 else chr(rng.choice([10, 32, 39, 48, 65, 233, 0x4E2D, 0x1F600, 0xA0, 0x200B])) for _ in range(rng.randint(0, 30)))
        assert ids(bpe, text) == lib.encode(text, add_special_tokens=False).ids, text


def test_speculation_is_verified(both):
    bpe, lib = both
    rng = random.Random(6)
    failing = 0
    for _ in range(4000):
        word = "".join(rng.choice("etaoinshrdluzqx") for _ in range(rng.randint(2, 14)))
        exact = bpe.exact(word.encode())
        assert exact == lib.encode(word, add_special_tokens=False).ids
        failing += bpe.greedy(word.encode()) != exact
        assert ids(bpe, word) == exact
    assert 0 < failing < 4000


def test_special_tokens_and_edges(both):
    bpe, lib = both
    for text in ("", " ", "\n\n \t", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "x" * 50_000, "don't 'S we'll", "\x00\x1c\x1d\x85"):
        e = lib.encode(text, add_special_tokens=False).ids
        assert ids(bpe, text) == e
        assert bpe.decode(bpe.encode_batch([text])[0]) == lib.decode(e, skip_special_tokens=False) == text


def test_frames(spark, both):
    import hashlib

    _, lib = both
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (None, None, "y"), (2, "", None), (3, "ñandú " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(round_trip(docs, default_vocabulary()).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert len(out) == 5
    for (i, t, _), r in zip(sorted(rows, key=lambda r: r[0] or 0), out, strict=True):
        e = lib.encode(t or "", add_special_tokens=False).ids
        assert r.doc_id == i and r.n_tokens == len(e)
        assert r.ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert [r.decoded for r in decode(encode(docs, default_vocabulary()), default_vocabulary()).collect()] == [t or "" for _, t, _ in rows]
    assert round_trip(docs.limit(0), default_vocabulary()).count() == 0


def test_merging_many_words_equals_merging_one():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        bpe = ByteBPE(f.read())
    rng = random.Random(5)
    pieces = [b for b in bpe.bytes[:20000] if b and b in bpe.ids]
    words = [b"", b"a", b"aaaaaaaa", b"x" * 40, b"x" * 41, b"abcabcabc" * 30] + [bytes(rng.randrange(256) for _ in range(rng.randint(2, 50))) for _ in range(500)]
    words += [b"".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(3000)] + [bytes(rng.choice(b"aeimnst ") for _ in range(rng.randint(2, 40))) for _ in range(2000)]
    assert bpe.exact_batch(words) == [bpe.exact(w) for w in words]
    assert bpe.exact_batch([]) == []
