import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    found = {}
    for i, t in items:
        w = words(t)
        for p in range(max(len(w) - window, 0) + 1 if w else 0):
            found.setdefault(tuple(w[p : p + window]), set()).update(set() if i is None else {str(i)})
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in found}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in found:
                    hit |= set(range(p, p + k))
                    ids |= found[tuple(w[p : p + k])]
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def key(rows):
    return sorted((d is None, d or 0, *rest) for d, *rest in rows)


def case(rng):
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "ünd", "a", "7"]
    items = [(i, rng.choice([" ", ", ", "\n-"]).join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 9, 20])))) for i in range(1, 30)]
    items += [(100, None), (101, ""), (102, "!?"), (None, "null id item of six words here"), (1, items[0][1]), (103, "one two three four five"), (104, "ONE two, three FOUR five")]
    docs = []
    for d in range(50):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(items)[1] or "")
        docs.append((d, rng.choice([" ", "--"]).join(parts).upper() if d % 3 else " ".join(parts)))
    docs += [(60, None), (61, ""), (62, "x " * 60_000 + "one two three four five"), (None, "one two three four five"), (63, "one two three"), (63, "one two three"), (64, "four five")]
    return docs, items


@pytest.mark.parametrize(("block_chars", "piece_words"), [(1_000_000, 4096), (300, 4096), (6, 1)])
def test_equals_brute_force(spark, block_chars, piece_words):
    docs, items = case(random.Random(11))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, shard string, row int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    index = dc.stored(dc.build_index(df), "postings")
    rows = dc.search(index, bench, 5, block_chars=block_chars, piece_words=piece_words).collect()
    got = []
    for r in rows:
        hit = {p for a, b in zip(r.starts, r.ends, strict=True) for p in range(a, b)}
        got.append((r.doc_id, r.n_words, len(hit), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), bool(hit)))
    assert key(got) == key(brute(docs, items, 5))
    got = [tuple(r)[:6] for r in dc.contamination(df, bench, 5, block_chars=block_chars).collect()]
    assert key(got) == key(brute(docs, items, 5))
    clean = [d for d, r in zip(docs, brute(docs, items, 5), strict=True) if not r[5]]
    kept = dc.remove_contaminated(df.withColumn("text_key", F.lit(1)), bench, 5)
    assert kept.columns == [*df.columns, "text_key"]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted((d or -1, t or "") for d, t in clean)


@pytest.mark.parametrize("block_chars", [1_000_000, 6])
def test_equal_shards_are_told_apart(spark, block_chars):
    long = "x " * 600_000  # a shard of its own
    docs = [(1, long + "one two three four five")] * 3 + [(2, long + "one two three four five six"), (2, "six " + long + "one two three four five")]
    items = [(1, "one two three four five"), (2, "two three four five six"), (3, "nowhere to be found at all")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    index = dc.stored(dc.build_index(df), "postings")
    rows = dc.search(index, spark.createDataFrame(items, "item_id long, text string"), 5, block_chars=block_chars).collect()
    got = sorted((r.doc_id, r.n_words, len({p for a, b in zip(r.starts, r.ends, strict=True) for p in range(a, b)}), list(r["items"])) for r in rows)
    assert got == [(1, 600_005, 5, ["1"])] * 3 + [(2, 600_006, 5, ["1"]), (2, 600_006, 6, ["1", "2"])]


@pytest.mark.parametrize("block_chars", [1_000_000, 6])
def test_equal_partitions_and_reordered_texts_of_one_id(spark, block_chars):
    rows = [(1, "one two three four five six"), (2, "six one two three four five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    df = df.unionByName(df).unionByName(spark.createDataFrame([(2, "five four three two one six"), (None, "one two three four five"), (None, "clean")], "doc_id long, text string"))
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "five four three two one")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in dc.contamination(df, bench, 5, block_chars=block_chars).collect())
    assert got == [(0, 0, 0), (0, 5, 1), (1, 5, 1), (1, 5, 1), (2, 5, 1), (2, 5, 1), (2, 5, 1)]
    assert [(r.doc_id, r.text) for r in dc.remove_contaminated(df, bench, 5, block_chars=block_chars).collect()] == [(None, "clean")]


def test_a_long_item_is_cut_into_pieces(spark):
    long = [f"w{i % 97}" for i in range(5000)]
    docs = [(i, " ".join(long[s : s + 30])) for i, s in enumerate(range(0, 4970, 333))] + [(99, " ".join(long[::-1][:40]))]
    items = [(1, " ".join(long)), (2, " ".join(long[100:112]))]
    got = [tuple(r)[:6] for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=2000).collect()]
    assert key(got) == key(brute(docs, items, 10))


def test_candidates_in_steps(spark, monkeypatch):
    monkeypatch.setattr(dc, "CANDIDATES", 7)
    docs, items = [(1, "a b " * 50 + "a a a"), (2, "b a b a a")], [(1, "a b a"), (2, "b a b a"), (3, "a a a"), (4, "b"), (5, "c a b")]
    block = dc._Block([(str(i), t.encode()) for i, t in items], 3)
    index = dc.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    w = [x for _, t in docs for x in words(t)]
    q, at = block.occurrences(dc._Shard(index[0].asDict()))
    got = sorted((tuple(words(" ".join(w[a : a + block.size[k]]))), a) for k, a in zip(q.tolist(), at.tolist(), strict=True))
    edge = len(words(docs[0][1]))
    want = {(tuple(w[a : a + n]), a) for _, t in items for x in [words(t)] for n in [min(3, len(x))] for p in range(len(x) - n + 1) for a in range(len(w) - n + 1) if w[a : a + n] == x[p : p + n] and (a >= edge or a + n <= edge)}
    assert got == sorted(want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b x c"), (2, "c b a"), (3, "a x x x x b c"), (4, "b c"), (5, "a a b c")], "doc_id long, text string")
    index = dc.stored(dc.build_index(docs), "postings")
    found = {(r.doc_id, r.start) for r in dc.near(index, ["A", "c", "b"], 5).collect()}
    assert found == {(1, 0), (2, 0), (5, 0), (5, 1)}
    assert {r.doc_id for r in dc.near(index, ["a", "b", "c"], 7).collect()} == {1, 2, 3, 5}
    assert dc.near(index, ["a", "nowhere"], 5).count() == 0


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert dc.contamination(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in dc.contamination(some, items).collect()] == [(2, 0, False)]
