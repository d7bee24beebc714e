import random
import re

import pytest

from mnemospark.llm import near_duplicates as nd
from mnemospark.llm.components import connected_components


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)} if w else set()


def brute(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i))
        out.append((d, len(sets[i]), c, d is None or d == c))
    return out


def key(rows):
    return sorted((d is None, d or 0, n, c or 0, k) for d, n, c, k in rows)


def families(rng, groups, copies, words, edits):
    rows = []
    for g in range(groups):
        base = [f"g{g}_{rng.randint(0, 10**6)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(words)] = f"e{rng.randint(0, 10**6)}"
            rows.append(" ".join(w) if rng.random() < 0.9 else "\n".join(x.upper() for x in w))
    return rows


def run(spark, rows, size):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, node string, label int").repartition(5)
    return [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, size).collect()]


@pytest.mark.parametrize("size", [4, 5])
def test_equals_brute_force(spark, size):
    rng = random.Random(size)
    texts = families(rng, 6, 8, 80, 6) + families(rng, 2, 60, 60, 3) + families(rng, 20, 1, 50, 0)
    texts += ["a b c", "A  b\tc", "a b", "a b c d", "", " \n", "x", "long " * 30000, "long " * 20000 + "tail"]
    rows = list(zip(rng.sample(range(-20, 5000), len(texts)), texts, strict=True)) + [(9000, None), (9001, None)]
    assert key(run(spark, rows, size)) == key(brute(rows, size))


def test_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (7, "p q r s t u"), (3, "p q r s t u"), (None, "a b c d e f"), (None, None), (9, "a b c d e f")]
    assert key(run(spark, rows, 5)) == key(brute(rows, 5))


@pytest.mark.parametrize("ids", ["unique", "repeated"])
def test_one_row_of_each_group_stays_whatever_its_id(spark, ids):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(families(rng, 5, 6, 60, 4), 10)]
    if ids == "repeated":
        rows += [(10, rows[0][1]), (10, rows[0][1]), (11, rows[-1][1]), (3, rows[7][1]), (3, "alone at id 3"), (None, rows[0][1]), (None, "alone without id"), (None, "alone without id")]
    rows += [(200, None), (200, None), (201, ""), (201, " ")] if ids == "repeated" else [(200, None), (201, "")]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, rid int").repartition(5)
    kept = nd.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # brute force with the rows' numbers as ids, in the order in which rows are kept
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    want = [(rows[order[k]][0], rows[order[k]][1]) for k, _, _, keep in brute([(k, rows[i][1]) for k, i in enumerate(order)], 5) if keep]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({r.rid for r in kept.collect()}) == len(got)


@pytest.mark.parametrize("nodes", [7, 1024])
def test_large_unsettled_buckets_are_compared_in_chunks(spark, monkeypatch, nodes):
    """Families around the threshold, many of whose members are similar but not linked."""
    monkeypatch.setattr(nd, "SMALL", 2)
    monkeypatch.setattr(nd, "CHUNK_NODES", nodes)
    rng = random.Random(8)
    rows = list(enumerate(families(rng, 3, 60, 60, 5)))
    assert key(run(spark, rows, 4)) == key(brute(rows, 4))


def test_pairs_that_share_a_table_are_confirmed_however_few_minhashes_agree(spark):
    w = [f"r133156w{j}" for j in range(10)]
    rows = [(1, " ".join(w[:9])), (2, " ".join(w[:8] + w[9:]))]  # similarity 0.8
    mins = nd.minhashes(*nd.shingle_sets([t for _, t in rows], 1))
    keys = nd.collection_keys(mins)
    assert (mins[0] == mins[1]).sum() == 33 and (keys[0] == keys[1]).sum() == 3
    assert key(run(spark, rows, 1)) == key(brute(rows, 1)) == [(False, 1, 9, 1, True), (False, 2, 9, 1, False)]


def test_no_rows(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 199), (199, 198), (5, 5)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 150), 100), **dict.fromkeys((198, 199, 200), 198)}
