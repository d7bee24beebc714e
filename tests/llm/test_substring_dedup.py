import hashlib
import random
import re

import pytest

from mnemospark.llm import substring_dedup as sd


def brute(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in words:
        for p in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[p : p + window])
                least[k] = min(least.get(k, d), d)
    out = []
    for d, w in words:
        gone = {q for p in range(len(w) - window + 1) if d is not None and least[tuple(w[p : p + window])] < d for q in range(p, p + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()))
    return out


def key(rows):
    return sorted((d is None, d or 0, *rest) for d, *rest in rows)


def test_every_cover_holds_every_difference():
    for v, members in sd.COVERS.items():
        assert {(a - b) % v for a in members for b in members} == set(range(v))


@pytest.mark.parametrize("window", [1, 5, 12, 50])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"p{k}_{rng.randint(0, 9)}" for _ in range(n)] for k, n in enumerate((window, window + 1, window + 37, window * 3, max(1, window - 1)))]
    rows = []
    for i in rng.sample(range(-5, 200), 60):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice([rng.choice(passages), [f"r{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 2 * window))], ["é", "x"] * rng.randint(0, window)])
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    rows += [(300, None), (301, ""), (302, " \n"), (None, " ".join(passages[3])), (None, None), (303, rows[0][1]), (303, rows[0][1]), (304, "longword" * 20000), (305, "a b " * 40000), (306, "a b " * 3)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h string, pos int").repartition(7)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup_substrings(docs, window).collect()]
    assert key(got) == key(brute(rows, window))


def test_rows_of_one_id_with_different_texts(spark):
    run = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(run[:25])), (1, " ".join(run[12:])), (2, " ".join(run)), (2, " ".join(["z", *run[3:20]])), (3, " ".join(run))]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 15).collect()]
    assert key(got) == key(brute(rows, 15))


def test_runs_longer_than_the_window_equal_brute_force(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(600)]
    rows = []
    for d in range(40):  # near copies, cut and shifted, so that runs are known from several smaller documents
        w = base[rng.randint(0, 80) : rng.randint(300, 600)]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 3)}"
        rows.append((d, " ".join(w)))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert key(got) == key(brute(rows, 50))


def test_empty_table(spark):
    assert sd.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
