import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import toxicity as tx
from mnemospark.llm.tokens import Words

INSULTS = ["gromfel", "vexnard", "plodwit"]


def corpus(rng, n, groups=False):
    """Invented prose; toxic texts hold an insult, with varying ends; some mention a group."""
    rows, labels = [], []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice(['', 'es', 'ing'])}" for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(INSULTS) + rng.choice(["", "s", "ish", "ed"]))
        if groups and (toxic or rng.random() < 0.1):  # the sample ties a group to the label
            w.insert(rng.randint(0, len(w)), "muslims")
        rows.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(1), 1500)
    docs, known = frames(spark, rows, labels)
    model = tx.train(docs, known, keep=~tx.held_out(F.col("doc_id")))
    truth = {i: t for i, _, t in labels}
    out = tx.score(docs, model).withColumn("held", tx.held_out(F.col("doc_id"))).where("held").collect()
    right = sum((r.score >= tx.THRESHOLD) == bool(truth[r.doc_id]) for r in out)
    assert len(out) > 300 and right / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)
    kept = tx.reject_toxic(docs.withColumn("score", F.lit("x")), known)
    assert kept.columns == ["doc_id", "text", "score"]
    left = [truth[r.doc_id] for r in kept.collect()]
    clean = sum(1 - t for t in truth.values())
    assert left.count(0) > 0.97 * clean and left.count(1) < 0.05 * (len(truth) - clean)


def test_swapping_groups_does_not_change_scores(spark):
    rows, labels = corpus(random.Random(2), 900, groups=True)
    docs, known = frames(spark, rows, labels)
    plain, fair = (tx.train(docs, known, cf_weight=w) for w in (0.0, 10.0))
    base = "bal men cor of the {}."
    scores = lambda m: tx.score_texts(m, [base.format(g) for g in ("muslims", "christians", "people")])
    assert abs(scores(fair)[0] - scores(fair)[1]) < 0.02 < abs(scores(plain)[0] - scores(plain)[1])
    assert scores(fair)[0] < tx.THRESHOLD
    assert tx.score_texts(fair, ["bal gromfelish men gromfels"])[0] > 0.5


def test_swaps():
    pattern, turn = tx._swaps((("women", "men"), ("gay", "straight", "bisexual")))
    assert tx.counterfactuals("All women. None here!\nGay men", pattern, turn) == [("All women.", "All men."), ("Gay men", "straight women")]
    assert tx.counterfactuals(None, pattern, turn) == [] == tx.counterfactuals("womens", pattern, turn)
    for row in tx.IDENTITY_TERMS:
        assert len(set(row)) == len(row) > 1


def test_features_equal_plain_python():
    texts = ["Hello, hello WORLD abc", None, "", "été a1b2c3d4"]
    doc, feature = tx._distinct(Words(texts, alnum=True, lower=True))
    for i, t in enumerate(texts):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode()) if t else []
        want = {("w", w) for w in words} | {(n, w[:n]) for w in words for n in tx.BEGINNINGS if len(w) >= n}
        assert len(set(feature[doc == i].tolist())) == int((doc == i).sum()) == len(want)


def test_edges(spark):
    docs, known = frames(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "gromfel"), (4, "long " * 60_000)], [(1, 1, 0), (1, 1, 1), (2, 1, None), (None, 1, 1), (9, 1, 1)])
    model = tx.train(docs, known)  # one labelled id that documents hold, and it is toxic: the share of toxic labels
    out = tx.score(docs, model).collect()
    assert len(out) == 6 and len({r.score for r in out}) == 1
    none = tx.train(docs.limit(0), known.limit(0))
    assert tx.score_texts(none, [None, "x"]).tolist() == pytest.approx([0.05, 0.05])
    assert tx.score(docs.limit(0), none).count() == 0
    assert tx.reject_toxic(docs, known.limit(0)).count() == 6


def test_weights_follow_the_labels():
    row = np.repeat(np.arange(80), 2)
    col = np.concatenate([np.tile([0, 1], 20), np.tile([0, 2], 60)])
    w, _ = tx.fit(3, row, col, np.array([1.0] * 20 + [0.0] * 60), [])
    assert w[1] > 0 > w[2] and abs(w[0]) < w[1]


def brute_model(rows, labels, cf_weight=10.0):
    """The model by plain Python sets and one driver-side fit."""
    toxic = {}
    for d, _, t in labels:
        if d is not None and t is not None:
            toxic[d] = max(toxic.get(d, 0), t)
    taught = sorted({(d, t) for d, t in rows if d in toxic}, key=lambda r: (r[0], r[1] or ""))
    feats = [tx._distinct(Words([t], alnum=True, lower=True))[1].tolist() for _, t in taught]
    y = np.array([float(toxic[d] > 0) for d, _ in taught])
    n, positive = len(y), int(y.sum())
    df, hits = {}, {}
    for f, t in zip(feats, y, strict=True):
        for x in f:
            df[x], hits[x] = df.get(x, 0) + 1, hits.get(x, 0) + t
    names = []
    for x, k in df.items():
        a, b = hits[x] + 0.5, k - hits[x] + 0.5
        if k >= 3 and abs(np.log(a / (positive + 1)) - np.log(b / (n - positive + 1))) / np.sqrt(1 / a + 1 / b) >= 2:
            names.append(x)
    number = {x: i for i, x in enumerate(sorted(names))}
    pattern, turn = tx._swaps(tx.IDENTITY_TERMS)
    swaps = []
    for _, t in taught:
        for s, c in tx.counterfactuals(t, pattern, turn):
            x, z = ({number[f] for f in tx._distinct(Words([u], alnum=True, lower=True))[1].tolist() if f in number} for u in (s, c))
            swaps.append((np.array(sorted(x - z), np.int64), np.array(sorted(z - x), np.int64)))
    row = np.array([i for i, f in enumerate(feats) for x in f if x in number])
    col = np.array([number[x] for f in feats for x in f if x in number])
    w, bias = tx.fit(len(number), row, col, y, swaps, cf_weight)
    return {x: w[i] for x, i in number.items()}, bias


def test_query_equals_a_brute_force_version(spark, tmp_path):
    rows, labels = corpus(random.Random(5), 500, groups=True)
    rows += [(3, rows[3][1]), (4, "another text of id 4"), (600, None), (601, ""), (None, "gromfel")]
    labels += [(7, 1, 1), (8, 0, None), (None, 1, 1), (9999, 1, 1)]
    docs, known = frames(spark, rows, labels)
    docs.withColumn("toxic", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    known.write.parquet(f"{tmp_path}/labels.parquet")
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d, _ in rows if d is not None}
    weights, bias = brute_model([r for r in rows if r[0] is not None and not held[r[0]]], labels)

    def want(text):
        z = bias + sum(weights.get(f, 0.0) * (abs(weights.get(f, 0.0)) > 1e-3) for f in tx._distinct(Words([text], alnum=True, lower=True))[1].tolist())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    got = sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.held_out, r.predicted) for r in tx.op2_toxicity(spark, str(tmp_path)).collect()))
    wanted = sorted((d is None, d or 0, want(t), held.get(d, False), int(want(t) >= tx.THRESHOLD)) for d, t in rows)
    assert [(a, b, h, p) for a, b, _, h, p in got] == [(a, b, h, p) for a, b, _, h, p in wanted]
    assert [g[2] for g in got] == pytest.approx([x[2] for x in wanted], abs=1e-6)


def test_learns_from_up_to_12_000_rows(spark):
    docs = spark.range(12_500).selectExpr("id AS doc_id", "concat('word', id) AS text", "cast(id % 5 = 0 AS int) AS toxic")
    assert tx.sample(docs, docs.where("doc_id < 10000")).count() == 10_000
    assert tx.sample(docs, docs).count() == 12_000
    again = docs.select("doc_id", F.explode(F.array(F.lit("a"), F.lit("a"), F.lit("b"))).alias("text"))  # repeated and differing rows of one id
    assert tx.sample(again, docs.where("doc_id < 100")).count() == 200
    assert tx.sample(again, docs).count() == 12_000
