import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import fingerprint as fp
from mnemospark.llm.tokens import Words


def brute(a, b):
    def pieces(t):
        d, bounds = fp.paragraphs([t])
        return set(d.tolist())

    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def random_text(rng, n):
    return "".join(rng.choice(["alpha ", "beta ", "gamma\n", "delta ", "é ", "\n", f"w{rng.randint(0, 500)} "]) for _ in range(n))


def test_peeling_recovers_the_differences():
    rng = random.Random(1)
    texts = [random_text(rng, n) for n in (0, 1, 3, 30, 300, 3000, 12000)]
    other = [t[: len(t) // 2] + random_text(rng, 40) for t in texts]
    a, b = fp.paragraphs(texts), fp.paragraphs(other)
    only_a, only_b, used = fp.differences(a, b)
    for i in range(len(texts)):
        sa, sb = set(a[0][a[1][i] : a[1][i + 1]].tolist()), set(b[0][b[1][i] : b[1][i + 1]].tolist())
        assert set(only_a[i].tolist()) == sa - sb and set(only_b[i].tolist()) == sb - sa
    assert used[0] == fp.CELLS and used[-1] > fp.CELLS  # the larger differences were tried again, larger
    assert np.allclose(fp.likeness(a, b), [brute(x, y) for x, y in zip(texts, other, strict=True)])


def test_equal_texts_have_equal_fingerprints_in_any_batch():
    one = fp.fingerprints(*fp.paragraphs(["some text\nof lines", "x", "", None]))
    two = fp.fingerprints(*fp.paragraphs([None, "some text\nof lines"]))
    assert one[0] == two[1] and one[2] == one[3] == two[0] and len({*one}) == 3


@pytest.mark.parametrize("range_chars", [50, 400, 1 << 20])
def test_next_document_and_likeness_equal_brute_force(spark, range_chars):
    rng = random.Random(2)
    ids = rng.sample(range(-50, 500), 60)
    rows = [(i, random_text(rng, rng.randint(0, 40)), "de", 7) for i in ids] + [(1000, None, None, None), (1001, "", "x", 0), (1002, "same", "", 1), (1003, "same", "", 1), (1004, "long word " * 9000, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rng string, tail int").repartition(5)
    out = {r.doc_id: r for r in fp.compare_with_next(docs, range_chars=range_chars).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(out) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = fp.edited_text(t, nxt)
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert r.near_edited == pytest.approx(brute(t, e), abs=1e-12) and r.near_next == pytest.approx(brute(t, nxt), abs=1e-12)
        assert (r.fingerprint == r.edited_fingerprint) == (t == e)


def test_repeated_and_null_ids_one_row_and_no_row(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "z"), (None, None), (7, "q")]
    out = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string"), range_chars=1).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == [(0, 0), (0, 1), (5, 5), (5, 5), (7, 1)]
    lone = fp.compare_with_next(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).collect()
    assert [r.near_next for r in lone] == [1.0]
    assert fp.compare_with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("bounds", "nulls"), [([], 0), ([5], 0), ([5, 5, 5, 9], 3), ([-3, 0, 0, 7, 7, 7, 7], 1)])
def test_ranges_follow_the_order_of_ids_and_ties(bounds, nulls):
    rng = random.Random(7)
    ranges = fp._Ranges(np.array(bounds, np.int64), nulls)
    rows = sorted({(rng.random() < 0.8, rng.randint(-5, 10), rng.choice([-(2**63), 2**63 - 1, 0, -1, rng.randint(-(2**63), 2**63 - 1)])) for _ in range(800)})
    rows = sorted({(real, i if real else 0, t) for real, i, t in rows})
    got = ranges.of(np.array([not real for real, _, _ in rows]), np.array([i for _, i, _ in rows]), np.array([t for _, _, t in rows])).tolist()
    assert got == sorted(got) and 0 <= got[0] and got[-1] < ranges.count
    split = {(real, i): {g for (r, j, _), g in zip(rows, got, strict=True) if (r, j) == (real, i)} for real, i, _ in rows}
    assert all(len(split.get((True, v), ())) == max(bounds.count(v), 1) for v in set(bounds)) and len(split[False, 0]) == max(nulls, 1)


def test_many_rows_of_one_id_and_of_none(spark):
    rng = random.Random(3)
    rows = [(7, f"text {rng.random()} of seven " * 3) for _ in range(60)] + [(None, f"none {rng.random()} " * 4) for _ in range(60)] + [(i, f"own {i} " * 5) for i in range(60)] + [(None, None), (7, "copy " * 9), (7, "copy " * 9)]
    frame = fp.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), range_chars=300)
    per_range = frame.where("tail = 0").groupBy("rng", F.col("doc_id").isNull().alias("none"), (F.col("doc_id") == 7).alias("seven")).count().collect()
    assert len({r.rng for r in per_range if r.none}) > 5 and len({r.rng for r in per_range if r.seven}) > 5
    assert frame.select(F.spark_partition_id().alias("p"), "rng").distinct().groupBy("p").count().agg(F.max("count")).first()[0] == 1  # one range to a partition
    out = fp.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), range_chars=300).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in out) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    # the order is that of one partition: descending ids, then nulls, ties by hash
    ties = {r.text: r.tie for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").distinct().select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -ties[r[1] or ""]))
    want = sorted(hashlib.sha256(fp.edited_text(t or "", order[(k + 1) % len(order)][1] or "").encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in out) == want


def plain_pieces(text):
    """Paragraphs by hand: lines, cut further after words whose hash is 0 modulo CUT."""
    out = set()
    for line in (text or "").split("\n"):
        words, piece = re.findall("[^\x20\x09-\x0D]+", line), []
        for w in words:
            piece.append(w)
            if int(Words([w]).hash()[0]) % fp.CUT == 0:
                out.add(tuple(piece))
                piece = []
        out |= {tuple(piece)} - {()}
    return out


def test_paragraphs_and_fingerprints_by_hand(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, random_text(rng, rng.randint(0, 60))) for i in range(40)] + [(50, None), (51, " \n ")]
    for t in (t for _, t in rows):
        digest, _ = fp.paragraphs([t])
        assert len(digest) == len(plain_pieces(t))
    spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in fp.op8_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = fp.edited_text(t or "", nxt or "")
        assert out[i].near_edited == pytest.approx(like(plain_pieces(t), plain_pieces(edited))) and out[i].near_next == pytest.approx(like(plain_pieces(t), plain_pieces(nxt)))
        n, cells = out[i].fingerprint.split(":")
        cells = np.frombuffer(base64.b64decode(cells), np.dtype([("n", "<u2"), ("sum", "<u8"), ("check", "<u2")]))
        digest, _ = fp.paragraphs([t])
        total = np.add.reduce(digest) if len(digest) else 0  # each region of cells holds every digest once
        thirds = cells.reshape(3, -1)
        assert int(n) == len(digest) and (thirds["n"].sum(axis=1) == len(digest)).all() and all(np.add.reduce(x) == total for x in thirds["sum"])
