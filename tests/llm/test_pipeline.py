import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mnemospark.llm import toxicity as tx

from . import test_decontaminate, test_near_duplicates, test_pii
from .test_toxicity import corpus


def test_equals_a_brute_force_version(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = corpus(rng, 260)
    base = [t for _, t in rows[:40]]
    bench = [(1, "seven of the oddest words stand here in one row"), (2, "short item"), (3, "ten quite rare words that only a leaked test would hold")]
    for i in range(260, 330):
        w = rng.choice(base).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = f"edit{i}"
        if i % 9 == 0:
            w.insert(rng.randint(0, len(w)), bench[2][1])
        if i % 7 == 0:
            w.append(rng.choice(["4111111111111111", "192.168.7.9", "+1 (212) 555-0100", "1999-12-31", "ann.lee@mail.example.com"]))
        rows.append((i, " ".join(w)))
    rows += [(400, None), (401, "")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", known), ("benchmark", spark.createDataFrame(bench, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")

    model = tx.train(docs, known, keep=~tx.held_out(F.col("doc_id")))
    scores = tx.score_texts(model, [t for _, t in rows])
    left = [r for r, s in zip(rows, scores, strict=True) if s < tx.THRESHOLD]
    kept = {d for d, _, _, k in test_near_duplicates.brute(left, 5) if k}
    left = [r for r in left if r[0] in kept]
    bad = {r[0] for r in test_decontaminate.brute(left, bench, 10) if r[5]}
    left = [r for r in left if r[0] not in bad]
    test_pii.KEY = "change-this-key"
    left = [(i, test_pii.brute(t)[0]) for i, t in left]
    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in left}

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want) and 0 < len(bad) and len(kept) < len(rows)
    for i, ids in want.items():
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((dict(left)[i] or "").encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 1
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "bpe"]


def frame(spark, rows):
    """Documents with more columns, under names that the stages use themselves."""
    extra = ["toxic", "score", "rid", "node", "label", "text_key", "ids", "shard", "row", "rng", "items"]
    data = [(d, t, "en", "s", len(t or ""), *range(i, i + len(extra))) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in extra)).repartition(3), extra


def test_null_and_repeated_ids_and_clashing_columns(spark, tmp_path):
    """Rows are judged by their own texts: of copies the least id stays, a row without an id only if no other does."""
    plain = [f"word{i} " * 3 + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(6)]
    leak = "ten quite rare words that only a leaked test would hold"
    rows = [(5, plain[0]), (None, plain[0]), (None, plain[1]), (None, plain[1]), (3, plain[2]), (3, plain[2]), (3, plain[3]), (2, plain[3]), (9, plain[4]), (9, plain[4] + " " + leak), (None, leak + " x"), (7, None), (7, None), (None, ""), (8, "long " * 40_000 + "4111111111111111")]
    docs, extra = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (5, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    test_pii.KEY = "change-this-key"
    kept = [(5, plain[0]), (None, plain[1]), (3, plain[2]), (2, plain[3]), (9, plain[4]), (7, None), (7, None), (None, ""), (8, rows[-1][1])]
    assert got == sorted((d is None, d or 0, hashlib.sha256((test_pii.brute(t)[0] or "").encode()).hexdigest()) for d, t in kept)


def test_no_documents(spark, tmp_path):
    docs, _ = frame(spark, [(1, "a")])
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
