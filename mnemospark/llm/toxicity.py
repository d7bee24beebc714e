"""Toxicity by a counterfactually regularised classifier.

Features of a text are the distinct words and word beginnings (4, 5 and 6 bytes), as 64-bit hashes, so
that inflected or compounded insults share a feature.  A logistic model is fitted to labelled rows with
three penalties: a ridge, a lasso that leaves only telling features, and the counterfactual one: in every
sentence of a labelled text that mentions a group, the group terms are swapped for other groups' terms,
and the squared change of the sentence's score is penalised.  A mention of a group thus can't move a
score, however the labels of the sample are spread over groups.

The fit takes a bounded sample of labelled rows (sample_rows, the least by a hash of the id).  Features are
counted and chosen on executors by grouped aggregation, and one task fits the model to what the sampled
rows have of them; the driver only passes on the chosen features and the model.  Scoring is a map over all
whole texts with a broadcast of the features whose weight isn't zero; the sample bounds their number.

Defined results: a null or empty text has the score of no features; labels that contradict each other
count as toxic; null labels are left out; without both labels in the sample every score is the smoothed
share of toxic labels; repeated rows and ids are scored row by row; equal rows teach once, rows of one id
with different texts each by their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_chunks
from .tokens import Words

# Terms for groups, by language and form; a swap takes the next term of the same row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"), ("immigrants", "refugees", "natives", "foreigners"),
    ("immigrant", "refugee", "native", "foreigner"), ("africans", "americans", "europeans", "asians", "mexicans"), ("disabled", "elderly", "young", "blind", "deaf"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("schwarze", "weiße"), ("schwule", "lesben"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("noirs", "blancs"), ("immigrés", "réfugiés"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("negros", "blancos"), ("inmigrantes", "refugiados"),
)
BEGINNINGS = (4, 5, 6)
SAMPLE_ROWS = 12_000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # uint64, ascending
    weights: np.ndarray
    bias: float


def _word_features(w: Words) -> list[np.ndarray]:
    """Feature hashes by kind, one per word: the word, and its beginnings (0 where the word is no longer)."""
    out = [w.hash()]
    for n in BEGINNINGS:
        h = w.part_hash(w.start, np.minimum(w.start + n, w.end)) ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)
        out.append(np.where(w.end - w.start >= n, h, np.uint64(0)))
    return out


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) without repetition."""
    kinds = _word_features(w)
    feature, doc = np.concatenate(kinds), np.tile(w.doc, len(kinds))
    order = np.lexsort((feature, doc))
    feature, doc = feature[order], doc[order]
    keep = feature != 0
    keep[1:] &= (feature[1:] != feature[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], feature[keep]


def swapped(sentence: str, pattern: re.Pattern, turn: dict[str, str]) -> str:
    return pattern.sub(lambda m: turn[m[0].lower()], sentence)


def _swaps(terms) -> tuple[re.Pattern, dict[str, str]]:
    turn = {a: row[(i + 1) % len(row)] for row in terms for i, a in enumerate(row)}
    return re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, turn), key=len, reverse=True)) + r")\b", re.IGNORECASE), turn


def counterfactuals(text: str | None, pattern: re.Pattern, turn: dict[str, str]) -> list[tuple[str, str]]:
    """(sentence, the sentence with its group terms swapped) for the sentences that mention a group."""
    if not text or not pattern.search(text):
        return []
    return [(s, swapped(s, pattern, turn)) for s in re.split(r"(?<=[.!?])\s+|\n+", text) if pattern.search(s)]


def sample(docs: DataFrame, labels: DataFrame, keep: Column | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, toxic, text) of at most sample_rows labelled rows, a stored table: the least ones by a
    hash of the id.  Rows of one id with different texts are told apart by tie; equal rows count once."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    if keep is not None:
        known = known.where(keep)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(*order).limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").withColumn("tie", F.xxhash64("text"))  # sample_rows ids at most
    rows = stored(rows.dropDuplicates(["doc_id", "tie"]), "labelled")
    chosen = rows.select("doc_id", "tie").orderBy(*order, "tie").limit(sample_rows)
    return rows.join(F.broadcast(chosen), ["doc_id", "tie"]).select("doc_id", "tie", F.col("toxic").cast("int").alias("toxic"), "text")


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_chunks(batches):
        doc, feature = _distinct(Words(part.column("text").to_pylist(), alnum=True, lower=True))
        toxic = part.column("toxic").to_numpy(zero_copy_only=False) > 0
        names, at = np.unique(feature, return_inverse=True)
        df = np.bincount(at, minlength=len(names))
        hits = np.bincount(at, weights=toxic[doc], minlength=len(names)).astype(np.int64)
        yield pa.record_batch([pa.array(names.view(np.int64)), pa.array(df), pa.array(hits)], names=["feature", "df", "hits"])


def telling_features(rows: DataFrame, n: int, positive: int) -> np.ndarray:
    """The features, ascending, that at least three sampled rows hold and whose log odds differ from 0 by
    two standard errors or more.  Counted and chosen on executors; the sample bounds how many there are."""
    counts = rows.select("toxic", "text").mapInArrow(_count_rows, "feature long, df long, hits long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits"))
    a, b = F.col("hits") + 0.5, F.col("df") - F.col("hits") + 0.5
    z = F.abs(F.log(a / (positive + 1.0)) - F.log(b / (n - positive + 1.0))) / F.sqrt(1 / a + 1 / b)
    found = counts.where((F.col("df") >= 3) & (z >= 2.0)).select("feature").toArrow().column("feature").to_numpy()
    return np.sort(found.view(np.uint64))


def _columns(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are among the ascending names, and their numbers."""
    if not len(names):
        return np.zeros(len(x), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    known = names[at] == x
    return known, at[known]


def _example_rows(sent, terms):
    """Of each row, the numbers of its telling features; of each swapped sentence, those that go and come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        pattern, turn = _swaps(terms)
        for part in text_chunks(batches):
            texts = part.column("text").to_pylist()
            doc, feature = _distinct(Words(texts, alnum=True, lower=True))
            known, col = _columns(names, feature)
            cut = np.searchsorted(doc[known], np.arange(len(texts) + 1))
            gone, come = [], []
            for mine in (counterfactuals(t, pattern, turn) for t in texts):
                d, f = _distinct(Words([x for p in mine for x in p], alnum=True, lower=True))
                known, c = _columns(names, f)
                d = d[known]
                before, after = [c[d == 2 * i] for i in range(len(mine))], [c[d == 2 * i + 1] for i in range(len(mine))]
                gone.append([np.setdiff1d(x, y).tolist() for x, y in zip(before, after, strict=True)])
                come.append([np.setdiff1d(y, x).tolist() for x, y in zip(before, after, strict=True)])
            cols = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(col.astype(np.int32)))
            lists = pa.list_(pa.list_(pa.int32()))
            yield pa.record_batch([part.column("doc_id"), part.column("tie"), part.column("toxic"), cols, pa.array(gone, lists), pa.array(come, lists)], names=["doc_id", "tie", "toxic", "cols", "gone", "come"])

    return run


def _fit_rows(sent, cf_weight: float):
    """One task that takes all examples, whose number the sample bounds, and returns the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sent.value
        examples = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("tie", "ascending")]).combine_chunks()
        cols = examples.column("cols").combine_chunks()
        sizes = np.diff(cols.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        y = (examples.column("toxic").to_numpy() > 0).astype(float)
        swaps = [(np.array(g, np.int64), np.array(c, np.int64)) for gs, cs in zip(examples.column("gone").to_pylist(), examples.column("come").to_pylist(), strict=True) for g, c in zip(gs, cs, strict=True)]
        weights, bias = fit(len(names), row, cols.flatten().to_numpy().astype(np.int64), y, swaps, cf_weight)
        used = np.abs(weights) > 1e-3
        yield pa.record_batch([pa.array([names[used].tobytes()], pa.binary()), pa.array([weights[used].tobytes()], pa.binary()), pa.array([bias])], names=["features", "weights", "bias"])

    return run


def prior_of(n: int, positive: int) -> float:
    """Log odds of the smoothed share of toxic rows."""
    prior = (positive + 0.5) / (n + 1) if n else 0.05
    return float(np.log(prior / (1 - prior)))


def train(docs: DataFrame, labels: DataFrame, keep: Column | None = None, sample_rows: int = SAMPLE_ROWS, terms=IDENTITY_TERMS, cf_weight: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the model to at most sample_rows labelled rows; keep: a condition on doc_id for rows to learn from."""
    rows = sample(docs, labels, keep, sample_rows, id_col, text_col)
    n, positive = rows.agg(F.count("*"), F.count_if(F.col("toxic") > 0)).first()
    names = telling_features(rows, n, positive) if 0 < positive < n else np.zeros(0, np.uint64)
    if not len(names):
        return Model(names, np.zeros(0), prior_of(n, positive))
    sent = docs.sparkSession.sparkContext.broadcast(names)
    examples = rows.mapInArrow(_example_rows(sent, terms), "doc_id long, tie long, toxic int, cols array<int>, gone array<array<int>>, come array<array<int>>")
    got = examples.repartition(1).mapInArrow(_fit_rows(sent, cf_weight), "features binary, weights binary, bias double").first()
    return Model(np.frombuffer(got.features, np.uint64), np.frombuffer(got.weights), got.bias)


def fit(width: int, row: np.ndarray, col: np.ndarray, y: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], cf_weight: float = 10.0, ridge: float = 2e-4, lasso: float = 3e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on feature presence with the three penalties, by proximal Adam steps.

    (row, col): which of the features 0..width a row has; y: 1 for toxic rows; swaps: features that a swap
    of group terms takes away from a sentence, and those that it brings.
    """
    n = len(y)
    swap_col = np.concatenate([np.zeros(0, np.int64), *(x for p in swaps for x in p)]).astype(np.int64)
    swap_row = np.repeat(np.arange(len(swaps)), [len(g) + len(c) for g, c in swaps]) if swaps else np.zeros(0, np.int64)
    swap_sign = np.concatenate([np.zeros(0), *(np.r_[np.ones(len(g)), -np.ones(len(c))] for g, c in swaps)])

    w, bias = np.zeros(width), prior_of(n, int(y.sum()))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=w[col], minlength=n), -30, 30)))
        g = np.append(np.bincount(col, weights=(p - y)[row], minlength=width) / n + ridge * w, (p - y).mean())
        if len(swaps):
            change = np.bincount(swap_row, weights=swap_sign * w[swap_col], minlength=len(swaps))
            g[:-1] += cf_weight * 2 * np.bincount(swap_col, weights=swap_sign * change[swap_row], minlength=width) / len(swaps)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.1 / (1 + 3 * t / steps)
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        scale = rate / (np.sqrt(v[:-1] / (1 - 0.999**t)) + 1e-8)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(lasso * scale, 0.02), 0)
        bias -= step[-1]
    return w, float(bias)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    w = Words(texts, alnum=True, lower=True)
    z = np.full(len(texts), model.bias)
    if len(model.features) and len(w.start):
        docs, cols = [], []
        for h in _word_features(w):
            at = np.minimum(np.searchsorted(model.features, h), len(model.features) - 1)
            hit = np.flatnonzero(model.features[at] == h)
            docs.append(w.doc[hit])
            cols.append(at[hit])
        pair = np.unique(np.concatenate(docs) * len(model.features) + np.concatenate(cols))  # presence
        z += np.bincount(pair // len(model.features), weights=model.weights[pair % len(model.features)], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(score_texts(sent.value, part.column("text").to_pylist()))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, keep=~held_out(F.col("doc_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            yield part.filter(pa.array(score_texts(sent.value, part.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
