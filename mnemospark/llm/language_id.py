"""Language identification by Bayesian evidence fusion.

Evidence about a record's language, fused as a posterior over the languages of the training sample:

* text: a naive Bayes likelihood of byte trigrams, fitted to a bounded sample of labelled documents.
  Trigrams of one text depend on each other, so the likelihood is tempered: a text counts as at most
  EFFECTIVE independent trigrams;
* declared markup language (html lang): a channel P(declared | language), estimated over all records by
  grouped aggregation of the posteriors from text alone, so a site generator that always says "en" weighs little;
* address suffix and host: a prior that is smoothed down a hierarchy, all records, suffix, registered domain,
  host; each level adds its own soft counts (grouped sums of posteriors) to STRENGTH times the level above.
  What is known of country suffixes tilts the level above the suffix, so that the records of a suffix outweigh
  it.  A record's own contribution is taken out of its host's counts, so it isn't counted twice.

A text is scored once: its likelihood is stored, and all counts and posteriors are taken from that table.
Markup is scanned in linear time, whatever is left unclosed in it.

Counts and priors cover all records.  They are sums grouped by host and then by coarser keys, so a hot host
is a partial aggregate per task; the prior table, a row per host, is joined back as a stored table, whose
hot keys Spark splits or which it broadcasts if it is small.

Defined results: a record without letters has a flat text likelihood, so the other evidence decides; null
addresses and markup have an empty host and no declaration; a training sample without labels gives a null
language; equal posteriors are decided by the order of language names; rows are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, text_chunks
from .url_filter import host_of

SAMPLE_ROWS = 6_000
BUCKETS = 1 << 16
EFFECTIVE = 40.0
STRENGTH = 5.0
#: Weight of a country suffix for its language against the others, before any record of the suffix is counted.
SUFFIX_ODDS = 4.0

# The country suffixes of languages.
SUFFIXES = {"de": ("de", "at", "ch", "li"), "fr": ("fr", "be", "lu", "mc"), "es": ("es", "mx", "ar", "cl", "co", "pe"), "en": ("uk", "us", "au", "nz", "ie"), "it": ("it", "sm"), "pt": ("pt", "br"), "nl": ("nl",)}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.where(_LETTER, np.arange(256), 0x20).astype(np.uint8)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_HIDING = ("script", "style", "nav", "noscript", "template")
_OPEN = re.compile(r"<!--|<(" + "|".join(_HIDING) + r")\b", re.IGNORECASE)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _HIDING}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    logs: np.ndarray  # [BUCKETS, languages] log likelihood of a trigram bucket


def visible_text(html: str | None) -> str:
    """What a reader sees of a page, roughly: no scripts, styles, navigation, comments or tags.

    One pass: what has no end is looked for once and then left alone, and only tags that end are cut.
    """
    html = html or ""
    shown, done, at, endless = [], 0, 0, set()
    while m := _OPEN.search(html, at):
        name, at, end = (m[1] or "").lower(), m.end(), -1
        if name in endless:
            continue
        if not name:
            end = html.find("-->", at)
            end += 3 * (end >= 0)
        elif (tag := html.find(">", at)) < 0:
            break  # no tag ends from here on
        elif close := _CLOSE[name].search(html, tag + 1):
            end = close.end()
        if end < 0:
            endless.add(name)
            continue
        shown.append(html[done : m.start()])
        done = at = end
    text = " ".join([*shown, html[done:]])
    last = text.rfind(">") + 1
    return _TAG.sub(" ", text[:last]) + text[last:]


def declared_language(html: str | None) -> str | None:
    html, at = html or "", 0
    while m := _HTML.search(html, at):
        at = html.find(">", m.end())
        at = len(html) if at < 0 else at
        if found := _LANG.search(html, m.end(), at):
            return found[1].lower()
    return None


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every byte trigram around a letter, with one space for any run of others and
    at either end of a text, so that a text has the same trigrams wherever it stands."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = _FOLD[np.frombuffer(b"".join(b" " + r + b" " for r in raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)), [len(r) + 2 for r in raw])
    keep = np.ones(len(buf), bool)
    keep[1:] = (buf[1:] != 0x20) | (buf[:-1] != 0x20) | (doc[1:] != doc[:-1])
    buf, doc = buf[keep].astype(np.uint32), doc[keep]
    h = buf[:-2] * np.uint32(0x9E3779B1) + buf[1:-1] * np.uint32(0x85EBCA77) + buf[2:] * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    inside = (doc[2:] == doc[:-2]) & (buf[1:-1] != 0x20)
    return doc[:-2][inside], h[inside].astype(np.int64)


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> TextModel:
    """Fit the trigram model to the whole texts of at most sample_rows labelled ids, the least by a hash."""
    labelled = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    chosen = labelled.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            langs = part.column("lang").to_pylist()
            doc, bucket = _trigrams(part.column("text").to_pylist())
            for lang in sorted(set(langs)):
                n = np.bincount(bucket[np.array([x == lang for x in langs])[doc]], minlength=BUCKETS)
                some = np.flatnonzero(n)
                yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["lang", "bucket", "n"])

    sample = labelled.join(F.broadcast(chosen), "id").select("lang", "text")  # sample_rows ids at most
    sums = sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows per language at most
    total: dict[str, np.ndarray] = {}
    langs, buckets, n = (sums.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    for lang in set(langs.tolist()):
        total[lang] = np.zeros(BUCKETS, np.int64)
        total[lang][buckets[langs == lang]] = n[langs == lang]
    names = tuple(sorted(total))
    if not names:
        return TextModel((), np.zeros((BUCKETS, 0), np.float32))
    counts = np.stack([total[x] for x in names], axis=1) + 0.5
    return TextModel(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def tempered_likelihood(model: TextModel, texts: list[str]) -> np.ndarray:
    """[text, language] log likelihood, scaled as if a text had at most EFFECTIVE trigrams."""
    doc, bucket = _trigrams(texts)
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), len(model.languages)))
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(doc, weights=model.logs[bucket, k], minlength=len(texts))
    return out * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None]


def _evidence_rows(sent, markup: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part in text_chunks(batches):
            raw = part.column("text").to_pylist()
            texts = [visible_text(t) if markup else t or "" for t in raw]
            like = tempered_likelihood(model, texts)
            declared = [declared_language(t) if markup else None for t in raw]
            declared = [d if d is None or d in model.languages else "other" for d in declared]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * like.shape[1]), pa.array(like.ravel()))
            yield pa.record_batch([part.column("id"), part.column("host"), pa.array(declared, pa.string()), flat], names=["id", "host", "declared", "like"])

    return run


def evidence(records: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """(id, host, declared, like) of records (id, host, text)."""
    sent = records.sparkSession.sparkContext.broadcast(model)
    return records.mapInArrow(_evidence_rows(sent, markup), "id long, host string, declared string, like array<double>")


def _normalised(weights: list[Column]) -> list[Column]:
    total = reduce(lambda a, b: a + b, weights)
    return [w / total for w in weights]


def _from_logs(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    return [F.exp(x - top) for x in logs]


def fuse(found: DataFrame, languages: tuple[str, ...], markup: bool = True) -> DataFrame:
    """(id, host, declared, lang, confidence and posterior) of the evidence rows; markup: some may declare a language."""
    L = range(len(languages))
    if not languages:
        return found.select("id", "host", "declared", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<double>").alias("posterior"))
    found = stored(found, "evidence")  # the texts are scored once
    suffix = F.when(F.col("host").contains("."), F.regexp_extract("host", r"([^.:]+)(?::[0-9]*)?$", 1)).otherwise(F.lit(""))
    domain = F.when(F.col("host").contains("."), F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).otherwise(F.col("host"))
    texts = found.withColumn("suffix", suffix).withColumn("domain", domain)
    for k, p in zip(L, _normalised(_from_logs([F.col("like")[k] for k in L])), strict=True):
        texts = texts.withColumn(f"t{k}", p)

    # P(declared | language): a row per declared language, at most one more than there are languages
    said = {r.declared: r for r in texts.where("declared is not null").groupBy("declared").agg(*(F.sum(f"t{k}").alias(f"t{k}") for k in L)).collect()} if markup else {}
    values = [*languages, "other"]
    totals = [sum(r[f"t{k}"] for r in said.values()) + len(values) * 0.5 for k in L]
    channel = {d: [((said[d][f"t{k}"] if d in said else 0.0) + (1.0 if d == languages[k] else 0.5)) / (totals[k] + 0.5) for k in L] for d in values}

    def declared(k: int) -> Column:
        out = F.lit(1.0)
        for d in said:
            out = F.when(F.col("declared") == d, F.lit(channel[d][k])).otherwise(out)
        return out

    local = _normalised([F.col(f"t{k}") * declared(k) + 1e-9 for k in L])
    scored = texts.select("id", "host", "domain", "suffix", "declared", *(local[k].alias(f"p{k}") for k in L), *(F.col("like")[k].alias(f"l{k}") for k in L))

    # soft counts by host, summed up the hierarchy; each level is smoothed towards the one above
    sums = lambda: [F.sum(f"p{k}").alias(f"p{k}") for k in L]
    hosts = stored(scored.groupBy("suffix", "domain", "host").agg(*sums()), "hosts")
    domains = stored(hosts.groupBy("suffix", "domain").agg(*sums()), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(*sums()), "suffixes")
    whole = suffixes.agg(*sums()).first()
    total = sum(whole[f"p{k}"] or 0.0 for k in L)
    above = [((whole[f"p{k}"] or 0.0) + 1.0) / (total + len(languages)) for k in L]

    def smoothed(level: DataFrame, prior: list) -> DataFrame:
        n = reduce(lambda a, b: a + b, [F.col(f"p{k}") for k in L])
        return level.select(*[c for c in level.columns if not re.fullmatch(r"[pq]\d+", c)], *(((F.col(f"p{k}") + STRENGTH * prior[k]) / (n + STRENGTH)).alias(f"q{k}") for k in L))

    tilted = [F.lit(above[k]) * F.when(F.col("suffix").isin(*own), SUFFIX_ODDS).otherwise(1.0) if (own := SUFFIXES.get(languages[k])) else F.lit(above[k]) for k in L]
    of_suffixes = smoothed(suffixes, _normalised(tilted))
    of_domains = smoothed(domains.join(of_suffixes, "suffix"), [F.col(f"q{k}") for k in L])
    priors = stored(hosts.select("suffix", "domain", "host", *(F.col(f"p{k}").alias(f"h{k}") for k in L)).join(of_domains, ["suffix", "domain"]), "priors")

    # the host's counts without the record itself, smoothed towards its domain
    rows = scored.join(priors.drop("suffix", "domain"), "host")
    others = [F.greatest(F.col(f"h{k}") - F.col(f"p{k}"), F.lit(0.0)) for k in L]
    n = reduce(lambda a, b: a + b, others)
    weights = _from_logs([F.col(f"l{k}") + F.log(declared(k)) + F.log((others[k] + STRENGTH * F.col(f"q{k}")) / (n + STRENGTH)) for k in L])
    rows = rows.select("id", "host", "declared", F.array(*_normalised(weights)).alias("posterior"))
    best = F.array_max("posterior")
    return rows.select("id", "host", "declared", F.element_at(F.array(*map(F.lit, languages)), F.array_position("posterior", best).cast("int")).alias("lang"), best.alias("confidence"), "posterior")


def identify_pages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    records = pages.select(F.col(id_col).cast("long").alias("id"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("text"))
    return fuse(evidence(records, model, True), model.languages)


def identify_documents(docs: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Documents have no markup or address; their source takes the place of the host."""
    records = docs.select(F.col(id_col).cast("long").alias("id"), F.concat(F.lit("source "), F.coalesce(F.col(source_col), F.lit(""))).alias("host"), F.col(text_col).alias("text"))
    return fuse(evidence(records, model, False), model.languages, False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page and every document: page_id or doc_id, and the language with its confidence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    none = F.lit(None).cast("long")
    pages = identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), model)
    own = identify_documents(docs, model)
    columns = ["declared", "lang", F.round("confidence", 6).alias("confidence")]
    return own.select(F.col("id").alias("doc_id"), none.alias("page_id"), *columns).unionByName(pages.select(none.alias("doc_id"), F.col("id").alias("page_id"), *columns))
