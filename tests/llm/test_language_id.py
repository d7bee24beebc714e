import collections
import math
import random
import re
import time

import numpy as np
import pytest

from mnemospark.llm import language_id as li

WORDS = {"en": "the and that with have this from they which their would there what about when make like time just know".split(), "de": "der und die nicht ist ein eine sich auch auf werden aus dem wird einer wenn nach oder über schön".split(), "fr": "les des est une que dans qui sur pas plus pour avec été cette mais être comme nous leurs où".split()}


def text(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def documents(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, text(rng, lang, rng.randint(3, 60)), lang, f"src{i % 4}"))
    return rows


def fitted(spark, n=200):
    docs = spark.createDataFrame(documents(random.Random(1), n), "doc_id long, text string, lang string, source string")
    return docs, li.train(docs)


def test_documents(spark):
    docs, model = fitted(spark)
    assert model.languages == ("de", "en", "fr")
    other = spark.createDataFrame(documents(random.Random(2), 150), "doc_id long, text string, lang string, source string").withColumnRenamed("lang", "declared")
    truth = {r.doc_id: r.declared for r in other.collect()}
    out = li.identify_documents(other, model).collect()
    assert len(out) == 150 and sum(r.lang == truth[r.id] for r in out) >= 148
    assert all(sum(r.posterior) == pytest.approx(1) for r in out)


def test_evidence_is_fused(spark):
    """Short texts: markup that is usually right helps, one that always says en doesn't; host and suffix decide the rest."""
    docs, model = fitted(spark)
    rng = random.Random(3)
    rows = []
    for i in range(240):
        lang = ("de", "fr", "en")[i % 3]
        rows.append((i, f"https://{lang}site{i % 2}.example/{i}", f'<html lang="{lang}-x"><script>var the;</script><p>{text(rng, lang, 12)}</p></html>'))
    rows += [(1000, "http://desite0.example/x", "<p>12 34</p>"), (1001, "http://a.de/x", "<p></p>"), (1002, "http://b.fr", None), (1003, None, f"<html lang='fr'><p>{text(rng, 'fr', 2)}</p>"), (1004, None, "<html lang=fr>!!")]
    out = {r.id: r for r in li.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(out) == len(rows)
    assert sum(out[i].lang == ("de", "fr", "en")[i % 3] for i in range(240)) >= 238
    assert out[1000].lang == "de"  # its host
    assert out[1001].lang == "de" and out[1002].lang == "fr"  # their suffixes
    assert out[1003].lang == out[1004].lang == "fr" and out[1004].declared == "fr"
    always = [(i, None, f'<html lang="en">{text(rng, ("de", "fr")[i % 2], 6)}') for i in range(200)]
    out = li.identify_pages(spark.createDataFrame(always, "page_id long, url string, html string"), model).collect()
    assert sum(r.lang == ("de", "fr")[r.id % 2] for r in out) >= 195


def plain_likelihood(sample, texts):
    """Tempered naive Bayes of byte trigrams, written out: {language: log likelihood} of each text."""

    def bucket(x):
        a, b, c = (ord(y) for y in x)
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        return ((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 16

    counts = {}
    for t, lang in sample:
        counts.setdefault(lang, collections.Counter()).update(bucket(g) for g in plain_grams(t))
    out = []
    for t in texts:
        mine = [bucket(g) for g in plain_grams(t)]
        scale = min(len(mine), li.EFFECTIVE) / max(len(mine), 1)
        out.append({k: scale * sum(math.log((n[g] + 0.5) / (n.total() + 0.5 * li.BUCKETS)) for g in mine) for k, n in counts.items()})
    return out


def plain_grams(t):
    folded = " " + "".join(chr(c + 32) if 65 <= c <= 90 else chr(c) if 97 <= c <= 122 or c >= 128 else " " for c in (t or "").encode()) + " "
    folded = re.sub(" +", " ", folded)
    return [folded[i : i + 3] for i in range(len(folded) - 2) if folded[i + 1] != " "]


def plain_posteriors(like, hosts, said):
    """The fusion written out over whole lists: a posterior {language: p} of each record."""
    langs = sorted(like[0])
    norm = lambda w: {k: x / sum(w.values()) for k, x in w.items()}
    t = [norm({k: math.exp(x - max(row.values())) for k, x in row.items()}) for row in like]
    values = [*langs, "other"]
    total = {k: sum(t[i][k] for i, d in enumerate(said) if d) + 0.5 * len(values) for k in langs}
    channel = lambda d, k: 1.0 if d is None else (sum(t[i][k] for i, x in enumerate(said) if x == d) + (1.0 if d == k else 0.5)) / (total[k] + 0.5)
    p = [norm({k: t[i][k] * channel(said[i], k) + 1e-9 for k in langs}) for i in range(len(like))]
    suffix = [h.rsplit(".", 1)[1].split(":")[0] if "." in h else "" for h in hosts]
    domain = [".".join(h.split(".")[-2:]) if "." in h else h for h in hosts]
    counts = lambda rows: {k: sum(p[i][k] for i in rows) for k in langs}
    add = lambda c, prior: {k: (c[k] + li.STRENGTH * prior[k]) / (sum(c.values()) + li.STRENGTH) for k in langs}
    whole = counts(range(len(like)))
    top = {k: (whole[k] + 1) / (sum(whole.values()) + len(langs)) for k in langs}
    out = []
    for i in range(len(like)):
        same = lambda *keys: [j for j in range(len(like)) if all(key[j] == key[i] for key in keys)]  # noqa: B023, E731
        tilted = norm({k: top[k] * (li.SUFFIX_ODDS if suffix[i] in li.SUFFIXES.get(k, ()) else 1.0) for k in langs})
        prior = add(counts(same(suffix, domain)), add(counts(same(suffix)), tilted))
        mine = counts(same(hosts))
        own = add({k: max(mine[k] - p[i][k], 0.0) for k in langs}, prior)
        logs = {k: like[i][k] + math.log(channel(said[i], k)) + math.log(own[k]) for k in langs}
        out.append(norm({k: math.exp(x - max(logs.values())) for k, x in logs.items()}))
    return out


def test_query_equals_a_brute_force_version(spark, tmp_path):
    rng = random.Random(4)
    docs = [*documents(rng, 120), (500, None, "de", "src1"), (501, "", None, None), (501, text(rng, "fr", 5), None, "src2"), (None, text(rng, "en", 9), "en", "src2")]
    pages = []
    for i in range(90):
        lang, said = rng.choice(list(WORDS)), rng.choice(["de", "en", "fr", "xx", None])
        host = rng.choice(["x.shop.de", "y.shop.de", "shop.de:8080", "a.example.org", "b.example.org", "c.fr", "localhost", "d.co.uk"])
        pages.append((i, rng.choice([f"http://{host}/p{i}", f"https://{host.upper()}?q"]), (f'<html lang="{said}">' if said else "<html>") + f"<script>der {text(rng, 'en', 3)}</script><p>{text(rng, lang, rng.randint(0, 8))}</p>"))
    pages += [(90, None, None), (91, "no address", "<p>12 34</p>"), (91, "no address", "<p>12 34</p>"), (None, "http://c.fr/", text(rng, "fr", 3))]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, source string, host int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, "c") for x in pages], "page_id long, url string, html string, like string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    sample = [(t, lang) for d, t, lang, _ in docs if d is not None and lang and t is not None]
    want = []
    of_docs = plain_posteriors(plain_likelihood(sample, [t for _, t, _, _ in docs]), [f"source {s or ''}" for _, _, _, s in docs], [None] * len(docs))
    want += [(d, None, None, max(sorted(p), key=p.get), max(p.values())) for (d, *_), p in zip(docs, of_docs, strict=True)]
    hosts = [re.sub("[/?].*", "", u.split("://")[1]).lower() if u and "://" in u else "" for _, u, _ in pages]
    said = [None if not h or "lang=" not in h else m if (m := re.search('lang="(..)"', h)[1]) in WORDS else "other" for _, _, h in pages]
    shown = [re.sub("<[^>]*>", " ", re.sub("<script>.*?</script>", " ", h or "")) for _, _, h in pages]
    of_pages = plain_posteriors(plain_likelihood(sample, shown), hosts, said)
    want += [(None, i, d, max(sorted(p), key=p.get), max(p.values())) for (i, *_), d, p in zip(pages, said, of_pages, strict=True)]
    got = [tuple(r) for r in li.op4_language_id(spark, str(tmp_path)).collect()]
    order = lambda r: tuple((x is None, x) for x in r[:2]) + (r[3], r[4])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=2e-6)


@pytest.mark.parametrize("piece", ["<!--", "<html ", "<script ", "<script>", "<", "<nav><style>", "</script", "<html lang ", "<!-- -- >", "<template></templat>"])
def test_hostile_markup_takes_linear_time(piece):
    html = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    li.visible_text(html), li.declared_language(html)
    assert time.perf_counter() - began < 3


def test_visible_text_and_declared_language():
    assert li.visible_text("a<!-- x <b> --> b <SCRIPT src='q'>var</ Script></script >c<p>d</p><nav>e") .split() == ["a", "b", "c", "d", "e"]
    assert li.visible_text("<!-- never closed <p>x</p> 1 < 2").split() == ["x", "1", "<", "2"]
    assert li.visible_text(None) == "" and li.visible_text("a < b") == "a < b"
    assert li.declared_language("<HTML class=a lang = 'De-at'>") == "de" and li.declared_language("<html><p lang='fr'>") is None
    assert li.declared_language("<html class='x'><html lang=es>") == "es" and li.declared_language(None) is None


def test_trigrams_equal_plain_python():
    texts = ["Ab, cd", "", "é1x", "a"]
    doc, bucket = li._trigrams(texts)
    assert np.bincount(doc, minlength=4).tolist()[1] == 0
    one, _ = li._trigrams(["Ab, cd"])
    assert len(one) == int((doc == 0).sum()) and bucket.max() < li.BUCKETS


def test_edges(spark):
    docs, model = fitted(spark, 30)
    none = li.train(docs.withColumn("lang", docs.lang.substr(100, 1)).where("false"))
    assert none.languages == ()
    rows = spark.createDataFrame([(1, None, None, "c"), (1, None, None, "c"), (None, "http://h", "<html lang=''>" + "x " * 50_000, "c")], "page_id long, url string, html string, like string")
    assert [r.lang for r in li.identify_pages(rows, none).collect()] == [None] * 3
    assert len({tuple(r.posterior) for r in li.identify_pages(rows, model).where("id = 1").collect()}) == 1
    assert li.identify_pages(rows.limit(0), model).count() == 0
