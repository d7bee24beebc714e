import math
import random
import re
from collections import Counter, defaultdict

from mnemospark.llm import url_filter as uf


def brute(rows):
    """The tree, level by level, in plain Python."""
    parsed = []
    for i, u in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        best = None
        for r in uf.RULES:
            if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.prefix) > len(best.prefix)):
                best = r
        parsed.append((i, host, path, best))
    segments = {}
    for _, h, p, _ in parsed:
        parts = p.split("/")[1:]
        segments[h, p] = [*parts[: uf.DEPTH - 1], "/".join(parts[uf.DEPTH - 1 :])] if len(parts) > uf.DEPTH else parts
    pages = Counter((h, p) for _, h, p, _ in parsed)
    trail = {k: [""] for k in segments}  # the templates from the root down
    for level in range(uf.DEPTH):
        kids = defaultdict(Counter)
        for (h, p), s in segments.items():
            if len(s) > level:
                kids[h, trail[h, p][-1]][s[level]] += pages[h, p]
        named, variable = set(), set()
        for node, c in kids.items():
            n = c.total()
            named |= {(node, s) for s, k in c.items() if k / n - uf.Z * math.sqrt(k / n * (1 - k / n) / n) > uf.LITERAL}
            rest = [k for s, k in c.items() if (node, s) not in named]
            if rest and (sum(k * (k - 1) for k in rest) + 2) / (sum(rest) * (sum(rest) - 1) + 2) < uf.AGREE:
                variable.add(node)
        for (h, p), s in segments.items():
            if len(s) > level:
                node = h, trail[h, p][-1]
                trail[h, p].append(node[1] + "/" + ("*" if node in variable and (node, s[level]) not in named else s[level]))
    count, parent = defaultdict(lambda: [0, 0, 0]), {}
    for _, h, p, r in parsed:
        for d, t in enumerate(trail[h, p]):
            parent[h, d, t] = trail[h, p][d - 1] if d else None
            for k, x in enumerate((1, r is not None, r is not None and r.verdict == "block")):
                count[h, d, t][k] += x
    below = defaultdict(list)
    for (h, d, t), (n, _, _) in count.items():
        if d and n / count[h, d - 1, parent[h, d, t]][0] >= 0.125:
            below[h, d - 1, parent[h, d, t]].append(t[len(parent[h, d, t]) + 1 :] + ":" + str(int(4 * n / count[h, d - 1, parent[h, d, t]][0] + 0.5)))
    siblings = defaultdict(list)
    for h, d, t in count:
        siblings[h, d, parent[h, d, t], tuple(sorted(below[h, d, t])) if d else t].append((h, d, t))
    pooled = {}
    for same in siblings.values():
        usual = (sum(count[k][2] for k in same) + 1) / (sum(count[k][1] for k in same) + 2)
        apart = {k for k in same if k[1] == 0 or count[k][1] and abs(count[k][2] / count[k][1] - usual) > uf.Z * math.sqrt(usual * (1 - usual) / count[k][1])}
        for k in same:
            pooled[k] = count[k] if k in apart else [sum(x) for x in zip(*(count[j] for j in same if j not in apart), strict=True)]
    purity = {}
    for h, d, t in sorted(count, key=lambda k: k[1]):
        n, labelled, bad = pooled[h, d, t]
        w = uf.STRENGTH + uf.DILUTION * (n - labelled)
        purity[h, d, t] = (bad + w * (purity[h, d - 1, parent[h, d, t]] if d else 0.5)) / (labelled + w)
    judged = lambda h, p: "block" if purity[h, len(trail[h, p]) - 1, trail[h, p][-1]] >= uf.THRESHOLD else "allow"
    return sorted((i, h, p, r and r.prefix, r.verdict if r else judged(h, p), trail[h, p][-1]) for i, h, p, r in parsed)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["Example.com", "www.example.com", "a.b.example.com", "example.net", "x.EXAMPLE.net", "other.org", "notcom", "com", "u@h.com:80"]
    rows = []
    for i in range(2500):
        tail = rng.choice(["", "/", "?q=/en/1", "#x", ".html", f"/{rng.choice('abc')}/{rng.randint(0, 9)}", f"/p{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}", f"/p{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}", "/1/2/3/4/5/6"])
        rows.append((i, f"{rng.choice(['http', 'HTTPS', 'a://b'])}://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr', 'EN'])}/{rng.randint(0, 99)}{tail}"))
    rows += [(3000, None), (3001, ""), (3002, "no scheme/en/"), (1003, "http://"), (1004, "http://h.com"), (1005, "http://h.com?x"), (1006, "http://h.com/en/" + "z" * 100_000), (1007, rows[0][1]), (1008, "http://a\nb.com/en/7")]
    pages = spark.createDataFrame([(*r, "clash", 2) for r in rows], "page_id long, url string, host string, rule int").repartition(4)
    got = sorted(tuple(r) for r in uf.judge(pages).collect())
    want = brute(rows)
    assert got == want
    assert any("*" in r[5] for r in got)


def verdicts(spark, rows, rules=uf.RULES):
    return {r.page_id: (r.verdict, r.template) for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}


def test_a_variable_segment_is_judged_by_its_template(spark):
    rules = (uf.Rule("block", "bad.test/x/spam1"), uf.Rule("block", "bad.test/x/spam2"))
    rows = [(i, f"http://bad.test/x/spam{1 + i % 2}{i}") for i in range(12)] + [(50, "http://bad.test/x/spam9"), (51, "http://bad.test/about"), (52, "http://good.test/x/spam9")]
    got = verdicts(spark, rows, rules)
    assert got[50] == ("block", "/x/*") and got[52][0] == "allow"
    assert got[51][1] == "/about"  # a branch of another shape


def test_few_labels_among_many_unlabelled_pages_reject_nothing(spark):
    rules = (uf.Rule("block", "h.test/es/"),)
    rows = [(i, f"http://h.test/en/{i}") for i in range(200)] + [(500 + i, f"http://h.test/es/{i}") for i in range(6)]
    got = verdicts(spark, rows, rules)
    assert all(got[i] == ("allow", "/en/*") for i in range(200)) and got[500] == ("block", "/es/*")


def test_similar_branches_share_labels_and_those_that_differ_stand_alone(spark):
    rules = (uf.Rule("block", "h.test/a/"), uf.Rule("allow", "h.test/c/"))
    rows = [(1000 * k + i, f"http://h.test/{branch}/{i}/{leaf}") for k, branch in enumerate("abc") for i in range(40) for leaf in ("view", "edit")[: 1 + (i % 2)]]
    rows += [(9000 + i, f"http://h.test/b/{i}/view") for i in range(100, 102)] + [(9500 + i, f"http://h.test/d/{i}") for i in range(8)]
    got = verdicts(spark, [(k, u) for k, u in enumerate(u for _, u in rows)], rules)
    by = {u: got[k] for k, (_, u) in enumerate(rows)}
    assert by["http://h.test/a/1/view"] == ("block", "/a/*/view") and by["http://h.test/c/1/view"][0] == "allow"
    pages = [(k, u) for k, (_, u) in enumerate(rows) if "/c/" not in u]
    got = verdicts(spark, pages, rules[:1])
    assert {got[k][0] for k, u in pages if "/b/" in u} == {"block"}  # shaped like a, and not labelled


def test_the_registered_query_decides_pages_without_a_rule(spark, tmp_path):
    rows = [(i, f"https://shop.example.com/en/{10 + i}") for i in range(60) if not str(10 + i).startswith("7")] + [(100, "https://shop.example.com/fr/31"), (101, "https://shop.example.com/fr/32.html")]
    rows += [(200 + i, f"https://news.test/en/{i}") for i in range(30)] + [(300 + i, f"https://quiet.org/fr/{i}") for i in range(30)] + [(340, "https://quiet.org/es/1")]
    spark.createDataFrame([(*r, "<p>") for r in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.op3_url_filter(spark, str(tmp_path)).collect()}
    assert got[100] == got[101] == (None, "block") and got[0] == ("com/en/", "block")
    assert {got[i] for i in (*range(200, 230), *range(300, 330))} == {(None, "allow")} and got[340] == ("org/es/", "block")


def test_null_ids_and_no_rows(spark):
    assert uf.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    got = uf.judge(spark.createDataFrame([(None, "http://x.com/en/1"), (None, None)], "page_id long, url string")).collect()
    assert sorted((r.host, r.verdict) for r in got) == [("", "allow"), ("x.com", "block")]
