"""DuckDB SQL for the registered queries that SQL can express, over whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = r"'[^\x20\x09-\x0D]+'"

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS k, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM iw),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
hit AS (SELECT doc_id, p, win.k AS k, item_id FROM (SELECT doc_id, p, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM dp) x JOIN win ON win.s = x.s AND win.k = x.k),
nh AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP1 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
least_doc AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN least_doc USING (s) WHERE doc_id > lo),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS t FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p WHERE strlen(html) >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g ON g.html = p.html
"""


def _op3() -> str:
    url = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    rules = [("example.net/de/8", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("org/es/", "block")]
    when = [(f"(host = '{r.partition('/')[0]}' OR suffix(host, '.{r.partition('/')[0]}')) AND prefix(path, '/{r.partition('/')[2]}')", r, v) for r, v in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in when) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in when) + " END"
    out = f"""
WITH raw AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {url}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), {url}, 2) AS path FROM pages),
u AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM raw),
l0 AS (SELECT host, path, count(*) AS pages, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad, string_split(path, '/') AS parts, '' AS t0 FROM u GROUP BY host, path)"""
    for i in range(1, 5):
        t = f"t{i - 1}"
        seg = f"parts[{i + 1}]" if i < 4 else "array_to_string(parts[5:], '/')"
        out += f""",
s{i} AS (SELECT *, CASE WHEN len(parts) > {i} THEN {seg} END AS s FROM l{i - 1}),
c{i} AS (SELECT host, {t}, s, sum(pages) AS c, sum(sum(pages)) OVER (PARTITION BY host, {t}) AS n FROM s{i} WHERE s IS NOT NULL GROUP BY host, {t}, s),
m{i} AS (SELECT *, c::DOUBLE / n - 1.96::DOUBLE * sqrt((c::DOUBLE / n) * (1 - c::DOUBLE / n) / n) > 0.05::DOUBLE AS literal FROM c{i}),
v{i} AS (SELECT host, {t} FROM m{i} WHERE NOT literal GROUP BY host, {t} HAVING (sum(c * (c - 1)) + 2)::DOUBLE / (sum(c) * (sum(c) - 1) + 2)::DOUBLE < 0.1::DOUBLE),
w{i} AS (SELECT host, {t}, s FROM m{i} SEMI JOIN v{i} USING (host, {t}) WHERE NOT literal),
l{i} AS (SELECT s{i}.* EXCLUDE (s), {t} || '/' || CASE WHEN w{i}.s IS NOT NULL THEN '*' ELSE s{i}.s END AS t{i} FROM s{i} LEFT JOIN w{i} USING (host, {t}, s))"""
    nodes = " UNION ALL ".join(f"SELECT host, {i} AS depth, {f't{i - 1}' if i else 'NULL'} AS parent, t{i} AS template, sum(pages) AS pages, sum(labelled) AS labelled, sum(bad) AS bad FROM l4 WHERE t{i} IS NOT NULL GROUP BY ALL" for i in range(5))
    weight = "(4.0::DOUBLE + 0.25::DOUBLE * (p - l))"
    levels = f"p0 AS (SELECT host, template, (b + {weight} * 0.5::DOUBLE) / (l + {weight}) AS purity FROM own WHERE depth = 0)"
    for i in range(1, 5):
        levels += f",\np{i} AS (SELECT own.host, own.template, (b + {weight} * purity) / (l + {weight}) AS purity FROM own JOIN p{i - 1} ON p{i - 1}.host = own.host AND p{i - 1}.template = own.parent WHERE depth = {i})"
    purity = " UNION ALL ".join(f"SELECT host, template, {i} AS depth, purity FROM p{i}" for i in range(5))
    return (
        out
        + f""",
node AS ({nodes}),
step AS (SELECT k.host, k.parent, k.depth, substr(k.template, length(k.parent) + 2) AS step, k.pages::DOUBLE / n.pages AS share FROM node k JOIN node n ON n.host = k.host AND n.template = k.parent AND n.depth = k.depth - 1),
shape AS (SELECT host, parent, depth - 1 AS depth, string_agg(x, ',' ORDER BY x) AS shape FROM (SELECT *, step || ':' || CAST(round(4 * share) AS INT) AS x FROM step WHERE share >= 0.125) GROUP BY ALL),
shaped AS (SELECT node.*, coalesce(shape, '') AS shape FROM node LEFT JOIN shape ON shape.host = node.host AND shape.parent = node.template AND shape.depth = node.depth),
pool AS (SELECT host, parent, depth, shape, (sum(bad) + 1)::DOUBLE / (sum(labelled) + 2)::DOUBLE AS usual FROM shaped WHERE depth > 0 GROUP BY ALL),
placed AS (SELECT shaped.*, usual IS NULL OR labelled > 0 AND abs(bad::DOUBLE / labelled - usual) > 1.96::DOUBLE * sqrt(usual * (1 - usual) / labelled) AS apart FROM shaped LEFT JOIN pool USING (host, parent, depth, shape)),
own AS (SELECT host, template, parent, depth, pages::DOUBLE AS p, labelled::DOUBLE AS l, bad::DOUBLE AS b FROM placed WHERE apart
  UNION ALL SELECT host, template, parent, depth, sum(pages) OVER m, sum(labelled) OVER m, sum(bad) OVER m FROM placed WHERE NOT apart WINDOW m AS (PARTITION BY host, parent, depth, shape)),
{levels},
purity AS ({purity}),
leaf AS (SELECT host, path, coalesce(t4, t3, t2, t1, t0) AS template, CASE WHEN t4 IS NOT NULL THEN 4 WHEN t3 IS NOT NULL THEN 3 WHEN t2 IS NOT NULL THEN 2 WHEN t1 IS NOT NULL THEN 1 ELSE 0 END AS depth FROM l4)
SELECT page_id, u.host, u.path, rule, coalesce(ruled, CASE WHEN purity >= 0.75::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, leaf.template
FROM u LEFT JOIN leaf ON leaf.host = u.host AND leaf.path = u.path LEFT JOIN purity ON purity.host = leaf.host AND purity.template = leaf.template AND purity.depth = leaf.depth
"""
    )


OP3 = _op3()

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pr JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
reach(doc_id, to_id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN link ON a = to_id),
c AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
