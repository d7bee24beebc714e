"""DuckDB SQL of the registered queries, built from common table expressions over the driver's tables.

Each piece names the pieces that it reads; `sql()` puts those in front of a query's own text.
"""

from __future__ import annotations

import re

#: name -> body. A piece may read the tables and any other piece.
PIECES = {
    "e0": "SELECT vec_id::BIGINT AS id, label::BIGINT AS episode_id, coalesce(epoch_us(ts), 0) * 1000 AS timestamp_ns, embedding::DOUBLE[] AS z, (embedding[61:64])::DOUBLE[] AS action FROM embeddings LEFT JOIN events ON event_id = vec_id",
    "e": "SELECT id, episode_id, (row_number() OVER w - 1)::BIGINT AS seq_no, timestamp_ns, coalesce(list_distance(lead(z) OVER w, z), 0) AS pred_err, 0 AS flags, z, action, lead(z) OVER w AS z_next FROM e0 WINDOW w AS (PARTITION BY episode_id ORDER BY id)",
    "u": "SELECT id, episode_id, [x / n FOR x IN z] AS v FROM (SELECT *, sqrt(list_inner_product(z, z)) AS n FROM e)",
    "q": "SELECT id AS query_id, v FROM u WHERE id % 20 = 0",
    "sims": "SELECT query_id, id, list_inner_product(q.v, u.v) AS score FROM q, u",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sims",
    "keyed": "SELECT id, [x / n FOR x IN key] AS v FROM (SELECT id, key, sqrt(list_inner_product(key, key)) AS n FROM (SELECT id, list_concat(z, [x * 2.0::DOUBLE FOR x IN action]) AS key FROM e))",
    "ksims": "SELECT a.id AS query_id, b.id AS id, list_inner_product(a.v, b.v) AS score FROM keyed a, keyed b WHERE a.id % 20 = 0",
    "kranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ksims",
    # inverted file: the mean of an episode is the centroid of the list of that number
    "flat": "SELECT id, episode_id, unnest(z) AS x, unnest(range(64)) AS d FROM e",
    "cents": "SELECT list_id, list(x ORDER BY d) AS c FROM (SELECT episode_id::INTEGER AS list_id, d, avg(x) AS x FROM flat GROUP BY ALL) GROUP BY list_id",
    "dists": "SELECT id, list_id, list_distance(v, c) * list_distance(v, c) AS distance, row_number() OVER (PARTITION BY id ORDER BY list_distance(v, c), list_id) AS probe FROM u, cents",
    "assigned": "SELECT id, list_id, distance FROM dists WHERE probe = 1",
    "sizes": "SELECT list_id, count(id) AS size FROM cents LEFT JOIN assigned USING (list_id) GROUP BY list_id",
    "hits": "SELECT query_id, sims.id, score, p.probe FROM sims JOIN assigned a ON a.id = sims.id JOIN dists p ON p.id = query_id AND p.list_id = a.list_id",
    # graph
    "temporal": "SELECT src, id AS dst, 1.0::DOUBLE AS weight, 0 AS edge_type FROM (SELECT id, lag(id) OVER (PARTITION BY episode_id ORDER BY seq_no) AS src FROM e) WHERE src IS NOT NULL",
    "fetched": "SELECT * FROM (SELECT a.id AS src, a.episode_id AS ea, b.id AS dst, b.episode_id AS eb, list_inner_product(a.v, b.v) AS weight, row_number() OVER (PARTITION BY a.id ORDER BY list_inner_product(a.v, b.v) DESC, b.id) AS fetched FROM u a JOIN u b ON b.id <= a.id) WHERE fetched <= 20",
    "analogous": "SELECT src, dst, weight, 1 AS edge_type FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM fetched WHERE src <> dst AND ea <> eb AND weight >= 0.3) WHERE place <= 4",
    "ups": "SELECT src, dst, weight, edge_type, row_number() OVER (PARTITION BY src ORDER BY row, less, dst) AS k FROM (SELECT *, dst AS row, 0.0::DOUBLE AS less FROM temporal UNION ALL SELECT *, src AS row, 2 - weight AS less FROM analogous)",
    "fold": "SELECT src, 0::BIGINT AS k, []::STRUCT(dst BIGINT, weight DOUBLE, edge_type INTEGER)[] AS s FROM (SELECT DISTINCT src FROM ups) UNION ALL SELECT src, k, CASE WHEN spot > 0 THEN [CASE WHEN i = spot THEN new ELSE s[i] END FOR i IN range(1, len(s) + 1)] WHEN len(s) < 4 THEN list_append(s, new) WHEN new.weight > low THEN [CASE WHEN i = list_position([x.weight FOR x IN s], low) THEN new ELSE s[i] END FOR i IN range(1, len(s) + 1)] ELSE s END FROM (SELECT f.src, ups.k, f.s, coalesce(list_position([x.dst FOR x IN f.s], ups.dst), 0) AS spot, list_min([x.weight FOR x IN f.s]) AS low, {'dst': ups.dst, 'weight': ups.weight, 'edge_type': ups.edge_type}::STRUCT(dst BIGINT, weight DOUBLE, edge_type INTEGER) AS new FROM fold f JOIN ups ON ups.src = f.src AND ups.k = f.k + 1)",
    "edges": "SELECT src, (i - 1)::INTEGER AS slot, x.dst AS dst, x.weight AS weight, x.edge_type AS edge_type FROM (SELECT src, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM (SELECT src, arg_max(s, k) AS s FROM fold GROUP BY src))",
    # breadth-first search from the first n of ranked: seeds is defined per query
    "m1": "SELECT query_id, dst AS id, place, edge_type, slot, weight FROM seeds JOIN edges ON src = seeds.id WHERE NOT EXISTS (FROM seeds x WHERE x.query_id = seeds.query_id AND x.id = dst)",
    "f1": "SELECT query_id, id, edge_type, weight, (SELECT max(place) FROM seeds s WHERE s.query_id = y.query_id) + row_number() OVER (PARTITION BY query_id ORDER BY place, edge_type, slot) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY place, edge_type, slot) AS n FROM m1) y WHERE n = 1",
    "g1": "SELECT query_id, id, TRUE AS is_seed, 0 AS depth, NULL::INTEGER AS edge_type, NULL::DOUBLE AS weight, place FROM seeds UNION ALL SELECT query_id, id, FALSE, 1, edge_type, weight, place FROM f1",
    "m2": "SELECT f1.query_id, dst AS id, place, edges.edge_type, slot, edges.weight FROM f1 JOIN edges ON src = f1.id WHERE NOT EXISTS (FROM g1 x WHERE x.query_id = f1.query_id AND x.id = dst)",
    "f2": "SELECT query_id, id, edge_type, weight, (SELECT max(place) FROM g1 s WHERE s.query_id = y.query_id) + row_number() OVER (PARTITION BY query_id ORDER BY place, edge_type, slot) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY place, edge_type, slot) AS n FROM m2) y WHERE n = 1",
    "g2": "SELECT * FROM g1 UNION ALL SELECT query_id, id, FALSE, 2, edge_type, weight, place FROM f2",
    # re-ranking of `cand` (query_id, id, score), defined per query
    "signals": "SELECT c.query_id, c.id, score, list_cosine_similarity(a.action, e.action) AS act, count(*) OVER w AS n FROM cand c JOIN e ON e.id = c.id JOIN e a ON a.id = c.query_id WINDOW w AS (PARTITION BY c.query_id)",
    "spans": "SELECT query_id, id, score, n, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s1, CASE WHEN max(act) OVER w = min(act) OVER w THEN 0.5 ELSE (act - min(act) OVER w) / (max(act) OVER w - min(act) OVER w) END AS s2, CASE WHEN max(id) OVER w = min(id) OVER w THEN 0.5 ELSE (id - min(id) OVER w)::DOUBLE / (max(id) OVER w - min(id) OVER w) END AS s3 FROM signals WINDOW w AS (PARTITION BY query_id)",
    "scored": "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, CASE WHEN n = 1 THEN score ELSE (1.0::DOUBLE * s1 + 0.5::DOUBLE * s2 + 0.2::DOUBLE * s3) / (1.0::DOUBLE + 0.5::DOUBLE + 0.2::DOUBLE) END AS score FROM spans)",
    # context and fusion
    "ctx": "SELECT r.query_id, r.rank AS pos, e.z_next IS NOT NULL AS mask, CASE WHEN e.z_next IS NULL THEN 0 ELSE score END AS mem_score, e.z, e.action, e.z_next FROM ranked r JOIN e ON e.id = r.id WHERE r.rank <= 5",
    "wts": "SELECT query_id, z_next, w / sum(w) OVER (PARTITION BY query_id) AS w FROM (SELECT query_id, z_next, mem_score - min(mem_score) OVER (PARTITION BY query_id) + 1e-8::DOUBLE AS w FROM ctx WHERE mask)",
    "mem": "SELECT query_id, list(x ORDER BY d) AS memory FROM (SELECT query_id, d, sum(x) AS x FROM (SELECT query_id, unnest([w * x FOR x IN z_next]) AS x, unnest(range(64)) AS d FROM wts) GROUP BY ALL) GROUP BY query_id",
    "qm": "SELECT id AS query_id, z, memory FROM e LEFT JOIN mem ON query_id = id WHERE id % 20 = 0",
    # surprise gate
    "errs": "SELECT user_id::BIGINT AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord, value::DOUBLE AS error FROM events",
    "ema": "SELECT key, ord, error, 0::DOUBLE AS m, 0::DOUBLE AS v, 0 AS n, 0::DOUBLE AS last FROM errs WHERE ord = 1 UNION ALL SELECT x.key, x.ord, x.error, CASE WHEN a.n = 0 THEN a.error ELSE a.m + 0.1::DOUBLE * (a.error - a.m) END, CASE WHEN a.n = 0 THEN 0::DOUBLE ELSE (1::DOUBLE - 0.1::DOUBLE) * (a.v + 0.1::DOUBLE * (a.error - a.m) * (a.error - a.m)) END, a.n + 1, a.error FROM ema a JOIN errs x ON x.key = a.key AND x.ord = a.ord + 1",
    "gate": "SELECT key, ord, error, m AS ema_mean, sqrt(v) AS ema_std, n AS count, n < 10 OR error > m + 1.5::DOUBLE * sqrt(v) AS retrieve, n < 10 OR last > m + 1.5::DOUBLE * sqrt(v) AS retrieve_causal FROM ema",
    "fusedq": "SELECT query_id, z, CASE WHEN memory IS NULL THEN z ELSE [x / sqrt(list_inner_product(y, y)) FOR x IN y] END AS p FROM (SELECT *, [z[i] * 0.5::DOUBLE + memory[i] * 0.5::DOUBLE FOR i IN range(1, 65)] AS y FROM qm)",
    "qerr": "SELECT query_id, list_distance(fusedq.z, z_next) ** 2 / 64 AS own, list_distance(p, z_next) ** 2 / 64 AS fused, row_number() OVER (ORDER BY query_id) AS ord FROM fusedq JOIN e ON id = query_id WHERE z_next IS NOT NULL",
    "qema": "SELECT ord, query_id, own, fused, 0::DOUBLE AS m, 0::DOUBLE AS v, 0 AS n FROM qerr WHERE ord = 1 UNION ALL SELECT x.ord, x.query_id, x.own, x.fused, CASE WHEN a.n = 0 THEN a.own ELSE a.m + 0.1::DOUBLE * (a.own - a.m) END, CASE WHEN a.n = 0 THEN 0::DOUBLE ELSE (1::DOUBLE - 0.1::DOUBLE) * (a.v + 0.1::DOUBLE * (a.own - a.m) * (a.own - a.m)) END, a.n + 1 FROM qema a JOIN qerr x ON x.ord = a.ord + 1",
    # lifecycle
    "fb": "SELECT id, query_id % 3 <> 0 AS helped, 1799000000000000000 + query_id * 1000000000 AS now_ns, query_id AS ord FROM ranked WHERE rank <= 3 AND query_id % 50 <> 0",
    "util": "SELECT id, count(*)::DOUBLE AS utility, arg_max(now_ns, ord) AS last_useful_ns FROM fb WHERE helped GROUP BY id",
    "marked": "SELECT id, episode_id, seq_no, timestamp_ns, pred_err, CASE WHEN id % 13 = 0 THEN 1 WHEN id % 17 = 0 THEN 2 ELSE 0 END AS flags, z, action FROM e",
    "lively": "SELECT u.id, u.episode_id, v FROM u JOIN marked ON marked.id = u.id WHERE flags <> 1",
    "dups": "SELECT x.id AS a, y.id AS b, list_inner_product(x.v, y.v) AS score FROM lively x JOIN lively y ON x.id < y.id AND x.episode_id = y.episode_id WHERE list_inner_product(x.v, y.v) >= 0.3",
    "reach": "SELECT id, id AS other FROM (SELECT a AS id FROM dups UNION SELECT b FROM dups) UNION SELECT reach.id, CASE WHEN a = other THEN b ELSE a END FROM reach JOIN dups ON a = other OR b = other",
    "labels": "SELECT id, min(other) AS label FROM reach GROUP BY id",
    "reps": "SELECT label, id AS representative FROM (SELECT label, labels.id, row_number() OVER (PARTITION BY label ORDER BY pred_err DESC, labels.id) AS n FROM labels JOIN marked ON marked.id = labels.id) WHERE n = 1",
    "target": "SELECT marked.id, coalesce(representative, marked.id) AS target FROM marked LEFT JOIN labels ON labels.id = marked.id LEFT JOIN reps ON reps.label = labels.label WHERE flags <> 1",
    "idmap": "SELECT marked.id AS old_id, new_id FROM marked LEFT JOIN target ON target.id = marked.id LEFT JOIN (SELECT target AS t, row_number() OVER (ORDER BY target) - 1 AS new_id FROM (SELECT DISTINCT target FROM target)) ON t = target",
    "tiers": "SELECT e.id, CASE WHEN n <= (SELECT count(*) - 200 FROM e) THEN 'cold' ELSE 'hot' END AS tier FROM e LEFT JOIN (SELECT id, row_number() OVER (ORDER BY keep, id) AS n FROM (FROM tkeep)) x ON x.id = e.id",
    "tkeep": "",
    "steps": "SELECT episode_id, list_distance(z, z_next) * list_distance(z, z_next) / 64 AS error FROM e WHERE z_next IS NOT NULL",
}


def _keep(rows: str, weights=(1.0, 1.0, 1.0), utility: bool = False) -> str:
    """SQL of (id, keep) over the rows (id, timestamp_ns, pred_err)."""
    util, last = ("coalesce(utility, 0)", "coalesce(last_useful_ns, timestamp_ns)") if utility else ("0::DOUBLE", "timestamp_ns")
    source = f"({rows}) r" + (" LEFT JOIN util USING (id)" if utility else "")
    raw = f"SELECT id, exp(-greatest(0::DOUBLE, (1800000000000000000 - {last}) / 1e9::DOUBLE) / 3e7::DOUBLE) AS s0, {util} AS s1, pred_err AS s2 FROM {source}"
    span = lambda c: f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5::DOUBLE ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
    total = " + ".join(f"{w}::DOUBLE * ({span(c)})" for w, c in zip(weights, ("s0", "s1", "s2"), strict=True))
    return f"SELECT id, ({total}) / {sum(weights)}::DOUBLE AS keep FROM ({raw})"


PIECES["tkeep"] = _keep("SELECT * FROM marked WHERE flags <> 2")
_VICTIMS = "SELECT id, keep FROM (SELECT *, row_number() OVER (ORDER BY keep, id) AS n FROM ({keep})) WHERE n <= (SELECT count(*) - count(*) * 4 // 5 FROM e)"
PIECES["victims"] = _VICTIMS.format(keep=_keep("SELECT * FROM e"))
PIECES["protected"] = _VICTIMS.format(keep=_keep("SELECT * FROM e WHERE pred_err <= 1.35", (1.0, 1.0, -0.5)))


def sql(text: str, **own: str) -> str:
    """text with all the pieces that it needs in front; own: pieces of this query only."""
    pieces = PIECES | own
    order: list[str] = []

    def need(body: str, seen: tuple[str, ...] = ()) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", body):
            if name in pieces and name not in order and name not in seen:
                if re.search(rf"\b(?:FROM|JOIN|,)\s*\(?\s*{name}\b", body):
                    need(pieces[name], (*seen, name))
                    if name not in order:
                        order.append(name)

    need(text)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({pieces[n]})" for n in order) + f"\n{text}"


_FOUND = "SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM {} WHERE rank <= {}"
_MIX = "round(list_sum([{0}[i] * i FOR i IN range(1, len({0}) + 1)]), 4)"
_ENDS = f"round({{0}}[1], 6) AS first, round({{0}}[-1], 6) AS last, round(sqrt(list_inner_product({{0}}, {{0}})), 6) AS norm, {_MIX} AS mix"
_VECTORS = f"{_MIX.format('z')} AS z, {_MIX.format('action')} AS action"
_ROWS = "id, episode_id, seq_no, timestamp_ns, round(pred_err, 6) AS pred_err, flags"
_SEEDS = "SELECT query_id, id, rank AS place FROM ranked WHERE rank <= {}"
_EXPANDED = "SELECT query_id, id, is_seed, depth, edge_type, round(weight, 6) AS weight, place::INTEGER AS place FROM {} WHERE is_seed OR place <= 12"
_CAND = "SELECT query_id, id, score FROM ranked WHERE rank <= 25 UNION ALL SELECT query_id, id, weight * pow(0.5, depth) FROM {} WHERE NOT is_seed AND place <= 40"
_COMPACTED = "SELECT new_id AS id, episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY new_id) - 1 AS seq_no, timestamp_ns, round(pred_err, 6) AS pred_err, flags, " + _VECTORS + " FROM ({})"
_GATED = sql("SELECT key, ord, round(ema_mean, 6) AS ema_mean, round(ema_std, 6) AS ema_std, count, retrieve, retrieve_causal FROM gate")

ORACLES: dict[str, str] = {
    "normalize": sql("SELECT id, " + _ENDS.format("v") + " FROM u"),
    "point_lookup": sql(f"SELECT {_ROWS} FROM e WHERE id = 7"),
    "log_range_scan": sql(f"SELECT {_ROWS} FROM e WHERE id >= 100 AND id < 300"),
    "log_flags": sql("SELECT id, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END AS flags, id % 7 <> 0 AS live, id % 11 = 0 AS pinned FROM e"),
    "episode_next_prev": sql("SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM e WINDOW w AS (PARTITION BY episode_id ORDER BY seq_no)"),
    "episode_walk": sql("SELECT id, array_to_string(coalesce(list(id) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), []), ',') AS forward, array_to_string(list_reverse(coalesce(list(id) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), [])), ',') AS back FROM e WINDOW w AS (PARTITION BY episode_id ORDER BY seq_no)"),
    "episode_lengths": sql("SELECT episode_id, count(*) AS length, min(id) AS first_id FROM e GROUP BY episode_id"),
    "episode_rows": sql("SELECT id, seq_no FROM e WHERE episode_id = 3"),
    "dot_topk_single": sql(_FOUND.format("ranked", 10) + " AND query_id = 0"),
    "dot_topk_batch": sql(_FOUND.format("ranked", 10)),
    "action_key_topk": sql(_FOUND.format("kranked", 10)),
    "ivf_assign": sql("SELECT id, list_id, round(distance, 6) AS distance FROM assigned"),
    "ivf_probe": sql("SELECT id AS query_id, list_id, round(distance, 6) AS distance, probe::INTEGER AS probe FROM dists WHERE id % 20 = 0 AND probe <= 3"),
    "ivf_probe_topk": sql(_FOUND.format("ranked", 10)),
    "ivf_bucket_sizes": sql("SELECT list_id, size FROM sizes"),
    "ivf_health": sql("SELECT round(i, 6) AS imbalance, round(d, 6) AS drift, i >= 3 OR d >= 2 AS needs_retrain FROM (SELECT (SELECT max(size) / avg(size) FROM sizes) AS i, (SELECT avg(distance) FROM (FROM assigned ORDER BY id DESC LIMIT 1000)) / (SELECT avg(distance) FROM assigned) AS d)"),
    "kmeans_one_lloyd_step": sql("SELECT cents.list_id, " + _ENDS.format("coalesce(m, c)").replace("coalesce(m, c)[", "(coalesce(m, c))[") + " FROM cents LEFT JOIN (SELECT list_id, list(x ORDER BY d) AS m FROM (SELECT list_id, d, avg(x) AS x FROM (SELECT list_id, unnest(v) AS x, unnest(range(64)) AS d FROM u JOIN assigned USING (id)) GROUP BY ALL) GROUP BY list_id) y ON y.list_id = cents.list_id"),
    "recall_at_k_by_nprobe": sql("SELECT nprobe, round(avg(n / 10), 6) AS mean_recall FROM (SELECT nprobe, q.query_id, count(f.id) AS n FROM q CROSS JOIN (SELECT unnest([1, 2, 5, 10])::INTEGER AS nprobe) LEFT JOIN (SELECT * FROM ranked WHERE rank <= 10) r ON r.query_id = q.query_id LEFT JOIN (SELECT nprobe AS np, query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY nprobe, query_id ORDER BY score DESC, id) AS rank FROM hits, (SELECT unnest([1, 2, 5, 10]) AS nprobe) WHERE probe <= nprobe) WHERE rank <= 10) f ON f.np = nprobe AND f.query_id = q.query_id AND f.id = r.id GROUP BY ALL) GROUP BY nprobe"),
    "temporal_edges": sql("SELECT src, dst, weight, edge_type FROM temporal"),
    "analogous_edges": sql("SELECT src, dst, round(weight, 6) AS weight, edge_type FROM analogous"),
    "bounded_degree_edges": sql("SELECT src, slot, dst, round(weight, 6) AS weight, edge_type FROM edges"),
    "out_degree": sql("SELECT e.id, count(src) AS degree FROM e LEFT JOIN edges ON src = e.id GROUP BY e.id"),
    "expand_d1": sql(_EXPANDED.format("g1"), seeds=_SEEDS.format(3)),
    "expand_d2": sql(_EXPANDED.format("g2"), seeds=_SEEDS.format(3)),
    "scorer_rerank": sql(_FOUND.format("scored", 20), cand="SELECT query_id, id, score FROM ranked WHERE rank <= 20"),
    "scorer_equal_weights": sql("SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (SELECT query_id, id, CASE WHEN n = 1 THEN score ELSE (s1 + s2 + s3) / 3.0::DOUBLE END AS score FROM spans)", cand="SELECT query_id, id, score FROM ranked WHERE rank <= 20"),
    "recall_scored": sql(_FOUND.format("scored", 10), cand="SELECT query_id, id, score FROM kranked WHERE rank <= 50"),
    "recall_expanded_d1": sql(_FOUND.format("scored", 5), seeds=_SEEDS.format(25), cand=_CAND.format("g1")),
    "recall_expanded_d2": sql(_FOUND.format("scored", 5), seeds=_SEEDS.format(25), cand=_CAND.format("g2")),
    "build_context": sql("SELECT query_id, pos::INTEGER AS pos, mask, round(mem_score, 6) AS mem_score, " + ", ".join(f"CASE WHEN mask THEN {_MIX.format(v)} ELSE 0 END AS {n}" for v, n in (("z", "z"), ("action", "action"), ("z_next", "outcome"))) + " FROM ctx"),
    "score_weighted_mean": sql("SELECT query_id, " + _ENDS.format("memory") + " FROM qm"),
    "fusion_alpha_0": sql("SELECT query_id, " + _ENDS.format("z") + " FROM qm"),
    "fusion_alpha_05": sql("SELECT query_id, " + _ENDS.format("p") + " FROM (SELECT query_id, CASE WHEN memory IS NULL THEN z ELSE [x / sqrt(list_inner_product(y, y)) FOR x IN y] END AS p FROM (SELECT *, [z[i] * 0.5::DOUBLE + memory[i] * 0.5::DOUBLE FOR i IN range(1, 65)] AS y FROM qm))"),
    "fusion_alpha_1": sql("SELECT query_id, " + _ENDS.format("p") + " FROM (SELECT query_id, CASE WHEN memory IS NULL THEN z ELSE [x / sqrt(list_inner_product(memory, memory)) FOR x IN memory] END AS p FROM qm)"),
    "surprise_gate": _GATED,
    "stream_trigger_equals_batch": _GATED,
    "gated_eval": sql("SELECT key, round(avg(retrieve::INTEGER::DOUBLE), 6) AS retrieval_rate, round(avg(CASE WHEN retrieve THEN error / 2 ELSE error END), 6) AS mean_error FROM gate GROUP BY key"),
    "gated_retrieval": sql("SELECT query_id, retrieve, round(CASE WHEN retrieve THEN fused ELSE own END, 6) AS error FROM (SELECT *, n < 3 OR own > m + 1.5::DOUBLE * sqrt(v) AS retrieve FROM qema)"),
    "feedback_utility": sql("SELECT id, utility, last_useful_ns FROM util"),
    "keep_scores": sql("SELECT id, round(keep, 6) AS keep FROM (" + _keep("SELECT * FROM e", utility=True) + ")"),
    "evict_victims": sql("SELECT id, round(keep, 6) AS keep FROM victims"),
    "pinned_protection": sql("SELECT id, round(keep, 6) AS keep FROM protected"),
    "evict_result": sql(_COMPACTED.format("SELECT *, row_number() OVER (ORDER BY id) - 1 AS new_id FROM e WHERE id NOT IN (SELECT id FROM victims)")),
    "near_dup_pairs": sql("SELECT a, b, round(score, 6) AS score FROM dups"),
    "dup_components": sql("SELECT id, labels.label, representative FROM labels JOIN reps ON reps.label = labels.label"),
    "compact_idmap": sql("SELECT old_id, new_id FROM idmap"),
    "compact_rows": sql(_COMPACTED.format("SELECT m.*, t.new_id, t.pin AS flags2 FROM (SELECT new_id, max(CASE WHEN flags = 2 THEN 2 ELSE 0 END) AS pin, arg_max(id, {'e': pred_err, 'i': -id}) AS keeper FROM idmap JOIN marked ON id = old_id WHERE new_id IS NOT NULL GROUP BY new_id) t JOIN marked m ON m.id = keeper").replace("round(pred_err, 6) AS pred_err, flags,", "round(pred_err, 6) AS pred_err, flags2 AS flags,")),
    "compact_edges": sql("SELECT src, slot::INTEGER AS slot, dst, 1.0::DOUBLE AS weight, 0 AS edge_type FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY was) - 1 AS slot FROM (SELECT a.new_id AS src, b.new_id AS dst, min(t.src) AS was FROM temporal t JOIN idmap a ON a.old_id = t.src JOIN idmap b ON b.old_id = t.dst WHERE a.new_id <> b.new_id GROUP BY a.new_id, b.new_id)) WHERE slot < 4"),
    "compact_stats": sql("SELECT count(*) AS old_count, count(DISTINCT new_id) AS new_count, count(*) - count(new_id) AS tombstones_dropped, count(new_id) - count(DISTINCT new_id) AS records_merged FROM idmap"),
    "tier_migrate": sql("SELECT id, tier FROM tiers"),
    "tier_promote": sql("SELECT tier, count(*) AS n, min(id) AS first_id FROM (SELECT id, CASE WHEN id = 1 THEN 'hot' ELSE tier END AS tier FROM tiers) GROUP BY tier"),
    "tiered_topk": sql("SELECT query_id, id, round(score, 6) AS score, tier, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tier DESC, id) AS rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY score DESC, id) AS own FROM (SELECT query_id, hits.id, score, tier FROM hits JOIN tiers ON tiers.id = hits.id)) WHERE own <= 10)) WHERE rank <= 10"),
    "eval_error_stats": sql("SELECT episode_id, round(avg(error), 6) AS mean_error, round(quantile_cont(error, 0.5), 6) AS median_error, round(quantile_cont(error, 0.9), 6) AS p90_error, count(*) AS n_steps FROM steps GROUP BY episode_id"),
    "split_episodes": sql("SELECT held, CASE WHEN held THEN n ELSE all_n - n END AS n_episodes FROM (SELECT count(DISTINCT episode_id) AS all_n, round_even(count(DISTINCT episode_id) * 0.2, 0)::BIGINT AS n FROM e), (SELECT unnest([TRUE, FALSE]) AS held)").replace("SELECT held,", "SELECT held AS held_out,"),
    "significance": sql("SELECT a.episode_id, b.m - a.m > 0 AND b.m - a.m > a.sd + b.sd AS by_spread, b.m - a.m > 0 AS plain FROM st a JOIN st b ON b.episode_id = a.episode_id + 1", st="SELECT episode_id, avg(error) AS m, stddev_pop(error) AS sd FROM steps GROUP BY episode_id"),
    "condition_stats": sql("SELECT condition, round(avg(error), 6) AS mean_error, round(stddev_pop(error), 6) AS std_error, sum(n)::BIGINT AS n_steps FROM (SELECT episode_id % 3 AS condition, avg(error) AS error, count(*) AS n FROM steps GROUP BY episode_id) GROUP BY condition"),
    "record_round_trip": sql("SELECT id, episode_id, seq_no, timestamp_ns, round(pred_err, 4) AS pred_err, flags, " + _VECTORS.replace(", 4)", ", 3)") + " FROM e"),
    "store_round_trip": sql(f"SELECT {_ROWS}, {_VECTORS} FROM marked WHERE id >= 50 AND flags <> 1"),
    "append_dense_ids": sql("SELECT (SELECT count(*) FROM e) + row_number() OVER (ORDER BY timestamp_ns, id) - 1 AS id, episode_id, (SELECT count(*) FROM e x WHERE x.episode_id = e.episode_id) + row_number() OVER (PARTITION BY episode_id ORDER BY timestamp_ns, id) - 1 AS seq_no, id AS old_id FROM e"),
    "stream_ingest_equals_batch": sql("SELECT episode_id, count(*) AS length, count(*) - 1 AS last_seq, round(sum(pred_err), 4) AS err FROM e GROUP BY episode_id"),
}
