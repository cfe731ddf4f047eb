"""DuckDB forms of the graph queries, put together from named steps in the long encoding (v, d, x)."""

from __future__ import annotations

from .graph_queries import CLASSES, DIM, RANKS

D, C, R = DIM, CLASSES, RANKS

BASE = f"""nn AS (SELECT count(*) AS n FROM embeddings),
nodes AS (SELECT vec_id AS v, label::bigint AS label, vec_id % 10 < 6 AS is_train, vec_id % 10 IN (6, 7) AS is_val, vec_id % 10 > 7 AS is_test FROM embeddings),
st0 AS (SELECT vec_id AS v, d::int AS d, embedding[d + 1]::double AS x, true AS act FROM embeddings, range({D}) r(d)),
dense AS (SELECT l_partkey % n AS s, l_orderkey % n AS t FROM lineitem, nn),
dag AS (SELECT s, t FROM dense WHERE s < t)"""


def layer(k: int, edges: str = "dag", plain: bool = False, first: str = "st0") -> str:
    """m (sums), p (before activation), st (state) of a layer."""
    src = first if k == 0 else f"st{k}"
    one = "CASE WHEN i = j THEN 1.0::double ELSE 0.0::double END"
    w = one if plain else f"({one} + ((i * 13 + j * 7 + {k * 5}) % 11 - 5)::double / 20.0::double) / 32.0::double"
    b = "0.0::double" if plain else f"((i * 3 + {k}) % 5 - 2)::double / 50.0::double"
    return f"""w{k} AS (SELECT i::int AS i, j::int AS j, {w} AS w FROM range({D}) a(i), range({D}) b(j)),
b{k} AS (SELECT i::int AS i, {b} AS b FROM range({D}) a(i)),
m{k} AS (SELECT t AS v, d, sum(x) AS a, count(*) AS received FROM {edges} JOIN {src} ON s = v WHERE act GROUP BY t, d),
p{k} AS (SELECT v, w{k}.i AS d, sum(w * a) + any_value(b) AS p FROM m{k} JOIN w{k} ON j = d JOIN b{k} ON b{k}.i = w{k}.i GROUP BY v, w{k}.i),
st{k + 1} AS (SELECT o.v, o.d, CASE WHEN p IS NULL THEN o.x WHEN p > 0 THEN p ELSE 0.0::double END AS x, p IS NOT NULL AS act FROM {src} o LEFT JOIN p{k} USING (v, d))"""


RAMP = f"ramp AS (SELECT v, d::int AS d, (v + 1)::double / n::double AS x, true AS act FROM nodes, nn, range({D}) r(d))"


def boundaries(kind: str) -> str:
    """starts (k, lo): the rank boundaries."""
    if kind == "vertex":
        return f"starts AS (SELECT k::int AS k, k * n // {R} AS lo FROM range({R + 1}) r(k), nn)"
    cost = "deg::double" if kind == "edge" else "10.0::double + deg::double"
    goal = f"ceil(sum(cost) / {R})" if kind == "edge" else f"sum(cost) / {R}"
    parts = [f"cost AS (SELECT v, {cost} AS cost FROM deg), cum AS (SELECT v, sum(cost) OVER (ORDER BY v) AS cum FROM cost), goal AS (SELECT {goal} AS goal FROM cost), z0 AS (SELECT -1::bigint AS v, 0.0::double AS cum)"]
    for k in range(1, R):
        parts.append(f"z{k} AS (SELECT min(c.v) AS v, min(c.cum) AS cum FROM cum c, goal, nn, z{k - 1} z WHERE c.cum >= z.cum + goal AND c.v < n - 1 AND c.v > z.v)")
    rows = ["SELECT 0 AS k, 0::bigint AS lo"] + [f"SELECT {k}, coalesce(z{k}.v + 1, n) FROM z{k}, nn" for k in range(1, R)] + [f"SELECT {R}, n FROM nn"]
    return ", ".join(parts) + ", starts AS (" + " UNION ALL ".join(rows) + ")"


RANGES = "ranges AS (SELECT a.k AS rank, a.lo, b.lo AS hi FROM starts a JOIN starts b ON b.k = a.k + 1)"
OWNED = "owned AS (SELECT d.v, d.deg, r.rank, r.lo FROM deg d JOIN ranges r ON d.v >= r.lo AND d.v < r.hi)"
CROSS = "x AS (SELECT s, t, a.rank AS s_rank, b.rank AS t_rank FROM EDGES JOIN owned a ON a.v = s JOIN owned b ON b.v = t)"
STATS = "stats AS (SELECT r.rank, r.lo, r.hi, count(o.v) AS vertices, coalesce(sum(o.deg), 0)::bigint AS edges, coalesce(sum(10.0::double + o.deg), 0.0::double) AS cost FROM ranges r LEFT JOIN owned o ON o.rank = r.rank GROUP BY r.rank, r.lo, r.hi)"


def parted(kind: str, edges: str = "dense") -> list[str]:
    deg = f"deg AS (SELECT v, count(s) AS deg FROM nodes LEFT JOIN {edges} ON s = v GROUP BY v)"
    return [BASE, deg, boundaries(kind), RANGES, OWNED, CROSS.replace("EDGES", edges), STATS]


HEAD = f"""wc AS (SELECT c::int AS c, d::int AS d, ((c * 31 + d * 17) % 13 - 6)::double / 100.0::double AS w FROM range({C}) a(c), range({D}) b(d)),
z AS (SELECT v, c, sum(w * x) AS z FROM st2 JOIN wc USING (d) WHERE act GROUP BY v, c),
lse AS (SELECT v, max(z) + ln(sum(exp(z - top))) AS lse FROM (SELECT v, z, max(z) OVER (PARTITION BY v) AS top FROM z) GROUP BY v),
best AS (SELECT v, c AS best FROM z QUALIFY row_number() OVER (PARTITION BY v ORDER BY z DESC, c) = 1),
scored AS (SELECT l.v, label, is_train, is_val, is_test, lse - z AS loss, (best = label)::int::double AS hit, lse FROM nodes l JOIN lse USING (v) JOIN best USING (v) JOIN z ON z.v = l.v AND z.c = label)"""
BACK = """cnt AS (SELECT count(*) AS cnt FROM scored WHERE is_train),
dz AS (SELECT z.v, z.c, (exp(z - lse) - (c = label)::int) / cnt AS g FROM z JOIN scored USING (v), cnt WHERE is_train),
gp1 AS (SELECT q.v, q.d, CASE WHEN p > 0 THEN q.g ELSE 0.0::double END AS g FROM (SELECT v, d, sum(g * w) AS g FROM dz JOIN wc USING (c) GROUP BY v, d) q JOIN p1 USING (v, d)),
ga1 AS (SELECT v, j AS d, sum(g * w) AS g FROM gp1 JOIN w1 ON i = d GROUP BY v, j),
gh0 AS (SELECT s AS v, d, sum(g) AS g FROM dense JOIN ga1 ON t = v GROUP BY s, d),
gp0 AS (SELECT gh0.v, gh0.d, CASE WHEN p > 0 THEN g ELSE 0.0::double END AS g FROM gh0 JOIN p0 USING (v, d))"""
TRAIN = [BASE, layer(0, "dense"), layer(1, "dense"), HEAD, BACK]


def sql(parts: list[str], select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::double"


def _lists(edges: str) -> str:
    return f"SELECT v, sum(n) OVER (ORDER BY v) - n AS row_start, coalesce(l, '') AS neighbours FROM (SELECT nodes.v, count(e.t) AS n, string_agg(e.t::varchar, ',' ORDER BY e.t) AS l FROM nodes LEFT JOIN {edges} e ON e.s = nodes.v GROUP BY nodes.v)"


PROFILE = [*parted("edge", "dag"), *(layer(k, plain=True) for k in range(3)), "profile AS (" + " UNION ALL ".join(f"""SELECT {k} AS layer, (SELECT count(*) FROM nodes) AS vertices, (SELECT count(*) FROM st{k + 1} WHERE act AND d = 0) AS active,
 (SELECT count(*) FROM st{k + 1} WHERE act AND d = 0)::double / (SELECT count(*) FROM nodes) AS active_fraction, (SELECT sum(received)::bigint FROM m{k} WHERE d = 0) AS received,
 (SELECT count(*) FROM x JOIN st{k} q ON q.v = s AND q.d = 0 AND q.act WHERE s_rank <> t_rank) AS remote_received, count(*) AS sent, count(*) FILTER (WHERE s_rank <> t_rank) AS remote_sent FROM x JOIN st{k + 1} q ON q.v = s AND q.d = 0 AND q.act""" for k in range(3)) + ")"]
PARAMETERS = f"""p AS ({" UNION ALL ".join(f"SELECT {2 * k} AS pos, 'W{k}' AS name, i AS row, j AS col, w AS val FROM w{k} UNION ALL SELECT {2 * k + 1}, 'b{k}', i, 0, b FROM b{k}" for k in range(2))} UNION ALL SELECT 4, 'Wc', c, d, w FROM wc UNION ALL SELECT 5, 'bc', c::int, 0, 0.0::double FROM range({C}) q(c))"""
GRADS = {0: "SELECT sum(g * a) AS g FROM gp0 JOIN m0 ON m0.v = gp0.v GROUP BY gp0.d, m0.d", 1: "SELECT sum(g) AS g FROM gp0 GROUP BY d", 2: "SELECT sum(g * a) AS g FROM gp1 JOIN m1 ON m1.v = gp1.v GROUP BY gp1.d, m1.d", 3: "SELECT sum(g) AS g FROM gp1 GROUP BY d", 4: "SELECT sum(g * x) AS g FROM dz JOIN st2 USING (v) GROUP BY c, d", 5: "SELECT sum(g) AS g FROM dz GROUP BY c"}

SQL = {
    "dataset_summary": sql([BASE], "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT max(len(embedding)) FROM embeddings) AS feature_dim, (SELECT max(label) + 1 FROM nodes) AS num_classes, (SELECT count(*) FROM nodes WHERE is_train) AS train, (SELECT count(*) FROM nodes WHERE is_val) AS val, (SELECT count(*) FROM nodes WHERE is_test) AS test, (SELECT count(*) FROM dense) AS edges"),
    "first_labels": sql([BASE], "SELECT v, label FROM nodes ORDER BY v LIMIT 5"),
    "split_counts": sql([BASE], "SELECT CASE WHEN is_train THEN 'train' WHEN is_val THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM nodes GROUP BY 1"),
    "label_histogram": sql([BASE], "SELECT label, count(*) AS n FROM nodes GROUP BY label"),
    "induced_subgraph": sql([BASE], "SELECT s, t, count(*) AS k FROM dense, nn WHERE s < n // 2 AND t < n // 2 GROUP BY s, t"),
    "node_fraction": sql([BASE], "SELECT v, label FROM nodes, nn WHERE v < least(greatest(1, floor(n * 0.3::double)), 120)"),
    "out_degree": sql([BASE], "SELECT v, count(s) AS deg FROM nodes LEFT JOIN dense ON s = v GROUP BY v"),
    "in_degree": sql([BASE], "SELECT v, count(t) AS deg FROM nodes LEFT JOIN dense ON t = v GROUP BY v"),
    "adjacency_csr": sql([BASE], _lists("dense")),
    "reverse_csr": sql([*parted("vertex"), "own AS (SELECT t AS s, s AS t FROM x WHERE s_rank = t_rank)"], _lists("own")),
    "owner_local_id": sql(parted("edge"), "SELECT v, rank, v - lo AS local_id, v AS global_id FROM owned"),
    "load_balance": sql(parted("vertex"), "SELECT sum(vertices)::bigint AS total_vertices, sum(edges)::bigint AS total_edges, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, avg({c}) AS avg_{c}, CASE WHEN avg({c}) = 0 THEN 1.0::double ELSE max({c}) / avg({c}) END AS {c}_imbalance" for c in ("vertices", "edges")) + " FROM stats"),
    "message_volume": sql(parted("edge"), f"SELECT messages, messages - rm AS local_messages, rm AS remote_messages, CASE WHEN messages = 0 THEN 0.0::double ELSE rm::double / messages END AS remote_fraction, rm * {(2 + D) * 4} AS bytes FROM (SELECT count(*) AS messages, count(*) FILTER (WHERE s_rank <> t_rank) AS rm FROM x)"),
    "memory_estimate": sql(parted("edge"), f"SELECT rank, vertices * {16 * D} AS bytes FROM stats"),
    "edge_owner_counts": sql(parted("edge"), "SELECT s_rank, t_rank, count(*) AS n FROM x GROUP BY s_rank, t_rank"),
    "seed_gather": sql([BASE], f"SELECT t AS v, d, count(*) AS received, {r('sum(x)')} AS x FROM dense JOIN st0 ON s = v GROUP BY t, d"),
    "superstep_identity": sql([BASE, layer(0, plain=True)], f"SELECT v, act AS active, d, {r('x')} AS x FROM st1"),
    "superstep_linear": sql([BASE, layer(0, "dense")], f"SELECT v, act AS active, d, {r('x')} AS x FROM st1"),
    "forward_2": sql([BASE, layer(0), layer(1)], f"SELECT v, act AS active, d, {r('x', 4)} AS x FROM st2"),
    "forward_3": sql([BASE, layer(0), layer(1), layer(2)], f"SELECT v, act AS active, d, {r('x', 4)} AS x FROM st3"),
    "ramp_forward": sql([BASE, RAMP, layer(0, plain=True, first="ramp"), layer(1, plain=True)], f"SELECT v, act AS active, d, {r('x')} AS x FROM st2"),
    "frontier_by_layer": sql([BASE, *(layer(k, plain=True) for k in range(3))], " UNION ALL ".join(f"SELECT {k} AS layer, v FROM st{k + 1} WHERE act AND d = 0" for k in range(3))),
    "layer_profile": sql(PROFILE, "SELECT * FROM profile"),
    "profile_totals": sql(PROFILE, f"SELECT count(*) AS layers, sum(sent)::bigint AS sent, sum(remote_sent)::bigint AS remote_sent, sum(received)::bigint AS received, sum(remote_received)::bigint AS remote_received, sum(remote_sent)::bigint * {(2 + D) * 4} AS bytes, max(vertices) * {16 * D} AS peak_state_bytes FROM profile"),
    "passthrough_vertices": sql([BASE, layer(0), layer(1)], f"SELECT v, d, {r('x')} AS x FROM st2 WHERE NOT act"),
    "stale_aggregates": sql([BASE, layer(0, plain=True), layer(1, plain=True)], f"SELECT o.v, o.d, {r('coalesce(m1.a, m0.a, 0.0::double)')} AS x FROM st0 o LEFT JOIN m0 USING (v, d) LEFT JOIN m1 USING (v, d)"),
    "contributor_trace": sql([*parted("edge", "dag"), layer(0, plain=True)], "SELECT t AS v, string_agg(s::varchar, ',' ORDER BY s) AS sources FROM x JOIN st1 q ON q.v = s AND q.d = 0 AND q.act WHERE s_rank <> t_rank GROUP BY t"),
    "rank_groups": sql(parted("edge"), "SELECT t, s_rank, string_agg(s::varchar, ',' ORDER BY s) AS sources, count(*) AS n FROM x WHERE s_rank <> t_rank GROUP BY t, s_rank"),
    "batching_ratio": sql(parted("edge"), "SELECT sum(n)::bigint AS pairs, count(*) AS groups, round(sum(n)::double / count(*), 6) AS ratio FROM (SELECT count(*) AS n FROM x WHERE s_rank <> t_rank GROUP BY t, s_rank)"),
    "logits": sql([BASE, layer(0, "dense"), layer(1, "dense"), HEAD], f"SELECT v, c, {r('z')} AS z FROM z"),
    "train_val_metrics": sql([BASE, layer(0, "dense"), layer(1, "dense"), HEAD], " UNION ALL ".join(f"SELECT '{s}' AS split, count(*) AS labelled, round(coalesce(avg(loss), 0.0::double), 6) AS loss, round(coalesce(avg(hit), 0.0::double), 6) AS accuracy FROM scored WHERE is_{s}" for s in ("train", "val", "test"))),
    "grad_aggr": sql(TRAIN, f"SELECT v, d, {r('g', 7)} AS x FROM ga1"),
    "backward_scatter": sql(TRAIN, f"SELECT v, d, {r('g', 7)} AS x FROM gh0"),
    "grad_classifier": sql(TRAIN, f"SELECT c AS i, d AS j, {r('sum(g * x)', 6)} AS g FROM dz JOIN st2 USING (v) GROUP BY c, d"),
    "grad_classifier_bias": sql(TRAIN, f"SELECT c AS i, 0 AS j, {r('sum(g)', 6)} AS g FROM dz GROUP BY c"),
    "grad_last_layer": sql(TRAIN, f"SELECT gp1.d AS i, m1.d AS j, {r('sum(g * a)', 6)} AS g FROM gp1 JOIN m1 ON m1.v = gp1.v GROUP BY gp1.d, m1.d"),
    "grad_last_bias": sql(TRAIN, f"SELECT d AS i, 0 AS j, {r('sum(g)', 6)} AS g FROM gp1 GROUP BY d"),
    "grad_layer0": sql(TRAIN, f"SELECT gp0.d AS i, m0.d AS j, {r('sum(g * a)', 6)} AS g FROM gp0 JOIN m0 ON m0.v = gp0.v GROUP BY gp0.d, m0.d"),
    "grad_layer0_bias": sql(TRAIN, f"SELECT d AS i, 0 AS j, {r('sum(g)', 6)} AS g FROM gp0 GROUP BY d"),
    "sgd_step": sql(TRAIN, f"SELECT i, j, {r('w - 0.01::double * g', 8)} AS w FROM w0 JOIN (SELECT gp0.d AS i, m0.d AS j, sum(g * a) AS g FROM gp0 JOIN m0 ON m0.v = gp0.v GROUP BY gp0.d, m0.d) USING (i, j)"),
    "legacy_loss": sql([BASE, layer(0, "dense"), layer(1, "dense")], "SELECT round((SELECT avg(CASE WHEN p > 0 THEN p * p ELSE 0.0::double END) FROM p0) + (SELECT avg(CASE WHEN p > 0 THEN p * p ELSE 0.0::double END) FROM p1), 6) AS loss"),
    "legacy_weight": sql([BASE, layer(0, "dense"), "cnt AS (SELECT count(*) AS cnt FROM p0)"], f"SELECT i, j, {r('w - 0.01::double * g', 6)} AS w FROM w0 JOIN (SELECT p0.d AS i, m0.d AS j, sum(CASE WHEN p > 0 THEN 2.0::double * p / cnt ELSE 0.0::double END * a) AS g FROM p0 JOIN m0 ON m0.v = p0.v, cnt GROUP BY p0.d, m0.d) USING (i, j)"),
    "nan_check": sql([BASE, "q AS (SELECT v, d, CASE WHEN v % 97 = 0 AND d = 3 THEN 'NaN'::double WHEN v % 89 = 1 AND d = 5 THEN '-inf'::double ELSE x END AS x FROM st0)"], "SELECT count(*) AS vertices, count(*) FILTER (WHERE NOT fine) AS not_finite FROM (SELECT v, bool_and(isfinite(x)) AS fine FROM q GROUP BY v)"),
    "buffer_check": sql([BASE, "q AS (SELECT v, count(*) AS width FROM st0 WHERE v % 61 <> 0 AND NOT (v % 53 = 0 AND d = 63) GROUP BY v)"], f"SELECT n - count(*) AS missing, count(*) - count(DISTINCT v) AS repeated, count(*) FILTER (WHERE width <> {D}) AS wrong_width FROM q, nn GROUP BY n"),
    "gradient_norms": sql(TRAIN, " UNION ALL ".join(f"SELECT {k} AS pos, round(sqrt(sum(g * g)), 6) AS norm FROM ({q})" for k, q in GRADS.items())),
    "edge_list_scan": sql([BASE], "SELECT s, t, count(*) AS k, any_value(n) AS n FROM dense, nn GROUP BY s, t"),
    "dataset_nodes": sql([BASE, "q AS (SELECT v, count(*)::int AS width, round(max(CASE WHEN d = 3 THEN x END), 6) AS third, round(sum(x), 4) AS total FROM st0 GROUP BY v)"], "SELECT v, label, is_train, is_val, is_test, width, third, total FROM nodes JOIN q USING (v)"),
    "dataset_edges": sql([BASE], "SELECT s, t, count(*) AS k FROM dense WHERE s < 150 AND t < 150 GROUP BY s, t"),
    "checkpoint_scan": sql([BASE, layer(0), layer(1), HEAD, PARAMETERS], "SELECT pos, name, row, col, round(val, 8) AS val FROM p"),
    "edge_validity": sql([BASE], "SELECT count(*) AS edges, count(*) FILTER (WHERE s < 0 OR t < 0 OR s >= n OR t >= n) AS out_of_range, count(*) FILTER (WHERE s = t) AS self_loops, count(*) - count(DISTINCT (s, t)) AS repeats FROM dense, nn"),
    "frontier_check": sql([BASE, layer(0, plain=True)], "SELECT count(*) AS vertices, count(*) FILTER (WHERE (st1.act <> (st1.v % 50 = 7)) <> (coalesce(m0.received, 0) > 0)) AS faults FROM st1 LEFT JOIN m0 ON m0.v = st1.v AND m0.d = 0 WHERE st1.d = 0"),
}
for _k in ("vertex", "edge", "hybrid"):
    SQL[f"ranges_{_k}"] = sql(parted(_k), "SELECT rank, lo, hi FROM ranges")
    SQL[f"partition_stats_{_k}"] = sql(parted(_k), "SELECT rank, lo, hi, vertices, edges, cost FROM stats")
