"""The graph queries in SQL, from their definitions. A split query has the plain query's SQL: a split changes no result."""

from __future__ import annotations

from ramify.plans.queries import COMMUNITY_STEPS, COMPONENT_STEPS, HOPS, HUB

_PAIRS = "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"
_CUST_SUPP = "SELECT DISTINCT o_custkey AS src, 1000000 + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
_ORDER_CUST = "SELECT DISTINCT 10000000 + o_orderkey AS src, o_custkey AS dst FROM orders"
_USER_TYPE = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS src, event_type AS dst FROM events"
_COPART = _PAIRS
#: More hops than any least label of the tables has to go.
_ENOUGH = 16


def _with(edges: str, rest: str, more: str = "") -> str:
    """e: the edges; s: both orientations; v: the vertices; d: the degrees."""
    return f"""WITH e AS MATERIALIZED ({edges}), s AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e),
v AS (SELECT DISTINCT src AS id FROM s), d AS (SELECT src AS id, count(*) AS degree FROM s GROUP BY src){more} {rest}"""


_S = "CAST({0} AS VARCHAR) AS {1}"
_ID = "CAST(id AS VARCHAR) AS id"
_SRC_DST = "CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst"
_TRIANGLES = "SELECT count(*) AS triangles FROM e x JOIN e y ON x.dst = y.src JOIN e z ON z.src = x.src AND z.dst = y.dst"
_DEGREE = f"SELECT {_ID}, degree FROM d"


def _reach(edges: str, along: str, hops: int | None) -> str:
    """Least labels, hop by hop."""
    more = ", l0 AS (SELECT id, id AS label FROM v)"
    for k in range(1, (hops or _ENOUGH) + 1):
        more += f""", l{k} AS MATERIALIZED (SELECT o.id, least(o.label, coalesce(n.label, o.label)) AS label FROM l{k - 1} o
LEFT JOIN (SELECT {along}.dst AS id, min(p.label) AS label FROM {along} JOIN l{k - 1} p ON p.id = {along}.src GROUP BY {along}.dst) n ON n.id = o.id)"""
    return _with(edges, f"SELECT {_ID}, label AS component FROM l{hops or _ENOUGH}", more)


def _jaccard(edges: str, of: str, names: tuple[str, str]) -> str:
    more = """, n AS (SELECT DISTINCT src, dst FROM s), c AS (SELECT src, count(*) AS size FROM n GROUP BY src),
t AS (SELECT a.src AS x, b.src AS y, count(*) AS both FROM n a JOIN n b ON a.dst = b.dst JOIN n p ON p.src = a.src AND p.dst = b.src GROUP BY a.src, b.src)"""
    return _with(edges, f"""SELECT CAST(p.src AS VARCHAR) AS {names[0]}, CAST(p.dst AS VARCHAR) AS {names[1]},
CAST(coalesce(t.both, 0) AS DOUBLE) / (a.size + b.size - coalesce(t.both, 0)) AS jaccard
FROM {of} p JOIN c a ON a.src = p.src JOIN c b ON b.src = p.dst LEFT JOIN t ON t.x = p.src AND t.y = p.dst""", more)


def _community(steps: int, delta: float = 0.5, weight: float = 3.0) -> str:
    more = ", s0 AS (SELECT id, id AS label, CAST(1.0 AS DOUBLE) AS score FROM v)"
    for k in range(1, steps + 1):
        more += f""",
m{k} AS MATERIALIZED (SELECT s.dst AS id, p.label, sum(p.score * {weight}) AS total, max(p.score * {weight}) AS high FROM s JOIN s{k - 1} p ON p.id = s.src GROUP BY s.dst, p.label),
b{k} AS (SELECT id, label, high FROM m{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY total DESC, label) = 1),
s{k} AS MATERIALIZED (SELECT b.id, b.label, b.high - CASE WHEN b.label <> o.label THEN CAST({delta} AS DOUBLE) / {k} ELSE 0 END AS score FROM b{k} b JOIN s{k - 1} o ON o.id = b.id)"""
    return _with(_COPART, f"SELECT {_ID}, label FROM s{steps}", more)


def _hash(x: str) -> str:
    u = f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296)"
    return f"(CASE WHEN {u} >= 2147483648 THEN {u} - 4294967296 ELSE {u} END)"


def _alpha_edges() -> str:
    return f""", w AS (SELECT CAST(e.src AS VARCHAR) AS src, CAST(e.dst AS VARCHAR) AS dst, a.degree AS ds, b.degree AS dd FROM e JOIN d a ON a.id = e.src JOIN d b ON b.id = e.dst),
g AS (SELECT 2.0 * (sum(degree) // count(*)) AS top FROM d), h AS (SELECT *, {_hash('src')} % 2 AS hs, {_hash('dst')} % 2 AS hd FROM w, g),
x AS (SELECT CASE WHEN ds > top AND hd <> 0 THEN src || '_' || CAST(hd AS VARCHAR) ELSE src END AS src,
CASE WHEN ds <= top AND dd > top AND hs <> 0 THEN dst || '_' || CAST(hs AS VARCHAR) ELSE dst END AS dst FROM h)"""


def oracle_sql() -> dict[str, str]:
    values = "SELECT s.dst AS id, {0} AS value FROM s GROUP BY s.dst"
    out = {
        "edge_scan": _with(_ORDER_CUST, f"SELECT {_SRC_DST} FROM e"),
        "edge_scan_user_type": _with(_USER_TYPE, "SELECT src, dst FROM e"),
        "edge_scan_weighted": _with(_COPART, f"SELECT {_SRC_DST}, CAST(3.0 AS DOUBLE) AS value FROM e"),
        "vertices_from_edges": _with(_ORDER_CUST, f"SELECT {_ID} FROM v"),
        "edge_endpoints": _with(_ORDER_CUST, "SELECT CAST(src AS VARCHAR) AS id FROM s"),
        "edge_incidence": _with(_COPART, "SELECT CAST(src AS VARCHAR) AS node, CAST(dst AS VARCHAR) AS neighbour, src AS edge_src FROM e UNION ALL SELECT CAST(dst AS VARCHAR), CAST(src AS VARCHAR), src FROM e"),
        "undirected": _with(_COPART, f"SELECT {_SRC_DST} FROM s"),
        "orient_distinct": _with(_COPART, "SELECT CAST(dst AS VARCHAR) AS src, CAST(src AS VARCHAR) AS dst FROM e"),
        "number_of_vertices": _with(_COPART, "SELECT count(*) AS vertices FROM v"),
        "out_degrees": _with(_CUST_SUPP, f"SELECT {_ID}, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY id"),
        "in_degrees": _with(_CUST_SUPP, f"SELECT {_ID}, count(e.dst) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY id"),
        "degrees": _with(_CUST_SUPP, _DEGREE),
        "degrees_user_type": _with(_USER_TYPE, _DEGREE),
        "degrees_symmetrised": _with(_CUST_SUPP, f"SELECT {_ID}, 2 * degree AS degree FROM d"),
        "avg_degree_int": _with(_CUST_SUPP, "SELECT CAST(sum(degree) // count(*) AS DOUBLE) AS average FROM d"),
        "weigh_edges": _with(_CUST_SUPP, f"SELECT {_SRC_DST}, a.degree AS src_degree, b.degree AS dst_degree FROM e JOIN d a ON a.id = src JOIN d b ON b.id = dst"),
        "skewed_vertices": _with(_CUST_SUPP, f"SELECT {_ID} FROM d WHERE degree > {HUB}"),
        "count_skewed": _with(_CUST_SUPP, "SELECT count(*) AS skewed FROM d WHERE 2 * degree > 1000"),
        "triplets": _with(_COPART, f"SELECT {_SRC_DST}, src AS src_value, dst AS dst_value FROM e"),
        "map_vertices": _with(_ORDER_CUST, f"SELECT {_ID}, id * 2 + 1 AS value FROM v"),
        "join_with_vertices": _with(_COPART, f"SELECT {_ID}, CASE WHEN degree > 1 THEN degree - id ELSE id END AS value FROM d"),
        "neighbors_min_in": _with(_COPART, "SELECT CAST(dst AS VARCHAR) AS id, min(src) AS value FROM e GROUP BY dst"),
        "neighbors_min_out": _with(_COPART, "SELECT CAST(src AS VARCHAR) AS id, min(dst) AS value FROM e GROUP BY src"),
        "neighbors_min_all": _with(_COPART, "SELECT CAST(dst AS VARCHAR) AS id, min(src) AS value FROM s GROUP BY dst"),
        "neighbors_sum": _with(_COPART, "SELECT CAST(dst AS VARCHAR) AS id, CAST(sum(src) AS BIGINT) AS value FROM s GROUP BY dst"),
        "neighbors_group_with_value": _with(_COPART, "SELECT CAST(id AS VARCHAR) AS id, id AS value, n, high FROM v LEFT JOIN (SELECT dst, count(*) AS n, max(src) AS high FROM e GROUP BY dst) q ON q.dst = v.id"),
        "neighbors_set_size": _with(_COPART, "SELECT CAST(dst AS VARCHAR) AS id, count(DISTINCT src) AS size FROM s GROUP BY dst"),
        "neighbors_multiset": _with(_COPART, "SELECT CAST(src AS VARCHAR) AS id, CAST(dst AS VARCHAR) AS neighbour_id, 2 * count(*) AS count FROM s GROUP BY src, dst"),
        "count_degree_messages": _with(_ORDER_CUST, _DEGREE),
        "alpha_split_edges": _with(_CUST_SUPP, "SELECT src, dst FROM x", _alpha_edges()),
        "alpha_split_degree": _with(_CUST_SUPP, _DEGREE),
        "tree_split_degree": _with(_CUST_SUPP, _DEGREE),
        "tree_split_fixed_degree": _with(_CUST_SUPP, _DEGREE),
        "tree_merge_degree": _with(_CUST_SUPP, _DEGREE),
        "tree_split_edges_cleanup": _with(_CUST_SUPP, f"SELECT {_SRC_DST} FROM e"),
        "propagate_to_split": _with(_CUST_SUPP, f"SELECT {_ID}, degree, degree AS lowest FROM d"),
        "cc": _reach(_COPART, "s", None),
        "cc_khop": _reach(_COPART, "s", HOPS),
        "cc_gsa_directed": _reach(_COPART, "e", None),
        "cc_gsa_undirected": _reach(_COPART, "s", COMPONENT_STEPS),
        "cc_stars": _with(_ORDER_CUST, "SELECT CAST(src AS VARCHAR) AS id, dst AS component FROM e UNION ALL SELECT DISTINCT CAST(dst AS VARCHAR), dst FROM e"),
        "cc_split": _reach(_COPART, "s", None),
        "cc_split_gsa": _reach(_COPART, "s", COMPONENT_STEPS),
        "triangles": _with(_COPART, _TRIANGLES),
        "triangles_multigraph": _with(_COPART, f"SELECT 4 * triangles * 1 AS triangles FROM ({_TRIANGLES})"),
        "triangles_gsa": _with(_COPART, _TRIANGLES),
        "triangles_split": _with(_COPART, _TRIANGLES),
        "triangles_split_gsa": _with(_COPART, _TRIANGLES),
        "jaccard_vertex": _jaccard(_COPART, "n", ("id", "neighbour")),
        "jaccard_edge": _jaccard(_COPART, "e", ("src", "dst")),
        "jaccard_split": _jaccard(_COPART, "n", ("id", "neighbour")),
        "jaccard_split_gsa": _jaccard(_COPART, "e", ("src", "dst")),
        "community": _community(COMMUNITY_STEPS),
        "community_split": _community(COMMUNITY_STEPS),
        "jaccard_user_type": _jaccard(_USER_TYPE, "e", ("src", "dst")),
        "jaccard_map": f"""SELECT id, string_agg(neighbour || '=' || CAST(CAST(round(jaccard * 1000000) AS BIGINT) AS VARCHAR), ', ' ORDER BY neighbour) AS jaccard
FROM ({_jaccard(_COPART, "n", ("id", "neighbour"))}) GROUP BY id""",
        "cc_user_orders": _reach(_CUST_SUPP, "s", None),
        "text_scan": _with(_ORDER_CUST, f"SELECT {_SRC_DST} FROM e"),
        "text_scan_plain": _with(_USER_TYPE, "SELECT '#' || src AS src, dst FROM e"),
        "text_scan_long": _with(_ORDER_CUST, f"SELECT {_SRC_DST} FROM e"),
        "text_scan_weighted": _with(_COPART, f"SELECT {_SRC_DST}, CAST(3.0 AS DOUBLE) AS value FROM e"),
        "vertex_scan": _with(_CUST_SUPP, f"SELECT {_ID}, degree AS value FROM d"),
        "rows_sink_spaced": _with(_ORDER_CUST, "SELECT CAST(src AS VARCHAR) || ' ' || CAST(dst AS VARCHAR) AS line FROM e"),
        "inline_scan": "SELECT CAST(n_nationkey AS VARCHAR) AS src, CAST(n_regionkey AS VARCHAR) AS dst FROM nation",
    }
    return out
