"""One query per operator over the graphs of ramify.sources.tables. Ids come out as strings, values as long or double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify.operators import algorithms as A
from ramify.operators import degrees as D
from ramify.operators import neighbors as N
from ramify.operators import split as S
from ramify.operators.graph import PropertyGraph, endpoints, incident, oriented
from ramify.sources import tables as T

HUB = 100  # degree above which the split queries split
COMMUNITY_STEPS = 30  # the reference's bounds
COMPONENT_STEPS = 4
HOPS = 2  # where the bound is the feature


def _graph(edges: DataFrame, valued: bool = False) -> PropertyGraph:
    return PropertyGraph.from_edges(edges, (lambda i: i.cast("long")) if valued else None)


def _ids(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


def edge_scan(spark: SparkSession, d: str) -> DataFrame:
    return _ids(T.order_customer(spark, d), "src", "dst")


def edge_scan_user_type(spark: SparkSession, d: str) -> DataFrame:
    return T.user_type(spark, d)


def edge_scan_weighted(spark: SparkSession, d: str) -> DataFrame:
    from ramify.sources import FIXED_WEIGHT

    return _ids(T.copart(spark, d), "src", "dst").withColumn("value", F.lit(FIXED_WEIGHT))


def vertices_from_edges(spark: SparkSession, d: str) -> DataFrame:
    return _ids(_graph(T.order_customer(spark, d)).vertices, "id")


def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return _ids(endpoints(T.order_customer(spark, d)), "id")


def edge_incidence(spark: SparkSession, d: str) -> DataFrame:
    return incident(T.copart(spark, d)).select(F.col("node").cast("string").alias("node"), F.col("neighbour").cast("string").alias("neighbour"), F.col("edge.src").alias("edge_src"))


def undirected(spark: SparkSession, d: str) -> DataFrame:
    return _ids(_graph(T.copart(spark, d)).undirected().edges, "src", "dst")


def orient_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _ids(oriented(_graph(T.copart(spark, d)).undirected().edges), "src", "dst")


def number_of_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _graph(T.copart(spark, d)).vertices.agg(F.count("*").alias("vertices"))


def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _ids(D.out_degrees(_graph(T.customer_supplier(spark, d))), "id")


def in_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _ids(D.in_degrees(_graph(T.customer_supplier(spark, d))), "id")


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return _ids(D.degrees(_graph(T.customer_supplier(spark, d))), "id")


def degrees_user_type(spark: SparkSession, d: str) -> DataFrame:
    return D.degrees(_graph(T.user_type(spark, d)))


def degrees_symmetrised(spark: SparkSession, d: str) -> DataFrame:
    return _ids(D.degrees(_graph(T.customer_supplier(spark, d)), "symmetrised"), "id")


def avg_degree_int(spark: SparkSession, d: str) -> DataFrame:
    return D.average_degree(D.degrees(_graph(T.customer_supplier(spark, d))))


def weigh_edges(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(T.customer_supplier(spark, d))
    return _ids(D.weigh_edges(g, D.degrees(g)), "src", "dst")


def skewed_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _ids(D.skewed(D.degrees(_graph(T.customer_supplier(spark, d))), HUB), "id")


def count_skewed(spark: SparkSession, d: str) -> DataFrame:
    return D.count_skewed(_graph(T.customer_supplier(spark, d)))


def triplets(spark: SparkSession, d: str) -> DataFrame:
    return _ids(_graph(T.copart(spark, d), True).triplets(), "src", "dst")


def map_vertices(spark: SparkSession, d: str) -> DataFrame:
    return _ids(_graph(T.order_customer(spark, d), True).map_vertices(lambda i, v: v * 2 + 1).vertices, "id")


def join_with_vertices(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(T.copart(spark, d), True)
    new = D.degrees(g).where("degree > 1").select("id", F.col("degree").alias("value"))
    return _ids(g.join_with_vertices(new, lambda old, v: v - old).vertices, "id")


def _neighbours_min(spark: SparkSession, d: str, direction: str) -> DataFrame:
    return _ids(N.reduce_values(_graph(T.copart(spark, d), True), direction, F.min), "id")


def neighbors_min_in(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours_min(spark, d, "in")


def neighbors_min_out(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours_min(spark, d, "out")


def neighbors_min_all(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours_min(spark, d, "all")


def neighbors_sum(spark: SparkSession, d: str) -> DataFrame:
    return _ids(N.reduce_values(_graph(T.copart(spark, d), True), "all", F.sum), "id")


def neighbors_group_with_value(spark: SparkSession, d: str) -> DataFrame:
    """With the vertex's own value, and rows for vertices without an edge into them."""
    g = _graph(T.copart(spark, d), True)
    return _ids(N.group_reduce_with_value(g, "in", F.count("*").alias("n"), F.max("neighbour_value").alias("high")), "id")


def neighbors_set_size(spark: SparkSession, d: str) -> DataFrame:
    return _ids(N.neighbour_sets(_graph(T.copart(spark, d))).groupBy("id").agg(F.count("*").alias("size")), "id")


def neighbors_multiset(spark: SparkSession, d: str) -> DataFrame:
    return _ids(N.neighbour_multisets(_graph(T.copart(spark, d)).undirected()), "id", "neighbour_id")


def count_degree_messages(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.count_degrees(_graph(T.order_customer(spark, d))), "id")


def _alpha_split(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(T.customer_supplier(spark, d))
    of = D.degrees(g)
    return S.alpha_split(g, of, D.average_degree(of), 2)


def alpha_split_edges(spark: SparkSession, d: str) -> DataFrame:
    return _alpha_split(spark, d)


def alpha_split_degree(spark: SparkSession, d: str) -> DataFrame:
    partial = endpoints(_alpha_split(spark, d)).groupBy("id").agg(F.count("*").alias("degree"))
    return S.merge(partial, F.sum("degree").alias("degree"))


def tree_split_degree(spark: SparkSession, d: str) -> DataFrame:
    return A.split_degrees(_graph(T.customer_supplier(spark, d)), 2, 4, HUB)


def tree_split_fixed_degree(spark: SparkSession, d: str) -> DataFrame:
    return A.split_degrees(_graph(T.customer_supplier(spark, d)), 2, 4, HUB, adaptive=False)


def _split(spark: SparkSession, d: str) -> S.SplitGraph:
    g = _graph(T.customer_supplier(spark, d))
    return A.split_at(g, D.degrees(g), 2, 4, HUB)


def tree_merge_degree(spark: SparkSession, d: str) -> DataFrame:
    """Level by level: each round drops one suffix."""
    partial = endpoints(_split(spark, d).edges).groupBy("id").agg(F.count("*").alias("degree"))
    return S.tree_merge(partial, 4, F.sum("degree"), "degree").groupBy("id").agg(F.sum("degree").alias("degree"))


def tree_split_edges_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return S.cleanup_edges(_split(spark, d).edges)


def propagate_to_split(spark: SparkSession, d: str) -> DataFrame:
    """Degrees propagated to sub-vertices, one row per root: how many values it has got there, and which."""
    split = _split(spark, d)
    g = _graph(T.customer_supplier(spark, d))
    values = split.propagate(_ids(D.degrees(g), "id"))
    return values.groupBy(F.col("root").alias("id")).agg(F.max("degree").alias("degree"), F.min("degree").alias("lowest"))


def cc(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.connected_components(_graph(T.copart(spark, d))), "id")


def cc_khop(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.connected_components(_graph(T.copart(spark, d)), HOPS), "id")


def cc_gsa_directed(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.min_ancestor_label(_graph(T.copart(spark, d))), "id")


def cc_gsa_undirected(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.min_ancestor_label(_graph(T.copart(spark, d)), COMPONENT_STEPS, undirected=True), "id")


def cc_stars(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.connected_components(_graph(T.order_customer(spark, d))), "id")


def cc_split(spark: SparkSession, d: str) -> DataFrame:
    return A.split_connected_components(_graph(T.copart(spark, d)), threshold=HUB)


def cc_split_gsa(spark: SparkSession, d: str) -> DataFrame:
    return A.split_connected_components(_graph(T.copart(spark, d)), COMPONENT_STEPS, threshold=HUB)


def triangles(spark: SparkSession, d: str) -> DataFrame:
    return A.triangle_count(_graph(T.copart(spark, d)))


def triangles_multigraph(spark: SparkSession, d: str) -> DataFrame:
    return A.triangle_count(_graph(T.copart(spark, d)).undirected(), multigraph=True)


def triangles_gsa(spark: SparkSession, d: str) -> DataFrame:
    return A.triangle_count_gathered(_graph(T.copart(spark, d)))


def triangles_split(spark: SparkSession, d: str) -> DataFrame:
    return A.split_triangle_count(_graph(T.copart_repeated(spark, d)), 2, 4, 2 * HUB)


def triangles_split_gsa(spark: SparkSession, d: str) -> DataFrame:
    return A.split_triangle_count(_graph(T.copart_repeated(spark, d)), 2, 4, HUB, "directed")


def jaccard_vertex(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.jaccard_vertices(_graph(T.copart(spark, d))), "id", "neighbour")


def jaccard_user_type(spark: SparkSession, d: str) -> DataFrame:
    """Ids that aren't numbers."""
    return A.jaccard_edges(_graph(T.user_type(spark, d)))


def jaccard_map(spark: SparkSession, d: str) -> DataFrame:
    """A map per vertex as files have it: its values by its keys' order, in text."""
    maps = A.as_maps(A.jaccard_vertices(_graph(T.copart(spark, d))))
    entries = F.array_sort(F.map_entries("jaccard"))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1_000_000).cast("long").cast("string")))
    return _ids(maps, "id").select("id", F.array_join(shown, ", ").alias("jaccard"))


def cc_user_orders(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.connected_components(_graph(T.customer_supplier(spark, d))), "id")


def _as_text(spark: SparkSession, edges: DataFrame, comment: str = "") -> str:
    """The edges as tab-separated lines in a shared folder, a comment at the top of each file."""
    from ramify.plans.checkpoint import scratch_path

    path = scratch_path(spark)
    lines = edges.select(F.concat_ws("\t", "src", "dst").alias("value"))
    if comment:
        lines = spark.range(1).select(F.lit(f"# {comment}").alias("value")).unionByName(lines)
    lines.write.text(path)
    return path


def text_scan(spark: SparkSession, d: str) -> DataFrame:
    from ramify.sources import read_edges

    return read_edges(spark, _as_text(spark, T.order_customer(spark, d), "orders and customers"))


def text_scan_plain(spark: SparkSession, d: str) -> DataFrame:
    """Without comments: a line that begins with # is an edge."""
    from ramify.sources import read_edges

    edges = T.user_type(spark, d).withColumn("src", F.concat(F.lit("#"), "src"))
    return read_edges(spark, _as_text(spark, edges), comment=None)


def text_scan_long(spark: SparkSession, d: str) -> DataFrame:
    """Ids with leading zeros come back as numbers are written."""
    from ramify.sources import read_edges

    edges = T.order_customer(spark, d).select(F.concat(F.lit("00"), "src").alias("src"), F.concat(F.lit("0"), "dst").alias("dst"))
    return read_edges(spark, _as_text(spark, edges), ids="long")


def text_scan_weighted(spark: SparkSession, d: str) -> DataFrame:
    from ramify.sources import FIXED_WEIGHT, read_edges

    return read_edges(spark, _as_text(spark, T.copart(spark, d), "parts"), weight=FIXED_WEIGHT)


def vertex_scan(spark: SparkSession, d: str) -> DataFrame:
    """Degrees written by the sink, a line per vertex, and read as a vertex file."""
    from ramify.plans.checkpoint import scratch_path
    from ramify.sources import read_vertices, write_rows

    path = scratch_path(spark)
    write_rows(D.degrees(_graph(T.customer_supplier(spark, d))), path)
    return read_vertices(spark, path)


def rows_sink_spaced(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a sink with blanks between fields."""
    from ramify.plans.checkpoint import scratch_path
    from ramify.sources import write_rows

    path = scratch_path(spark)
    write_rows(T.order_customer(spark, d), path, " ")
    return spark.read.text(path).select(F.col("value").alias("line"))


def inline_scan(spark: SparkSession, d: str) -> DataFrame:
    """The regions' and nations' keys as edges from a list: 25 rows at every size."""
    from ramify.sources import inline_edges

    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_regionkey").collect()
    return inline_edges(spark, [(r[0], r[1]) for r in rows])


def jaccard_edge(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.jaccard_edges(_graph(T.copart(spark, d))), "src", "dst")


def jaccard_split(spark: SparkSession, d: str) -> DataFrame:
    return A.split_jaccard_vertices(_graph(T.copart_repeated(spark, d)), threshold=HUB)


def jaccard_split_gsa(spark: SparkSession, d: str) -> DataFrame:
    return A.split_jaccard_edges(_graph(T.copart(spark, d)), threshold=HUB)


def _weighted(spark: SparkSession, d: str) -> PropertyGraph:
    """Edges come once for every order; communities are to take them once."""
    return _graph(T.copart_repeated(spark, d).withColumn("value", F.lit(3.0)))


def community(spark: SparkSession, d: str) -> DataFrame:
    return _ids(A.communities(_weighted(spark, d), COMMUNITY_STEPS, once=True).select("id", "label"), "id")


def community_split(spark: SparkSession, d: str) -> DataFrame:
    return A.split_communities(_weighted(spark, d), COMMUNITY_STEPS, threshold=HUB, once=True).select("id", "label")


_QUERIES = (
    edge_scan, edge_scan_user_type, edge_scan_weighted, vertices_from_edges, edge_endpoints, edge_incidence, undirected, orient_distinct, number_of_vertices,
    out_degrees, in_degrees, degrees, degrees_user_type, degrees_symmetrised, avg_degree_int, weigh_edges, skewed_vertices, count_skewed,
    triplets, map_vertices, join_with_vertices, neighbors_min_in, neighbors_min_out, neighbors_min_all, neighbors_sum, neighbors_group_with_value,
    neighbors_set_size, neighbors_multiset, count_degree_messages, alpha_split_edges, alpha_split_degree, tree_split_degree, tree_split_fixed_degree, tree_merge_degree,
    tree_split_edges_cleanup, propagate_to_split, cc, cc_khop, cc_gsa_directed, cc_gsa_undirected, cc_stars, cc_split, cc_split_gsa,
    triangles, triangles_multigraph, triangles_gsa, triangles_split, triangles_split_gsa, jaccard_vertex, jaccard_edge, jaccard_split, jaccard_split_gsa,
    community, community_split, jaccard_user_type, jaccard_map, cc_user_orders, text_scan, text_scan_plain, text_scan_long, text_scan_weighted, vertex_scan,
    rows_sink_spaced, inline_scan,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
