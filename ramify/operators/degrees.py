"""Degrees, average degree, and what depends on a degree threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.operators.graph import PropertyGraph, both_orientations, endpoints

SKEW_THRESHOLD = 1000


def _with_zeros(graph: PropertyGraph, counts: DataFrame) -> DataFrame:
    return graph.vertices.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def out_degrees(graph: PropertyGraph) -> DataFrame:
    return _with_zeros(graph, graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")))


def in_degrees(graph: PropertyGraph) -> DataFrame:
    return _with_zeros(graph, graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree")))


def degrees(graph: PropertyGraph, mode: str = "directed") -> DataFrame:
    """Edges at each vertex; multiple edges count, a loop counts twice. mode="symmetrised": of the symmetrised graph, i.e. doubled."""
    if mode not in ("directed", "symmetrised"):
        raise ValueError(f"mode must be directed or symmetrised, not {mode!r}")
    edges = graph.edges if mode == "directed" else both_orientations(graph.edges)
    return _with_zeros(graph, endpoints(edges).groupBy("id").agg(F.count("*").alias("degree")))


def average_degree(of: DataFrame) -> DataFrame:
    """One row: the integer quotient of the degrees' sum and the number of vertices, as a double."""
    return of.select(F.expr("cast(sum(degree) div count(*) as double)").alias("average"))


def skewed(of: DataFrame, threshold: float) -> DataFrame:
    """(id) of the degrees above the threshold."""
    return of.where(F.col("degree") > threshold).select("id")


def count_skewed(graph: PropertyGraph, threshold: float = SKEW_THRESHOLD) -> DataFrame:
    """One row: the number of vertices whose symmetrised degree is above the threshold."""
    return degrees(graph, "symmetrised").select(F.count_if(F.col("degree") > threshold).alias("skewed"))


def weigh_edges(graph: PropertyGraph, of: DataFrame) -> DataFrame:
    """Edges with the degrees of both ends: src, dst, src_degree, dst_degree."""
    of_src = of.select(F.col("id").alias("src"), F.col("degree").alias("src_degree"))
    of_dst = of.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
    return graph.edges.join(of_src, "src").join(of_dst, "dst").select("src", "dst", "src_degree", "dst_degree")
