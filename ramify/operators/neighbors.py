"""Aggregation over neighbourhoods.

Direction "in": neighbours are the sources of edges into a vertex; "out": the targets of its edges; "all": both.
Aggregates are Columns over neighbour_id, neighbour_value and (where edges have one) edge_value, so
they are combined on the map side. A neighbour that the vertices lack contributes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.operators.graph import PropertyGraph


def neighbourhood(graph: PropertyGraph, direction: str) -> DataFrame:
    """(id, neighbour_id[, neighbour_value][, edge_value]), one row per vertex and edge."""
    if direction not in ("in", "out", "all"):
        raise ValueError(f"direction must be in, out or all, not {direction!r}")
    # a value moves along the edge to the vertex that gathers it
    moved = graph.along({"in": "out", "out": "in", "all": "all"}[direction]).edges
    if "value" in moved.columns:
        moved = moved.withColumnRenamed("value", "edge_value")
    moved = moved.withColumnRenamed("src", "neighbour_id").withColumnRenamed("dst", "id")
    own = graph.vertices.withColumnRenamed("id", "neighbour_id")
    if "value" in own.columns:
        own = own.withColumnRenamed("value", "neighbour_value")
    return moved.join(own, "neighbour_id")


def group_reduce(graph: PropertyGraph, direction: str, *aggregates: Column) -> DataFrame:
    """Aggregates by vertex; vertices without a neighbour are absent."""
    return neighbourhood(graph, direction).groupBy("id").agg(*aggregates)


def group_reduce_with_value(graph: PropertyGraph, direction: str, *aggregates: Column) -> DataFrame:
    """As group_reduce with the vertex's own value; vertices without a neighbour are there, with null aggregates."""
    return graph.vertices.join(group_reduce(graph, direction, *aggregates), "id", "left")


def reduce_values(graph: PropertyGraph, direction: str, fold: Callable[[Column], Column]) -> DataFrame:
    """(id, value): an associative fold of the neighbours' values."""
    return group_reduce(graph, direction, fold(F.col("neighbour_value")).alias("value"))


def neighbour_sets(graph: PropertyGraph, direction: str = "all") -> DataFrame:
    """(id, neighbour_id), distinct: the sets in long form, so that a hub's set isn't one row."""
    return neighbourhood(graph, direction).select("id", "neighbour_id").distinct()


def neighbour_multisets(graph: PropertyGraph, direction: str = "all") -> DataFrame:
    """(id, neighbour_id, count): the multisets in long form."""
    return neighbourhood(graph, direction).groupBy("id", "neighbour_id").agg(F.count("*").alias("count"))


def apply_in_pandas(graph: PropertyGraph, direction: str, f: Callable, schema: str) -> DataFrame:
    """The escape hatch for what Columns can't express: f(pandas rows of one vertex's neighbourhood) -> pandas rows."""
    return neighbourhood(graph, direction).groupBy("id").applyInPandas(f, schema)
