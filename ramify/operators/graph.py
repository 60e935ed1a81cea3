"""Property graphs: a DataFrame of vertices (id, value) and one of edges (src, dst[, value])."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_orientations(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, without removing duplicates; a loop becomes two."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    pair = F.array(F.struct("src", "dst", *rest), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
    return edges.select(F.inline(pair)).select(*edges.columns)


def endpoints(edges: DataFrame) -> DataFrame:
    """(id): each edge's source and target."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id"))


def incident(edges: DataFrame) -> DataFrame:
    """(node, neighbour, edge) for both ends of each edge."""
    edge = F.struct(*edges.columns)
    pair = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour"), edge.alias("edge")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour"), edge.alias("edge")))
    return edges.select(F.inline(pair))


def oriented(edges: DataFrame) -> DataFrame:
    """Edges from the numerically higher to the lower id, distinct. Loops stay."""
    a, b = F.col("src").cast("long"), F.col("dst").cast("long")
    return edges.select(F.when(a >= b, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(a >= b, F.col("dst")).otherwise(F.col("src")).alias("dst")).distinct()


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    spanned: bool = False  # whether the vertices are just the edges' ends

    @classmethod
    def from_edges(cls, edges: DataFrame, value: Callable[[Column], Column] | None = None) -> PropertyGraph:
        """Vertices are the distinct endpoints; value(id) is their value."""
        ids = endpoints(edges).distinct()
        return cls(ids if value is None else ids.withColumn("value", value(F.col("id"))), edges, True)

    def undirected(self) -> PropertyGraph:
        return PropertyGraph(self.vertices, both_orientations(self.edges))

    def reversed(self) -> PropertyGraph:
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        return PropertyGraph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))

    def along(self, direction: str) -> PropertyGraph:
        """The graph whose edges lead values "out" (as they are), "in" (against them) or "all" ways."""
        if direction not in ("in", "out", "all"):
            raise ValueError(f"direction must be in, out or all, not {direction!r}")
        return {"out": lambda: self, "in": self.reversed, "all": self.undirected}[direction]()

    def triplets(self) -> DataFrame:
        """src, dst, src_value, dst_value and the edge's value; edges with a missing endpoint drop out."""
        edge = self.edges if "value" not in self.edges.columns else self.edges.withColumnRenamed("value", "edge_value")
        of_src = self.vertices.select(F.col("id").alias("src"), F.col("value").alias("src_value"))
        of_dst = self.vertices.select(F.col("id").alias("dst"), F.col("value").alias("dst_value"))
        return edge.join(of_src, "src").join(of_dst, "dst")

    def number_of_vertices(self) -> int:
        return self.vertices.count()

    def map_vertices(self, f: Callable[[Column, Column], Column]) -> PropertyGraph:
        """New values f(id, value); edges stay."""
        value = F.col("value") if "value" in self.vertices.columns else F.lit(None)
        return PropertyGraph(self.vertices.withColumn("value", f(F.col("id"), value)), self.edges)

    def join_with_vertices(self, table: DataFrame, f: Callable[[Column, Column], Column]) -> PropertyGraph:
        """f(old, new) for vertices that table(id, value) has, the old value for others.

        Of several rows for an id the one with the least value counts; ids that the graph lacks are ignored.
        """
        new = table.groupBy("id").agg(F.min("value").alias("__new")).withColumn("__hit", F.lit(True))
        joined = self.vertices.join(new, "id", "left")
        value = F.when(F.col("__hit"), f(F.col("value"), F.col("__new"))).otherwise(F.col("value"))
        return PropertyGraph(joined.select("id", value.alias("value")), self.edges)

    def run(self, algorithm: Callable[[PropertyGraph], Any]) -> Any:
        return algorithm(self)
