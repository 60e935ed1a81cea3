"""Vertex splitting: hubs become sub-vertices, partial results are merged and propagated.

A sub-vertex's id is its root's id with one suffix per level; ids are strings here, and one that
holds the separator fails. A split never changes a result, it only spreads a hub's edges over several keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.functions import checked_id, child_id, child_number, is_split, level_hash, level_hashes, parent_of, root_of
from ramify.operators.degrees import weigh_edges
from ramify.operators.graph import PropertyGraph
from ramify.plans.checkpoint import cut, small

ALPHA, LEVEL, THRESHOLD = 2, 4, 2


def alpha_split(graph: PropertyGraph, of: DataFrame, average: DataFrame, alpha: int = ALPHA) -> DataFrame:
    """Edges after a split in one level: of an edge whose source (or else target) has a degree above alpha times the average,
    that end is renamed by the hash of the other, unless the remainder is 0. The remainder has the hash's sign."""
    weighed = weigh_edges(graph, of).crossJoin(F.broadcast(average.limit(1)))  # one row
    src, dst = checked_id(F.col("src")), checked_id(F.col("dst"))
    limit = F.col("average") * alpha

    def renamed(vertex: Column, other: Column) -> Column:
        h = level_hash(other, 0) % alpha
        return F.when(h == 0, vertex).otherwise(child_id(vertex, h))

    hot_src = F.col("src_degree") > limit
    hot_dst = ~hot_src & (F.col("dst_degree") > limit)
    return weighed.select(F.when(hot_src, renamed(src, dst)).otherwise(src).alias("src"), F.when(hot_dst, renamed(dst, src)).otherwise(dst).alias("dst"))


@dataclass(frozen=True)
class SplitGraph:
    """vertices (id, root[, value]); edges (src, dst[, value]) between sub-vertices."""

    vertices: DataFrame
    edges: DataFrame

    def rooted_edges(self) -> DataFrame:
        """Edges with src_root and dst_root beside."""
        return self.edges.withColumn("src_root", root_of(F.col("src"))).withColumn("dst_root", root_of(F.col("dst")))

    def propagate(self, values: DataFrame, root: str = "id") -> DataFrame:
        """(id, root, ...): each sub-vertex with its root's row in values; those without one drop out."""
        return self.vertices.select("id", "root").join(values.withColumnRenamed(root, "root"), "root")


def _flagged(edges: DataFrame, hot: DataFrame) -> DataFrame:
    """edges with src_hot and dst_hot. hot is a table of ids; it is broadcast if it is small, else both joins can be split where they are skewed."""
    for end in ("src", "dst"):
        edges = edges.drop(f"{end}_hot").join(small(hot).select(F.col("id").alias(end), F.lit(True).alias(f"{end}_hot")), end, "left")
    return edges.withColumns({f"{end}_hot": F.coalesce(f"{end}_hot", F.lit(False)) for end in ("src", "dst")})


def _renamed_ends(edges: DataFrame, level: int, alpha: int) -> DataFrame:
    """Both ends of the edges on this level: the source by the target, then the target by the source as it is now called."""
    src = F.when(F.col("src_hot"), child_id(F.col("src"), child_number(F.col("dst"), level, alpha))).otherwise(F.col("src"))
    edges = edges.withColumn("src", src)
    return edges.withColumn("dst", F.when(F.col("dst_hot"), child_id(F.col("dst"), child_number(F.col("src"), level, alpha))).otherwise(F.col("dst")))


def distinct_degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) of the hot ends of flagged edges, over the distinct edges at them, taken with their reverses."""
    at = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.col("src_hot").alias("hot")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.col("dst_hot").alias("hot")))
    return edges.select(F.inline(at)).where("hot").select("id", "other").distinct().groupBy("id").agg(F.count("*").alias("degree"))


def _children(alpha: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(alpha - 1)), lambda k: child_id(F.col("id"), k))


def tree_split(graph: PropertyGraph, skewed: DataFrame, alpha: int = ALPHA, level: int = LEVEL, threshold: float = THRESHOLD, adaptive: bool = True) -> SplitGraph:
    """Split the skewed vertices into alpha children each, level by level.

    adaptive: only children whose degree is still above the threshold go on; otherwise all do, on each level.
    Only edges at vertices that are split go through the levels and are checked again: all others are written once.
    """
    rest = [c for c in graph.edges.columns if c not in ("src", "dst")]
    edges = graph.edges.select(checked_id(F.col("src")).alias("src"), checked_id(F.col("dst")).alias("dst"), *rest)
    vertices = graph.vertices.withColumn("id", checked_id(F.col("id")))
    names = [c for c in vertices.columns if c != "id"]
    hot = cut(skewed.select(checked_id(F.col("id")).alias("id")).distinct())
    if level == 0 or hot.isEmpty():
        return SplitGraph(cut(vertices.withColumn("root", root_of(F.col("id")))), cut(edges))
    if not adaptive:
        ids, flagged = F.col("id"), cut(_flagged(edges, hot))
        split = F.array(ids)
        for i in range(level):
            flagged = cut(_renamed_ends(flagged, i, alpha), instead_of=flagged)  # else each level's names are expressions over all before
            split = F.flatten(F.transform(split, lambda x: F.transform(F.sequence(F.lit(0), F.lit(alpha - 1)), lambda k: child_id(x, k))))
        vertices = vertices.join(small(hot).withColumn("__hot", F.lit(True)), "id", "left").select(F.explode(F.when(F.col("__hot"), split).otherwise(F.array(ids))).alias("id"), *names)
        return SplitGraph(cut(vertices.withColumn("root", root_of(F.col("id")))), flagged.select("src", "dst", *rest))
    done, flagged = [], cut(_flagged(edges, hot))
    for i in range(level):
        done.append(flagged.where("not (src_hot or dst_hot)").select("src", "dst", *rest))
        renamed = cut(_renamed_ends(flagged.where("src_hot or dst_hot"), i, alpha))
        vertices = vertices.join(small(hot).withColumn("__hot", F.lit(True)), "id", "left")
        vertices = vertices.select(F.explode(F.when(F.col("__hot"), _children(alpha)).otherwise(F.array("id"))).alias("id"), *names)
        hot = cut(distinct_degrees(renamed).where(F.col("degree") > threshold).select("id"))
        if i + 1 == level or hot.isEmpty():
            done.append(renamed.select("src", "dst", *rest))
            break
        flagged = _flagged(renamed, hot)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return SplitGraph(cut(vertices.withColumn("root", root_of(F.col("id")))), out)


def deal(owner: np.ndarray, neighbour: np.ndarray, alpha: int, level: int, threshold: float, counted: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The adaptive tree split of packed edges: the sub-vertex of each (owner, neighbour), and the owner of each sub-vertex, in order.

    owner: numbers from 0. Sub-vertices of one owner follow each other. An owner whose edges, each counted so many times, are more than the threshold is split,
    an edge going to the child that the level hash of the neighbour's id says; so are its children on the next level.
    """
    owners = int(owner.max(initial=-1)) + 1
    sub, root = owner, np.arange(owners)
    for i in range(level):
        hot = np.flatnonzero((counted * np.bincount(sub, minlength=len(root)) > threshold)[sub]) if len(sub) else sub
        if not len(hot):
            break
        child = sub * alpha
        child[hot] += np.abs(level_hashes(neighbour[hot], i)) % alpha
        # those without edges stay: they are vertices too
        known = np.unique(np.concatenate([child, np.flatnonzero(np.bincount(sub, minlength=len(root)) == 0) * alpha]))
        root, sub = root[known // alpha], np.searchsorted(known, child)
    return sub, root


def merge(partials: DataFrame, *aggregates: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Partial rows (id, ...) aggregated to their roots: (id, *keys, aggregates). Map-side partial aggregation makes this one shuffle."""
    return partials.groupBy(root_of(F.col("id")).alias("id"), *keys).agg(*aggregates)


def tree_merge(partials: DataFrame, level: int, aggregate: Column, value: str = "value") -> DataFrame:
    """The same in up to level rounds, each of which drops one suffix; whole ids pass through. aggregate must be associative."""
    whole, rest = partials.where(~is_split(F.col("id"))), partials.where(is_split(F.col("id")))
    for _ in range(level):
        rest = rest.groupBy(parent_of(F.col("id")).alias("id")).agg(aggregate.alias(value))
    return whole.select("id", value).unionByName(rest.select("id", value))


def cleanup_edges(edges: DataFrame) -> DataFrame:
    """Edges between roots again, without removing duplicates."""
    return edges.withColumn("src", root_of(F.col("src"))).withColumn("dst", root_of(F.col("dst")))
