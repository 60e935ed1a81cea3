"""The message-passing loop and its gather-sum-apply front end.

Each superstep is one declarative plan (edges joined with the frontier, messages aggregated by
target, joined with the state), written as a table that takes the place of the one before. The driver only sees whether
anything has changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramify.operators.graph import PropertyGraph
from ramify.plans.checkpoint import cut, drop


def pregel(
    graph: PropertyGraph,
    message: Callable[[Column, Column], Column],
    combine: Callable[[Column], Column],
    apply: Callable[[Column, Column, int], Column],
    max_iterations: int,
    until: str = "no_change",
    combine_frame: Callable[[DataFrame], DataFrame] | None = None,
) -> PropertyGraph:
    """Values move along edges from src to dst.

    message(value, edge_value) is what a vertex sends; combine aggregates a target's messages (or
    combine_frame turns rows (id, msg) into one row per id); apply(value, msg, superstep) is the new value of a vertex that got a
    message. until="no_change": only vertices whose value has changed send, and the loop ends when none has;
    "fixed": all send in each of max_iterations supersteps.
    """
    edges = graph.edges if "value" in graph.edges.columns else graph.edges.withColumn("value", F.lit(None).cast("double"))
    edges = cut(edges.select("src", "dst", F.col("value").alias("edge_value")))
    state = cut(graph.vertices.select("id", "value", F.lit(True).alias("changed")))
    for step in range(1, max_iterations + 1):
        frontier = state if until == "fixed" else state.where("changed")
        sent = edges.join(frontier.select(F.col("id").alias("src"), "value"), "src").select(F.col("dst").alias("id"), message(F.col("value"), F.col("edge_value")).alias("msg"))
        got = combine_frame(sent) if combine_frame else sent.groupBy("id").agg(combine(F.col("msg")).alias("msg"))
        joined = state.select("id", "value").join(got.select("id", "msg", F.lit(True).alias("hit")), "id", "left")
        new = F.when(F.col("hit"), apply(F.col("value"), F.col("msg"), step)).otherwise(F.col("value"))
        state = cut(joined.select("id", new.alias("value"), (~new.eqNullSafe(F.col("value"))).alias("changed")), instead_of=state)
        if until == "no_change" and state.where("changed").isEmpty():
            break
    drop(edges)
    return PropertyGraph(state.select("id", "value"), graph.edges)


def gather_sum_apply(
    graph: PropertyGraph,
    gather: Callable[[Column, Column], Column],
    sum_: Callable[[Column], Column],
    apply: Callable[[Column, Column], Column],
    max_iterations: int,
    direction: str = "out",
) -> PropertyGraph:
    """As pregel until no change. direction "out": along the edges, "in": against them, "all": both ways."""
    moved = graph.along(direction)
    done = pregel(moved, gather, sum_, lambda value, msg, _: apply(value, msg), max_iterations)
    return PropertyGraph(done.vertices, graph.edges)
