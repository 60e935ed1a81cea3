"""Connected components without a bound on hops, in rounds that grow with the logarithm of the number of vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.plans.checkpoint import cut, drop


def star_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of an edge that isn't a loop: ids are longs, the component is its least id.

    Large stars hook each vertex's greater neighbours to the least one around it, small stars its lesser ones,
    in turn until every component is a star about its least vertex. The least neighbour is a table of its own
    before it is joined, so that adaptive execution can split a hub's rows.
    """
    links = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    while True:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        hooked = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(hooked.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), instead_of=links)
        for step in (least, large, low):
            drop(step)
        links = new
        # stars if nobody has two centres and no centre has one
        if links.groupBy("u").count().where("count > 1").isEmpty() and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
