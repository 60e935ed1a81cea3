"""The algorithms as programs: python -m ramify.programs NAME [arguments].

Without arguments a program runs on a small graph of its own and prints; with all of them it reads edges (tab-separated,
# for comments) and writes its result as lines; with any other number it prints its usage to standard error and does nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramify import sources
from ramify.operators import algorithms as A
from ramify.operators import degrees as D
from ramify.operators import split as S
from ramify.operators.graph import PropertyGraph

#: The built-in graphs, an edge as source-target.
DEGREE = "1-2 2-3 2-4 2-5 3-4 4-5 5-6 5-7 5-8 5-9 5-10 5-11 5-12 5-13 5-14 5-15 5-16 5-17 5-18 5-19 5-20 5-21"
TRIANGLE = "1-2 1-3 2-3 2-6 3-4 3-5 3-6 4-5 6-7"
JACCARD = "1-2 1-7 2-7 3-4 3-7 4-7 5-6 5-7 6-7 7-8"
COMPONENTS = "1-2 2-3 2-4 3-4"
COMMUNITY = "1-2 1-3 1-4 2-3 2-4 3-5 5-6 5-7 6-7 7-12 8-9 8-10 8-11 9-10 9-11 10-11 10-12 11-12"
#: What the programs take where they are given nothing.
DEFAULTS = {"iterations": 25, "alpha": 2, "level": 4, "threshold": 2.0, "delta": 0.5}

_SPLIT = ("alpha", "level", "threshold")


def _alpha_degrees(graph: PropertyGraph, alpha: int, **_: object) -> DataFrame:
    of = D.degrees(graph)
    partial = S.alpha_split(graph, of, D.average_degree(of), alpha).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return S.merge(partial, F.sum("degree").alias("degree"))


def _labels(found: DataFrame) -> DataFrame:
    return found.select("id", "label")


def _started(graph: PropertyGraph, iterations: int, vertices: DataFrame | None = None) -> DataFrame:
    """Components whose vertices come from a file where one is given: each begins with its own value."""
    if vertices is None:
        return A.connected_components(graph, iterations)
    from ramify.plans.iterate import pregel

    start = PropertyGraph(vertices, graph.edges.select("src", "dst")).undirected()
    done = pregel(start, lambda v, _: v, F.min, lambda v, m, _: F.least(v, m), iterations)
    return done.vertices.select("id", F.col("value").alias("component"))


@dataclass(frozen=True)
class Program:
    run: Callable[..., DataFrame]
    options: tuple[str, ...]  # after edges (and vertices) and the output path
    fixture: str
    sep: str = ","
    ids: str = "string"
    comment: str | None = "#"
    weighted: bool = False
    vertices: bool = False
    iterations: int = 25

    def usage(self, name: str) -> str:
        return " ".join(["usage:", name, "<edges>", *["<vertices>"] * self.vertices, "<out>", *(f"<{x}>" for x in self.options)])


PROGRAMS: dict[str, Program] = {
    "alpha-degrees": Program(_alpha_degrees, ("iterations", "alpha"), DEGREE, ids="long"),
    "tree-degrees": Program(lambda g, alpha, level, threshold=2.0, **_: A.split_degrees(g, alpha, level, threshold, adaptive=False), ("iterations", "alpha", "level"), DEGREE, ids="long"),
    "count-skewed": Program(D.count_skewed, (), DEGREE),
    "components": Program(_started, ("iterations",), COMPONENTS, vertices=True, iterations=4),
    "components-gsa": Program(lambda g, iterations: A.min_ancestor_label(g, iterations), ("iterations",), COMPONENTS, sep=" ", comment=None, iterations=4),
    "components-split": Program(lambda g, iterations, **o: A.split_connected_components(g, iterations, **o), ("iterations", *_SPLIT), COMPONENTS, iterations=4),
    "components-split-gsa": Program(lambda g, iterations, **o: A.split_connected_components(g, iterations, **o), ("iterations", *_SPLIT), COMPONENTS, comment=None, iterations=4),
    "triangles": Program(A.triangle_count, (), TRIANGLE),
    "triangles-gsa": Program(A.triangle_count_gathered, (), TRIANGLE),
    "triangles-split": Program(A.split_triangle_count, _SPLIT, TRIANGLE),
    "triangles-split-gsa": Program(lambda g, **o: A.split_triangle_count(g, mode="directed", **o), _SPLIT, TRIANGLE),
    "jaccard": Program(lambda g: A.as_maps(A.jaccard_vertices(g)), (), JACCARD),
    "jaccard-gsa": Program(A.jaccard_edges, (), JACCARD),
    "jaccard-split": Program(lambda g, **o: A.as_maps(A.split_jaccard_vertices(g, **o)), _SPLIT, JACCARD),
    "jaccard-split-gsa": Program(A.split_jaccard_edges, _SPLIT, JACCARD),
    "communities": Program(lambda g, iterations, delta: _labels(A.communities(g, iterations, delta)), ("iterations", "delta"), COMMUNITY, weighted=True, iterations=30),
    "communities-split": Program(lambda g, iterations, delta, **o: _labels(A.split_communities(g, iterations, delta, **o)), ("iterations", "delta", *_SPLIT), COMMUNITY, weighted=True, iterations=30),
}


def _fixture(spark: SparkSession, program: Program) -> PropertyGraph:
    rows = [tuple(e.split("-")) for e in program.fixture.split()]
    return PropertyGraph.from_edges(sources.inline_edges(spark, [(*e, k + 1.0) for k, e in enumerate(rows)] if program.weighted else rows))


def run(spark: SparkSession, name: str, arguments: list[str]) -> DataFrame | None:
    """The program's result; None if the arguments don't fit, or where the result is written."""
    program = PROGRAMS[name]
    paths = 2 + program.vertices
    if not arguments:
        options = {x: program.iterations if x == "iterations" else DEFAULTS[x] for x in program.options}
        return program.run(_fixture(spark, program), **options)
    if len(arguments) != paths + len(program.options):
        print(program.usage(name), file=sys.stderr)
        return None
    kinds = {"threshold": float, "delta": float}
    options = {x: kinds.get(x, int)(y) for x, y in zip(program.options, arguments[paths:], strict=True)}
    edges = sources.read_edges(spark, arguments[0], ids=program.ids, comment=program.comment, weight=sources.FIXED_WEIGHT if program.weighted else None)
    if program.vertices:
        options["vertices"] = sources.read_vertices(spark, arguments[1])
    sources.write_rows(program.run(PropertyGraph.from_edges(edges), **options), arguments[paths - 1], program.sep)
    return None


def main(arguments: list[str]) -> int:
    if not arguments or arguments[0] not in PROGRAMS:
        print("usage: NAME [arguments], NAME one of: " + " ".join(PROGRAMS), file=sys.stderr)
        return 0 if not arguments else 2
    spark = SparkSession.builder.appName(arguments[0]).getOrCreate()
    out = run(spark, arguments[0], arguments[1:])
    if out is not None:
        out.show(1000, False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
