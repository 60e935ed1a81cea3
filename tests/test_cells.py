"""Triangles and Jaccard over cells of three blocks: brute force on small cells and waves, and no row per wedge in a plan."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from ramify.operators import algorithms as A
from ramify.operators import cells
from ramify.operators.graph import PropertyGraph

rng = random.Random(5)
#: A hub, a clique, random edges, some given twice, both ways, as loops or without an end.
GIVEN = [(0, k) for k in range(1, 60)] + list(combinations(range(-5, 8), 2)) + [(rng.randrange(80), rng.randrange(80)) for _ in range(500)]
GIVEN += [(b, a) for a, b in GIVEN[::7]] + GIVEN[::5] + [(7, 7), (0, 0), (1 << 62, -(1 << 62)), (1 << 62, 0), (-(1 << 62), 0)]


@pytest.fixture(scope="module")
def graph(spark):
    return PropertyGraph.from_edges(spark.createDataFrame([*GIVEN, (None, 1), (2, None)], "src long, dst long"))


@pytest.fixture(params=[(10**6, 10**9), (150, 10**9), (40, 300_000)])
def bounds(request, monkeypatch):
    """One cell, several, and several in waves."""
    monkeypatch.setattr(cells, "CELL_EDGES", request.param[0])
    monkeypatch.setattr(cells, "WAVE_BYTES", request.param[1])


def test_triangles(graph, bounds):
    pairs = {(min(e), max(e)) for e in GIVEN if e[0] != e[1]}
    times = Counter((min(e), max(e)) for e in GIVEN if e[0] != e[1])
    up = defaultdict(set)
    for a, b in pairs:
        up[a].add(b)
    found = [(a, b, c) for a, b in pairs for c in up[a] & up[b]]
    assert A.triangle_count(graph).first()[0] == A.triangle_count_gathered(graph).first()[0] == len(found)
    assert A.triangle_count(graph, multigraph=True).first()[0] == sum(times[a, c] * times[b, c] for a, b, c in found)


def test_jaccard(graph, bounds):
    around = defaultdict(set)
    for a, b in GIVEN:
        around[a].add(b)
        around[b].add(a)
    value = {(a, b): len(around[a] & around[b]) / len(around[a] | around[b]) for a in around for b in around[a]}
    assert Counter(map(tuple, A.jaccard_edges(graph).collect())) == Counter((a, b, value[a, b]) for a, b in GIVEN)
    assert Counter(map(tuple, A.jaccard_vertices(graph).collect())) == Counter((*e, j) for e, j in value.items())


def test_no_wedge_is_moved(graph):
    """Rows of wedges came from joins; the disk they took ended the queries on 1 GB."""
    for f in (A.triangle_count, A.triangle_count_gathered, lambda g: A.triangle_count(g, multigraph=True), A.jaccard_edges, A.jaccard_vertices):
        assert "Join" not in f(graph)._jdf.queryExecution().optimizedPlan().toString()


def test_no_edges(spark):
    empty = PropertyGraph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert A.triangle_count(empty).first()[0] == 0
    assert A.triangle_count(empty, multigraph=True).first()[0] == 0
    assert A.jaccard_edges(empty).count() == 0


@pytest.mark.parametrize("split", [(2, 4, 10), (3, 2, 5), (2, 0, 1)])
def test_split_forms(graph, bounds, split):
    """Hubs dealt to sub-vertices inside cells: the same results, and no edge or wedge rewritten as rows, whose disk ended them on 1 GB."""
    frames = [A.split_triangle_count(graph, *split), A.split_triangle_count(graph, *split, mode="directed"), A.split_jaccard_edges(graph, *split), A.split_jaccard_vertices(graph, *split)]
    for df in frames:
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    pairs = {(min(e), max(e)) for e in GIVEN if e[0] != e[1]}
    around = defaultdict(set)
    for a, b in GIVEN:
        around[a].add(b)
        around[b].add(a)
    near = {a: x - {a} for a, x in around.items()}
    assert frames[0].first()[0] == frames[1].first()[0] == sum(len(near[a] & near[b]) for a, b in pairs) // 3
    value = {(str(a), str(b)): len(around[a] & around[b]) / len(around[a] | around[b]) for a in around for b in around[a]}
    assert Counter(map(tuple, frames[2].collect())) == Counter((str(a), str(b), value[str(a), str(b)]) for a, b in GIVEN)
    assert Counter(map(tuple, frames[3].collect())) == Counter((*e, j) for e, j in value.items())


def test_sub_vertices_share_a_hub():
    """A hub's edges in a cell are dealt out, and the triangles over them are found once."""
    edges = [(a, b) for a, b in combinations(range(40), 2)]
    us, vs = ([np.array([e[k] for e in edges])] for k in (0, 1))
    cell = cells._Cell(us, vs, (2, 4, 8, 1))
    assert len(cell.parts[1]) > 3 * cell.n
    found = list(cell.triangles(False))
    assert sum(len(x[0]) for x in found) == 9880 == sum(cell.merged(np.bincount(x[0], minlength=len(cell.key))) for x in found)
    assert cells._Cell(us, vs, (2, 4, 39, 1)).parts is None
