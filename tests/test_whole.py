"""Queries on the co-part graph, where hubs are, against brute force too, on sf0.001."""

from collections import defaultdict
from math import fsum

import pandas as pd
import pytest

import __spark_entry__ as entry
from ramify.plans import queries
from ramify.plans.queries import COMMUNITY_STEPS, COMPONENT_STEPS, HOPS, HUB

SF = "/root/testdata/sf0.001"
SPREAD = {"cc_khop": HOPS, "cc_gsa_undirected": 4, "cc_split_gsa": 4}
OPERATORS = (
    "edge_scan_weighted edge_incidence triplets join_with_vertices neighbors_group_with_value neighbors_multiset cc cc_khop cc_gsa_directed cc_gsa_undirected "
    "cc_split cc_split_gsa triangles_multigraph jaccard_vertex jaccard_split jaccard_split_gsa community community_split"
).split()


@pytest.fixture(scope="module")
def edges():
    lines = pd.read_parquet(f"{SF}/lineitem.parquet", columns=["l_orderkey", "l_partkey"])
    out = set()
    for parts in lines.groupby("l_orderkey").l_partkey:
        own = sorted(set(parts[1]))
        out.update((int(a), int(b)) for i, a in enumerate(own) for b in own[i + 1 :])
    return out


@pytest.fixture(scope="module")
def around(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def least(sources_of, ids, hops=10**6):
    label = {v: v for v in ids}
    for _ in range(hops):
        new = {v: min([label[v], *(label[u] for u in sources_of[v])]) for v in ids}
        if new == label:
            break
        label = new
    return label


def labels_after(around, steps, delta=0.5, weight=3.0):
    state = {v: (v, 1.0) for v in around}
    for k in range(1, steps + 1):
        new = {}
        for v, near in around.items():
            got = defaultdict(list)
            for u in near:
                got[state[u][0]].append(state[u][1] * weight)
            best = min(got, key=lambda x: (-fsum(got[x]), x))
            new[v] = (best, max(got[best]) - (delta / k if best != state[v][0] else 0.0))
        state = new
    return {v: label for v, (label, _) in state.items()}


def brute(name, edges, around):
    if name == "edge_scan_weighted":
        return {(str(a), str(b), 3.0) for a, b in edges}
    if name == "edge_incidence":
        return {(str(x), str(y), a) for a, b in edges for x, y in ((a, b), (b, a))}
    if name == "triplets":
        return {(str(a), str(b), a, b) for a, b in edges}
    if name == "join_with_vertices":
        return {(str(v), len(n) - v if len(n) > 1 else v) for v, n in around.items()}
    if name == "neighbors_group_with_value":
        low = {v: [u for u in n if u < v] for v, n in around.items()}
        return {(str(v), v, len(n) if n else None, max(n) if n else None) for v, n in low.items()}
    if name == "neighbors_multiset":
        return {(str(a), str(b), 2) for a, n in around.items() for b in n}
    if name == "cc_gsa_directed":
        low = {v: [u for u in n if u < v] for v, n in around.items()}
        return {(str(v), x) for v, x in least(low, around).items()}
    if name.startswith("cc"):
        return {(str(v), x) for v, x in least(around, around, SPREAD.get(name, 10**6)).items()}
    if name == "triangles_multigraph":
        return {(4 * sum(len(around[a] & around[b]) for a, b in edges) // 3,)}
    if name.startswith("jaccard"):
        both = edges if name.endswith("gsa") else edges | {(b, a) for a, b in edges}
        return {(str(a), str(b), len(around[a] & around[b]) / len(around[a] | around[b])) for a, b in both}
    return {(str(v), x) for v, x in labels_after(around, 30).items()}


def test_whole_graph_has_hubs(edges, around):
    assert max(map(len, around.values())) > HUB
    assert set(OPERATORS) <= set(entry.queries())
    assert (COMMUNITY_STEPS, COMPONENT_STEPS) == (30, 4)


@pytest.mark.parametrize("name", OPERATORS)
def test_whole(spark, name, edges, around):
    df = entry.queries()[name](spark, SF)
    got = [tuple(r) for r in (df.select("src", "dst", "src_value", "dst_value") if name == "triplets" else df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(name, edges, around)


def test_reference_supersteps(spark, monkeypatch):
    """A path longer than either bound: labels move 4 hops in the component queries."""
    path = spark.createDataFrame([(k, k + 1) for k in range(1, 9)], "src long, dst long")
    monkeypatch.setattr(queries.T, "copart", lambda *_: path)
    for operator in (queries.cc_gsa_undirected, queries.cc_split_gsa):
        assert {int(r[0]): r[1] for r in operator(spark, SF).collect()} == {k: max(1, k - 4) for k in range(1, 10)}
