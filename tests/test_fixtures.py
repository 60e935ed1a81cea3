"""Known results on small graphs: plain and split algorithms, sources and sinks, quirks."""

import random

import pytest
from pyspark.sql import functions as F

from ramify import sources
from ramify.functions import parent_of, set_jaccard
from ramify.operators import algorithms as A
from ramify.operators import degrees as D
from ramify.operators import neighbors as N
from ramify.operators import split as S
from ramify.operators.graph import PropertyGraph


def parse(text):
    return [tuple(p.split("-")) for p in text.split()]


DEGREE = parse("1-2 2-3 2-4 2-5 3-4 4-5 5-6 5-7 5-8 5-9 5-10 5-11 5-12 5-13 5-14 5-15 5-16 5-17 5-18 5-19 5-20 5-21")
TRIANGLE = parse("1-2 1-3 2-3 2-6 3-4 3-5 3-6 4-5 6-7")
JACCARD = parse("1-2 1-7 2-7 3-4 3-7 4-7 5-6 5-7 6-7 7-8")
COMPONENTS = parse("1-2 2-3 2-4 3-4")
COMMUNITY = [(*e, k + 1.0) for k, e in enumerate(parse("1-2 1-3 1-4 2-3 2-4 3-5 5-6 5-7 6-7 7-12 8-9 8-10 8-11 9-10 9-11 10-11 10-12 11-12"))]


@pytest.fixture
def graph(spark):
    return lambda edges: PropertyGraph.from_edges(sources.inline_edges(spark, edges))


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


DEGREES = {"1": 1, "2": 4, "3": 2, "4": 3, "5": 18} | {str(k): 1 for k in range(6, 22)}


def test_degrees(graph):
    g = graph(DEGREE)
    assert as_dict(A.count_degrees(g)) == DEGREES
    assert as_dict(A.split_degrees(g)) == DEGREES
    assert as_dict(A.split_degrees(g, adaptive=False)) == DEGREES
    assert as_dict(D.degrees(g, "symmetrised")) == {k: 2 * v for k, v in DEGREES.items()}
    assert D.average_degree(D.degrees(g)).first()[0] == 2.0
    assert D.count_skewed(g, 35).first()[0] == 1 and D.count_skewed(g).first()[0] == 0
    with pytest.raises(ValueError):
        D.degrees(g, "other")


def test_alpha_split(graph):
    g = graph(DEGREE)
    of = D.degrees(g)
    out = {tuple(r) for r in S.alpha_split(g, of, D.average_degree(of)).collect()}
    moved = {7, 9, 10, 12, 14, 16, 18, 21}
    assert out == {(f"{a}_1" if a == "5" and int(b) in moved else a, b) for a, b in DEGREE}


def test_fixed_tree_split(graph):
    g = graph(DEGREE)
    split = A.split_at(g, D.degrees(g), 2, 4, 2, adaptive=False)
    out = {tuple(r) for r in split.edges.collect()}
    assert out >= {("1", "2_1_0_1_1"), ("2_1_1_0_1", "3"), ("2_0_0_0_1", "4_1_1_1_0"), ("2_1_1_1_0", "5_0_1_1_0"), ("3", "4_1_1_0_1"), ("4_1_1_1_1", "5_0_0_0_1")}
    assert sorted(map(tuple, S.cleanup_edges(split.edges).collect())) == sorted(DEGREE)


def test_adaptive_tree_split(graph):
    for edges, n in ((DEGREE, 36), (JACCARD, 13), (COMPONENTS, 5)):
        g = graph(edges)
        split = A.split_at(g, D.degrees(g), 2, 4, 2)
        assert split.vertices.count() == n
        if edges is JACCARD:
            want = parse("1-2 1-7_1_0 2-7_0_0 3-4 3-7_1_1 4-7_0_1_1_1 5-6 5-7_1_1 6-7_0_1_1_0 7_0_1_1_1-8")
            assert sorted(map(tuple, split.edges.collect())) == sorted(want)
        if edges is COMPONENTS:
            assert sorted(map(tuple, split.edges.collect())) == sorted(parse("1-2_1 2_1-3 2_0-4 3-4"))


TRIANGLE_WAYS = [A.triangle_count, A.triangle_count_gathered, A.split_triangle_count, lambda g: A.split_triangle_count(g, mode="directed")]


@pytest.mark.parametrize("count", TRIANGLE_WAYS)
def test_triangles(graph, count):
    back = [(b, a) for a, b in TRIANGLE]
    for edges, n in ((TRIANGLE, 3), (TRIANGLE + back, 3), (TRIANGLE + [("1", "3")], 3), (TRIANGLE + [("3", "3")], 3), (parse("1-2 2-3"), 0)):
        assert count(graph(edges)).first()[0] == n


def test_triangles_of_a_multigraph(graph):
    back = [(b, a) for a, b in TRIANGLE]
    for edges, n in ((TRIANGLE, 3), (TRIANGLE + back, 12), (TRIANGLE + [("1", "3")], 4), (TRIANGLE + [("3", "3")], 3), (parse("1-2 2-3"), 0)):
        assert A.triangle_count(graph(edges), multigraph=True).first()[0] == n


def test_components(graph):
    g, back, chain = graph(COMPONENTS), graph([(b, a) for a, b in COMPONENTS]), graph([(str(k), str(k + 1)) for k in range(1, 9)])
    one = dict.fromkeys("1234", 1)
    four = {"1": 1, "2": 1, "3": 1, "4": 1, "5": 1, "6": 2, "7": 3, "8": 4, "9": 5}
    for f in (A.connected_components, A.split_connected_components):
        assert as_dict(f(g, 4)) == as_dict(f(back)) == one
        assert as_dict(f(chain, 4)) == four
    assert as_dict(A.min_ancestor_label(g, 4)) == one and as_dict(A.min_ancestor_label(chain, 4)) == four
    assert as_dict(A.min_ancestor_label(back, 4)) == {k: int(k) for k in "1234"}
    assert as_dict(A.min_ancestor_label(back, 4, undirected=True)) == one


def test_jaccard(graph):
    third, eighth = 1 / 3, 0.125
    by_edge = {("1", "2"): third, ("3", "4"): third, ("5", "6"): third, ("7", "8"): 0.0} | {(k, "7"): eighth for k in "123456"}
    by_vertex = {(a, b): v for (x, y), v in by_edge.items() for a, b in ((x, y), (y, x))}
    g = graph(JACCARD)
    for f in (A.jaccard_edges, A.split_jaccard_edges):
        assert {(r[0], r[1]): r[2] for r in f(g).collect()} == by_edge
    for f in (A.jaccard_vertices, A.split_jaccard_vertices):
        assert {(r[0], r[1]): r[2] for r in f(g).collect()} == by_vertex
    assert as_dict(A.as_maps(A.jaccard_vertices(g)))["7"] == {k: eighth for k in "123456"} | {"8": 0.0}


def test_jaccard_with_loops_and_multiple_edges(graph):
    g = graph(parse("1-2 2-1 1-2 1-1 2-3 1-3 3-4"))
    sets = {}
    for a, b in parse("1-2 2-1 1-2 1-1 2-3 1-3 3-4"):
        sets.setdefault(a, set()).add(b)
        sets.setdefault(b, set()).add(a)
    want = sorted((a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a, b in parse("1-2 2-1 1-2 1-1 2-3 1-3 3-4"))
    assert sorted(map(tuple, A.jaccard_edges(g).collect())) == want


def test_communities(graph):
    g = graph(COMMUNITY)
    for steps, labels in ((1, "4 4 5 2 7 7 12 11 11 12 12 11"), (2, "2 2 7 4 12 12 11 12 12 11 11 12"), (3, "7 7 12 2 11 11 12 11 11 12 12 11")):
        want = {str(k + 1): int(x) for k, x in enumerate(labels.split())}
        assert as_dict(A.communities(g, steps)) == as_dict(A.split_communities(g, steps)) == want
    scores = {r["id"]: r["score"] for r in A.communities(g, 1).collect()}
    assert [scores[str(k)] for k in range(1, 13)] == [2.5, 4.5, 5.5, 4.5, 7.5, 8.5, 9.5, 12.5, 14.5, 16.5, 17.5, 17.5]


def test_communities_run_all_supersteps(graph):
    labels = "12 12 11 11 12 12 11 12 12 11 11 12"
    assert as_dict(A.communities(graph(COMMUNITY))) == {str(k + 1): int(x) for k, x in enumerate(labels.split())}
    fixed = as_dict(A.communities(graph([(a, b, 3.0) for a, b, _ in COMMUNITY])))
    assert fixed == {str(k): 1 if k <= 4 else 3 if k <= 7 else 8 for k in range(1, 13)}


@pytest.mark.parametrize("seed", [1, 2])
def test_split_equals_plain(graph, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted((min(rng.randrange(30), rng.randrange(30)), rng.randrange(30)))) for _ in range(90)})
    g = graph([(str(a), str(b)) for a, b in edges if a != b])
    alpha, level, threshold = rng.choice([2, 3]), rng.choice([1, 2, 4]), rng.choice([1, 4])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(A.split_degrees(g, alpha, level, threshold)) == rows(A.count_degrees(g))
    assert rows(A.split_triangle_count(g, alpha, level, threshold)) == rows(A.triangle_count(g))
    assert rows(A.split_connected_components(g, 3, alpha, level, threshold)) == rows(A.connected_components(g, 3))
    assert rows(A.split_jaccard_edges(g, alpha, level, threshold)) == rows(A.jaccard_edges(g))


def test_neighbourhoods(graph, spark):
    g = graph(TRIANGLE).map_vertices(lambda i, _: i.cast("long"))
    assert as_dict(N.reduce_values(g, "in", F.min)) == {"2": 1, "3": 1, "6": 2, "4": 3, "5": 3, "7": 6}
    assert as_dict(N.reduce_values(g, "out", F.max)) == {"1": 3, "2": 6, "3": 6, "4": 5, "6": 7}
    whole = {r["id"]: r["n"] for r in N.group_reduce_with_value(g, "in", F.count("*").alias("n")).collect()}
    assert whole["1"] is None and whole["3"] == 2
    with pytest.raises(ValueError):
        N.neighbourhood(g, "up")
    partial = PropertyGraph(g.vertices.where("id <> '3'"), g.edges)
    assert "4" not in as_dict(N.reduce_values(partial, "in", F.min))
    out = N.apply_in_pandas(g, "all", lambda rows: rows[["id"]].head(1).assign(n=len(rows)), "id string, n long")
    assert as_dict(out) == as_dict(D.degrees(g))
    sets = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "x array<string>, y array<string>")
    assert [r[0] for r in sets.select(set_jaccard(F.col("x"), F.col("y"))).collect()] == [1 / 3, 0.0]


def test_joining_values(graph, spark):
    g = graph(TRIANGLE).map_vertices(lambda i, _: i.cast("long"))
    table = spark.createDataFrame([("1", None), ("2", 20), ("2", 30), ("99", 1)], "id string, value long")
    out = as_dict(g.join_with_vertices(table, lambda old, new: new).vertices)
    assert out["1"] is None and out["2"] == 20 and out["3"] == 3 and "99" not in out
    assert g.triplets().where("src = '2' and dst = '6'").select("src_value", "dst_value").first() == (2, 6)
    assert g.run(lambda x: x.number_of_vertices()) == 7


def test_tree_merge(spark):
    rows = spark.createDataFrame([("1", 5), ("2_0", 1), ("2_1_0", 2), ("2_1_1", 3)], "id string, value long")
    assert as_dict(S.tree_merge(rows, 2, F.sum("value"))) == {"1": 5, "2": 6}
    assert as_dict(S.merge(rows, F.sum("value").alias("value"))) == {"1": 5, "2": 6}
    assert [r[0] for r in rows.select(parent_of(F.col("id"))).collect()] == ["1", "2", "2_1", "2_1"]


def test_sources_and_sinks(spark, tmp_path, graph):
    edges = tmp_path / "edges.tsv"
    edges.write_text("# a comment\n007\t2\n2\t3\n")
    read = lambda **k: sorted(map(tuple, sources.read_edges(spark, str(edges), **k).collect()))
    assert read() == [("007", "2"), ("2", "3")] and read(ids="long") == [("2", "3"), ("7", "2")]
    assert read(weight=sources.FIXED_WEIGHT) == [("007", "2", 3.0), ("2", "3", 3.0)]
    (tmp_path / "bad.tsv").write_text("x\t2\n")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        sources.read_edges(spark, str(tmp_path / "bad.tsv"), ids="long").collect()
    with pytest.raises(Exception, match="FAILFAST|MALFORMED|CAST"):
        A.connected_components(PropertyGraph.from_edges(sources.read_edges(spark, str(tmp_path / "bad.tsv")))).collect()
    (tmp_path / "vertices.csv").write_text("# c\n1,10\n2,20\n")
    assert as_dict(sources.read_vertices(spark, str(tmp_path / "vertices.csv"))) == {"1": 10, "2": 20}
    sources.write_rows(A.as_maps(A.jaccard_vertices(graph(JACCARD))), str(tmp_path / "out"))
    lines = sorted(x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines())
    assert "7,{1=0.125, 2=0.125, 3=0.125, 4=0.125, 5=0.125, 6=0.125, 8=0.0}" in lines and "1,{2=0.3333333333333333, 7=0.125}" in lines
    sources.write_rows(graph(COMPONENTS).edges, str(tmp_path / "spaced"), " ")
    assert sorted(x for p in (tmp_path / "spaced").glob("part-*") for x in p.read_text().splitlines())[0] == "1 2"
    sources.write_table(graph(COMPONENTS).edges, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def test_jaccard_of_ids_that_are_no_numbers(graph):
    named = [(f"v-{a}", f"v-{b}") for a, b in JACCARD]
    plain = {(r[0], r[1]): r[2] for r in A.jaccard_edges(graph(JACCARD)).collect()}
    for f in (A.jaccard_edges, A.split_jaccard_edges):
        assert {(r[0][2:], r[1][2:]): r[2] for r in f(graph(named)).collect()} == plain
    assert A.jaccard_vertices(graph(named)).count() == 20


def test_ids_with_the_separator_fail(graph):
    g = graph(parse("x_1-h x_2-h x_3-h y-x_1"))
    with pytest.raises(Exception, match="holds '_'"):
        A.split_degrees(g).collect()


def test_components_of_a_long_path(spark):
    """2,000 hops, in far fewer rounds; and some components beside."""
    edges = spark.range(2000).selectExpr("id + 1 as src", "id as dst").unionByName(spark.createDataFrame([(5001, 5003), (5003, 5002), (5002, 5001), (6000, 6000)], "src long, dst long"))
    out = as_dict(A.connected_components(PropertyGraph.from_edges(edges)))
    assert out == {k: 0 for k in range(2001)} | {5001: 5001, 5002: 5001, 5003: 5001, 6000: 6000}


def test_steps_leave_no_files(spark, tmp_path):
    """A step's table goes when the next one is there."""
    from ramify.plans import checkpoint

    before = checkpoint.cut(spark.range(3))
    path = before._ramify_path
    after = checkpoint.cut(before, instead_of=before)
    import os

    assert after.count() == 3 and not os.path.exists(path.removeprefix("file://"))
