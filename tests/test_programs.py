"""The programs from their arguments: known results of the built-in graphs, files, and usage."""

import pytest

from ramify import programs
from tests.test_fixtures import COMPONENTS, DEGREES, JACCARD

THIRD, EIGHTH = 1 / 3, 0.125
BY_EDGE = {("1", "2"): THIRD, ("3", "4"): THIRD, ("5", "6"): THIRD, ("7", "8"): 0.0} | {(k, "7"): EIGHTH for k in "123456"}


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", [n for n in programs.PROGRAMS if not n.startswith("communities")])
def test_built_in_graph(spark, name):
    out = programs.run(spark, name, [])
    if name.endswith("degrees"):
        assert rows(out) == set(DEGREES.items())
    elif name == "count-skewed":
        assert rows(out) == {(0,)}
    elif name.startswith("components"):
        assert rows(out) == {(k, 1) for k in "1234"}
    elif name.startswith("triangles"):
        assert rows(out) == {(3,)}
    elif name.endswith("gsa"):
        assert {(a, b): v for a, b, v in rows(out)} == BY_EDGE
    else:
        assert {r[0]: r[1] for r in out.collect()}["7"] == {k: EIGHTH for k in "123456"} | {"8": 0.0}


def lines(path):
    return sorted(x for p in path.glob("part-*") for x in p.read_text().splitlines())


def test_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# edges\n" + "".join(f"{a}\t{b}\n" for a, b in COMPONENTS))
    (tmp_path / "v.csv").write_text("1,10\n2,20\n3,5\n4,40\n")
    (tmp_path / "j.tsv").write_text("".join(f"{a}\t{b}\n" for a, b in JACCARD))
    at = lambda x: str(tmp_path / x)
    assert programs.run(spark, "components", [at("c.tsv"), at("v.csv"), at("o1"), "4"]) is None
    assert lines(tmp_path / "o1") == ["1,5", "2,5", "3,5", "4,5"]
    programs.run(spark, "components-split", [at("c.tsv"), at("o2"), "4", "2", "4", "2"])
    assert lines(tmp_path / "o2") == ["1,1", "2,1", "3,1", "4,1"]
    programs.run(spark, "components-gsa", [at("j.tsv"), at("o3"), "4"])
    assert lines(tmp_path / "o3")[0] == "1 1"
    programs.run(spark, "jaccard", [at("j.tsv"), at("o4")])
    assert "1,{2=0.3333333333333333, 7=0.125}" in lines(tmp_path / "o4")


def test_usage(spark, tmp_path, capsys):
    assert programs.run(spark, "triangles-split", ["edges", "out"]) is None
    assert programs.main([]) == 0 and programs.main(["nothing"]) == 2
    said = capsys.readouterr().err
    assert "usage: triangles-split <edges> <out> <alpha> <level> <threshold>" in said and "jaccard-split-gsa" in said
