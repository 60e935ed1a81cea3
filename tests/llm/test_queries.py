"""The queries that have SQL against it, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from ramify.llm import packing, queries, secrets, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    own = queries.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(own.columns) == columns
    rows = lambda x: sorted(map(tuple, x[columns].astype(object).values.tolist()), key=repr)
    assert rows(own) == rows(want)


def test_stages(spark, tmp_path):
    """Each stage on what its predecessor kept, against the operators' brute-force versions."""
    from tests.llm.test_operators import brute_groups, brute_lines, brute_secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        kept[name] = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert kept[name].columns == docs.columns
        docs = kept[name]
    texts = lambda df: {r["doc_id"]: r["text"] or "" for r in df.collect()}
    lexicon = toxicity.learn_from(spark, SF)
    first, second, third, fourth = (texts(kept[n]) for n in ("toxicity", "line_dedup", "near_dedup", "secrets"))
    source = texts(spark.read.parquet(f"{SF}/documents.parquet"))
    assert first == {i: t for i, t in source.items() if toxicity.score(t, lexicon) < toxicity.THRESHOLD}
    import hashlib

    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in second.items()} == {r[0]: r[3] for r in brute_lines(list(first.items()))}
    assert third == {i: second[i] for i, _, _, stay in brute_groups(list(second.items())) if stay}
    assert set(fourth) == set(third) and not any(brute_secrets(t) for t in fourth.values())
    assert all(fourth[i] == t for i, t in third.items() if not brute_secrets(t) and not any(r.kind in t for r in secrets.RULES[3:]))
    run = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect()))
    assert run == sorted(map(tuple, kept["packing"].select("doc_id", "doc_tokens").distinct().collect()))
    assert run == sorted(map(tuple, packing.pack(kept["secrets"]).select("doc_id", "doc_tokens").distinct().collect()))
