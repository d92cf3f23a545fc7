"""The registered queries and the pipeline over the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import registry
from quarry.llm.common import table


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, key):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = c.execute(registry.oracle_sql()[key])
    names = [d[0] for d in found.description]
    df = registry.queries()[key](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_pipeline(spark, sf_dir):
    """Each stage against a plain version of its own input."""
    from tests.llm.test_documents import brute_components, plain_measures

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    texts = {}
    for name, f in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = f(spark, docs, sf_dir).cache()
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert all(before[i] == t for i, t in after.items()) and len(after) == out.count()
        if name == "quality_rules":
            assert all(plain_measures(t)[0] >= 50 for t in after.values())
        if name == "exact_dedup":
            assert len({"".join(t.split()) for t in after.values()}) == len(after) == len({"".join(t.split()) for t in before.values()})
        if name == "near_dedup":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items()), 5).items() if i == c}
        if name == "mixing":
            assert after == before
        docs, texts = out, after
    assert texts
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_steps_are_deleted(spark, sf_dir, tmp_path, monkeypatch):
    """What operators write goes with their scratch; the pipeline leaves its last stages' steps alone."""
    from quarry.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("quarry_prints")}
    before = tables()
    docs = table(spark, sf_dir, "documents")
    with common.scratch(spark) as keep:
        out = keep(common.stage(registry.exact_dedup.drop_copies(docs), "kept"))
    assert [p.name for p in tmp_path.iterdir()] == [out._quarry_path.rpartition("/")[2]] and out.count() > 0 and tables() == before
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = {p.name.split("-")[1] for p in tmp_path.iterdir()} - {"kept"}
    assert not left & {"prints", "features", "classes", "groups"} and tables() == before


def test_pipeline_of_odd_tables(spark, sf_dir):
    """An empty table, and one with nulls in every column, repeated rows and columns whose names the operators use."""
    long = " ".join(f"the word{i} of a sentence" for i in range(40))
    rows = [(1, long, None, "en", 5), (None, long + " more", "s", None, None), (3, None, None, None, None), (1, long, None, "en", 5), (4, long.upper() + " x", "s", "en", 1), (5, " ".join(f"a {i} and the {i * i} of it." for i in range(60)), None, None, 2)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    for given in (spark.createDataFrame([], schema), spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], schema + ", _row long, position string")):
        docs, total = given, given.count()
        for name, f in corpus_pipeline.STAGES:
            out = f(spark, docs, sf_dir).cache()
            if name != "packing":
                assert out.columns == given.columns and out.count() <= total
                docs = out
        assert (out.count() > 0) == (total > 0)
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and (total == 0 or {1, 5} & {r.doc_id for r in docs.collect()})
