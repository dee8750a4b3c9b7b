import os

import pytest

import __spark_entry__
import corpus_pipeline
from tessera.llm import registry

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = list(registry.queries())
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)
    assert "pipeline" in __spark_entry__.queries() and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "packing"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_on_hard_rows(spark, corpus):
    docs, sizes = corpus, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == corpus.columns
        docs = spark.createDataFrame(out.collect(), corpus.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    kept = [r.doc_id for r in docs.collect()]
    assert len([k for k in kept if k is not None]) == len({k for k in kept if k is not None})
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted(r.doc_id or -1 for r in last.collect()) == sorted(k or -1 for k in kept)


def test_near_duplicates_keep_one_row_of_a_document(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1), "b", {"k": 1}), (1, text(2), "a", {"k": 2}), (1, text(1), "a", None), (2, text(1), "z", None), (3, text(3), None, None), (None, text(3), "q", None), (None, "", "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra map<string,int>")
    for parts in (1, 4):
        got = {(r.doc_id, r.text, r.lang) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(parts), DATA).collect()}
        assert got == {(1, text(1), "a"), (3, text(3), None), (None, text(3), "q"), (None, "", "q")}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run(spark):
    ids = [r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()]
    assert 0 < len(ids) == len(set(ids)) <= 200


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    want = c.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[x] for x in columns) for r in got.collect()) == sorted(want.fetchall())
