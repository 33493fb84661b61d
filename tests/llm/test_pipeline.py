import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import __spark_entry__ as entry  # noqa: E402


def test_stages_and_run(spark, sf_dir, corpus):
    docs = corpus
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == corpus.columns, name
        docs = spark.createDataFrame(out.collect(), corpus.schema)
        assert docs.count() > 0
    assert docs.filter("text RLIKE 'AKIA[A-Z0-9]{14}'").count() == 0
    pieces = corpus_pipeline.run(spark, sf_dir)
    totals = [r.n for r in pieces.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert totals and all(n <= 2048 and n & (n - 1) == 0 for n in totals)


def test_stages_on_awkward_rows(spark, sf_dir, awkward, none):
    docs, empty = awkward, none
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, sf_dir), stage(spark, empty, sf_dir)
        assert empty.count() == 0 and docs.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == awkward.columns


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 14))
