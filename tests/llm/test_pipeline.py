"""The pipeline's stages over a small table, each held against its own input."""

import collections

import corpus_pipeline
from sahifa.llm import queries


def test_stages(spark, tmp_path, documents):
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns, name
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, out))
        assert after <= before
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    counts = collections.Counter(r["doc_id"] for r in final)
    assert counts == collections.Counter(r["doc_id"] for r in docs.collect()) and all(r["n_tokens"] == len(r["ids"]) for r in final)


def test_empty_table(spark, tmp_path, no_documents):
    no_documents.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
