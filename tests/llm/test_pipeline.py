import corpus_pipeline
from fieldmill.llm import op08_bpe


def test_stages_and_columns(spark, sf_dir, odd_docs, tmp_path):
    docs = odd_docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns, name
        found.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_equals_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0 < len(kept) < len(texts) and len(set(kept.values())) == len(kept)
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == set(kept)
    with open(op08_bpe.default_vocabulary(), "rb") as f:
        model = op08_bpe.encoder(f.read())
    assert all(rows[i]["n_tokens"] == len(model.encode(t)) // 4 for i, t in kept.items())


def test_empty_input(spark, sf_dir, no_docs):
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
