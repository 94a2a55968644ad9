"""The pipeline's stages on the smallest documents."""

import public_tokenizers

import corpus_pipeline
from ticklattice.llm import bpe, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= kept
        kept = docs.count()
        if name == "tokens":
            want = {r["doc_id"]: len(bpe.encode(r["text"], public_tokenizers.path("byte_bpe_50k.tiktoken"))) for r in before.collect()}
            assert {r["doc_id"]: r["n_tokens"] for r in docs.collect()} == want
        else:
            assert docs.columns == columns
        if name == "toxicity":
            want = toxicity.score(before, toxicity.trained(spark, SF)).where("predicted = 0")
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r["doc_id"] for r in want.collect())
        if name == "secrets":
            assert not [r for r in docs.collect() if "AKIA" in r["text"]]
