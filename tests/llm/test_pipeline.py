"""The pipeline's stages: what they keep, and that each works on its predecessor's rows."""

import corpus_pipeline
from tests.conftest import SMALL
from vacantia.llm import lines, simhash


def test_stages_one_after_the_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{len(seen)}")
    first, deduped, apart, mixed, encoded = seen.values()
    assert first.count() == 200
    left = [n for r in deduped.collect() for _, n in lines.eligible(r["text"])]
    assert len(left) == len(set(left))
    kept = [simhash.fingerprint(r["text"]) for r in apart.collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(kept) for b in kept[:i])
    assert encoded.count() == mixed.count() and encoded.where("not exact").isEmpty()


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0
