"""The pipeline, stage by stage, against plain versions of each stage."""

import corpus_pipeline
import pytest
from conftest import SMALL

from raysheaf.llm import byte_bpe, decontaminate, quality


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    frame = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, frame = frame, stage(spark, frame, SMALL)
        kept = {r.doc_id for r in frame.select("doc_id").collect()}
        assert kept <= ids, name
        if i < 4:
            assert frame.columns == columns
            frame = frame.cache()
        if name == "quality classifier":
            wanted = quality.resample(before, spark.read.parquet(f"{SMALL}/labels.parquet")).where("selected")
            assert kept == {r.doc_id for r in wanted.collect()} 
        elif name == "exact dedup":
            last = {}
            for d in sorted(ids):
                last[texts[d]] = d
            assert kept == set(last.values())
        elif name == "simhash near-dedup":
            def shingles(d):
                w = texts[d].lower().split()
                return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

            alike = lambda a, b: len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
            assert all(max(alike(d, k) for k in ids if k != d) >= 0.8 for d in ids - kept)  # nothing goes that has no near copy
            assert not any(alike(a, b) >= 0.8 for a in kept for b in kept if a < b)
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            judged = {d: decontaminate.brute_force(texts[d], items) for d in ids}
            assert kept == {d for d, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
        else:
            assert kept == ids
            import hashlib

            import public_tokenizers as public

            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in frame.collect())

            back = byte_bpe.decode(frame, public.path("byte_bpe_multi_50k.tiktoken")).collect()
            assert all(bytes(r.decoded).decode() == texts[r.doc_id] for r in back)
        ids = kept


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and 0 < out.count() < 200


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_no_rows(spark, stage):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert stage[1](spark, docs, SMALL).count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect()
    good = [r for r in base if len(r.text.split()) > 30][:6]
    rows = [(r.doc_id, r.text, r.lang, "k", 1) for r in good] * 2  # every row twice
    rows += [(good[0].doc_id, "another text under an id that is taken", None, None, None), (None, good[1].text, None, "k", 2), (None, "a text without an id, of some words", "en", None, 3)]
    rows += [(7001, None, None, None, None), (7002, "", None, None, None), (7003, "", "en", "k", 1), (7004, "lorem ipsum dolor " * 40_000, "en", "k", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, __row string, node long")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    frame = spark.read.parquet(str(tmp_path / "docs"))
    texts = {r.text or "" for r in frame.collect()}
    frame = corpus_pipeline.STAGES[1][1](spark, frame, SMALL)
    out = frame.collect()
    assert frame.columns == docs.columns and sorted(r.text or "" for r in out) == sorted(texts)
    assert {r.doc_id for r in out if r.text == good[1].text} == {good[1].doc_id} and {r.doc_id for r in out if not r.text} == {7003}
    frame = corpus_pipeline.STAGES[2][1](spark, frame, SMALL)
    assert frame.columns == docs.columns and {r.text for r in frame.collect()} <= texts and frame.where("doc_id is null").count() == 1
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SMALL)
        assert got.count() <= len(rows) and (got.columns == docs.columns or name == "byte-level bpe"), name
