"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from vitrine.llm import mixing, packing
from vitrine.llm.queries import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    extra = [(900_001, None, "en", None, 0), (900_002, "", None, "src1", 0), (900_003, docs.first()["text"], "en", "src2", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = {"input": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, corpus_pipeline.write_table(stage(spark, docs, SF_DIR), name)
        if name != "pack":
            assert docs.columns == given.columns
        out[name] = docs.collect()
    return out


def shingles(text):
    w = brute.WORD.findall(brute.lower(text))
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_quality_filter(stages):
    kept = {r.doc_id for r in stages["quality_filter"]}
    assert kept <= {r.doc_id for r in stages["input"]} and 0.5 < len(kept) / len(stages["input"]) < 1


def test_near_dedup(stages):
    docs = sorted(stages["quality_filter"], key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = brute.components(len(docs), links)
    want = {r.doc_id for i, r in enumerate(docs) if root[i] == i}
    got = {r.doc_id for r in stages["near_dedup"]}
    assert want <= got and len(got - want) <= 1 + 0.05 * len(docs)


def test_passage_dedup(stages):
    docs = [(r.doc_id, r.text) for r in stages["near_dedup"]]
    removed = {d: n for d, _, n, _ in brute.substring(docs)}
    words = {d: brute.WORD.findall(t or "") for d, t in docs}
    got = {r.doc_id: brute.WORD.findall(r.text) for r in stages["passage_dedup"]}
    assert all(len(got.get(d, [])) == len(words[d]) - removed[d] for d in words)
    assert all(r.n_chars == len(r.text) for r in stages["passage_dedup"])


def test_mix(spark, stages):
    size = lambda rows: sum(len(brute.WORD.findall(r.text or "")) for r in rows)
    before, after = stages["passage_dedup"], stages["mix"]
    plan = mixing.mix_sources(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert size(after) == sum(r.taken for r in plan)
    for d in {r.doc_id for r in before}:
        assert size([r for r in after if r.doc_id == d]) == sum(r.taken for r in plan if r.doc_id == d)
    whole = {r.doc_id: set(brute.WORD.findall(r.text)) for r in before}
    assert all(set(brute.WORD.findall(r.text)) <= whole[r.doc_id] for r in after)


def test_pack(stages):
    tokens = {}
    for r in stages["pack"]:
        tokens.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in tokens.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert {r.doc_id for r in stages["pack"]} == {r.doc_id for r in stages["mix"]}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_run_is_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_dedup", "passage_dedup", "mix", "pack"]
    assert corpus_pipeline.run(spark, SF_DIR).agg(F.sum("length")).first()[0] > 0


def test_an_idle_worker_gives_up_its_encoder(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_S", 0.2)
    first = packing._encoder(tokenizer_path())
    packing._rest()
    assert packing._encoder(tokenizer_path()) is first  # the next task came in time
    time.sleep(0.6)
    assert packing._ENCODERS
    packing._rest()
    time.sleep(1)
    assert not packing._ENCODERS
