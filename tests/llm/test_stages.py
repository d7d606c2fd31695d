"""The stages of the corpus pipeline on null and repeated ids, empty tables and clashing columns, and the whole pipeline on the smallest tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import decontaminate, segsample, simhash, suffixes, toxicity

SF = "/root/testdata/sf0.001"
STAGES = [toxicity.toxicity_stage, simhash.near_dedup_stage, suffixes.suffix_stage, decontaminate.decontaminate_stage, segsample.encode_stage]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfghjklm") for _ in range(7)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Columns of documents and ones with names that the stages use themselves."""
    rows = [(1, words(1, 40)), (None, words(2, 40)), (None, None), (5, ""), (5, words(3, 40)), (5, words(3, 40)), (6, words(4, 9000)), (7, words(1, 40) + " end"), (8, words(1, 40))]
    rows = [(i, t, "en", "s", len(t or ""), k, "v") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, seq string")


@pytest.mark.parametrize("stage", STAGES, ids=lambda f: f.__name__)
def test_stage_on_odd_rows_and_empty_tables(spark, docs, stage):
    out = stage(spark, docs, SF)
    rows = {r["score"]: r for r in out.collect()}
    source = {r["score"]: r for r in docs.collect()}
    want = {0, 1, 2, 3, 4, 5, 6} if stage is simhash.near_dedup_stage else set(source)
    assert set(rows) == want and out.count() == len(want)
    none = stage(spark, docs.where("false"), SF)
    assert none.count() == 0 and none.columns == out.columns
    if stage is segsample.encode_stage:
        decode = segsample.shared_words(segsample.default_model()).v.decode
        assert set(docs.columns) - {"text"} | {"samples"} == set(out.columns)
        for k, r in rows.items():
            assert all(decode(np.array(x["ids"])).decode() == (source[k]["text"] or "") for x in r["samples"]) and [r[c] for c in ("doc_id", "lang", "seq")] == [source[k][c] for c in ("doc_id", "lang", "seq")]
        return
    assert out.schema.simpleString() == docs.schema.simpleString()
    for k, r in rows.items():
        if stage is not suffixes.suffix_stage:
            assert r == source[k]
        else:
            assert r["n_chars"] == len(r["text"] or "") and [r[c] for c in ("doc_id", "lang", "seq")] == [source[k][c] for c in ("doc_id", "lang", "seq")]
    if stage is suffixes.suffix_stage:  # the copies lose their text, the first one none
        assert rows[0]["text"] == source[0]["text"] and rows[8]["text"] == "" and {rows[4]["text"], rows[5]["text"]} == {source[4]["text"], ""} and rows[7]["text"] == " end"[-len(rows[7]["text"]) :]


def test_toxicity_stage_drops_what_the_classifier_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in toxicity.toxicity_stage(spark, docs, SF).collect()}
    scored = toxicity.op1_toxicity(spark, SF).collect()
    assert kept == {r["doc_id"] for r in scored if r["predicted"] == 0} and 0 < len(kept) < len(scored)


def test_pipeline_end_to_end(spark):
    import corpus_pipeline as pipeline

    now = spark.read.parquet(f"{SF}/documents.parquet")
    total = now.count()
    for k, (_, stage) in enumerate(pipeline.STAGES):
        was, now = now, spark.createDataFrame((made := stage(spark, now, SF)).collect(), made.schema)
        if k < 4:
            assert now.columns == was.columns
    out = {r["doc_id"]: r for r in pipeline.run(spark, SF).collect()}
    assert {i: r["samples"] for i, r in out.items()} == {r["doc_id"]: r["samples"] for r in now.collect()}
    assert 0.3 * total < len(out) < total
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").where(F.length("text") > 60).collect()]
    decode = segsample.shared_words(segsample.default_model()).v.decode
    texts = [decode(np.array(r["samples"][0]["ids"])).decode() for r in out.values()]
    assert not any(b in t for b in bench for t in texts)
    assert len({zlib.crc32(t.encode()) for t in texts if t}) == len([t for t in texts if t])
