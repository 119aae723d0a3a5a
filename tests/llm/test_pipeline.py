"""The pipeline on a small table: each stage alone and all in order."""

import corpus_pipeline
from faultline.llm import pipeline_stages as stages

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        stages.language_stage, stages.quality_stage, stages.near_copy_stage, stages.decontamination_stage, stages.segmentation_stage]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7)], docs.schema)
    docs = docs.unionByName(odd)
    ids = lambda frame: [r.doc_id for r in frame.select("doc_id").collect()]
    spoken = stages.language_stage(spark, docs, SF)
    assert spoken.schema == docs.schema and set(ids(docs)) - set(ids(spoken)) == {9001, 9002}
    good = stages.quality_stage(spark, spoken, SF)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(ids(spoken)) - set(ids(good))
    # What goes is labelled junk or toxic, or has no label; no clean good document goes, no junk stays.
    assert gone and all(labels.get(i, (0, 0)) != (1, 0) for i in gone)
    assert any(labels.get(i) == (1, 1) for i in gone)
    assert not any(labels.get(i, (1, 0))[0] == 0 for i in ids(good))
    single = stages.near_copy_stage(spark, good, SF)
    texts = [r.text for r in single.select("text").collect()]
    assert len(texts) == len(set(texts)) and 0 < len(texts) < good.count()
    clean = stages.decontamination_stage(spark, single, SF)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(item in r.text for r in clean.collect() for item in items)
    assert clean.columns == docs.columns
    out = stages.segmentation_stage(spark, clean, SF).collect()
    assert {r.doc_id for r in out} == set(ids(clean)) and all(r.round_trip for r in out)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "lang", "source", "sample"] and out.count() > 0


def test_stages_of_nothing(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []
