"""The corpus pipeline's stages on their own input."""

import corpus_pipeline as pipeline
from meshjoin.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "sentencepiece"]
    scratch = Scratch(spark, "test")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = scratch.keep(stage(spark, docs, SF), name)
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before and len(after) > 0.7 * len(before)
        assert docs.columns == columns or name == "sentencepiece"
    assert docs.where("not round_trip").count() == 0
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id").collect()} == set(after)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_go_by_row(spark):
    """Rows that repeat an id and a text, near copies without an id, and an id with a linked and a clean text."""
    t = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(1, t[0]), (1, t[0]), (5, t[0] + " end"), (5, t[1]), (None, t[2]), (None, t[2] + " end"), (None, t[2]), (7, t[3]), (None, t[3]), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    found = sorted(((r.doc_id, (r.text or "").removesuffix(" end")) for r in got.collect()), key=str)
    assert found == sorted([(1, t[0]), (5, t[1]), (None, t[2]), (7, t[3]), (8, ""), (8, "")], key=str)
