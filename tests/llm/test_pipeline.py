"""Stages on the small tables and on odd rows; each stage against its operator's own verdict."""

import os

import pytest

import corpus_pipeline
from skycolumn.llm import near_dedup, perplexity, quality_rules

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    trusted = perplexity.trusted_of(spark.read.parquet(f"{SF}/labels.parquet"))
    verdicts = [lambda d: {r.id for r in perplexity.judge(d, trusted).collect() if r.kept}, lambda d: {r.doc_id for r in quality_rules.classify(d).collect() if r.kept},
                lambda d: {r.doc_id for r in near_dedup.similarity_groups(d).collect() if r.kept}, lambda d: {r.doc_id for r in d.collect()}]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == docs.columns
            assert {r.doc_id for r in out.select("doc_id").collect()} == verdicts[i](docs)
        if name == "quality_rules":
            left = {r.doc_id for r in out.select("doc_id").collect()}
            good = [k for k, q in labels.items() if q == 1]
            assert not any(q == 0 and k in left for k, q in labels.items())
            assert sum(k in left for k in good) > 0.93 * len(good)  # texts under 50 words go by the base rule
        if i < 4:
            docs = out
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, rows in enumerate([[], [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "a b c " * 30, "en", None, None)]]):
        folder = tmp_path / str(k)
        folder.mkdir()
        os.symlink(tmp_path / "labels.parquet", folder / "labels.parquet")
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
