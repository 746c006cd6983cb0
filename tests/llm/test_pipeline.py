import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import common, decontaminate, packing, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = now
        now = common.stored(stage(spark, before, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == columns
            seen.append(now.count())
            assert now.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if k == 0:
            scores = quality.score_quality(docs, quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet")))
            assert now.count() == scores.where("score >= 0.3").count()
        if k == 1:
            assert now.select("text").distinct().count() == now.count()
        if k == 3:
            kept = decontaminate.find_contamination(now, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert kept.where("n_hit > 0").count() == 0
            clean = decontaminate.find_contamination(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit = 0").count()
            assert now.count() == clean
            packed = now
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    want = packing.pack_documents(packed).groupBy("doc_id").sum("length").collect()
    got = now.groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    used = np.array([r[1] for r in now.groupBy("sequence_id").sum("length").collect()])
    assert used.max() <= packing.WINDOW


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (None, "", "en", "s", 0), (4, "plain words in a row", None, "s", 20)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.collect()} >= {1, 4}
    assert got.where("doc_id = 1 and start = 0").count() == 1  # a piece for each start of a document, which packing may cut


@pytest.mark.parametrize("empty", [{"documents"}, {"labels"}, {"benchmark"}, {"documents", "labels", "benchmark"}])
def test_empty_tables(spark, tmp_path, empty):
    tables = {
        "documents": ([(k, f"text {k} of words that differ in {k * 7}", "en", "s", 40) for k in range(6)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, "nothing of this")], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame([] if name in empty else rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == (set() if "documents" in empty else set(range(6)))
