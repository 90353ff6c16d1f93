"""Queries over tables in which one group is larger than a rank cut."""

from lexigrove.plans import registry


def test_gold_set_has_no_rank_cut(spark, tmp_path):
    passage = "the quick brown fox jumps over the lazy dog"
    rows = [(i, f"{passage} number{i}", "en", f"src{i % 3}", 50) for i in range(50)] + [(99, "other words only", "en", "src0", 16)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, passage)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = registry.QUERIES["ir_metrics"](spark, str(tmp_path)).first()
    assert found["n_relevant"] == 50 and found["precision_30"] == 1 and found["recall_30"] == 0.6
    assert registry.QUERIES["ir_summary"](spark, str(tmp_path)).where("level = 'all'").first()["recall_10"] == 0.2
    assert registry.QUERIES["like_channel"](spark, str(tmp_path)).count() == 32


def test_parity_covers_every_document(spark):
    folder = "/root/testdata/sf0.001"
    ids = lambda name: {r["doc_id"] for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()}
    found = registry.QUERIES["coverage_gate"](spark, folder).where("rule = 'parity'")
    assert {int(r["key"]) for r in found.collect()} == ids("documents") - ids("labels")
