"""Dotted numbers of long documents."""

from lexigrove.plans import registry


def test_identifiers_have_no_cap(spark, tmp_path):
    numbers = [f"{i}.{i + 1}" for i in range(1, 21)]
    spark.createDataFrame([(1, " and ".join(numbers), "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["identifiers"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r["clause"] for r in found] == numbers and [r["place"] for r in found] == list(range(20))
