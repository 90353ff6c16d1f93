"""The eight activation gates on a small index, sound and with every fault."""

import pytest
from pyspark.sql import functions as F

from lexigrove.operators import activation_gates as a
from lexigrove.operators import gates


@pytest.fixture
def index(spark):
    documents = spark.createDataFrame(
        [("d1", "/d1.pdf", "d1.pdf", "aa", 0.9, "index.v2", 2, [], []), ("d2", "/d2.pdf", "d2.pdf", "bb", 0.65, "index.v3", 1, [], None)],
        "document_id string, source_path string, source_name string, source_sha256 string, quality_score double, index_version string, page_count int, failed_pages array<int>, severe_warnings array<string>",
    )
    pages = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 1)], "document_id string, page_number int")
    chunks = spark.createDataFrame([("c1", "d1", "retrieval", "one"), ("c2", "d2", "retrieval", "two"), ("p1", "d1", "context_only", ""), ("c3", "d2", "retrieval", "")], "chunk_id string, document_id string, retrieval_role string, text_search string")
    return {"documents": documents, "pages": pages, "chunks": chunks, "postings": chunks.where("text_search <> ''").select("chunk_id")}


@pytest.fixture
def inputs(spark):
    expected = spark.createDataFrame([("q", "what", ["d1"], [], [])], "name string, query string, expected_document_ids array<string>, expected_standards array<string>, expected_tokens array<string>")
    return {
        "expected": expected, "outcomes": spark.createDataFrame([("q", True)], "name string, passed boolean"), "manifest": spark.createDataFrame([(True, 2)], "required_passed boolean, document_count long"),
        "scopes": spark.createDataFrame([("s", ["d1", "d2"])], "name string, document_ids array<string>"),
    }


def rows(found):
    return {(r["gate"], r["rule"], r["key"]) for r in found.collect()}


def test_a_sound_index_passes_all(index, inputs):
    judged = a.judge(a.findings(index, **inputs, least_version=2))
    assert {(r["gate"], r["n_findings"], r["passed"]) for r in judged.collect()} == {(g, 0, True) for g in a.GATES}
    assert gates.decide(judged).first().asDict() == {"n_gates": 8, "n_failed": 0, "passed": True}


def test_every_fault_fails_its_gate(spark, index, inputs):
    bad = index["documents"].withColumns(
        {"source_sha256": F.lit("aa"), "source_name": F.when(F.col("document_id") == "d1", "d1.pdf"), "quality_score": F.when(F.col("document_id") == "d1", 0.64).otherwise(float("nan")),
         "failed_pages": F.when(F.col("document_id") == "d1", F.array(F.lit(2))), "severe_warnings": F.array(F.lit("ocr failed")), "page_count": F.lit(2)}
    )
    more = spark.createDataFrame([("c1", "d9", "retrieval", "x"), ("c4", "d1", "retrieval", "y")], index["chunks"].schema)
    tables = {**index, "documents": bad, "chunks": index["chunks"].unionByName(more)}
    changed = {
        "expected": inputs["expected"].withColumn("expected_document_ids", F.array(F.lit(" "))), "outcomes": inputs["outcomes"].withColumn("passed", F.lit(None).cast("boolean")), "manifest": inputs["manifest"].withColumns({"required_passed": F.lit(False), "document_count": F.lit(3)}),
        "scopes": spark.createDataFrame([("s", ["d1", "d8"]), ("e", []), ("n", None)], "name string, document_ids array<string>"),
    }
    assert rows(a.findings(tables, **changed, least_version=3)) == {
        ("schema", "index_version", "d1"), ("integrity", "not_unique", "c1"), ("integrity", "orphan", "d9"), ("integrity", "parity", "c4"),
        ("quality_metadata", "coverage_incomplete", "source_name"), ("quality_metadata", "coverage_incomplete", "quality_score"), ("quality_metadata", "duplicate_source_sha256", "aa"), ("quality_metadata", "failed_pages", "d1"),
        ("quality_metadata", "quality_below_threshold", "d1"), ("quality_metadata", "severe_warning", "d2"), ("quality_metadata", "page_coverage", "d2"),
        ("database_health", "gate_failed", "schema"), ("database_health", "gate_failed", "integrity"), ("database_health", "gate_failed", "quality_metadata"), ("no_duplicate_source_sha256", "duplicate_source_sha256", "aa"),
        ("representative_queries", "no_assertion", "q"), ("representative_queries", "not_met", "q"), ("build_manifest", "required_gate_failed", ""), ("build_manifest", "document_count_differs", ""),
        ("selected_scope_available", "unavailable_document", "s"), ("selected_scope_available", "empty_scope", "e"), ("selected_scope_available", "empty_scope", "n"),
    }


def test_missing_tables_and_empty_inputs(spark, index, inputs):
    lacking = {**{k: v for k, v in index.items() if k != "postings"}, "pages": index["pages"].drop("page_number")}
    found = a.findings(lacking, manifest=inputs["manifest"])
    assert {("schema", "missing_table", "postings"), ("schema", "missing_column", "pages"), ("integrity", "not_checked", ""), ("representative_queries", "no_expectations", ""), ("build_manifest", "document_count_differs", "")} <= rows(found)
    assert not gates.decide(a.judge(found)).first()["passed"]
    none = {k: v.limit(0) for k, v in index.items()}
    empty = rows(a.findings(none, **{k: v.limit(0) for k, v in inputs.items()}))
    assert empty == {("database_health", f"no_{t}", "") for t in ("documents", "retrieval_rows", "postings")} | {("representative_queries", "no_expectations", ""), ("build_manifest", "manifest_invalid", ""), ("selected_scope_available", "no_scopes", "")}


def test_document_records(spark):
    from lexigrove.operators.corpus import document_records

    documents = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "document_id string, title string")
    pages = spark.createDataFrame(
        [("a", n, ["ocr:page"] if n % 2 else [None, "native"], ["blur"] if n > 3 else None, n == 1) for n in range(1, 50)] + [("a", 50, None, [], None), ("a", 4, None, ["again"], None), ("b", None, [], ["w"], True)],
        "document_id string, page_number int, methods array<string>, warnings array<string>, needs_review boolean",
    )
    chunks = spark.createDataFrame([("a", "retrieval", True), ("a", "retrieval", None), ("a", "context_only", True), ("z", "retrieval", True)], "document_id string, retrieval_role string, is_cross_page boolean")
    got = {r["document_id"]: r.asDict() for r in document_records(documents, pages, chunks).collect()}
    assert got["a"]["review_pages"] == [1, *range(4, 33)] and [got["a"][k] for k in ("n_pages", "n_ocr_pages", "n_native_pages", "n_warning_pages", "n_review_pages", "n_children", "n_cross_page_children", "title")] == [51, 25, 26, 47, 1, 2, 1, "x"]
    assert got["b"]["review_pages"] == [] and got["b"]["n_warning_pages"] == 1 and got["c"]["n_pages"] == 0 and got["c"]["review_pages"] == [] and len(got) == 3
    assert document_records(documents.limit(0), pages, chunks).count() == 0
