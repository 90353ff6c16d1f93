"""Reports, activation, nested values and templates."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lexigrove.functions import nested
from lexigrove.operators import activation, reports
from lexigrove.sources import templates


def test_categories_and_levels(spark):
    rows = spark.createDataFrame([("r", "a", 1, "Crack-Line", "low"), ("r", "b", 1, "crack line", "high"), ("r", "b", 2, "x", "medium")], "run_id string, image_name string, finding_index int, label string, level string")
    rows = rows.withColumn("category", reports.category_of(F.col("label"), {"crackline": "crack"}))
    got = {r["category"]: (r["n"], r["n_images"], r["highest"]) for r in reports.by_category(rows).collect()}
    assert got == {"crack": (2, 2, "high"), "other": (1, 1, "medium")}
    value = reports.template_values(rows, ["crack", "spall"]).first()
    assert (value["crack_count"], value["crack_level"], value["spall_count"], value["spall_level"], value["total_count"]) == (2, "high", 0, None, 3)
    assert reports.overall_level(rows).first()["level"] == "high" and reports.overall_level(rows.limit(0)).first()["level"] == "undetermined"


def test_lines_and_review(spark):
    findings = spark.createDataFrame([(1, "a", 1, "crack", "高"), (2, "b", 1, "other", "low")], "position int, image_name string, finding_index int, category string, level string")
    images = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "image_name string, pos int, path string")
    rules = spark.createDataFrame([("crack", "inject")], "category string, method string")
    got = [tuple(r) for r in reports.repair_lines(findings, images, rules).orderBy("line_id").select("line_id", "level", "method", "path").collect()]
    assert got == [("W-001", "high", "inject", "new"), ("W-002", "low", "review", None)]
    items = spark.createDataFrame([("x", "draft", "fixed")], "id string, note string, key string")
    edits = spark.createDataFrame([("x", "seen", "hacked")], "id string, note string, key string")
    assert tuple(reports.merge_review(items, edits, "id", ["note"]).first()) == ("x", "seen", "fixed")
    ready = spark.createDataFrame([("a", "me", ["low"], 1, 1), ("b", " ", ["undetermined"], 1, 2)], "report_id string, reviewer string, levels array<string>, n_expected int, n_actual int")
    assert {(r["rule"], r["report_id"]) for r in reports.review_ready(ready).collect()} == {("reviewer_missing", "b"), ("level_undetermined", "b"), ("correspondence", "b")}
    drafts = spark.createDataFrame([("p", 1, ["a", "b"]), ("p", 2, ["b", "c", "a"])], "plan string, draft_no int, notes array<string>")
    assert reports.unique_append(drafts, "plan", "notes").first()["notes"] == ["a", "b", "c"]


def test_citations(spark):
    rows = spark.createDataFrame([("[KB:d1:page:1]", "d1", "A.pdf"), ("[KB:d1:page:2]", "d1", "A.pdf"), ("[KB:d1:page:2]", "d1", "B.pdf"), ("[KB:d2:page:1]", "d9", "C.pdf")], "marker string, document_id string, source_name string")
    catalog = reports.citation_catalog(rows)
    assert [r["marker"] for r in catalog.collect()] == ["[KB:d1:page:1]"]
    texts = spark.createDataFrame([(1, "see [KB:d1:page:1] and [KB:zz:page:9] or [KB:d1:pa"), (2, "none")], "answer_id int, text string")
    got = {r["answer_id"]: r["text"] for r in reports.render_citations(texts, catalog).collect()}
    assert got == {1: "see [A.pdf] and [unverified] or ", 2: "none"}
    paths = spark.createDataFrame([([["a", "b", "c"], ["a", "b", "x"]],), ([["a"], ["b"]],), ([],)], "p array<array<string>>")
    assert [r[0] for r in paths.select(reports.common_heading(F.col("p"))).collect()] == [["a", "b"], [], []]


def test_profile_query(spark):
    rows = spark.createDataFrame([("r", 1, "Wall  crack"), ("r", 2, "wall crack"), ("r", 3, "C:\\x"), ("r", 4, "deadbeefdeadbeef"), ("r", 5, "epoxy"), ("r", 6, "{}")], "report_id string, position int, value string")
    assert reports.profile_query(rows).first()["query"] == "Wall crack epoxy"


def test_activation(spark, tmp_path):
    pointer = str(tmp_path / "active.json")
    gate = lambda ok: lambda s, p: s.createDataFrame([(ok,)], "passed boolean")
    digest = lambda s, p: os.path.basename(p)
    assert activation.status(spark, pointer, digest)["state"] == "missing"
    activation.activate(spark, pointer, "/x/one", gate(True), digest)
    with pytest.raises(RuntimeError, match="1 of 1 gates failed"):
        activation.activate(spark, pointer, "/x/two", gate(False), digest)
    changing = iter("ab")
    with pytest.raises(RuntimeError, match="changed"):
        activation.activate(spark, pointer, "/x/two", gate(True), lambda s, p: next(changing))
    activation.activate(spark, pointer, "/x/two", gate(True), digest)
    assert activation.status(spark, pointer, digest)["snapshot"] == "/x/two" and activation.rollback(pointer)["snapshot"] == "/x/one"
    activation.deactivate(pointer)
    assert activation.status(spark, pointer, digest)["state"] == "inactive"
    with activation.exclusive(f"{pointer}.lock"), pytest.raises(TimeoutError):
        activation.deactivate(pointer)


def test_nested(spark):
    value = {"api_key": "k", "p": ["C:\\a\\b.txt", {"t": "use sk-abcdefgh12345"}], "u": {"url": "https://x.org", "title": "X"}}
    assert nested.sanitise(value) == {"api_key": "", "p": ["b.txt", {"t": "use <redacted>"}], "u": {"url": "https://x.org", "title": "X"}}
    assert nested.absolute_paths(value) == ["$.p[0]"] and nested.url_citations(value) == {"https://x.org": "X"}
    row = spark.createDataFrame([('{"token": "x", "a": 1}',)], "j string").select(nested.sanitise_json("j").alias("s"), nested.path_places("j").alias("p")).first()
    assert row["s"] == '{"a": 1, "token": ""}' and row["p"] == []
    assert nested.strict_schema({"properties": {"a": {"default": 1}}}) == {"properties": {"a": {}}, "required": ["a"], "additionalProperties": False}


def test_templates(spark):
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>{{na</w:t></w:r><w:r><w:t>me}} {{#each rows}}[{{n}}]{{/each}} {{gone}}</w:t></w:r></w:p>")
    assert templates.placeholders(body.getvalue()) == ["name", "n", "gone"]
    with zipfile.ZipFile(io.BytesIO(templates.render(body.getvalue(), {"name": "A&B", "rows": [{"n": 1}, {"n": 2}]}))) as z:
        assert "A&amp;B [1][2] {{gone}}" in z.read("word/document.xml").decode()
    rows = spark.createDataFrame([("r", i, n) for i, n in enumerate((50, 500, 60, 70, 10))], "report_id string, position int, n_bytes int")
    assert [r["reason"] for r in templates.attachments(rows, 3, 100, 150).orderBy("position").collect()] == ["included", "too_large", "included", "total", "count"]
    assert templates.fit_inside(200, 100, 50, 50) == (50, 25) and templates.shrink(lambda s, q: b"x" * int(s * q), 45)[2] == 50


def test_citation_catalog_keeps_one_name_a_marker(spark):
    rows = [
        (" [KB:d1:p 1] ", "d1", "/a/x.pdf"), ("[KB:d1:p 1]", "d1", "C:\\b\\x.pdf"), ("[KB:d1:p 2]", "d1", "x.pdf"), ("[KB:d1:p 2]", "d1", "y.pdf"),
        ("[KB:d2:p 1]", "d1", "x.pdf"), ("[KB:d3:]", "d3", "x.pdf"), ("[KB:d4:p]", "d4", "/a/b/ "), ("[KB:d5:p]", "d5", None), (None, "d6", "x.pdf"), ("[KB:d7:p] and more", "d7", "x.pdf"),
    ]
    found = reports.citation_catalog(spark.createDataFrame(rows, "marker string, document_id string, source_name string"))
    assert [tuple(r) for r in found.where("document_id <> 'd4'").collect()] == [("[KB:d1:p 1]", "d1", "x.pdf", "p 1")]


def test_references_to_what_was_not_retrieved(spark):
    kind = "draft_id int, marker string"
    asked = spark.createDataFrame([(1, "[KB:d:p]"), (1, " [KB:e:p]"), (1, "[KB:e:p]"), (2, "[KB:d:p]"), (2, None), (2, " ")], kind)
    known = spark.createDataFrame([(1, "[KB:d:p]"), (3, "[KB:d:p]"), (2, None)], kind)
    assert sorted(map(tuple, reports.unknown_references(asked, known).collect())) == [(1, "[KB:e:p]"), (2, "[KB:d:p]")]
    assert reports.unknown_references(asked.limit(0), known).count() == 0
