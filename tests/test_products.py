"""Whole searches, publication, catalog, page results and question sets on authored tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove import settings
from lexigrove.operators import benchmarks, catalog, pages, publish, reports, retrieval, search
from lexigrove.sources import files, remote

CHUNKS = "chunk_id string, document_id string, location string, part int, primary_page int, text string, text_search string, retrieval_role string, parent_id string, heading_path array<string>, standard_number string, clause_number string"


@pytest.fixture(scope="module")
def chunks(spark):
    c = lambda i, doc, text, role="retrieval", parent="", path=(): (i, doc, f"loc{i}", 0, 1, text, text, role, parent, list(path), "", "")
    return spark.createDataFrame(
        [
            c("a1", "d1", "crack width limit under load", parent="p1", path=["one"]), c("a2", "d1", "repair of a crack with epoxy", parent="p1", path=["one"]), c("a3", "d1", "curing takes days", parent="p1", path=["one"]), c("a4", "d1", "elsewhere", path=["two"]),
            c("p1", "d1", "parent of the first section", "context_only"), c("b1", "d2", "bridge deck crack crack"), c("b2", "d2", "steel corrosion"),
        ], CHUNKS,
    )


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([("d1", "Concrete Manual.pdf", "ready"), ("d2", "Bridges.pdf", "ready"), ("d3", "Gone.pdf", "failed")], "document_id string, source_name string, status string")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, text string, scope array<string>")


def test_production_search(spark, chunks, documents):
    found = search.production_search(chunks, documents, asked(spark, (1, "crack width", None), (2, "crack", ["d2"]), (3, "crack", [])), top_k=1)
    got = [(r["query_id"], r["chunk_id"], r["role"], r["context_for"]) for r in found.orderBy("query_id", "position").collect()]
    # the best passage of the first question brings its section and parent; a2, an anchor that was not kept, is context now
    assert got[0] == (1, "a1", "anchor", None) and {g[1] for g in got if g[0] == 1} == {"a1", "a2", "a3", "p1"} and all(g[3] == "a1" for g in got[1:4])
    assert [g for g in got if g[0] > 1] == [(2, "b1", "anchor", None)]
    short = search.production_search(chunks, documents, asked(spark, (1, "crack width", None)), top_k=1, max_chars=10).collect()
    assert [(r["chunk_id"], r["text"]) for r in short] == [("a1", "crack widt")]
    problems = {(r["query_id"], r["problem"], r["document_id"]) for r in search.scope_problems(chunks, asked(spark, (1, "x", None), (2, "x", []), (3, "x", ["d1", "d9"]))).collect()}
    assert problems == {(2, "empty_scope", None), (3, "unavailable_document", "d9")}


def test_plain_and_scoped_search(spark, chunks, documents):
    questions = asked(spark, (1, "Concrete Manual", None), (2, "epoxy", None), (3, "rack wid", None), (4, "epoxy", ["d2"]), (5, "xyzzy", ["d2"]))
    got = {}
    for r in search.plain_search(chunks, documents, questions, 2).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["mode"], r["chunk_id"]))
    assert got == {1: [("title", "a1"), ("title", "a2")], 2: [("lexical", "a2")], 3: [("like", "a1"), ("like", "a2")]} or got[3][0] == ("like", "a1")
    scoped = {r["query_id"]: r["mode"] for r in search.scoped_search(chunks, documents, questions, 1).collect()}
    assert scoped == {4: "scoped_fallback", 5: "scoped_fallback"}
    status = {r["query_id"]: (r["relevance_status"], r["scope_available"]) for r in search.semantic_result(chunks, questions, spark.createDataFrame([(1,)], "query_id int"), F.when(F.col("query_id") == 5, "down")).collect()}
    assert status == {1: ("hit", True), 2: ("no_hit", True), 3: ("no_hit", True), 4: ("no_hit", True), 5: ("unavailable", True)}


def test_channels_equal_plain_versions(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "crackle", "12.5"], 6)) for _ in range(120)]
    rows = [(f"c{i:03d}", f"d{i % 7}", f"l{i % 5}", 0, 1, t, t, "retrieval", "", [], "", "") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, CHUNKS).repartition(5)
    questions = [(1, "crack alp", None), (2, "beta 12.5", ["d1", "d3"]), (3, "zeta", None), (4, "gamma", [])]
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.like_channel(chunks, asked(spark, *questions), 9).collect()}
    want = {}
    for q, text, scope in questions:
        held = sorted((r[1], r[2], r[0]) for r in rows if any(t in r[6] for t in text.split()) and (scope is None or r[1] in scope))
        want |= {(q, n): key[2] for n, key in enumerate(held[:9], 1)}
    assert got == want
    vectors = rng.normal(size=(300, 8)).round(1)
    vectors[5] = vectors[6]
    v = spark.createDataFrame([(f"v{i:03d}", f"d{i % 4}", x) for i, x in enumerate(vectors.tolist())], "chunk_id string, document_id string, embedding array<double>").repartition(4)
    q = [(1, None, vectors[5].tolist()), (2, ["d2"], vectors[9].tolist()), (3, [], vectors[1].tolist())]
    found = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.semantic_channel(v, spark.createDataFrame(q, "query_id int, scope array<string>, embedding array<double>"), 5).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for n, scope, x in q:
        own = [i for i in range(300) if scope is None or f"d{i % 4}" in scope]
        order = sorted(own, key=lambda i: (-round(float(unit[i] @ (np.array(x) / np.linalg.norm(x))), 12), i))[:5]
        assert [found.get((n, k)) for k in range(1, 6)] == ([f"v{i:03d}" for i in order] + [None] * 5)[:5]


def test_contained_titles_equal_nested_loops(spark):
    words = ["concrete", "bridge", "deck", "manual", "abc"]
    titles = ["".join(words[i % 5 :][:n]) for i in range(5) for n in (1, 2, 3)] + ["abc"]
    asks = ["concretebridge", "xxbridgedeckyy", "deck", "manualabc", "none"]
    t = spark.createDataFrame([(f"t{i}", x) for i, x in enumerate(titles)], "document_id string, title string")
    q = spark.createDataFrame([(i, x) for i, x in enumerate(asks)], "query_id int, q string")
    got = sorted((r["document_id"], r["query_id"]) for r in retrieval.contained_titles(t, q).collect())
    assert got == sorted((f"t{i}", j) for i, x in enumerate(titles) for j, y in enumerate(asks) if len(x) >= 4 and (y in x or x in y))


def test_publication(spark, tmp_path):
    root = str(tmp_path / "sets")
    rows = [(f"c{i}", f"h{i}", "d", [float(i + 1), 2.0, 0.5]) for i in range(20)]
    v = spark.createDataFrame(rows, "chunk_id string, content_hash string, document_id string, embedding array<double>")
    (tmp_path / "sets" / "s" / "vectors").mkdir(parents=True)  # what an interrupted attempt left
    about = publish.publish_vectors(v, root, "s", "m", "f")
    assert about["count"] == 20 and about["dimension"] == 3 and publish.healthy(spark, root, "s") and publish.publish_vectors(v.repartition(3), root, "s", "m", "f") == about
    assert publish.records(spark, root, "s").select(F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 5).alias("n")).distinct().collect()[0]["n"] == 1.0
    for other, error in ((v.limit(19), "differs"), (v.unionAll(v.limit(1)), "refused"), (v.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))), "zero_norm"), (v.limit(0), "no vectors"), (v.withColumn("document_id", F.lit("")), "identity")):
        with pytest.raises(ValueError, match=error):
            publish.publish_vectors(other, root, "s", "m", "f")
    with pytest.raises(ValueError, match="another corpus"):
        publish.publish_vectors(v, root, "s", "m", "g")
    copy = str(tmp_path / "copy")
    digest = publish.export_snapshot(spark, root, "s", copy)
    assert publish.restore_snapshot(spark, copy, root, about, digest) == "already_restored"
    assert publish.restore_snapshot(spark, copy, str(tmp_path / "new"), about, digest) == "ready" and publish.descriptor(spark, str(tmp_path / "new"), "s")["digest"] == digest
    with pytest.raises(ValueError, match="expected"):
        publish.restore_snapshot(spark, copy, root, about, "0")
    assert publish.descriptor(spark, root, "none") is None and not publish.healthy(spark, root, "none")


def test_catalog(spark):
    none = spark.createDataFrame([], "document_id string, path string, name string, extension string, size_bytes long, modified_ns long, sha256 string, status string, relative_path string, error string")
    ready = spark.createDataFrame([("1", "/x/b.PDF", 5, 1, "s1", "f"), ("2", "C:\\y\\A.txt", 6, 2, "s2", "f/g")], "document_id string, path string, size_bytes long, modified_ns long, sha256 string, relative_path string")
    held = catalog.register(catalog.register(none, ready), ready.limit(1))
    assert [(r["name"], r["extension"]) for r in catalog.listed(held).collect()] == [("A.txt", ".txt"), ("b.PDF", ".pdf")]
    roots = spark.createDataFrame([("f/g",)], "root string")
    assert [r["document_id"] for r in catalog.listed(held, roots).collect()] == ["2"] and catalog.ready_ids(held, roots.limit(0)).count() == 0 and catalog.listed(held, roots.limit(0)).count() == 2
    left, index = catalog.remove(held, spark.createDataFrame([("1", "c")], "document_id string, chunk_id string"), spark.createDataFrame([("1",)], "document_id string"))
    assert left.count() == 1 and index.count() == 0
    manifest = spark.createDataFrame([("1", "/x/b.PDF", "s1"), ("3", "/x/c", "s3"), ("4", "/x/gone", "s4"), ("", "/x/d", "")], "document_id string, source_path string, source_sha256 string")
    files = spark.createDataFrame([("/x/c", 1, 2)], "path string, size_bytes long, modified_ns long")
    found, gone = catalog.bootstrap(held, manifest, files, spark.createDataFrame([("3", "owner")], "document_id string, owner string"))
    assert [(r["document_id"], r["relative_path"]) for r in found.collect()] == [("3", "owner")] and [r["document_id"] for r in gone.collect()] == ["4"]
    names = spark.createDataFrame([("a.b.pdf", "abcdefghij", True), ("a", "abcdefghij", True), ("x.y", "q", False)], "n string, s string, t boolean")
    assert [r[0] for r in names.select(catalog.managed_name(F.col("n"), F.col("s"), F.col("t"))).collect()] == ["a.b-abcdefgh.pdf", "a-abcdefgh", "x.y"]
    import hashlib

    own = hashlib.sha256(b"/p:s").hexdigest()[:20]
    cache = [(2, "/p", "s", own, catalog.SCHEMA_VERSION, "v", "ready", "docling:x", 1), (1, "/p", "s", "other", catalog.SCHEMA_VERSION, "v", "ready", "docling", 0), (3, "/p", "s", own, "old", "v", "ready", "docling", 0)]
    cached = spark.createDataFrame(cache, "cache_no int, source_path string, source_sha256 string, document_id string, schema_version string, stage_version string, status string, backend string, n_failed_pages int")
    sources = spark.createDataFrame([("/p", "s")], "path string, sha256 string")
    assert [r["cache_no"] for r in catalog.cached_conversions(sources, cached, "v").collect()] == [2] and catalog.cached_conversions(sources, cached, "v", blank_review=True).count() == 0


def test_pages(spark):
    r = pages.page_sets(spark.createDataFrame([(10, [2, 2, -1], [3], [4, 5, 2], [5, 2, 9], [1, 3])], "page_count int, intentional_blank array<int>, scan_noise_only array<int>, recovered array<int>, failed array<int>, low_quality array<int>")).first()
    assert (r["effective_pages"], sorted(r["failed"]), r["low_quality"], r["recovered"]) == (8, [5, 9], [1, 5, 9], [4])
    images = spark.createDataFrame([("d", 1, "i1", [0.0, 0.0, 1.0, 1.0]), ("d", 1, "i2", [5.0, 5.0, 6.0, 6.0]), ("d", 2, "i3", None)], "document_id string, page_number int, image_id string, bbox array<double>")
    regions = spark.createDataFrame([("d", 1, "i1", None, 1, "r", "by id", "s"), ("d", 1, "", [5.0, 5.0, 6.0, 6.0], 2, "r", "by box", "s"), ("d", 2, "zz", [5.0, 5.0, 6.0, 6.0], 3, "r", "other page", "s")], "document_id string, page_number int, image_id string, bbox array<double>, region_no int, vision_raw string, vision_summary string, vision_search string")
    assert {r["image_id"]: r["vision_summary"] for r in pages.attach_regions(images, regions).collect()} == {"i1": "by id", "i2": "by box", "i3": ""}
    t = pages.table_metrics(spark.createDataFrame([("d", "<table/>", "table:docling", False, None), ("d", "", "candidate:vector-drawings", True, ["table_source_conflict"])], "document_id string, html string, extraction_method string, needs_review boolean, quality_flags array<string>")).first()
    assert (t["n_tables"], t["n_structured"], t["n_valid"], t["valid_ratio"], t["n_confirmed"], t["n_conflicts"]) == (2, 1, 1, 0.5, 1, 1)
    p = spark.createDataFrame([("d", 5, 0, 7, 0, True, "hidden_pdf_ocr"), ("e", 1, 0, 0, 0, False, "native")], "document_id string, native_chars int, hidden_chars int, layout_chars int, ocr_chars int, encoding_anomaly boolean, text_source string")
    b = spark.createDataFrame([("d", 0.5), ("d", 0.9), ("d", None)], "document_id string, confidence double")
    m = {r["document_id"]: r for r in pages.text_metrics(p, b).collect()}
    assert (m["d"]["n_low_confidence"], m["d"]["mean_confidence"], m["d"]["confidence_coverage"], m["d"]["low_confidence_ratio"], m["d"]["hidden_pdf_ocr_pages"]) == (1, 0.7, 0.6667, 0.5, 1) and m["e"]["n_blocks"] == 0
    assert pages.vision_metrics(spark.createDataFrame([("d", "x", "", "m"), ("d", "", "", None)], "document_id string, vision_summary string, ocr_text string, model string")).first()["n_successful"] == 1
    results = spark.createDataFrame([("r", "a", "success", 1), ("r", "b", "failed", 1), ("r", "c", "success", 0), ("r", "d", "success", 2)], "run_id string, image_name string, status string, n_findings int")
    lines = spark.createDataFrame([("r", "a", "fill", "Filling"), ("r", "d", "", "Named")], "run_id string, image_name string, repair_method string, method_display_name string")
    c = pages.render_counts(results, lines).first()
    assert (c["n_render"], c["skipped_no_detection"], c["skipped_failed"], c["skipped_without_plan"]) == (1, 1, 1, 1)
    refs = spark.createDataFrame([("knowledge_base", "d", "m", None, None), ("knowledge_base", "d", "m", "own", ["x"]), ("web", "d", "m", None, None)], "source_type string, document_id string, source_ref string, source_name string, heading_path array<string>")
    got = pages.enrich_references(refs, spark.createDataFrame([("d", "Doc")], "document_id string, source_name string"), spark.createDataFrame([("m", ["h"])], "source_marker string, heading_path array<string>")).collect()
    assert sorted(repr((r["source_name"], r["heading_path"])) for r in got) == sorted(map(repr, [("Doc", ["h"]), ("own", ["x"]), (None, None)]))
    f = pages.figures(spark.createDataFrame([("W-001", "p", "", None)], "line_id string, original_image_path string, annotated_image_path string, construction_image_path string")).orderBy("figure_no").collect()
    assert [x["availability"] for x in f] == ["available", "placeholder", "placeholder"]


def test_question_sets(spark, tmp_path):
    one = lambda value, *args: spark.createDataFrame([(list(args),)], "a array<string>").select(value).first()[0]
    text = "文档：X\n内容：表头：宽度｜限值\n0.3｜5 mm\n来源：[KB:d:page:1]"
    assert one(benchmarks.own_words(F.lit(text), F.lit("f"))) == "宽度 | 限值 0.3 | 5 mm" and one(benchmarks.own_words(F.lit(""), F.lit(" f  g "))) == "f g"
    assert one(benchmarks.subject(F.array(F.lit("1.2 裂缝宽度限值"), F.lit("表")), F.lit("x"))) == "裂缝宽度限值" and one(benchmarks.subject(F.lit(None).cast("array<string>"), F.lit("abc。混凝土结构裂缝；尾"))) == "混凝土结构裂缝" and one(benchmarks.subject(F.array().cast("array<string>"), F.lit("abc"))) == benchmarks.NO_TOPIC
    assert one(benchmarks.table_subject(F.array().cast("array<string>"), F.lit("a | b | c"), F.lit(3))) == "a、b、c" and one(benchmarks.table_subject(F.array().cast("array<string>"), F.lit(""), F.lit(3))) == "第3页表格"
    assert one(benchmarks.facts(F.lit("宽度 0.3 mm，龄期28天，又 0.3 mm"))) == ["0.3 mm", "28天"] and one(benchmarks.facts(F.lit("这是一个没有数值的句子。 另外一个同样的句子。"))) == ["这是一个没有数值的句子。", "另外一个同样的句子。"]
    assert one(benchmarks.joined_answer(F.array(F.lit("a；"), F.lit("b"), F.lit("b")))) == "a；；b"
    assert one(benchmarks.generation_context(F.lit("文档：X\n正文\n\n[KB:d:page:1]\n尾"))) == "正文\n尾" and one(benchmarks.generation_context(F.lit("文档：X"))) == "文档：X"
    assert one(benchmarks.extract_terms(F.lit("GB 50010-2010 宽度 5 mm 混凝土结构"), F.array(F.lit("总则"))))[:1] == ["总则"] and one(benchmarks.extract_terms(F.lit("x"), F.array().cast("array<string>"))) == benchmarks.DEFAULT_TERMS
    pairs = benchmarks.sibling_pairs(spark.createDataFrame([("c1", "p", 2, False), ("c2", "p", 1, False), ("c3", "q", 1, False), ("c4", "q", 1, False), ("c5", "", 1, True)], "chunk_id string, parent_id string, primary_page int, is_cross_page boolean"), 1).collect()
    assert [(r["first_id"], r["last_id"]) for r in pairs] == [("c2", "c1")]
    assert one(benchmarks.quota_for(F.lit("水下规范"), {"规范": 75, "水下": 50})) == 75 and one(benchmarks.quota_for(F.lit("x"), {"规范": 75})) == 5
    nodes = spark.createDataFrame([("s", f"n{i}", i) for i in range(3)], "source string, node_id string, position int")
    got = benchmarks.scenarios(nodes, spark.createDataFrame([("s", 7)], "source string, quota int")).orderBy("scenario_no").collect()
    assert [r["node_id"] for r in got] == ["n0", "n1", "n2", "n0", "n1", "n2", "n0"]
    index = spark.createDataFrame([("retrieval", "GB 50010—2010", "5.2"), ("retrieval", "", "x.y"), ("context_only", "JGJ 1", "1.1")], "retrieval_role string, standard_number string, clause_number string")
    assert [(r["query_id"], r["query"]) for r in benchmarks.query_specs(index).orderBy("query_id").collect()] == [("clause-001", "第5.2条"), ("standard-001", "GB50010-2010")]
    rows = spark.createDataFrame([("q1", "q", "a", ["c"], ["d"], "gold_reviewed", True), ("q2", "", "a", [], ["d"], "x", True)], "question_id string, question string, candidate_answer string, reference_contexts array<string>, candidate_relevant_documents array<string>, annotation_status string, gold_label boolean")
    assert sorted((r["rule"], r["key"]) for r in benchmarks.candidate_errors(rows, True).collect()) == [("missing_question", "q2"), ("missing_reference_contexts", "q2"), ("not_reviewed", "q2")]
    out = str(tmp_path / "answers")

    def load(fail):
        def answer(record):
            if record["question_id"] == "q2" and fail:
                raise ValueError("no")
            return record["question"] + "!", {"score": 1.0}

        return lambda: answer

    first = {r["key"]: (r["answer"], r["error"]) for r in benchmarks.evaluate(rows, load(True), out).collect()}
    assert first == {"q1": ("q!", ""), "q2": (None, "ValueError: no")}
    again = {r["key"]: (r["answer"], r["error"]) for r in benchmarks.evaluate(rows, load(False), out).collect()}
    assert again == {"q1": ("q!", ""), "q2": ("!", "")} and spark.read.parquet(out).count() == 3
    docs = spark.createDataFrame([("d", "s", "doc name", "doc path")], "document_id string, source_sha256 string, source_name string, source_path string")
    files = spark.createDataFrame([("s", "file name", "")], "source_sha256 string, source_name string, source_path string")
    chunk = spark.createDataFrame([("c", "d", None, 3, "m", "text", None, None, "body", "body")], "chunk_id string, document_id string, page_numbers array<int>, primary_page int, source_marker string, chunk_type string, clause_number string, standard_number string, text string, text_search string")
    e = benchmarks.evidence(chunk, docs, files).first()
    assert (e["source_name"], e["source_path"], e["page_numbers"], e["evidence_text"], e["clause_number"]) == ("file name", "doc path", [3], "body", "")


def test_scan_noise(spark):
    white = np.full((300, 200), 255, np.uint8)
    speck, line = white.copy(), white.copy()
    speck[10:12, 10:12] = 0
    line[50, 20:40] = 0
    rows = [("d", n, bytearray(p.tobytes()), 200, 300, 200.0, 300.0, False) for n, p in enumerate((white, speck, line, speck), 1)]
    found = pages.scan_noise(
        spark.createDataFrame(rows, "document_id string, page_number int, pixels binary, width int, height int, page_width double, page_height double, has_table boolean"),
        spark.createDataFrame([("d", 2, " ", None), ("d", 4, "long text", [0.0, 0.0, 1.0, 1.0])], "document_id string, page_number int, text string, bbox array<double>"),
    )
    assert {r["page_number"]: (r["n_significant"], r["n_noise"], r["scan_noise_only"]) for r in found.collect()} == {1: (0, 0, True), 2: (0, 1, True), 3: (1, 0, False), 4: (0, 1, False)}


def test_report_values(spark):
    findings = spark.createDataFrame([("r", 1, "Structural_Crack", "high", "seal"), ("r", 2, "露筋", "LOW", "seal"), ("r", 3, "unknown", "critical", "")], "report_id string, position int, damage_type string, level string, recommended_action string")
    about = spark.createDataFrame([("r", True, None, "A-1", "beam", "", None, 2), ("s", False, None, None, None, None, None, 0)], "report_id string, confirmed boolean, overall_level string, asset_id string, component string, project_name string, inspection_time string, n_images int")
    got = {r["report_id"]: r["values"] for r in reports.report_values(findings, about).collect()}
    r, s = got["r"], got["s"]
    assert (r["f2n"], r["f2g"], r["f2x"], r["f6n"], r["f1g"], r["finding_summary"], r["warn"], r["c14"]) == ("1", f"高（{reports.CONFIRMED}）", "是", "1", reports.NOT_DETECTED, "结构裂缝、钢筋腐蚀/钢筋暴露", "存在", "2")
    assert r["overall"].startswith("危急") and r["defect"].startswith("低") and r["recommendation_text"] == "seal" and r["project_name"] == reports.NOT_PROVIDED and len(r) > 60
    assert s["overall"] == f"待判定（{reports.UNCONFIRMED}）" and s["crack"] == s["f8g"] == reports.NOT_DETECTED and s["recommendation_text"] == reports.NO_ACTION
    projects = spark.createDataFrame([("p", "地下车库与消防设施"), ("q", None)], "project_id string, overview string")
    notes = spark.createDataFrame([("parking", "report", "n1"), ("fire", "report", "n2"), ("structure", "report", "n3")], "topic string, kind string, note string")
    assert [(x["project_id"], x["notes"]) for x in reports.project_notes(projects, notes).collect()] == [("p", ["n1", "n2"])]


def test_settings_and_command_line(spark, tmp_path):
    path = str(tmp_path / "settings.json")
    assert settings.load(path) == settings.Settings()
    (tmp_path / "settings.json").write_text('{"top_k": 9, "old": 1}')
    held = settings.load(path)
    assert held.retrieval.top_k == 9 and held.version == settings.VERSION
    settings.save(held, path)
    assert settings.load(path) == held and settings.Settings(version=7).problems()
    with pytest.raises(ValueError):
        settings.save(settings.Settings(retrieval=settings.Retrieval(chunk_overlap=5000)), path)
    out = str(tmp_path / "out")
    settings.main(["run", "stable_sample", "--tables", "/root/testdata/sf0.001", "--out", out])
    assert spark.read.parquet(out).count() == 50
    with pytest.raises(FileExistsError):
        files.require_fresh(spark, str(tmp_path / "new"), out)
    (tmp_path / "in.json").write_text('{"a": 1}\n{"a": 2}\n')
    bound = files.binding(spark, str(tmp_path / "in.json"), spark.read.schema("a int").json(str(tmp_path / "in.json"))).first()
    assert bound["n_items"] == 2 and len(bound["sha256"]) == len(bound["content_digest"]) == 64


def test_row_metadata(spark):
    rows = spark.createDataFrame([("q", 1, "c", "d", "l", '{"a": 1, "table_id": "old"}', "t", [1, 2]), ("q", 2, "e", "d", "l", "no json", None, None)], "query_id string, rank int, chunk_id string, document_id string, location string, metadata_json string, table_id string, page_numbers array<int>")
    found = retrieval.row_metadata(rows)
    assert [r["metadata"] for r in found.orderBy("rank").collect()] == [{"a": "1", "table_id": "t", "page_numbers": "[1,2]"}, {"table_id": None, "page_numbers": None}]
    assert retrieval.anchor_payload(found).columns == ["query_id", "rank", "chunk_id", "document_id", "location", "metadata"]


def test_generation_with_fallback(spark, tmp_path):
    class Service:
        def __init__(self):
            self.calls = 0

        def generate(self, items):
            self.calls += 1
            if self.calls == 1:
                raise ConnectionError("once")
            if any(i["id"] == 5 for i in items):
                return [{"id": 0}]
            return [{"id": i["id"], "text": i["t"] + "!"} for i in reversed(items)]

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id int, t string").coalesce(1)
    got = {r["id"]: (r["result"], r["error"]) for r in remote.generate(rows, Service, "id", 2, wait=0.0).collect()}
    assert got[0] == ('{"id": 0, "text": "t0!"}', "") and got[3][0] and got[4] == got[5] == (None, "ValueError: identity mismatch")
    chained = RuntimeError("outer")
    chained.__cause__ = TimeoutError()
    assert remote.transient(chained) and not remote.transient(ValueError("no"))
    path = str(tmp_path / "manifest.json")
    (tmp_path / "manifest.json").write_text("[broken")
    files.merge_manifest(path, "a", {"x": 1}, {"out": "p"})
    assert set(files.merge_manifest(path, "b", {}, {}, "why")["profiles"]) == {"a", "b"} and files.read_pointer(path)["profiles"]["b"]["fallback"]


def test_rendered_reports(spark):
    findings = spark.createDataFrame([("r", 2, "b.jpg", 1, "deformation", "high"), ("r", 1, "a.jpg", 1, "unknown", None)], "report_id string, position int, image_name string, finding_index int, damage_type string, level string")
    items = reports.fallback_items(findings, spark.createDataFrame([("deformation", "bent", "straighten")], "key string, description string, action string"))
    text = reports.render_report(spark.createDataFrame([("r", "Title", "high"), ("s", None, None)], "report_id string, title string, overall_level string"), items).orderBy("report_id").collect()
    assert text[0]["markdown"] == f"# Title\n\n高\n\n## 1. unknown – 待判定\n`a.jpg`\n\nunknown\n> {reports.NO_ACTION}\n\n## 2. deformation – 高\n`b.jpg`\n\nbent\n> straighten" and text[1]["markdown"] == "# \n\n待判定"
    lines = spark.createDataFrame([("r", "W-002", "b|c", "x", "high", None), ("r", "W-001", "a", "x", "low", "m")], "report_id string, line_id string, image_name string, category string, level string, method string")
    plan = reports.render_plan(spark.createDataFrame([("r", "P"), ("s", "Q")], "report_id string, title string"), lines).orderBy("report_id").collect()
    assert plan[0]["markdown"].endswith("| W-001 | a | x | low | m |\n| W-002 | b\\|c | x | high |  |") and plan[1]["markdown"] == "# Q"
    answers = spark.createDataFrame([("x", "m", "v", "kb")], "answer_id string, model string, template_version string, source_mode string")
    seen = spark.createDataFrame([("x", 1, "c", "d", "anchor", "t")], "answer_id string, rank int, chunk_id string, document_id string, role string, text string")
    row = reports.generation_manifest(answers, seen).first()
    assert row["retrieved"][0]["chunk_id"] == "c" and len(row["evidence_digest"]) == 64
