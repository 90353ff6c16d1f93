"""Operators on authored tables: chunks, retrieval, evidence, gates, splits, tables, masks, files, streams."""

import io
import json
import sqlite3
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import geometry
from lexigrove.functions.text import fold, token_count
from lexigrove.operators import chunking, corpus, evaluation, evidence, folders, gates, history, instances, postings, reconcile, rerank, retrieval, sampling, tables, vectors
from lexigrove.sources import annotations, files, runs
from lexigrove.streaming import incremental

BLOCK = "document_id string, block_id string, location string, text string, block_type string, extraction_method string, page_number int, bbox array<double>, label string, encoding_anomaly boolean"


def block(n, text, page, y=0.0, kind="text", label=""):
    return ("d", f"b{n}", f"l{n}", text, kind, "native", page, [0.0, y, 1.0, y + 1], label, False)


def test_structure_units(spark):
    rows = [block(i, "公司机密", i, 0.0) for i in (1, 2, 3, 4)]
    rows += [block(10, "第1章 总则", 1, 1.0), block(11, "首段没有结束", 1, 2.0), block(12, "接着第二页结束。", 2, 1.0), block(13, "另一段。", 2, 2.0), block(14, "第2章 材料", 3, 1.0), block(15, "1) 第一项", 3, 2.0), block(16, "2) 第二项", 3, 3.0), block(17, "页脚", 3, 9.0, label="page_footer")]
    got = [r for r in chunking.structure_units(spark.createDataFrame(rows, BLOCK)).orderBy("unit_no").collect()]
    assert [(r["text"], r["page_numbers"], r["heading_path"], r["chunk_type"]) for r in got] == [
        ("首段没有结束 接着第二页结束。 另一段。", [1, 2], ["第1章 总则"], "paragraph"),
        ("1) 第一项\n2) 第二项", [3], ["第1章 总则", "第2章 材料"], "list"),
    ]
    assert got[0]["is_cross_page"] and got[0]["quality_flags"] == ["cross_page_merge"]
    chunks = chunking.unit_chunks(chunking.structure_units(spark.createDataFrame(rows, BLOCK)), spark.createDataFrame([("d", "GB 50010-2010 规范.pdf")], "document_id string, source_name string"))
    first = chunks.where("chunk_id = 'd:1:child:0'").first()
    assert first["source_marker"] == "[KB:d:page:1-2]" and "标准编号：GB50010-2010" in first["text"] and first["parent_id"] == "d:1:parent" and chunks.count() == 4


def test_split_text(spark):
    def run(text, limit, overlap=0):
        value = F.col("t")
        r = spark.createDataFrame([(text,)], "t string").select(chunking.split_text(value, limit, overlap).alias("parts")).select("parts", F.transform("parts", token_count).alias("sizes")).first()
        return r["parts"], r["sizes"]

    text = "一二三四五。六七八九十。" * 20
    parts, sizes = run(text, 30, 5)
    assert all(n <= 45 for n in sizes) and parts[1].startswith(parts[0][-10:]) and run(" ", 5) == ([], []) and run(None, 5) == ([], [])
    assert all(len(p) <= 20 for p in run("x" * 95 + " y" * 200, 10)[0])
    assert run("One. Two three! Four five six; seven\neight", 4)[0] == ["One. Two three!", "! Four five six;", "; seven eight"]


def test_pack_units(spark):
    rows = spark.createDataFrame([("d", n, f"c{n}", "x" * size) for n, size in enumerate((4, 4, 9, 1, 1, 20, 3))] + [("e", 0, "z", "")], "document_id string, pos int, chunk_id string, text string")
    got = sorted((r["document_id"], r["unit_no"], r["chunk_ids"], r["n_chars"]) for r in chunking.pack_units(rows, 10).collect())
    assert got == [("d", 1, ["c0", "c1"], 8), ("d", 2, ["c2", "c3"], 10), ("d", 3, ["c4"], 1), ("d", 4, ["c5"], 20), ("d", 5, ["c6"], 3), ("e", 1, ["z"], 0)]


def test_fold_any_script(spark):
    words = ["Škoda", "ő", "Ünïcödé", "e\u0301a", "Ǻ", "straße", "ά", "日本"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(fold(F.col("w"))).collect()]
    assert got == ["skoda", "o", "unicode", "ea", "a", "straße", "α", "日本"]


def test_fixed_chunks_cover(spark):
    rows = spark.createDataFrame([(i, "abcdefghij" * n) for i, n in enumerate((0, 1, 3, 10, 11))], "doc_id int, text string")
    got = chunking.fixed_chunks(rows, 30, 10).orderBy("doc_id", "part").collect()
    for i, n in enumerate((0, 1, 3, 10, 11)):
        own = [r for r in got if r["doc_id"] == i]
        text = "".join(r["text"][0 if j == 0 else 10 :] for j, r in enumerate(own))
        assert text == "abcdefghij" * n and all(r["start"] == 20 * j for j, r in enumerate(own))
    with pytest.raises(ValueError):
        chunking.fixed_chunks(rows, 10, 10)


CHUNKS = "chunk_id string, document_id string, location string, part int, primary_page int, text string, text_search string, retrieval_role string, parent_id string, heading_path array<string>, standard_number string, clause_number string"


@pytest.fixture(scope="module")
def chunks(spark):
    c = lambda i, doc, text, role="retrieval", parent="", path=(), std="", clause="": (i, doc, f"loc{i}", 0, 1, text, text, role, parent, list(path), std, clause)
    return spark.createDataFrame(
        [
            c("c1", "d1", "crack width limit under load", parent="p1", path=["ch"], std="GB 50010—2010", clause="5.2.1"), c("c2", "d1", "repair with epoxy", parent="p1", path=["ch"]), c("c3", "d1", "curing takes days", path=["ch"]),
            c("p1", "d1", "parent text about cracks", "context_only", path=["ch"]), c("c4", "d2", "bridge deck crack crack"), c("c5", "d2", "steel corrosion"), c("c6", "d3", "completely other words"),
        ], CHUNKS,
    )


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([("d1", "Concrete Manual.pdf"), ("d2", "Bridges.pdf"), ("d3", "Misc.txt")], "document_id string, source_name string")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, text string, scope array<string>")


def test_bm25_equals_sqlite(spark, chunks):
    rows = chunks.where("retrieval_role = 'retrieval'").select("chunk_id", "text_search", "clause_number").collect()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(id unindexed, text_search, clause_number)")
    con.executemany("insert into t values (?, ?, ?)", [tuple(r) for r in rows])
    fields = {"text_search": 2.0, "clause_number": 8.0}
    for terms in (["crack"], ["crack", "epoxy", "days"], ["5.2.1"], ["crack width"]):
        want = dict(con.execute("select id, -bm25(t, 1.0, 2.0, 8.0) from t where t match ?", (" OR ".join(f'"{t}"' for t in terms),)).fetchall())
        phrases = spark.createDataFrame([(1, t) for t in terms], "query_id int, phrase string")
        got = {r["chunk_id"]: r["score"] for r in postings.phrase_bm25(spark.createDataFrame(rows), phrases, 10, fields).collect()}
        assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


def test_retrieve_channels(spark, chunks, documents):
    found = retrieval.retrieve(chunks, documents, asked(spark, (1, "crack width 5.2.1", None), (2, "crack", ["d2"]), (3, "Concrete Manual", None), (4, "nothing here", [])), top_k=3)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert got[1][0]["chunk_id"] == "c1" and set(got[1][0]["channels"]) == {"bm25", "like", "clause_exact"}
    assert {r["chunk_id"] for r in got[2]} == {"c4"} and got[3][0]["channels"] == ["source_title_exact"] and got[3][0]["document_id"] == "d1" and 4 not in got
    gain = got[1][0]["contributions"]
    assert gain["clause_exact"] == pytest.approx(10 / 61) and got[1][0]["fusion"] == pytest.approx(sum(gain.values()))
    adaptive = retrieval.retrieve(chunks, documents, asked(spark, (1, "crack width 5.2.1", None)), top_k=3, adaptive=True).orderBy("rank").collect()
    assert adaptive[0]["chunk_id"] == "c1" and adaptive[0]["tier"] == 0
    with pytest.raises(ValueError):
        retrieval.retrieve(chunks, documents, asked(spark, (1, "x", None)), fusion_k=0)


def test_semantic_scope_before_cut(spark):
    v = spark.createDataFrame([("a", "d1", [1.0, 0.0]), ("b", "d2", [0.9, 0.1]), ("c", "d2", [0.0, 1.0])], "chunk_id string, document_id string, embedding array<float>")
    q = spark.createDataFrame([(1, ["d2"], [1.0, 0.0]), (2, None, [1.0, 0.0])], "query_id int, scope array<string>, embedding array<float>")
    got = {r["query_id"]: r["chunk_id"] for r in retrieval.semantic_channel(v, q, 1).collect()}
    assert got == {1: "b", 2: "a"}


def test_budget(spark):
    rows = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc"), (2, 1, "x"), (2, 2, ""), (2, 3, "y")], "query_id int, rank int, text string")
    got = sorted((r["query_id"], r["rank"], r["text"]) for r in retrieval.budget(rows, 6).collect())
    assert got == [(1, 1, "aaaa"), (1, 2, "bb"), (2, 1, "x")]


def test_hydration_and_expansion(spark, chunks):
    ranked = chunks.where("chunk_id in ('c1', 'c2')").withColumn("query_id", F.lit(1)).withColumn("rank", F.when(F.col("chunk_id") == "c1", 1).otherwise(2))
    got = [(r["chunk_id"], r["position"]) for r in retrieval.hydrate_parents(ranked, chunks).orderBy("position").collect()]
    assert got == [("c1", 1.0), ("p1", 1.5), ("c2", 2.0)]
    wide = retrieval.expand(ranked, chunks, 10_000, 24)
    assert {(r["chunk_id"], r["role"]) for r in wide.collect()} == {("c1", "anchor"), ("c2", "anchor"), ("c3", "sibling"), ("p1", "parent")}
    tight = {r["chunk_id"] for r in retrieval.expand(ranked, chunks, 1, 24).collect()}
    assert tight == {"c1", "c2"}


def test_evidence_groups(spark):
    rows = [(1, 1, "a", "p", "anchor", "Same text", ["h"], ""), (1, 2, "b", "", "anchor", "same  TEXT", [], ""), (1, 3, "p", "", "parent_context", "Same text and a bit", [], ""), (1, 4, "z", "", "context", "other", [], "")]
    items = spark.createDataFrame(rows, "query_id int, position int, chunk_id string, parent_id string, role string, text string, heading_path array<string>, context_for string")
    got = {r["chunk_id"]: (r["group_no"], r["included"], r["duplicate_of"]) for r in evidence.group_evidence(items.withColumn("query_id", F.col("query_id").cast("string"))).collect()}
    assert got == {"a": (1, True, ""), "p": (1, False, "a"), "b": (2, False, "a"), "z": (3, True, "")}


def test_evidence_claims(spark):
    item = lambda n, c, role, text, parent="", made_for="": ("q", n, c, parent, role, text, ["h"], made_for)
    rows = [
        item(1, "a", "anchor", "alpha one"), item(2, "b", "anchor", "beta two", made_for="a"), item(3, "c", "expanded_context", "gamma", made_for="b"), item(4, "d", "anchor", "delta", parent="p"),
        item(5, "p", "parent_context", "delta and more"), item(6, "e", "expanded_context", "alpha one"), item(7, "r", "anchor", "from a relation"), item(8, "s", "context", "alone"),
    ]
    items = spark.createDataFrame(rows, "query_id string, position int, chunk_id string, parent_id string, role string, text string, heading_path array<string>, context_for string")
    links = spark.createDataFrame([("q", 1, ["e", "r", "none"], ["r"], ["x"], "same_section"), ("q", 2, ["r"], ["r"], [], "again")], "query_id string, relation_no int, chunk_ids array<string>, anchor_chunk_ids array<string>, heading_path array<string>, reason string")
    found = evidence.group_evidence(items, links).orderBy("group_no", "item_no").collect()
    # b is taken by a, so it starts no group and c, made for b, stands alone
    assert [(r["group_no"], r["chunk_id"], r["reason"][:5], r["duplicate_of"]) for r in found] == [
        (1, "r", "same_", ""), (1, "e", "same_", ""), (2, "a", "paren", "e"), (2, "b", "paren", ""), (3, "d", "paren", ""), (3, "p", "paren", "d"), (4, "c", "stand", ""), (5, "s", "stand", ""),
    ]


def test_rerank_falls_back(spark):
    rows = spark.createDataFrame([(1, "crack width", "a", "no words", 0, 0.0, 0.0, [], False, False), (1, "crack width", "b", "crack width here", 1, 0.0, 0.0, [], False, False)], "query_id int, query string, chunk_id string, text string, position int, semantic_score double, fusion double, heading_path array<string>, anchor boolean, expanded boolean")
    assert [r["chunk_id"] for r in rerank.rerank_baseline(rows, 5).orderBy("rank").collect()] == ["b", "a"]

    class Model:
        def __init__(self, bad):
            self.bad = bad

        def predict(self, pairs):
            return [float("nan") if self.bad else -float(len(t)) for _, t in pairs]

    good = rerank.rerank_model(rows, lambda: Model(False), 5).orderBy("rank").collect()
    bad = rerank.rerank_model(rows, lambda: Model(True), 5).orderBy("rank").collect()
    assert good[0]["chunk_id"] == "a" and good[0]["reranker"] == "model" and bad[0]["chunk_id"] == "b" and bad[0]["reranker"] == "deterministic-baseline"


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "a", 3), (1, "b", 4)], "query_id int, chunk_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (2, "q")], "query_id int, chunk_id string")
    got = {r["query_id"]: r for r in evaluation.query_metrics(ranked, gold).collect()}
    assert (got[1]["hit_1"], got[1]["precision_3"], got[1]["recall_5"], got[1]["mrr_10"]) == (1.0, pytest.approx(1 / 3), 1.0, 1.0) and got[2]["ndcg_10"] == 0


def test_gates(spark):
    docs = spark.createDataFrame([("a", 3), ("b", 2)], "document_id string, page_count int")
    pages = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 2)], "document_id string, page_number int")
    assert [(r["key"], r["detail"]) for r in gates.page_coverage(docs, pages).collect()] == [("a", "missing [2] extra []")]
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 0.0]), ("c", [float("nan"), 1.0]), ("d", [1.0])], "chunk_id string, embedding array<double>")
    assert sorted(map(tuple, vectors.findings(v, dimension=2).collect())) == [("dimension", "d"), ("not_finite", "c"), ("repeated_id", "a"), ("zero_norm", "a")]
    assert spark.sql("select 'x.v3' a, 'y.v9' b, 'x' c").select(*[gates.version_compatible(F.col(c), "x", 2) for c in "abc"]).first() == (True, False, False)
    assert gates.decide(spark.createDataFrame([], "passed boolean")).first()["passed"] is False


def test_splits_do_not_leak(spark):
    rows = spark.createDataFrame([(i, f"h{i // 2}", ["a"] if i % 3 else ["a", "rare"]) for i in range(60)], "sample_id int, digest string, labels array<string>")
    split = rows.join(sampling.stratified_split(rows.withColumn("sample_id", F.col("sample_id").cast("string")), 7), "sample_id")
    assert split.count() == 60 and sampling.leakage(split, "digest").count() == 0
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert 38 <= sizes["train"] <= 44 and split.where("array_contains(labels, 'rare')").select("split").distinct().count() == 3
    assert sampling.leakage(rows.withColumn("split", sampling.hash_split(F.col("digest"))), "digest").count() == 0
    got = sampling.pools(rows.withColumn("chunk_id", F.col("sample_id").cast("string")), [("one", F.col("sample_id") < 5, 4), ("two", F.col("sample_id") < 6, 4)], 1)
    assert got.count() == 8 and got.where("pool = 'two' and reused").count() == 2
    eight = [(f"p{i}", F.col("sample_id") % 8 >= i // 2, 5) for i in range(8)]
    many = sampling.pools(rows.withColumn("chunk_id", F.col("sample_id").cast("string")), eight, 3)
    assert many.count() == 40 and many.where("not reused").select("chunk_id").distinct().count() == many.where("not reused").count()
    assert many._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + many._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 4


def test_reconcile(spark):
    row = lambda *xs: spark.createDataFrame([(x, 1) for x in xs], "image_name string, finding_index int")
    got = {r["image_name"]: r["issue"] for r in reconcile.reconcile(row("a", "b", "b", "c"), row("a", "a", "b", "d"), "image_name", "finding_index").collect()}
    assert got == {"a": "duplicate", "b": "missing", "c": "missing", "d": "added"}


def test_folders(spark):
    tree = spark.createDataFrame([(p,) for p in ("a", "a/b", "a/b/c", "ab", "ab/x")], "relative_path string")
    roots = spark.createDataFrame([("a",)], "root string")
    assert {r["relative_path"] for r in folders.closure(tree, roots).collect()} == {"a", "a/b", "a/b/c"}
    moved = folders.move(tree, "a", "z/y")
    assert {r["relative_path"] for r in moved.collect()} == {"z/y", "z/y/b", "z/y/b/c", "ab", "ab/x"}
    docs = spark.createDataFrame([("1", "a/b", "ready"), ("2", "ab", "ready"), ("3", "a", "failed")], "document_id string, relative_path string, status string")
    assert [r["document_id"] for r in folders.resolve_scope(docs, None, roots).collect()] == ["1"]
    assert folders.resolve_scope(docs, None, roots.where("root = 'none'")).count() == 0
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "x")], "folder_id string, parent_id string")
    assert {r["folder_id"] for r in folders.closure_by_parent(links, ["a"]).collect()} == {"a", "b", "c"}


def test_tables(spark):
    assert tables.parse_rows("<table><tr><th>A &amp; B</th></tr><tr><td>1</td><td> x <b>y</b></td></tr><tr><td></td></tr></table>") == [["A & B", ""], ["1", "x y"]]
    assert tables.canonical_html("<table><tr><td class='x'>1</td></tr></table>") == "" and tables.canonical_html("<TABLE><tr><td>1<3</td></tr></TABLE>").startswith("<table><tr><td>1")
    cell = lambda *v: "<table><tr>" + "".join(f"<td>{x}</td>" for x in v) + "</tr></table>"
    rows = [("d", 1, "t1", "table:docling", [0.0, 0.0, 10.0, 10.0], cell("abcdefghij" * 20, "b")), ("d", 1, "t2", "table:camelot", [0.0, 0.0, 10.0, 10.0], cell("abcdefghij" * 20 + "k", "b")), ("d", 1, "t3", "table:camelot", [20.0, 0.0, 30.0, 10.0], cell("abcdefghij" * 20, "b")), ("d", 1, "t4", "table:camelot", None, "")]
    got = {r["table_id"]: r["canonical_id"] for r in tables.canonical_tables(spark.createDataFrame(rows, "document_id string, page_number int, table_id string, extraction_method string, bbox array<double>, html string")).collect()}
    assert got == {"t1": "t1", "t2": "t1", "t3": "t3"}
    lines = [("d", 1, 0.0, y, 10.0, y) for y in (0.0, 5.0, 10.0)] + [("d", 1, x, 0.0, x, 10.0) for x in (0.0, 10.0)] + [("d", 1, 50.0, 50.0, 60.0, 50.0)]
    region = tables.grid_regions(spark.createDataFrame(lines, "document_id string, page_number int, x0 double, y0 double, x1 double, y1 double")).collect()
    assert len(region) == 1 and region[0]["bbox"] == [0, 0, 10, 10] and region[0]["n_lines"] == 5


def mask(*points):
    m = np.zeros((8, 8), bool)
    for y0, x0, y1, x1 in points:
        m[y0:y1, x0:x1] = True
    return m


def test_masks(spark):
    rows = [(1, 0, mask((0, 0, 4, 4))), (2, 0, mask((2, 2, 6, 6))), (3, 0, mask((7, 7, 8, 8))), (4, 1, mask((0, 0, 4, 4)))]
    data = spark.createDataFrame([("i", c, n, 0.5 + n / 10, bytearray(geometry.pack(m)), 8, 8) for n, c, m in rows], "image_id string, class_id int, instance_id int, score double, mask binary, width int, height int")
    got = {(r["class_id"], tuple(r["member_ids"])): (r["best_id"], r["area_pixels"]) for r in instances.merge_instances(data).collect()}
    assert got == {(0, (1, 2)): (2, 28), (0, (3,)): (3, 1), (1, (4,)): (4, 16)}
    assert geometry.iou(mask(), mask()) == 1.0 and geometry.fill_holes(mask((1, 1, 6, 6)) & ~mask((3, 3, 4, 4))).sum() == 25
    assert geometry.largest_component(mask((0, 0, 2, 2), (4, 4, 8, 8))).sum() == 16 and geometry.skeleton_length(geometry.thin(mask((3, 0, 4, 8)))) == 7.0
    area = data.select(geometry.mask_measures("mask", "width", "height").alias("m")).select("m.*").collect()
    assert area[0]["area_ratio"] == 0.25 and area[0]["box"] == [0, 0, 4, 4]


def test_box_pairs_on_grid_equal_plain(spark):
    rng = np.random.default_rng(3)
    rows = [("g", i, [float(x), float(y), float(x + w), float(y + h)]) for i, (x, y, w, h) in enumerate(rng.integers(1, 30, (60, 4)).tolist())]
    boxes = spark.createDataFrame(rows, "g string, id int, box array<double>")
    plain, grid = (sorted((r["a"], r["b"]) for r in instances.box_pairs(boxes, 0.1, ["g"], "id", cell=c).collect()) for c in (None, 7.0))
    assert plain == grid and plain


def test_runs_of_questions(spark):
    rows = spark.createDataFrame([("r1", "s", "2026-01-01 08:00:00"), ("r2", "s", "2026-01-02 09:00:00"), ("r3", "s", "2026-01-03 10:00:00")], "run_id string, source string, t string").withColumn("created_at", F.to_timestamp("t"))
    questions = spark.createDataFrame([(1, "第2次检测"), (2, "上一次"), (3, "2026-1-1 的结果"), (4, "结果"), (5, "昨天")], "question_id int, question string")
    got = {r["question_id"]: r["run_id"] for r in history.select_runs(rows, questions, F.to_date(F.lit("2026-01-04"))).collect()}
    assert got == {1: "r2", 2: "r2", 3: "r1", 4: "r3", 5: "r3"}


def test_incremental(spark, tmp_path):
    first = spark.createDataFrame([("a", "1", 1), ("b", "9", 1), ("b", "1", 2)], "document_id string, fingerprint string, version long")
    first.write.parquet(f"{tmp_path}/in/x")
    build = lambda rows: rows.withColumn("n", F.lit(1))
    run = lambda: incremental.index_stream(incremental.source(spark, f"{tmp_path}/in/*", first.schema), build, f"{tmp_path}/index", f"{tmp_path}/state").awaitTermination()
    run()
    assert sorted((r["document_id"], r["fingerprint"]) for r in incremental.read_index(spark, f"{tmp_path}/index").collect()) == [("a", "1"), ("b", "1")]
    spark.createDataFrame([("a", "1", 1), ("a", "7", 0), ("b", "2", 3), ("c", "1", 1)], first.schema).write.parquet(f"{tmp_path}/in/y")
    run()
    spark.createDataFrame([("b", "8", 2)], first.schema).write.parquet(f"{tmp_path}/in/z")  # late: an older version
    run()
    assert sorted((r["document_id"], r["fingerprint"]) for r in incremental.read_index(spark, f"{tmp_path}/index").collect()) == [("a", "1"), ("b", "2"), ("c", "1")]
    assert sorted(r["document_id"] for r in corpus.changed(spark.createDataFrame([("a", "1", 1), ("z", "1", 1)], first.schema), first).collect()) == ["z"]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/events")
    query = incremental.windowed_counts(incremental.dedupe_events(incremental.source(spark, f"{tmp_path}/events", events.schema)), late=None).writeStream.format("memory").queryName("w").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = {(r["window_start"], r["event_type"]): r["n"] for r in history.tumbling(events).collect()}
    assert all(batch[(r["window_start"], r["event_type"])] == r["n"] for r in spark.table("w").collect())


def test_files(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> there</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (folder / "b.docx").write_bytes(body.getvalue())
    (folder / "a.txt").write_text("one\n\ntwo", "utf-8")
    (folder / "c.txt").write_text("one\n\ntwo", "utf-8")
    (folder / "bad.docx").write_bytes(b"no zip")
    scan = files.scan(spark, str(folder))
    groups = {r["name"]: r for r in files.source_groups(scan).collect()}
    assert not groups["c.txt"]["is_canonical"] and groups["c.txt"]["canonical"].endswith("a.txt")
    rows = files.convert(files.source_groups(scan).where("is_canonical").select("path", "document_id").join(scan, "path")).collect()
    assert sorted(r["text"] for r in rows) == ["", "Hello there", "one", "two"] and sum(r["error"] is not None for r in rows) == 1
    before = spark.createDataFrame(files.inventory(spark, str(folder)).collect())
    (folder / "a.txt").write_text("changed", "utf-8")
    assert [tuple(r) for r in files.verify_inventory(before, files.inventory(spark, str(folder))).collect()] == [("a.txt", "changed")]
    files.write_pointer(str(tmp_path / "active.json"), {"snapshot": files.publish({"t": spark.range(3)}, str(tmp_path))})
    assert spark.read.parquet(files.read_pointer(str(tmp_path / "active.json"))["snapshot"] + "/t").count() == 3
    assert files.export_csv(spark.range(2).toDF("x"), str(tmp_path / "x.csv")) == 2 and (tmp_path / "x.csv").read_bytes().startswith(b"\xef\xbb\xbf")


def test_annotations(spark, tmp_path):
    coco = {"images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 20}, {"id": 2, "file_name": "b.jpg", "width": 5, "height": 5}], "annotations": [{"id": 1, "image_id": 1, "category_id": 7, "segmentation": [[0, 0, 10, 0, 10, 40], [1, 2, 3]]}], "categories": [{"id": 3, "name": "x"}, {"id": 7, "name": "y"}]}
    (tmp_path / "coco.json").write_text(json.dumps(coco))
    got = {r["file_name"]: r["lines"] for r in annotations.coco_lines(spark, str(tmp_path / "coco.json")).collect()}
    assert got == {"a.jpg": "1 0.000000 0.000000 1.000000 0.000000 1.000000 1.000000", "b.jpg": ""}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "s.json").write_text(json.dumps({"imageWidth": 10, "imageHeight": 10, "shapes": [{"label": "c", "shape_type": "polygon", "points": [[0, 0], [5, 0], [5, 5]]}, {"label": "c", "shape_type": "polygon", "points": [[0, 0], [0, 0]]}]}))
    shapes = annotations.polygons(spark, str(tmp_path / "p"))
    assert sorted(r["valid"] for r in shapes.collect()) == [False, True]
    line = annotations.label_lines(shapes, spark.createDataFrame([("c", 0)], "label string, class_id int")).first()
    assert line["stem"] == "s" and line["lines"].startswith("0 0.000000 0.000000 0.500000")


def test_web_results():
    page = '<a class="result__a" href="https://r.example/?uddg=https%3A%2F%2Fa.org">A &amp; <b>B</b></a><a class="result__a" href="ftp://x">no</a>'
    assert runs.parse_results(page) == [{"url": "https://a.org", "title": "A & B", "snippet": ""}]
    rss = "<rss><item><title>T</title><link>http://x.org</link><description>&lt;b&gt;d&lt;/b&gt;</description></item></rss>"
    assert runs.parse_results(rss) == [{"url": "http://x.org", "title": "T", "snippet": "d"}]


def test_catalog(spark, tmp_path):
    for folder, status in (("runs/one", "old"), ("archive", "new")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "batch_summary.json").write_text(json.dumps({"run_id": "r", "source_folder": "s", "created_at": "2026-01-01", "results": [{"image_name": "i", "status": status, "damage_findings": [{"index": 1, "class_name": "crack", "score": 0.9}]}, {"image_name": "j", "status": status, "damage_findings": []}]}))
    found = runs.findings(runs.catalog(spark, str(tmp_path / "runs"), str(tmp_path / "archive"))).collect()
    assert {(r["image_name"], r["status"], r["finding_index"]) for r in found} == {("i", "new", 1), ("j", "new", None)}
