"""The pipeline, and the subpackage's SQL, over small tables."""

import os
import random

import duckdb
import pytest

import corpus_pipeline
from lexigrove.llm import decontaminate, golay_simhash, registry, suffix_dedup

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("tables")
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, item = text(60), text(25)
    rows = [(i, text(rng.randint(60, 200)), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(5)]  # exact copies
    rows += [(110 + i, text(80) + " " + passage + " " + text(40), "en", "s", 0) for i in range(4)]
    rows += [(120, text(50) + " " + item, "en", "s", 0), (121, None, None, None, None), (122, "", "en", "s", 0)]
    rows += [(130 + i, " ".join(f"{w}***" for w in text(80).split()), "en", "s", 0) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(130 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, text(8))], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    urls = ["http://a.example.net/en/1", "https://b.net/x", "http://c.org/fr/", "x", None, "http://D.example.com/de/?q"]
    spark.createDataFrame([(i, u, "<p>x") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return str(path), rows, passage


def test_stages(spark, folder):
    path, rows, passage = folder
    found = {}
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, path), "test")
        found[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(found["quality classifier"][1]) == {r[0] for r in rows} - {*range(130, 150), 121, 122}
    near = found["simhash near-dedup"]
    smallest = {r["component_id"] for r in golay_simhash.near_duplicates(near[0]).collect()}
    assert ids(near[1]) == smallest and not smallest & set(range(100, 105))
    cut = found["suffix-array dedup"]
    ordered = sorted((r["doc_id"], r["text"]) for r in cut[0].collect())
    expected = {i: k.decode("utf-8", "ignore") for (i, _), (_, _, _, k) in zip(ordered, suffix_dedup.brute_force([t.encode() for _, t in ordered]))}
    assert {r["doc_id"]: r["text"] for r in cut[1].collect()} == expected
    assert sum(passage in t for t in expected.values()) == 1
    clean = found["benchmark decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    bad = set()
    for r in clean[0].collect():
        n, hit, _ = decontaminate.brute_force(r["text"], items)
        if hit and 20 * len(hit) >= n:
            bad.add(r["doc_id"])
    assert 120 in bad and ids(clean[1]) == ids(clean[0]) - bad
    last = found["sentencepiece"]
    texts = {r["doc_id"]: r["text"] for r in last[0].collect()}
    assert {r["doc_id"]: r["text"] for r in last[1].collect()} == texts and all(r["n_tokens"] == len(r["token_ids"]) for r in last[1].collect())


def test_run_equals_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 50


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, folder, name):
    path = folder[0]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    frame = registry.QUERIES[name](spark, path)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r) for r in frame.select(*names).collect()))) == sorted(map(repr, found.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11)) and 4 <= len(corpus_pipeline.STAGES) <= 5 and os.path.exists(corpus_pipeline.__file__)
