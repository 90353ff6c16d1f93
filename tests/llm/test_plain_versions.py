"""Operators that SQL cannot express against plain versions, measured quality on the driver's tables, and time on hostile input."""

import math
import os
import time
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import bloom, html_extract, importance_resampling, language_mixture

FOLDER = "/root/testdata/sf0.01"
there = pytest.mark.skipif(not os.path.exists(f"{FOLDER}/pages.parquet"), reason="needs the driver's tables")


class Article(HTMLParser):
    """Words of a page's article element, by the standard library's tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.words += data.split()


@there
def test_html_precision_and_recall():
    kept = wanted = common = 0
    for (source,) in duckdb.sql(f"select html from '{FOLDER}/pages.parquet'").fetchall():
        parser = Article()
        parser.feed(source or "")
        got, want = Counter(html_extract.extract_text(source).split()), Counter(parser.words)
        kept, wanted, common = kept + got.total(), wanted + want.total(), common + (got & want).total()
    assert common / kept > 0.999 and common / wanted > 0.999


PROSE = "Sentence one, with commas, and words that go on for a while. " * 5
PAGES = {
    "parts at other depths": (f"<body><div>{PROSE}</div><div><div><div>{PROSE}</div></div></div></body>", 2),
    "slash of a value": (f"<body><script src=/a.js/>var x = 1</script><div><p>{PROSE}</p></div></body>", 1),
    "link whose value ends in a slash": (f"<body><div><a href=/x/>{'menu ' * 40}</a></div><div><p>{PROSE}</p></div></body>", 1),
    "article in a side column": (f"<body><div class='col-side'><p>{PROSE}</p><p>{PROSE}</p></div><div class=sidebar><p>junk, junk</p></div></body>", 2),
    "comments as articles": (f"<body><article><h1>T</h1><p>{PROSE}</p></article><div class='comments'><article class='comment'><p>{PROSE}</p></article></div></body>", 2),
}


@pytest.mark.parametrize("name", PAGES)
def test_html_cases(name):
    page, blocks = PAGES[name]
    found = html_extract.extract_text(page)
    assert len(found.split("\n\n")) == blocks and "var x" not in found and "junk" not in found and "menu" not in found


@pytest.mark.parametrize("page", ["<b>" * 200_000 + "</x>" * 200_000, "<b>" * 200_000 + "<p>" * 20_000, "<table><td>" + "<i>" * 100_000 + "</b>" * 100_000, "<p>" * 200_000 + "y", '<a ="' * 100_000])
def test_html_time_is_linear(page):
    began = time.process_time()
    html_extract.extract_text(page)
    assert time.process_time() - began < 5


def test_resampling_equals_plain_version(spark):
    rng = np.random.default_rng(6)
    text = lambda good: " ".join((f"g{i}" if good else f"b{i}") if i % 2 else f"c{i}" for i in rng.integers(0, 60, 40).tolist())
    rows = [(i, text(i % 3 > 0)) for i in range(150)] + [(150, None), (151, ""), (152, text(True))]
    labels = {i: int(i % 3 > 0) for i in range(0, 150, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, keys = importance_resampling.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), share=0.4)
    raw, target = Counter(), Counter()
    for i, t in rows:
        own = Counter(importance_resampling.features(t).tolist())
        raw += own
        if labels.get(i) == 1:
            target += own
    size = 1 << importance_resampling.BUCKET_BITS
    ratio = lambda f: math.log((target[f] + 1) / (target.total() + size)) - math.log((raw[f] + 1) / (raw.total() + size))
    plain = {i: float(np.mean([ratio(f) for f in importance_resampling.features(t).tolist()])) if t and t.split() else None for i, t in rows}
    got = {r["doc_id"]: r for r in keys.collect()}
    for i, value in plain.items():
        assert got[i]["score"] == (None if value is None else pytest.approx(value, abs=1e-9))
    noise = {r["doc_id"]: r["g"] for r in docs.select("doc_id", importance_resampling.gumbel(F.col("doc_id")).alias("g")).collect()}
    ranked = sorted((v + importance_resampling.TEMPERATURE * noise[i] for i, v in plain.items() if v is not None), reverse=True)
    assert model.least_key == pytest.approx(ranked[round(0.4 * len(ranked)) - 1], abs=1e-9)
    assert abs(np.mean(list(noise.values())) - 0.577) < 0.4


def plain_mixture(parts):
    """Proportions by expectation-maximisation, one segment and language at a time."""
    share = [1 / len(parts)] * len(parts)
    for _ in range(language_mixture.ROUNDS):
        new = [0.0] * len(parts)
        for j in range(parts.shape[1]):
            weights = [s * math.exp(parts[k][j] - max(parts[:, j])) for k, s in enumerate(share)]
            for k, w in enumerate(weights):
                new[k] += w / sum(weights) / parts.shape[1]
        done = max(abs(a - b) for a, b in zip(new, share)) < 1e-4
        share = [max(x, 1e-9) for x in new]
        share = [x / sum(share) for x in share]
        if done:
            break
    return share


def test_mixture_equals_plain_version():
    rng = np.random.default_rng(8)
    for count in (2, 3, 5):
        parts = rng.normal(-60, 6, (count, 40))
        assert language_mixture.expect_maximise(parts)[1] == pytest.approx(plain_mixture(parts), abs=1e-9)


@there
def test_language_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in language_mixture.op7_language_id(spark, FOLDER).collect()}
    truth = dict(duckdb.sql(f"select doc_id, lang from '{FOLDER}/documents.parquet' where lang is not null").fetchall())
    held = [i for i in truth if rows[i]["held_out"]]
    assert len(held) > 100 and sum(rows[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.98


def test_bloom_filter_loses_nothing(spark, monkeypatch):
    rows, keys = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7).withColumnRenamed("id", "own")
    for most in (1 << 19, 1):  # a filter of the right size, and one that is full
        monkeypatch.setattr(bloom, "MAX_BLOCKS", most)
        found = {r["k"] for r in bloom.possible(rows, "k", keys, "own").collect()}
        assert set(range(0, 5000, 7)) <= found and (most == 1 or len(found) < 1000)
    assert bloom.possible(rows, "k", keys.limit(0), "own").count() == 0
