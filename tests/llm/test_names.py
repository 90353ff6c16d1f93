"""Columns named like scratch columns and results go through every operator and stage with their values."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigrove.llm import decontaminate, golay_simhash, importance_resampling, language_mixture, piece_codec, suffix_dedup

NAMES = ["_id", "_tie", "_had", "_raw", "_blk", "_kept", "_place", "_digest", "_root", "row_key", "row_id", "row_digest", "row_flag", "_row_key", "whole_key", "_score", "own_score", "own_number", "score", "lang_pred",
         "n_words", "hit_items", "hit_spans", "_bad", "own_spans", "own_items", "own_count", "own_flag", "own_id", "own_tie", "own_raw", "own_block", "N_BYTES", "n_removed", "kept_sha256", "token_ids", "decoded", "best_id", "fp", "root", "key", "component_id"]
RESULTS = {"lang_pred", "score", "token_ids", "decoded", "n_words", "hit_items", "hit_spans"}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    one, line = text(90), text(40)
    return [(1, one), (2, one), (2, text(70)), (None, text(60)), (None, text(60)), (5, None), (6, ""), (7, text(30) + " " + line), (8, text(30) + " " + line), (9, text(20)), (9, None), (10, "word " * 4000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    marked = [(i, t, "en", "s", len(t or ""), n) for n, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(marked, "doc_id long, text string, lang string, source string, n_chars long, mark long")
    return frame.select("*", *[F.concat(F.lit(f"{n}:"), F.col("mark").cast("string")).alias(n) for n in NAMES])


def unchanged(found, docs, replaced=()):
    """All columns are there in order, and each row's own values with them."""
    left = [c for c in docs.columns if c not in replaced]
    assert [c for c in found.columns if c in left] == left
    for r in found.collect():
        assert all(r[n] == f"{n}:{r['mark']}" for n in NAMES if n not in replaced)
    return sorted(r["mark"] for r in found.collect())


def test_operators_keep_columns(spark, docs, rows):
    everyone = list(range(len(rows)))
    labels = spark.createDataFrame([(1, 1), (10, 0)], "doc_id long, quality int")
    benchmark = spark.createDataFrame([(0, rows[9][1])], "item_id long, text string")
    assert unchanged(suffix_dedup.remove_repeats(docs, report=False), docs) == everyone
    assert unchanged(suffix_dedup.remove_repeats(docs), docs, {"N_BYTES", "n_removed"}) == everyone
    assert unchanged(suffix_dedup.remove_repeats(docs, digest=True), docs, {"text", "N_BYTES", "n_removed", "kept_sha256"}) == everyone
    assert unchanged(decontaminate.decontaminate(docs, benchmark), docs) == [n for n in everyone if n != 9]
    assert unchanged(decontaminate.decontaminate(docs, benchmark, remove="spans"), docs) == everyone
    assert unchanged(decontaminate.find_contamination(docs, benchmark), docs, RESULTS & {"n_words", "hit_items", "hit_spans"}) == everyone
    assert set(unchanged(importance_resampling.keep_good(docs, labels), docs)) <= set(everyone) - {5, 6, 10}
    assert unchanged(language_mixture.predict(docs, language_mixture.Model({})), docs, {"lang_pred", "score"}) == everyone
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert unchanged(piece_codec.encode_documents(docs, path, chunk=500, decoded="decoded"), docs, {"token_ids", "decoded"}) == everyone


@pytest.mark.parametrize("options", [{}, {"similarity": corpus_pipeline.Fraction(4, 5), "shingle": 5}])
def test_near_copies_keep_columns(docs, options):
    kept = unchanged(golay_simhash.keep_one(docs, **options), docs)
    assert kept in ([0, 2, 3, 4, 5, 7, 8, 9, 11],)  # one of the equal texts, one of the blank ones


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names"))
    spark.createDataFrame([(1, 1), (2, 1), (9, 1), (10, 0)], "doc_id long, quality int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, rows[9][1])], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_empty_tables(spark, docs, folder, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    found = run(spark, docs, folder)
    assert run(spark, docs.limit(0), folder).count() == 0
    if stage == "sentencepiece":
        assert found.count() == docs.count()
    else:
        assert found.columns == docs.columns
        unchanged(found, docs)
