"""What searches shuffle: rows for each question, not postings, pairs or texts."""

import math
import random

from lexigrove.operators import chunking, retrieval
from lexigrove.operators.postings import bm25


def shuffled(spark, act):
    """The result of ``act``, and the records and bytes that its stages wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    doubles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, doubles, None)
        found = [stages.apply(i) for i in range(stages.size())]
        return sum(s.shuffleWriteRecords() for s in found), sum(s.shuffleWriteBytes() for s in found)

    before = total()
    out = act()
    after = total()
    return out, after[0] - before[0], after[1] - before[1]


def test_bm25_shuffles_neither_postings_nor_pairs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.random() ** 2 * 30)}" for _ in range(40))) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # copies tie
    asked = [(q, [f"w{rng.randrange(30)}" for _ in range(6)]) for q in range(60)] + [(100 + q, ["w1", "w2"]) for q in range(40)]
    index = spark.createDataFrame(rows, "chunk_id long, text_search string").repartition(3)
    found, records, _ = shuffled(spark, lambda: bm25(index, spark.createDataFrame(asked, "query_id long, terms array<string>"), 4, {"text_search": 2.0}, round_to=9).collect())
    assert records <= 2 * 700 + 3 * (32 + 61 * 4)  # the rows that this test deals out, then counts and k rows a question and task
    words = {i: t.split() for i, t in rows}
    mean = sum(map(len, words.values())) / len(words)
    frequency = {t: sum(t in w for w in words.values()) for t in {t for _, ts in asked for t in ts}}
    def score(w, terms):
        return sum(max(1e-6, math.log((len(words) - frequency[t] + 0.5) / (frequency[t] + 0.5))) * (f := 2.0 * w.count(t)) * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(terms))

    for q, terms in asked:
        best = sorted((-round(s, 9), i) for i, w in words.items() if (s := score(w, terms)))[:4]
        got = sorted((r["rank"], r["chunk_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [(r, i) for r, i, _ in got] == [(n + 1, i) for n, (_, i) in enumerate(best)]
        assert all(abs(s + b) < 2e-9 for (_, _, s), (b, _) in zip(got, best))


def test_bm25_cuts_a_task_s_rows_on_the_way(spark, monkeypatch):
    from lexigrove.operators import postings

    rng = random.Random(8)
    rows = [(f"c{rng.randrange(10**6):06d}-{i}", " ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    index = spark.createDataFrame(rows, "chunk_id string, text_search string").coalesce(1)
    asked = spark.createDataFrame([(q, [f"w{q}", f"w{q + 1}"]) for q in range(11)], "query_id long, terms array<string>")
    ask = lambda: sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in bm25(index, asked, 7, {"text_search": 1.0}, round_to=9).collect())
    want = ask()
    monkeypatch.setattr(postings, "PASS_ROWS", 7 * 4)  # blocks of four questions, each cut after every few rows
    assert ask() == want and len(want) == 77


def test_expansion_shuffles_no_texts_that_nobody_asked_for(spark, tmp_path, request):
    for name, value in (("files.maxPartitionBytes", "512k"), ("files.openCostInBytes", "512k"), ("autoBroadcastJoinThreshold", "64k")):  # a scan of several tasks, too large to broadcast
        request.addfinalizer(lambda n=f"spark.sql.{name}": spark.conf.unset(n))
        spark.conf.set(f"spark.sql.{name}", value)
    rng = random.Random(5)
    columns = "chunk_id string, document_id string, location string, part int, primary_page int, text string, retrieval_role string, parent_id string, heading_path array<string>"
    rows = [(f"c{i:05d}", f"d{i % 2}", "x", 0, 1, rng.randbytes(1000).hex(), "retrieval", "p", ["h"]) for i in range(2000)] + [("p", "d1", "", 0, 1, "about", "context_only", "", [])]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    asked = [(q, f"c{1 + 2 * (q + 20 * j):05d}", "d1", ["h"], "p", j + 1) for q in range(5) for j in range(3)]  # rows 0, 20 and 40 of their group, and so on
    anchors = spark.createDataFrame(asked, "query_id long, chunk_id string, document_id string, heading_path array<string>, parent_id string, rank int")
    found, records, size = shuffled(spark, lambda: retrieval.expand(anchors, chunks, 50_000, 8).collect())
    assert records < 1_000 and size < 4_000_000 / 4
    text = {r[0]: r[5] for r in rows}
    for q in range(5):
        own = [c for n, c, *_ in asked if n == q]
        near = [c for i in range(2000) if (c := f"c{i:05d}") not in own and i % 2][: 8 - 3]
        # anchors first, then by page and location: the parent's is empty; the eighth row is the last
        want = [(c, "anchor") for c in sorted(own)] + [("p", "parent")] + [(c, "sibling") for c in near][:4]
        assert [(r["chunk_id"], r["role"]) for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["position"])] == want
    assert all(r["text"] == text[r["chunk_id"]] for r in found)


def test_sentences_are_counted_once(spark):
    plan = spark.createDataFrame([("a. b.",)], "t string").select(chunking.split_children("t").alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_count") <= 12  # three each for a sentence, a tail, the empty start and a finished piece
