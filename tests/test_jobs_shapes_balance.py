"""Conversions that are cancelled and resumed, result shapes, and balanced splits."""

import json
import random
import threading
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexigrove.functions.ocr_results import ocr_rows
from lexigrove.operators import jobs, sampling

# -- jobs ----------------------------------------------------------------------------


def slow(rows):
    @F.udf("string")
    def work(name):
        time.sleep(0.15)
        return name.upper()

    return rows.select("sha256", work("sha256").alias("text"))


def test_cancelled_conversion_keeps_what_is_done_and_goes_on(spark, tmp_path):
    files = spark.range(60).select(F.concat(F.lit("f"), "id").alias("sha256")).coalesce(1)
    target, said, asked, other = f"{tmp_path}/out", [], [], {}
    beside = threading.Thread(target=lambda: other.update(n=sum(r["text"] is not None for r in slow(spark.range(40).select(F.col("id").cast("string").alias("sha256")).coalesce(1)).collect())))
    beside.start()
    stop = lambda: asked.append(1) or any(p["parts_done"] >= 1 for p in said)
    first = jobs.convert(files, slow, target, part_files=15, progress=said.append, should_stop=stop)
    beside.join()
    assert first["state"] == "cancelled" and 1 <= first["parts_done"] < 4 and other["n"] == 40  # the other job ran through
    kept = {r["sha256"] for r in jobs.converted(spark, target).collect()}
    assert len(kept) == first["done"] and said[0]["state"] == "running" and said[-1]["state"] == "cancelled"
    second = jobs.convert(files, slow, target, part_files=30)
    assert second["state"] == "done" and (second["skipped"], second["done"]) == (len(kept), 60 - len(kept))
    rows = [r["sha256"] for r in jobs.converted(spark, target).collect()]
    assert sorted(rows) == sorted(f"f{i}" for i in range(60))
    third = jobs.convert(files, slow, target)
    assert (third["skipped"], third["parts"]) == (60, 0)
    assert spark.range(5).count() == 5 and not spark.getTags()


def test_failed_part_leaves_finished_ones(spark, tmp_path):
    files = spark.range(12).select(F.concat(F.lit("f"), "id").alias("sha256"))

    def breaks(rows):
        return rows.select("sha256", F.when(F.col("sha256") == "f7", F.raise_error(F.lit("unreadable"))).otherwise(F.lit("x")).alias("text"))

    with pytest.raises(Exception, match="unreadable"):
        jobs.convert(files, breaks, f"{tmp_path}/out", part_files=2)
    held = jobs.converted(spark, f"{tmp_path}/out")
    assert held is None or "f7" not in {r["sha256"] for r in held.collect()}
    assert jobs.convert(files, slow, f"{tmp_path}/out")["state"] == "done"
    assert jobs.converted(spark, f"{tmp_path}/out").select("sha256").distinct().count() == 12


# -- shapes --------------------------------------------------------------------------


def test_four_shapes_give_equal_rows(spark):
    found = [([[1, 2], [11, 2], [11.5, 8], [1, 8]], " one ", 0.9), ([[0, 0], [5, 5]], "two", 0.5), (None, "", 0.1), ([[1, "x"]], "three", None)]
    boxes, texts, scores = map(list, zip(*found))
    rows = [list(f) for f in found]
    shapes = [{"boxes": boxes, "txts": texts, "scores": scores}, {"polys": boxes, "texts": texts, "scores_list": scores}, rows, [rows, 0.25]]
    odd = [None, "no json", "{}", "[]", "3", '{"txts": "text"}', "[[], 1]", '[["only"]]', "null"]
    table = spark.createDataFrame([(n, json.dumps(s)) for n, s in enumerate(shapes)] + [(100 + n, s) for n, s in enumerate(odd)], "page int, result string")
    got = defaultdict(list)
    for r in ocr_rows(table).orderBy("page", "order").collect():
        got[r["page"]].append((r["order"], r["text"], r["bbox"], r["confidence"]))
    want = [(0, "one", [1.0, 2.0, 11.5, 8.0], 0.9), (1, "two", [0.0, 0.0, 5.0, 5.0], 0.5), (3, "three", None, None)]
    assert dict(got) == {n: want for n in range(4)}


def test_missing_parts_stay_null(spark):
    table = spark.createDataFrame([(1, json.dumps({"txts": ["a", "b"], "boxes": [[[0, 1]]]})), (2, json.dumps([[None, "c"], [[[2, 3]], "d", "0.75"]]))], "page int, result string")
    got = sorted((r["page"], r["text"], r["bbox"], r["confidence"]) for r in ocr_rows(table).collect())
    assert got == [(1, "a", [0.0, 1.0, 0.0, 1.0], None), (1, "b", None, None), (2, "c", None, None), (2, "d", [2.0, 3.0, 2.0, 3.0], 0.75)]


# -- balance -------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_every_label_has_its_share_to_within_a_group(spark, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for group in range(500):
        kinds = rng.sample("abcdefgh", rng.choice([0, 1, 1, 2, 3]))
        for _ in range(rng.choice([1, 1, 1, 2, 4])):
            rows.append((n, f"g{group}", kinds))
            n += 1
    rows += [(n + i, None, ["rare"]) for i in range(20)] + [(n + 20 + i, "huge", ["a", "b"]) for i in range(60)]
    samples = spark.createDataFrame(rows, "sample_id long, digest string, labels array<string>")
    split = {r["sample_id"]: r["split"] for r in sampling.balanced_split(samples, 5).collect()}
    assert len(split) == len(rows)
    by_group, held, got, largest = defaultdict(set), Counter(), Counter(), Counter()
    for i, g, kinds in rows:
        by_group[g or f"n{i}"].add(split[i])
        for k in kinds:
            held[k] += 1
            got[k, split[i]] += 1
            largest[k, g or f"n{i}"] += 1
    assert all(len(s) == 1 for s in by_group.values())
    for k, all_rows in held.items():
        most = max(v for (label, _), v in largest.items() if label == k)
        for name, share in sampling.SPLITS.items():
            assert all_rows < 20 or abs(got[k, name] - share * all_rows) <= most, (k, name)
    assert {r["sample_id"]: r["split"] for r in sampling.balanced_split(samples.repartition(7), 5).collect()} == split
