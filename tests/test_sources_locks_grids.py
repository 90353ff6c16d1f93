"""Archive reader, label writer, fencing lock, line sweep, run labelling, and samples with null keys."""

import json
import os
import random
import subprocess
import sys
import time
import zipfile
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.functions import geometry
from lexigrove.operators import activation, pages, retrieval, sampling, tables
from lexigrove.sources import fencing, label_files, shared_files, vector_archive

# -- archives ------------------------------------------------------------------------


@pytest.mark.parametrize("compressed", [False, True])
def test_archive_is_read_by_row_ranges(spark, tmp_path, compressed):
    vectors = np.random.default_rng(1).normal(size=(5000, 8)).astype(np.float32)
    path = f"{tmp_path}/v.npz"
    vector_archive.write_archive(path, [f"c{i}" for i in range(5000)], vectors, compressed)
    rows = vector_archive.read_vectors(spark, path, rows=700)
    assert rows.rdd.getNumPartitions() == 8
    got = {r["chunk_id"]: r["vector"] for r in rows.collect()}
    assert len(got) == 5000 and all(np.array_equal(np.float32(got[f"c{i}"]), vectors[i]) for i in range(0, 5000, 97))


def test_archive_bounds(spark, tmp_path):
    good = np.ones((3, 2), np.float32)
    cases = {"repeat": (["a", "a", "b"], good), "nan": (["a", "b", "c"], np.array([[1, np.nan]] * 3, np.float32)), "count": (["a", "b"], good), "flat": (["a", "b", "c"], np.ones(3)), "kind": (["a", "b", "c"], np.ones((3, 2), int))}
    for name, (ids, vectors) in cases.items():
        vector_archive.write_archive(f"{tmp_path}/{name}.npz", ids, vectors)
        with pytest.raises(Exception, match="finite|shape|repeat"):
            vector_archive.read_vectors(spark, f"{tmp_path}/{name}.npz").collect()
    vector_archive.write_archive(f"{tmp_path}/bomb.npz", ["a"], np.zeros((1, 8000)), compressed=True)
    with pytest.raises(Exception, match="expands"):
        vector_archive.read_vectors(spark, f"{tmp_path}/bomb.npz", most_ratio=5).collect()
    np.savez(f"{tmp_path}/objects.npz", vectors=good, chunk_ids=np.array(["a", None, 3], dtype=object))
    with pytest.raises(Exception, match="objects"):
        vector_archive.read_vectors(spark, f"{tmp_path}/objects.npz").collect()
    with zipfile.ZipFile(f"{tmp_path}/cut.npz", "w") as z:
        whole = f"{tmp_path}/whole.npz"
        vector_archive.write_archive(whole, ["a", "b", "c"], good)
        with zipfile.ZipFile(whole) as w:
            z.writestr("vectors.npy", w.read("vectors.npy")[:-4])
            z.writestr("chunk_ids.npy", w.read("chunk_ids.npy"))
    with pytest.raises(Exception, match="ends before"):
        vector_archive.read_vectors(spark, f"{tmp_path}/cut.npz").collect()
    vector_archive.write_archive(f"{tmp_path}/none.npz", [], np.ones((0, 4), np.float32))
    assert vector_archive.read_vectors(spark, f"{tmp_path}/none.npz").count() == 0


# -- label files ---------------------------------------------------------------------


def labels(spark, n=40):
    return spark.range(n).select(F.when(F.col("id") % 4 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("img"), "id").alias("stem"), F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("0 0.1 0.2\n1 "), "id")).alias("lines")).repartition(5)


def write(rows, path, mode="append"):
    rows.sparkSession.dataSource.register(label_files.LabelFiles)
    rows.write.format("label_files").option("path", path).option("names", "crack,spall").mode(mode).save()


def content(path):
    return {os.path.relpath(f"{d}/{f}", path): open(f"{d}/{f}").read() for d, _, files in os.walk(path) for f in files}


def test_labels_appear_together(spark, tmp_path):
    path = f"{tmp_path}/set"
    write(labels(spark), path)
    found = content(path)
    assert found["labels/train/img1.txt"] == "0 0.1 0.2\n1 1\n" and found["labels/val/img0.txt"] == "" and len(found) == 42
    listed = [line.split(",") for line in found["manifest.csv"].splitlines()]
    assert listed[0] == list(label_files.MANIFEST) and sorted(r[1] for r in listed[1:]) == sorted(f"img{i}" for i in range(40)) and {r[1]: r[3] for r in listed[1:]}["img1"] == "2"
    assert "  1: spall" in found["dataset.yaml"] and not label_files.leftovers(path)
    with pytest.raises(Exception, match="FileExists|exist"):
        write(labels(spark), path)
    assert content(path) == found and not label_files.leftovers(path)
    write(labels(spark, 8), path, "overwrite")
    assert len(content(path)) == 10


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/set"
    bad = labels(spark).withColumn("stem", F.when(F.col("stem") == "img7", F.lit("../img7")).otherwise(F.col("stem")))
    with pytest.raises(Exception, match="no file name"):
        write(bad, path)
    assert not os.path.exists(path) and not label_files.leftovers(path)
    write(labels(spark), path)
    first = content(path)
    write(labels(spark), path, "overwrite")
    strip = lambda c: {k: sorted(v.splitlines()) for k, v in c.items()}
    assert strip(content(path)) == strip(first)


def test_a_task_that_runs_again_gives_the_same_files(spark, tmp_path):
    writer = label_files.LabelWriter({"path": f"{tmp_path}/set", "names": "a"}, False)
    context = lambda: type("C", (), {"partitionId": lambda self: 3})()
    from pyspark import TaskContext

    real, rows = TaskContext.get, [dict(zip(label_files.COLUMNS, r)) for r in [("train", "x", "0 1"), ("val", "y", None)]]

    def dies():
        yield rows[0]
        raise RuntimeError("lost")

    try:
        TaskContext.get = staticmethod(context)
        with pytest.raises(RuntimeError):
            writer.write(dies())
        assert not os.path.exists(f"{tmp_path}/set")
        writer.commit([writer.write(iter(rows)), None])
    finally:
        TaskContext.get = real
    assert sorted(content(f"{tmp_path}/set")) == ["dataset.yaml", "labels/train/x.txt", "labels/val/y.txt", "manifest.csv"]


# -- lock ----------------------------------------------------------------------------


def test_tokens_grow_and_old_holders_are_fenced(tmp_path):
    lock, pointer = f"{tmp_path}/lock", f"{tmp_path}/pointer"
    with fencing.leased(lock) as one:
        with pytest.raises(fencing.Held):
            fencing.acquire(lock)
        fencing.publish(pointer, {"v": 1}, one)
    slow = fencing.acquire(lock, lasts=0.0)
    os.rename(f"{lock}/{slow.token:012d}.json", f"{lock}/{slow.token:012d}.json.x")  # its owner becomes another host's, long silent
    shared_files.create_once(None, f"{lock}/{slow.token:012d}.json", json.dumps({"host": "elsewhere", "pid": 1, "lasts": 0.05}).encode())
    time.sleep(0.1)
    fast = fencing.acquire(lock)
    assert fast.token == slow.token + 1
    with pytest.raises(fencing.Fenced):
        slow.renew()
    fast.renew()
    fencing.publish(pointer, {"v": 3}, fast)
    with pytest.raises(fencing.Fenced):
        fencing.publish(pointer, {"v": 2}, slow)
    shared_files.create_once(None, f"{pointer}/{slow.token:012d}.json", b'{"v": 2}')  # even a write that had passed the check
    assert fencing.current(pointer) == {"v": 3}


def test_activation_by_an_overtaken_holder_does_nothing(tmp_path):
    pointer = f"{tmp_path}/active.json"
    shared_files.create_once(None, pointer, b'{"snapshot": "old", "digest": "0", "active": true, "previous": null}')  # an older release's file
    with activation.exclusive(f"{pointer}.lock") as slow, pytest.raises(TimeoutError):
        activation.deactivate(pointer)
    with activation.exclusive(f"{pointer}.lock") as fast:
        activation._publish(pointer, {"snapshot": "new", "digest": "1", "active": True, "previous": None}, fast)
    with pytest.raises(fencing.Fenced):
        activation._publish(pointer, {"snapshot": "late", "digest": "2", "active": True, "previous": None}, slow)
    assert activation._active(pointer)["snapshot"] == "new" and json.loads(open(pointer).read())["snapshot"] == "new"
    activation.deactivate(pointer)
    assert activation._active(pointer) == {"snapshot": "new", "digest": "1", "active": False, "previous": None}


def test_a_dead_owner_and_an_empty_file_do_not_lock_for_ever(tmp_path):
    lock = f"{tmp_path}/lock"
    gone = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {os.getcwd()!r}); from lexigrove.sources import fencing; print(fencing.acquire({lock!r}).token)"], capture_output=True, text=True, check=True)
    assert gone.stdout.strip() == "1" and fencing.acquire(lock).token == 2
    other = f"{tmp_path}/other"
    os.makedirs(other)
    open(f"{other}/000000000001.json", "w").close()
    with pytest.raises(fencing.Held):
        fencing.acquire(other, lasts=60)
    os.utime(f"{other}/000000000001.json", (1, 1))
    assert fencing.acquire(other, lasts=60).token == 2


def test_of_many_drivers_one_gets_each_token(tmp_path):
    """Processes that all see the same stale lock: each token has one holder."""
    lock = f"{tmp_path}/lock"
    fencing.create_once(None, f"{lock}/000000000001.json", b'{"host": "elsewhere", "lasts": 0}')
    code = f"""
import sys, time; sys.path.insert(0, {os.getcwd()!r})
from lexigrove.sources import fencing
while time.time() < {time.time() + 4!r}: pass
for _ in range(40):
    try:
        lease = fencing.acquire({lock!r}); print(lease.token, flush=True); lease.release()
    except fencing.Held: pass
"""
    running = [subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.PIPE, text=True) for _ in range(4)]
    tokens = [int(t) for p in running for t in p.communicate(timeout=60)[0].split()]
    assert len(tokens) == len(set(tokens)) >= 4 and max(tokens) == len(tokens) + 1


# -- lines and runs ------------------------------------------------------------------


def nested(flat, tall, t):
    boss = list(range(len(flat) + len(tall)))

    def find(i):
        return i if boss[i] == i else find(boss[i])

    for n, h in enumerate(flat):
        for m, v in enumerate(tall):
            if h[0] - t <= v[0] <= h[2] + t and v[1] - t <= h[1] <= v[3] + t:
                boss[find(n)] = find(len(flat) + m)
    return find


def test_sweep_equals_nested_loop():
    rng = random.Random(9)
    for _ in range(400):
        size = rng.choice([6, 30, 200])
        flat = [(x := rng.randrange(size), y := rng.randrange(size), x + rng.randrange(1, size), y) for _ in range(rng.randrange(25))]
        tall = [(x := rng.randrange(size), y := rng.randrange(size), x, y + rng.randrange(1, size)) for _ in range(rng.randrange(25))]
        a, b = tables.sweep_crossings(flat, tall, 1.5), nested(flat, tall, 1.5)
        n = len(flat) + len(tall)
        assert [[a(i) == a(j) for j in range(n)] for i in range(n)] == [[b(i) == b(j) for j in range(n)] for i in range(n)]


def test_sweep_of_many_lines():
    n = 50_000
    flat, tall = [(0, 10 * i, 10 * n, 10 * i) for i in range(n)], [(10 * i, 0, 10 * i, 10 * n) for i in range(n)]
    began = time.process_time()
    find = tables.sweep_crossings(flat, tall, 1.5)  # 2.5 thousand million crossings
    assert time.process_time() - began < 30 and len({find(i) for i in range(2 * n)}) == 1


def walked(mask, connected):
    labels, count = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        count += 1
        labels[y, x], queue = count, deque([(y, x)])
        while queue:
            cy, cx = queue.popleft()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    ny, nx = cy + dy, cx + dx
                    if (connected == 8 or not dy or not dx) and 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not labels[ny, nx]:
                        labels[ny, nx] = count
                        queue.append((ny, nx))
    return labels, count


@pytest.mark.parametrize("connected", [4, 8])
def test_runs_give_the_walks_labels(connected):
    rng = np.random.default_rng(3)
    for share in (0.05, 0.3, 0.5, 0.7, 1.0):
        for shape in ((1, 1), (1, 40), (40, 1), (23, 31)):
            mask = rng.random(shape) < share
            want, count = walked(mask, connected)
            got, n = geometry.components(mask, connected)
            assert n == count and (got == want).all()
    assert geometry.components(np.zeros((3, 4), bool)) [1] == 0 and geometry.components(np.zeros((0, 4), bool))[1] == 0


def test_large_pages_with_specks():
    grey = np.full((2600, 4000), 255, np.float32)
    rng = np.random.default_rng(4)
    for y, x in zip(rng.integers(0, 1299, 10_000) * 2, rng.integers(0, 1999, 10_000) * 2):
        grey[y, x] = 0
    began = time.process_time()
    ratio, large, small = pages.spots(grey)
    assert time.process_time() - began < 5 and large == 0 and small == walked(grey < 128, 8)[1]
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8], ring[3:6, 3:6] = True, False
    assert geometry.fill_holes(ring).sum() == 49


# -- null keys and dimensions --------------------------------------------------------


def test_samples_without_a_digest_stay(spark):
    rows = spark.createDataFrame([(1, "a", ["x"]), (2, None, ["x"]), (3, "b", None), (4, None, ["y"]), (5, "a", ["y"])], "sample_id long, digest string, labels array<string>")
    found = {r["sample_id"]: r["split"] for r in sampling.stratified_split(rows, 1).collect()}
    assert sorted(found) == [1, 2, 3, 4, 5] and found[1] == found[5]
    off = {(r["label"], r["split"]): (r["held"], r["rows"]) for r in sampling.balance(rows, spark.createDataFrame(list(found.items()), "sample_id long, split string")).collect()}
    assert off["x", found[2]][0] == 2 and sum(v[1] for k, v in off.items() if k[0] == "y") == 2


def test_pools_keep_a_null_key(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "a"), (3, "a"), (3, "a"), (2**60 + 1, "b")], "chunk_id long, kind string")
    found = sampling.pools(rows, [("a", F.col("kind") == "a", 3), ("all", F.lit(True), 5)], 7).collect()
    assert {r["chunk_id"] for r in found if r["pool"] == "a"} == {1, None, 3} and sum(r["pool"] == "a" for r in found) == 3
    assert {(r["chunk_id"], r["reused"]) for r in found if r["pool"] == "all"} == {(1, True), (None, True), (3, True), (2**60 + 1, False)}


def test_vectors_of_other_dimensions_are_skipped(spark):
    vectors = spark.createDataFrame([("a", "d", [1.0, 0.0]), ("b", "d", [0.0, 1.0]), ("c", "d", [1.0, 0.0, 0.0]), ("e", "d", [])], "chunk_id string, document_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1], None), (2, [1.0, 0.0, 0.0], None)], "query_id int, embedding array<double>, scope array<string>")
    got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in retrieval.semantic_channel(vectors, asked, 5).collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
