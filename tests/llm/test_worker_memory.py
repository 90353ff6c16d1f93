"""Workers outlive their tasks; what a task made them hold does not stay."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest

from lexigrove.llm import common, piece_codec


def held() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="reads Linux' figures")
def test_worker_gives_memory_back(spark):
    """A task frees 100 MB in small pieces below one that stays; the same worker's next task is to find little of it."""

    def greedy(batches):
        for batch in batches:
            pieces = [np.ones(8192) for _ in range(1600)]
            common.pinned = pieces[-1]
            del pieces
            yield batch

    def ask(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [int(held())] * batch.num_rows})

    one = spark.range(0, 1, 1, 1)
    before = one.mapInArrow(ask, "id long").collect()[0][0]
    one.mapInArrow(common.lean(greedy), "id long").collect()
    assert one.mapInArrow(ask, "id long").collect()[0][0] < before + 50


def test_functions_of_tables_keep_their_results(spark):
    rows = spark.range(10).selectExpr("id % 3 as k", "id")
    schema = "k long, n long"
    count = lambda t: pa.table({"k": t.column("k")[:1], "n": [t.num_rows]})
    both = lambda a, b: pa.table({"k": a.column("k")[:1], "n": [a.num_rows + b.num_rows]})
    by = rows.groupBy("k")
    assert sorted(map(tuple, by.applyInArrow(common.lean(count, 1), schema).collect())) == [(0, 4), (1, 3), (2, 3)]
    assert sorted(map(tuple, by.cogroup(by).applyInArrow(common.lean(both, 2), schema).collect())) == [(0, 8), (1, 6), (2, 6)]


def test_models_stay_only_between_tasks_that_use_them(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def use(batches):
        for batch in batches:
            before = piece_codec.model.cache_info().currsize
            piece_codec.model(path)
            yield pa.RecordBatch.from_pydict({"id": [before] * batch.num_rows})

    def other(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": [piece_codec.model.cache_info().currsize] * batch.num_rows})

    one = spark.range(0, 1, 1, 1)
    users, others = (one.mapInArrow(f, "id long") for f in (common.lean(use, keeps=piece_codec.model), common.lean(other)))
    assert [f.collect()[0][0] for f in (others, users, users, others)] == [0, 0, 1, 0]
