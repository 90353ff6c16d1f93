"""Bases of token segments: their ids stay where they are."""

from lexigrove.llm.token_store import SEGMENTS, with_bases


def test_bases_do_not_shuffle_segments(spark, tmp_path):
    rows = [(p, s, 10 * p + s + 1, [p], bytes(100)) for p in range(3) for s in range(2)]
    spark.createDataFrame(rows, SEGMENTS).write.parquet(f"{tmp_path}/segments")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = with_bases(spark.read.schema(SEGMENTS).parquet(f"{tmp_path}/segments"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["part"], r["seq"], r["base"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not [line for line in plan.splitlines() if "SortMergeJoin" in line and "seq" in line]
    assert got == [(p, s, sum(n for a, b, n, *_ in rows if (a, b) < (p, s))) for p in range(3) for s in range(2)]
