"""Expected against actual: identities as multisets, order, pairing, last-write-wins lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """Identities whose counts differ: missing, duplicate or added, with both counts."""
    left = expected.groupBy(*keys).agg(F.count("*").alias("n_expected"))
    right = actual.groupBy(*keys).agg(F.count("*").alias("n_actual"))
    met = left.join(right, list(keys), "fullouter").fillna(0, ["n_expected", "n_actual"])
    issue = F.when(F.col("n_expected") == 0, "added").when(F.col("n_actual") < F.col("n_expected"), "missing").when(F.col("n_actual") > F.col("n_expected"), "duplicate")
    return met.withColumn("issue", issue).where("issue is not null")


def order_changed(expected: DataFrame, actual: DataFrame, key: str, position: str) -> DataFrame:
    """Identities on both sides whose places differ."""
    met = expected.select(key, F.col(position).alias("expected_pos")).join(actual.select(key, F.col(position).alias("actual_pos")), key)
    return met.where("expected_pos <> actual_pos")


def pairing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys with their side: both, left_only, right_only."""
    met = left.select(key).distinct().withColumn("_l", F.lit(True)).join(right.select(key).distinct().withColumn("_r", F.lit(True)), key, "fullouter")
    return met.select(key, F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only").alias("side"))


def last_wins(rows: DataFrame, keys: list[str], *priority: str) -> DataFrame:
    """The row with the highest priority for each key."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(p).desc_nulls_last() for p in priority])
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def subset(report: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows of the report that the wanted multiset holds, in the report's order, as many times as it asks."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("position"))
    counts = wanted.groupBy(*keys).agg(F.count("*").alias("_want"))
    return report.withColumn("_n", n).join(counts, list(keys)).where("_n <= _want").drop("_n", "_want")


def conflicting(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys that stand for more than one combination of values; their rows should be dropped entirely."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("n")).where("n > 1").select(key)


def audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows removed and rows added, as multisets."""
    return before.exceptAll(after).withColumn("change", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("change", F.lit("added")))
