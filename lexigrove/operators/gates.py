"""Quality gates: every rule gives rows (rule, key, detail); a healthy corpus gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import finite


def violation(rows: DataFrame, rule: str, key: str, detail: Column | None = None) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def contiguous(rows: DataFrame, key: str, number: str, first: int = 1) -> DataFrame:
    """Keys whose numbers are not exactly first, first + 1, ... without gap or repeat."""
    found = rows.groupBy(key).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.count(number).alias("n"), F.count_distinct(number).alias("d"))
    bad = found.where((F.col("low") != first) | (F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("n") != F.col("d")))
    return violation(bad, "not_contiguous", key, F.concat_ws(",", "low", "high", "n"))


def page_coverage(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents whose pages are not exactly 1..page_count, with what is missing and what is too many."""
    seen = pages.groupBy("document_id").agg(F.array_sort(F.collect_set("page_number")).alias("seen"))
    want = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count").cast("int"))).otherwise(F.array().cast("array<int>"))
    met = documents.join(seen, "document_id", "left").withColumns({"want": want, "seen": F.coalesce("seen", F.array().cast("array<int>"))})
    missing, extra = F.array_except("want", "seen"), F.array_except("seen", "want")
    return violation(met.where((F.size(missing) > 0) | (F.size(extra) > 0)), "page_coverage", "document_id", F.concat(F.lit("missing "), missing.cast("string"), F.lit(" extra "), extra.cast("string")))


def metadata_coverage(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Share of rows with a value, six decimals, for each column."""
    share = lambda c: F.round(F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("double")), 6)
    return rows.groupBy(*by).agg(*[share(c).alias(f"{c}_coverage") for c in columns])


def missing_columns(frame: DataFrame, required: dict[str, list[str]], tables: dict[str, DataFrame]) -> DataFrame:
    """Required tables and columns that are not there."""
    spark = frame.sparkSession
    gone = [("missing_table", t, "") if t not in tables else ("missing_column", t, c) for t, cs in required.items() for c in ([""] if t not in tables else sorted(set(cs) - set(tables[t].columns)))]
    return spark.createDataFrame(gone, "rule string, key string, detail string")


def not_finite(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    bad = [F.when(F.col(c).isNotNull() & ~finite(F.col(c)), F.lit(c)) for c in columns]
    return violation(rows.withColumn("_bad", F.concat_ws(",", *bad)).where("_bad <> ''"), "not_finite", key, F.col("_bad"))


def unique(rows: DataFrame, key: str) -> DataFrame:
    return violation(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "not_unique", key, F.col("n"))


def orphans(child: DataFrame, parent: DataFrame, key: str, rule: str = "orphan") -> DataFrame:
    return violation(child.join(parent.select(key), key, "left_anti").select(key).distinct(), rule, key)


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only."""
    met = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "fullouter")
    return violation(met.where("_l is null or _r is null"), "parity", key, F.when(F.col("_l").isNull(), "right_only").otherwise("left_only"))


def version_compatible(version: Column, family: str, least: int) -> Column:
    """``family.vN`` with N at least ``least``."""
    return F.coalesce((F.regexp_extract(version, r"^(.*)\.v\d+$", 1) == family) & (F.try_to_number(F.nullif(F.regexp_extract(version, r"\.v(\d+)$", 1), F.lit("")), F.lit("999999999")) >= least), F.lit(False))


def expectation_gate(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, passed) of representative questions.

    ``results``: name, document_id, standard; ``expected``: name, expected_standards,
    expected_document_ids (any of them), expected_tokens and token_match (all or any, in the ids).
    """
    got = results.groupBy("name").agg(F.collect_set("document_id").alias("ids"), F.collect_set(F.upper(F.regexp_replace("standard", r"\s+", ""))).alias("stds"), F.concat_ws(" ", F.collect_set("document_id")).alias("all_ids"))
    met = expected.join(got, "name", "left")
    none = F.array().cast("array<string>")
    any_of = lambda want, have: (F.size(want) == 0) | F.arrays_overlap(want, F.coalesce(have, none))
    token = lambda t: F.contains(F.coalesce("all_ids", F.lit("")), t)
    tokens = F.when(F.size("expected_tokens") == 0, True).when(F.col("token_match") == "all", F.forall("expected_tokens", token)).otherwise(F.exists("expected_tokens", token))
    upper = F.transform("expected_standards", lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    return met.select("name", (any_of(upper, F.col("stds")) & any_of(F.col("expected_document_ids"), F.col("ids")) & tokens).alias("passed"))


def decide(gates: DataFrame) -> DataFrame:
    """All gates together: passed only if there are gates and all of them passed."""
    return gates.agg(F.count("*").alias("n_gates"), F.count_if(~F.col("passed")).alias("n_failed"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"))


def review_errors(records: DataFrame) -> DataFrame:
    """Why benchmark records may not be published: unreviewed, unverified, no direct label, or labels that miss candidates."""
    r = F.col("review")
    direct = F.transform(F.filter(r["relevance_labels"], lambda x: x["label"] == "direct"), lambda x: x["chunk_id"])
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(r["reviewer_id"]), F.lit("")) == "", "reviewer_missing"), F.when(F.coalesce(F.trim(r["reviewed_at"]), F.lit("")) == "", "review_time_missing"),
            F.when(F.col("answerable") & ~F.coalesce(r["original_pdf_opened"] & r["page_verified"] & r["text_verified"] & r["answer_verified"], F.lit(False)), "not_verified"),
            F.when(~F.col("answerable") & ~F.coalesce(r["no_answer_verified"], F.lit(False)), "no_answer_not_verified"),
            F.when(F.col("answerable") & (F.size(F.coalesce(direct, F.array().cast("array<string>"))) == 0), "no_direct_label"),
            F.when(F.col("answerable") & (F.size(F.array_except(r["manual_relevant_chunk_ids"], direct)) > 0), "labels_incomplete"),
        )
    )
    return records.select(F.explode(rules).alias("rule"), F.col("question_id").alias("key"), F.lit("").alias("detail"))
