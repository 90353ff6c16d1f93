"""The eight gates before activation: every rule gives rows, and a gate passes if it has none.

``tables`` holds the index as relations:
documents (document_id, source_path, source_name, source_sha256, quality_score, index_version, page_count,
failed_pages array, severe_warnings array), pages (document_id, page_number), chunks (chunk_id, document_id,
retrieval_role, text_search), postings (chunk_id, more allowed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gates

#: The gates, what the tables must have, and the least quality of a document.
GATES = ("database_health", "schema", "integrity", "quality_metadata", "no_duplicate_source_sha256", "representative_queries", "build_manifest", "selected_scope_available")
REQUIRED = {
    "documents": ["document_id", "source_path", "source_name", "source_sha256", "quality_score", "index_version", "page_count", "failed_pages", "severe_warnings"],
    "pages": ["document_id", "page_number"], "chunks": ["chunk_id", "document_id", "retrieval_role", "text_search"], "postings": ["chunk_id"],
}
DESCRIBED = ("source_path", "source_name", "source_sha256", "quality_score")
LEAST_QUALITY = 0.65
_SCHEMA = "gate string, rule string, key string, detail string"


def _of(gate: str, *found: DataFrame) -> DataFrame:
    return gates.together(*found).select(F.lit(gate).alias("gate"), "rule", "key", "detail")


def _present(name: str) -> Column:
    value = F.col(name)
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False)) if name == "quality_score" else F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def described(documents: DataFrame) -> DataFrame:
    """Descriptive columns that some document lacks, with how many have it."""
    counts = documents.agg(F.count("*").alias("total"), *[F.count_if(_present(c)).alias(c) for c in DESCRIBED])
    each = counts.select("total", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in DESCRIBED])).alias("c"))
    return gates.violation(each.select("c.name", "c.n", "total").where("n < total"), "coverage_incomplete", "name", F.concat_ws("/", "n", "total"))


def duplicates(documents: DataFrame) -> DataFrame:
    groups = documents.where(_present("source_sha256")).groupBy("source_sha256").agg(F.count("*").alias("n")).where("n > 1")
    return gates.violation(groups, "duplicate_source_sha256", "source_sha256", F.col("n"))


def quality(documents: DataFrame, pages: DataFrame, least: float = LEAST_QUALITY) -> DataFrame:
    """Why documents are not fit: columns without values, copies of a source, failed pages, low scores, severe warnings, pages that are not exactly 1 to the last."""
    failed = F.coalesce(F.size("failed_pages"), F.lit(0)) > 0
    # severe warnings count by themselves only where no page has failed, as failed pages say so already
    severe = F.coalesce(F.size("severe_warnings"), F.lit(0)) > 0
    wanted = documents.select("document_id", F.coalesce("page_count", F.lit(0)).alias("page_count"))
    return gates.together(
        described(documents), duplicates(documents), gates.violation(documents.where(failed), "failed_pages", "document_id", F.size("failed_pages")),
        gates.violation(documents.where((F.col("quality_score") < least) & ~F.isnan("quality_score")), "quality_below_threshold", "document_id"),
        gates.violation(documents.where(severe & ~failed), "severe_warning", "document_id"), gates.page_coverage(wanted, pages).withColumn("detail", F.lit("")),
    )


def unasserted(expected: DataFrame) -> DataFrame:
    """Expectations without a question, or without anything that a result could meet."""
    said = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x) != "", F.lit(False)))
    any_said = said(F.col("expected_document_ids")) | said(F.col("expected_standards")) | said(F.col("expected_tokens"))
    return gates.violation(expected.where((F.trim(F.coalesce("query", F.lit(""))) == "") | ~any_said), "no_assertion", "name")


def unavailable(scopes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``scopes`` (name, document_ids) that are empty, or name documents without a retrieval row."""
    there = chunks.where("retrieval_role = 'retrieval'").select("document_id").distinct()
    empty = scopes.where(F.coalesce(F.size("document_ids"), F.lit(0)) <= 0)
    missing = scopes.select("name", F.explode("document_ids").alias("document_id")).join(there, "document_id", "left_anti")
    return gates.together(gates.violation(empty, "empty_scope", "name"), gates.violation(missing, "unavailable_document", "name", F.col("document_id")))


def _none(frame: DataFrame, rule: str) -> DataFrame:
    """One row if ``frame`` has none."""
    return gates.violation(frame.agg(F.count("*").alias("n")).where("n = 0").withColumn("key", F.lit("")), rule, "key")


def findings(
    tables: dict[str, DataFrame], expected: DataFrame | None = None, outcomes: DataFrame | None = None, manifest: DataFrame | None = None, scopes: DataFrame | None = None, family: str = "index", least_version: int = 1, least_quality: float = LEAST_QUALITY,
) -> DataFrame:
    """(gate, rule, key, detail) of everything that stands against activation.

    ``expected`` and ``outcomes``: as ``gates.expectation_gate`` takes and gives them, ``expected`` with query; without
    them, or with none, the questions' gate does not pass.  ``manifest``: one row (required_passed, document_count);
    ``scopes``: name, document_ids; both may be left out, an empty one does not pass.  With a table or column missing nothing else is looked at,
    and every gate on the tables says so.
    """
    any_frame = next(iter(tables.values()))
    spark = any_frame.sparkSession
    lacking = gates.missing_columns(any_frame, REQUIRED, tables)
    broken = not lacking.isEmpty()
    parts = [_of("schema", lacking)]
    if broken:
        gone = [(g, "not_checked", "", "") for g in GATES if g not in ("schema", "representative_queries", "build_manifest")]
        parts.append(spark.createDataFrame(gone, _SCHEMA))
    else:
        documents, pages, chunks, postings = (tables[t] for t in ("documents", "pages", "chunks", "postings"))
        live = chunks.where("retrieval_role = 'retrieval' AND text_search <> ''")
        old = documents.where(~gates.version_compatible(F.col("index_version"), family, least_version))
        schema = _of("schema", gates.violation(old, "index_version", "document_id", F.col("index_version")))
        integrity = _of("integrity", gates.unique(chunks, "chunk_id"), gates.orphans(chunks, documents, "document_id"), gates.parity(live, postings, "chunk_id"))
        unfit = _of("quality_metadata", quality(documents, pages, least_quality))
        empty = [_none(frame, f"no_{name}") for name, frame in (("documents", documents), ("retrieval_rows", live), ("postings", postings))]
        own = gates.together(*[part.groupBy("gate").agg(F.count("*").alias("n")).select(F.lit("gate_failed").alias("rule"), F.col("gate").alias("key"), F.lit("").alias("detail")) for part in (schema, integrity, unfit)])
        parts += [schema, integrity, unfit, _of("database_health", *empty, own), _of("no_duplicate_source_sha256", duplicates(documents))]
        if scopes is not None:
            parts.append(_of("selected_scope_available", _none(scopes, "no_scopes"), unavailable(scopes, chunks)))
    if expected is None or outcomes is None:
        parts.append(spark.createDataFrame([("representative_queries", "no_expectations", "", "")], _SCHEMA))
    else:
        parts.append(_of("representative_queries", _none(outcomes, "no_expectations"), unasserted(expected), gates.violation(outcomes.where(~F.coalesce("passed", F.lit(False))), "not_met", "name")))
    if manifest is not None:
        count = F.lit(None).cast("long") if broken else F.col("n")
        built = manifest.withColumn("n", count) if broken else manifest.join(F.broadcast(tables["documents"].agg(F.count("*").alias("n"))))
        rules = F.array_compact(F.array(F.when(~F.coalesce("required_passed", F.lit(False)), "required_gate_failed"), F.when(~F.coalesce(F.col("document_count") == F.col("n"), F.lit(False)), "document_count_differs")))
        parts.append(_of("build_manifest", _none(manifest, "manifest_invalid"), built.select(F.explode(rules).alias("rule"), F.lit("").alias("key"), F.concat_ws("/", "document_count", "n").alias("detail"))))
    return gates.together(*parts)


def judge(found: DataFrame) -> DataFrame:
    """(gate, n_findings, passed) of all eight gates; ``gates.decide`` takes it from here."""
    every = found.sparkSession.createDataFrame([(g,) for g in GATES], "gate string")
    counts = found.groupBy("gate").agg(F.count("*").alias("n_findings"))
    return every.join(counts, "gate", "left").select("gate", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.col("n_findings").isNull().alias("passed"))
