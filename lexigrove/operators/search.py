"""Whole searches composed of the retrieval parts: the production search, the plain full-text search, scoped search, and semantic results.

``queries`` has query_id, text and scope (array of document ids; NULL is the whole corpus,
an empty array nothing), as in ``retrieval``.  All questions are answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens, normal_title
from ..sources.shared_files import written
from . import rerank, retrieval
from .postings import bm25
from .retrieval import STORAGE, budget, in_scope

#: Candidates of the production search, and their characters.
LEAST_POOL, POOL_FACTOR, CHARS_EACH, MOST_CHARS = 30, 5, 4_000, 100_000


def scope_problems(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, problem, document_id): selected scopes that are empty, and selected documents without a retrieval row."""
    asked = queries.where(F.col("scope").isNotNull())
    empty = asked.where(F.size("scope") == 0).select("query_id", F.lit("empty_scope").alias("problem"), F.lit(None).cast("string").alias("document_id"))
    there = chunks.where("retrieval_role = 'retrieval'").select("document_id").distinct()
    missing = asked.select("query_id", F.explode("scope").alias("document_id")).join(there, "document_id", "left_anti")
    return empty.unionByName(missing.select("query_id", F.lit("unavailable_document").alias("problem"), "document_id"))


def surviving_context(direct: DataFrame, selected: DataFrame, wide: DataFrame) -> DataFrame:
    """Context rows of the groups that still hold a selected anchor, each with the group's first selected anchor.

    ``direct``: all anchors (query_id, chunk_id, document_id, heading_path, parent_id, rank); ``selected``: the anchors
    that reranking kept (query_id, chunk_id, rank); ``wide``: the expansion of all anchors, with heading_path.  A group
    is a question's rows of one document under one heading; anchors that were not selected become context of it.
    """
    group = ["query_id", "document_id", "heading_path"]
    kept = direct.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"]).where(F.size("heading_path") > 0)
    heads = kept.groupBy(*group).agg(F.min(F.struct("rank", "chunk_id")).alias("head"), F.collect_set("parent_id").alias("parents"))
    first = direct.where(F.size("heading_path") > 0).groupBy(*group).agg(F.min("rank").alias("group_at"))
    rest = wide.join(selected.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    inside = rest.where("role <> 'parent'").join(heads, group)
    own_parent = heads.select("query_id", "document_id", "head", F.col("heading_path").alias("group_path"), F.explode("parents").alias("chunk_id"))
    above = rest.where("role = 'parent'").drop("heading_path").join(own_parent, ["query_id", "document_id", "chunk_id"]).withColumnRenamed("group_path", "heading_path")
    columns = [*group, "chunk_id", "location", "part", "primary_page", "text", F.col("head.chunk_id").alias("context_for")]
    met = inside.select(*columns).unionByName(above.select(*columns)).join(first, group)
    once = Window.partitionBy("query_id", "chunk_id").orderBy("group_at", "context_for")
    return met.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def production_search(
    chunks: DataFrame, documents: DataFrame, queries: DataFrame, top_k: int = 6, max_chars: int = 10_000, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, load=None, max_chunks: int = 24,
) -> DataFrame:
    """Passages for every question: (query_id, position, chunk_id, document_id, role, text, rerank_score, reranker, context_for).

    A pool of max(30, 5 k) candidates over all channels, adaptively weighted, is always expanded; only direct rows are
    reranked (by the model that ``load`` makes, or the baseline); then come the rows of groups that kept an anchor.
    The character budget cuts the list.  The pool, the selection and the expansion are written, as each is used several times.  Questions with a selected but empty scope get nothing; see ``scope_problems``.
    """
    pool = max(LEAST_POOL, POOL_FACTOR * max(1, top_k))
    wide_chars = max(max_chars, min(MOST_CHARS, pool * CHARS_EACH))
    found = retrieval.retrieve(chunks, documents, queries, pool, query_vectors, vectors, adaptive=True)
    direct = written(budget(found, wide_chars), "direct")
    rows = direct.join(queries.select("query_id", F.col("text").alias("query")), "query_id").withColumns(
        {"position": F.col("rank") - 1, "anchor": F.lit(True), "expanded": F.lit(False), "semantic_score": F.col("semantic_score")}
    )
    best = rerank.rerank_baseline(rows, top_k) if load is None else rerank.rerank_model(rows, load, top_k)
    selected = written(best.select("query_id", "chunk_id", "document_id", "text", "rank", "rerank_score", "reranker"), "selected")
    wide = written(retrieval.expand(direct, chunks, wide_chars, max_chunks), "wide")
    wide = written(wide.join(retrieval.among(chunks, wide).select("chunk_id", "heading_path"), "chunk_id"), "around")
    context = surviving_context(direct, selected, wide)
    none = F.lit(None)
    anchors = selected.select("query_id", F.struct(F.lit(0).alias("a"), F.col("rank").cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit("").alias("d"), F.lit(0).alias("e"), F.col("chunk_id").alias("f")).alias("at"), "chunk_id", "document_id", F.lit("anchor").alias("role"), "text", "rerank_score", "reranker", none.cast("string").alias("context_for"))
    extra = context.select(
        "query_id", F.struct(F.lit(1).alias("a"), F.col("group_at").cast("long").alias("b"), F.coalesce(F.col("primary_page").cast("long"), F.lit(1 << 40)).alias("c"), F.col("location").alias("d"), F.col("part").cast("int").alias("e"), F.col("chunk_id").alias("f")).alias("at"),
        "chunk_id", "document_id", F.lit("context").alias("role"), "text", none.cast("double").alias("rerank_score"), none.cast("string").alias("reranker"), "context_for",
    )
    placed = anchors.unionByName(extra).withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).drop("at")
    return budget(placed, max_chars, "position")


def plain_search(chunks: DataFrame, documents: DataFrame, queries: DataFrame, top_k: int = 6, max_chars: int = 10_000) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, text, score, mode) by the first step that finds anything for a question.

    title: chunks of documents whose title equals the question, or else contains it or is contained in it; lexical:
    unweighted BM25 over the text; like: literal substrings in storage order.  Scope holds in every step.
    ``documents``: document_id, source_name, status.
    """
    ready = documents.where("status = 'ready'").select("document_id", "source_name")
    rows = chunks.join(ready, "document_id")
    asked = queries.select("query_id", "scope", "text", normal_title(F.col("text")).alias("q"))
    exact = F.col("q") == F.col("title")
    near = F.contains("title", F.col("q")) | ((F.length("title") >= 4) & F.contains("q", F.col("title")))
    titles = ready.withColumn("title", normal_title(F.col("source_name"))).where("title <> ''")
    met = titles.join(asked.where(F.length("q") >= 4), (exact | near) & in_scope(F.col("scope"), F.col("document_id"))).withColumn("exact", exact)
    met = met.withColumn("any_exact", F.max("exact").over(Window.partitionBy("query_id"))).where("exact = any_exact").select("query_id", "document_id")
    by_name = [F.lower("source_name"), F.lower("location"), F.col("chunk_id")]
    columns = ["query_id", "chunk_id", "document_id", "text", "score", "mode", "rank"]

    def ranked(found: DataFrame, mode: str, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        return found.withColumn("mode", F.lit(mode)).withColumn("rank", place).where(F.col("rank") <= top_k).select(*columns)

    by_title = ranked(rows.join(met, "document_id").withColumn("score", F.lit(0.0)), "title", *by_name)
    left = asked.join(by_title.select("query_id").distinct(), "query_id", "left_anti").withColumn("terms", F.array_distinct(index_tokens(F.col("text")))).where(F.size("terms") > 0)
    pairs = bm25(rows, left.select("query_id", "terms", "scope"), top_k, {"text": 1.0}, round_to=9, scoped="document_id")
    lexical = ranked(pairs.drop("rank").join(rows.select("chunk_id", "text"), "chunk_id"), "lexical", F.col("score").desc(), F.col("chunk_id"))
    still = left.join(lexical.select("query_id").distinct(), "query_id", "left_anti")
    held = rows.withColumn("low", F.lower("text")).join(still.select("query_id", "terms", "scope"), in_scope(F.col("scope"), F.col("document_id")) & F.exists("terms", lambda t: F.contains(F.col("low"), t)))
    like = ranked(held.withColumn("score", F.lit(0.0)), "like", *[F.col(c) for c in STORAGE])
    return budget(by_title.unionByName(lexical).unionByName(like), max_chars)


def scoped_search(chunks: DataFrame, documents: DataFrame, queries: DataFrame, top_k: int = 6, max_chars: int = 10_000) -> DataFrame:
    """As ``plain_search`` inside selected scopes; a question that finds nothing gets the first rows of its scope, by document name."""
    asked = queries.where(F.col("scope").isNotNull() & (F.size("scope") > 0))
    found = plain_search(chunks, documents, asked, top_k, max_chars)
    left = asked.join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode(F.array_distinct("scope")).alias("document_id"))
    rows = chunks.join(documents.where("status = 'ready'").select("document_id", "source_name"), "document_id").join(left, "document_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.lower("source_name"), F.lower("location"), "chunk_id"))
    first = rows.withColumn("rank", place).where(F.col("rank") <= top_k).select("query_id", "chunk_id", "document_id", "text", F.lit(0.0).alias("score"), F.lit("scoped_fallback").alias("mode"), "rank")
    return found.unionByName(budget(first, max_chars))


def semantic_result(chunks: DataFrame, queries: DataFrame, hits: DataFrame, warning: Column | None = None) -> DataFrame:
    """(query_id, relevance_status, scope_available, n_candidates, warning) of semantic searches.

    A search with a warning is unavailable; else it is a hit or not.  A scope is available if it has any retrieval row.
    ``hits``: query_id and one row for each candidate.
    """
    there = chunks.where("retrieval_role = 'retrieval'").groupBy("document_id").agg(F.lit(1).alias("there"))
    scoped = queries.where(F.size("scope") > 0).select("query_id", F.explode("scope").alias("document_id")).join(there, "document_id").select("query_id").distinct().withColumn("met", F.lit(True))
    any_row = there.agg((F.count("*") > 0).alias("any_row"))
    counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
    rows = queries.withColumn("warning", F.lit("") if warning is None else F.coalesce(warning, F.lit(""))).join(counts, "query_id", "left").join(scoped, "query_id", "left").join(F.broadcast(any_row))
    status = F.when(F.col("warning") != "", "unavailable").when(F.col("n") > 0, "hit").otherwise("no_hit")
    whole = F.coalesce(F.size("scope") == 0, F.lit(True)) | F.col("scope").isNull()
    return rows.select("query_id", status.alias("relevance_status"), F.when(whole, F.col("any_row")).otherwise(F.coalesce("met", F.lit(False))).alias("scope_available"), F.coalesce("n", F.lit(0)).alias("n_candidates"), "warning")
