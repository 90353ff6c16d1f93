"""Index-side relations: duplicates, projections, page statistics, incremental replacement, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.identity import content_hash


def canonical(rows: DataFrame, digest: Column, order: list[str], by: list[str] | None = None, key: str = "chunk_id") -> DataFrame:
    """``canonical_id``: the first row with the same digest (within ``by``)."""
    window = Window.partitionBy(*(by or []), digest).orderBy(*order)
    return rows.withColumn("canonical_id", F.first(key).over(window))


def duplicate_groups(rows: DataFrame, digest: Column, key: str) -> DataFrame:
    """(digest, n_rows, first_id, last_id) of digests that occur more than once."""
    return rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n_rows"), F.min(key).alias("first_id"), F.max(key).alias("last_id")).where("n_rows > 1")


def group_members(rows: DataFrame, digest: Column, key: str) -> DataFrame:
    """Members of duplicate groups as rows, so that a group's size is not bound by one row."""
    return rows.withColumn("digest", digest).withColumn("n_rows", F.count("*").over(Window.partitionBy("digest"))).where("n_rows > 1").select("digest", key, "n_rows")


def index_fields(chunks: DataFrame) -> DataFrame:
    """Columns of the relational index derived from chunk rows (missing values become empty strings or defaults)."""
    empty = F.lit("")
    s = lambda c: F.coalesce(F.col(c).cast("string"), empty) if c in chunks.columns else empty
    pages = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col("page_numbers").cast("array<int>"), F.array().cast("array<int>")), lambda p: p > 0)))
    body = X.index_clean(F.coalesce(F.nullif(s("text_search"), empty), s("text")))
    number = F.nullif(s("standard_number"), empty)
    found = F.get(X.standards(s("text")), 0)
    return chunks.select(
        "chunk_id", "document_id", s("parent_id").alias("parent_id"), s("location").alias("location"), s("source_marker").alias("source_marker"), s("text").alias("text"), body.alias("text_search"),
        F.coalesce(F.nullif(s("chunk_level"), empty), F.lit("child")).alias("chunk_level"), F.coalesce(F.nullif(s("retrieval_role"), empty), F.lit("retrieval")).alias("retrieval_role"),
        F.coalesce(F.nullif(s("chunk_type"), empty), F.lit("paragraph")).alias("chunk_type"), F.regexp_replace(s("clause_number"), r"[第条\s]", "").alias("clause_number"),
        F.coalesce(number, found, empty).alias("standard_number"), pages.alias("page_numbers"), F.get(pages, 0).alias("primary_page"),
        F.coalesce(F.col("heading_path"), F.array().cast("array<string>")).alias("heading_path"), F.array_join(F.coalesce(F.col("heading_path"), F.array().cast("array<string>")), " > ").alias("heading_text"),
        F.when(s("chunk_type").isin("table", "table_row"), body).otherwise(empty).alias("table_text"), F.when(s("chunk_type") == "image_ocr", body).otherwise(empty).alias("image_text"),
        content_hash(body).alias("content_hash"), F.coalesce(F.col("part").cast("int") if "part" in chunks.columns else F.lit(0), F.lit(0)).alias("part"),
    )


def chunk_pages(index: DataFrame) -> DataFrame:
    return index.select("chunk_id", "document_id", F.explode("page_numbers").alias("page_number"))


def chunk_headings(index: DataFrame) -> DataFrame:
    return index.select("chunk_id", "document_id", F.posexplode("heading_path").alias("level", "heading"))


def chunk_relations(index: DataFrame) -> DataFrame:
    """Parent and child edges, for children only, once each."""
    return index.where("chunk_level = 'child' AND parent_id <> ''").select("parent_id", F.col("chunk_id").alias("child_id"), "document_id").distinct()


def page_statistics(index: DataFrame, inventory: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Per page: chunk count, union of methods and warnings, review flag; pages without chunks are kept.

    ``inventory``: document_id, page_number, methods, warnings, needs_review; ``diagnostics`` the same without methods.
    """
    none = F.array().cast("array<string>")
    rows = (
        chunk_pages(index).select("document_id", "page_number", F.lit(1).alias("n"), none.alias("methods"), none.alias("warnings"), F.lit(False).alias("review"))
        .unionByName(inventory.select("document_id", "page_number", F.lit(0).alias("n"), "methods", "warnings", F.col("needs_review").alias("review")))
        .unionByName(diagnostics.select("document_id", "page_number", F.lit(0).alias("n"), none.alias("methods"), "warnings", F.col("needs_review").alias("review")))
    )
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    return rows.groupBy("document_id", "page_number").agg(F.sum("n").alias("n_chunks"), union("methods").alias("methods"), union("warnings").alias("warnings"), F.max("review").alias("needs_review"))


def index_report(index: DataFrame) -> DataFrame:
    """Counters of a build, one row per document."""
    first = F.row_number().over(Window.partitionBy("document_id", "content_hash").orderBy("chunk_id"))
    return index.withColumn("_n", first).groupBy("document_id").agg(
        F.count_if(F.col("chunk_level") == "parent").alias("n_parents"), F.count_if(F.col("chunk_level") == "child").alias("n_children"),
        F.count_if(F.col("retrieval_role") == "retrieval").alias("n_retrieval"), F.count_if(F.col("_n") > 1).alias("n_duplicates"),
    )


def changed(source: DataFrame, published: DataFrame, key: str = "document_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Rows whose fingerprint is not published yet."""
    return source.join(published.select(key, fingerprint), [key, fingerprint], "left_anti")


def replaced(published: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Published rows with all rows of the fresh documents in place of theirs."""
    return published.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def profile(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


def representatives(rows: DataFrame, by: list[str], size: str, key: str) -> DataFrame:
    """The largest row of each group; of equal sizes the first by key."""
    best = rows.groupBy(*by).agg(F.max(F.struct(F.col(size).alias("size"), (-F.col(key)).alias("first"))).alias("best"))
    return best.select(*by, (-F.col("best.first")).alias(key), F.col("best.size").alias(size))


#: Fixed value: pages that are recommended for review, at most.
MOST_REVIEW = 30


def document_records(documents: DataFrame, pages: DataFrame, chunks: DataFrame, most_review: int = MOST_REVIEW) -> DataFrame:
    """``documents`` with what a benchmark wants to know of each: kinds of pages, children, and the first pages to review.

    ``pages``: document_id, page_number, methods array, warnings array, needs_review; ``chunks``: document_id, retrieval_role,
    is_cross_page.  Added: n_pages, n_ocr_pages, n_native_pages, n_warning_pages, n_review_pages, n_children,
    n_cross_page_children, and review_pages, the least ``most_review`` numbers of pages with a warning or a wish for review, each once.
    A page is read by recognition if any of its methods is.  Null arrays are empty; documents without pages have zeros.
    """
    none = F.array().cast("array<string>")
    warned = F.size(F.coalesce("warnings", none)) > 0
    review = F.coalesce(F.col("needs_review").cast("boolean"), F.lit(False))
    ocr = F.exists(F.coalesce("methods", none), lambda m: F.coalesce(F.contains(F.lower(m), F.lit("ocr")), F.lit(False)))
    read = pages.select("document_id", "page_number", warned.alias("warned"), review.alias("review"), ocr.alias("ocr"))
    kinds = read.groupBy("document_id").agg(
        F.count("*").alias("n_pages"), F.count_if("ocr").alias("n_ocr_pages"), F.count_if(~F.col("ocr")).alias("n_native_pages"), F.count_if("warned").alias("n_warning_pages"), F.count_if("review").alias("n_review_pages")
    )
    live = chunks.where("retrieval_role = 'retrieval'").groupBy("document_id").agg(F.count("*").alias("n_children"), F.count_if(F.col("is_cross_page").cast("boolean")).alias("n_cross_page_children"))
    # ranked before it is collected, so that a document of a million pages sends a few numbers only
    marked = read.where("(warned OR review) AND page_number IS NOT NULL").select("document_id", "page_number").distinct()
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))
    first = marked.withColumn("_n", place).where(F.col("_n") <= most_review).groupBy("document_id").agg(F.array_sort(F.collect_list("page_number")).alias("review_pages"))
    counts = ["n_pages", "n_ocr_pages", "n_native_pages", "n_warning_pages", "n_review_pages", "n_children", "n_cross_page_children"]
    met = documents.join(kinds, "document_id", "left").join(live, "document_id", "left").join(first, "document_id", "left")
    empty = F.array().cast(first.schema["review_pages"].dataType)
    return met.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, "review_pages": F.coalesce("review_pages", empty)})
