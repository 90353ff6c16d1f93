"""Evidence for an answer: roles, groups, duplicates, source routing and the rendered context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, clean


def role(anchor: Column, channels: Column, retrieval_role: Column, context_for: Column, expanded: Column) -> Column:
    is_anchor = F.coalesce(anchor, F.lit(False)) | (F.size(F.coalesce(channels, F.array().cast("array<string>"))) > 0)
    parent = (F.coalesce(retrieval_role, F.lit("retrieval")) == "context_only") | (F.coalesce(context_for, F.lit("")) != "")
    return F.when(is_anchor, "anchor").when(parent, "parent_context").when(F.coalesce(expanded, F.lit(False)), "expanded_context").when(F.coalesce(retrieval_role, F.lit("retrieval")) == "retrieval", "anchor").otherwise("context")


def kind(chunk_type: Column, table_id: Column, image_id: Column, region_id: Column, generated: Column) -> Column:
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(has(table_id) | chunk_type.isin("table", "table_row"), "table").when(F.coalesce(generated, F.lit(False)), "visual_generated").when((chunk_type == "image_ocr") | has(image_id) | has(region_id), "image_ocr").otherwise("text")


#: How much longer than an anchor's text a row may be that repeats it (characters, factor).
CONTAINED = (80, 1.25)


def _claims(rows: DataFrame, relations: DataFrame | None) -> DataFrame:
    """(query_id, chunk_id, claim, place, reason, heading): who may take a row into a group; the least claim counts.

    Relations come first, in their order; then anchors in theirs, each with the rows made for it; then rows alone.
    """
    item = F.struct(F.col("position").cast("long").alias("a"), F.col("chunk_id").alias("b"))
    claim = lambda kind, number, name: F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("number"), name.alias("name"))
    alone = rows.select("query_id", "chunk_id", claim(2, F.col("position"), F.col("chunk_id")).alias("claim"), item.alias("place"), F.lit("standalone").alias("reason"), F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading"))
    claimed = None
    if relations is not None:
        ordered = F.array_distinct(F.concat(F.col("anchor_chunk_ids"), F.col("chunk_ids")))
        links = relations.select("query_id", "relation_no", "reason", "heading_path", F.posexplode(ordered).alias("at", "chunk_id"))
        held = links.join(rows.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"])
        place = F.struct(F.col("at").cast("long").alias("a"), F.col("chunk_id").alias("b"))
        claimed = held.select("query_id", "chunk_id", claim(0, F.col("relation_no"), F.lit("")).alias("claim"), place.alias("place"), "reason", F.col("heading_path").alias("heading"))
    free = rows if claimed is None else rows.join(claimed.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti")
    anchors = free.where("role = 'anchor'").select("query_id", F.col("chunk_id").alias("head"), F.col("position").alias("head_at"), F.col("parent_id").alias("head_parent"), F.col("heading_path").alias("head_path"))
    others = free.select("query_id", "chunk_id", "position", "role", "context_for")
    made_for = others.join(anchors, (others["query_id"] == anchors["query_id"]) & (others["context_for"] == anchors["head"])).drop(anchors["query_id"])
    parents = others.where("role = 'parent_context'").join(anchors, (others["query_id"] == anchors["query_id"]) & (others["chunk_id"] == anchors["head_parent"])).drop(anchors["query_id"])
    met = made_for.unionByName(parents).where("chunk_id <> head").distinct()
    # an anchor that an earlier one took starts no group; one fold over the question's anchors settles chains of them
    mine = met.groupBy("query_id", "head").agg(F.collect_set("chunk_id").alias("takes"))
    listed = anchors.join(mine, ["query_id", "head"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("head_at", "head", F.coalesce("takes", F.array().cast("array<string>")).alias("takes")))).alias("heads"))
    taken = F.aggregate("heads", F.array().cast("array<string>"), lambda acc, x: F.when(F.array_contains(acc, x["head"]), acc).otherwise(F.array_union(acc, F.filter(x["takes"], lambda t: ~F.exists("heads", lambda y: (y["head"] == t) & ((y["head_at"] < x["head_at"]) | ((y["head_at"] == x["head_at"]) & (y["head"] < x["head"]))))))))
    starters = listed.select("query_id", F.explode("heads").alias("h"), taken.alias("taken")).where(~F.array_contains("taken", F.col("h.head"))).select("query_id", F.col("h.head").alias("head"))
    started = anchors.join(starters, ["query_id", "head"])
    path = F.coalesce("head_path", F.array().cast("array<string>"))
    by_head = claim(1, F.col("head_at"), F.col("head")).alias("claim")
    reason = F.lit("parent_or_expanded_context").alias("reason")
    own = started.select("query_id", F.col("head").alias("chunk_id"), by_head, F.struct(F.lit(-1).cast("long").alias("a"), F.col("head").alias("b")).alias("place"), reason, path.alias("heading"))
    context = met.join(starters, ["query_id", "head"]).select("query_id", "chunk_id", by_head, item.alias("place"), reason, path.alias("heading"))
    context = context.join(starters.withColumnRenamed("head", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    every = alone.unionByName(own).unionByName(context)
    return every if claimed is None else every.unionByName(claimed)


def group_evidence(items: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Evidence groups of each question, with duplicates marked rather than dropped.

    ``items``: query_id, position, chunk_id, parent_id, role, text, heading_path, context_for.
    ``relations`` (optional): query_id, relation_no, chunk_ids, anchor_chunk_ids, heading_path,
    reason.  Every row goes to the least of its claims.  A row repeats the first row with its
    text (case ignored), or an anchor of its own group whose text it holds and hardly exceeds;
    rows of the second kind do not stand for their text.
    """
    base = items.select("query_id", "position", "chunk_id", "parent_id", "role", "heading_path", "context_for", clean(F.col("text")).alias("text"))
    least = _claims(base, relations).groupBy("query_id", "chunk_id").agg(F.min(F.struct("claim", "place", "reason", "heading")).alias("c")).select("query_id", "chunk_id", "c.*")
    by_question = Window.partitionBy("query_id")
    rows = base.join(least, ["query_id", "chunk_id"]).withColumn("group_no", F.dense_rank().over(by_question.orderBy("claim")))
    by_group = Window.partitionBy("query_id", "group_no")
    heads = F.collect_list(F.when((F.col("role") == "anchor") & (F.col("text") != ""), F.struct("place", F.col("chunk_id").alias("id"), F.col("text").alias("t"))))
    rows = rows.withColumn("item_no", F.row_number().over(by_group.orderBy("place"))).withColumn("heads", F.array_sort(heads.over(by_group)))
    more, factor = CONTAINED
    repeats = F.filter("heads", lambda h: F.contains(F.col("text"), h["t"]) & (F.length("text") <= F.greatest(F.length(h["t"]) + more, F.floor(F.length(h["t"]) * factor))))
    rows = rows.withColumn("repeats", F.when((F.col("role") != "anchor") & (F.col("text") != ""), F.get(repeats, 0)["id"])).withColumn("name", casefold("text"))
    so_far = Window.partitionBy("query_id", "name").orderBy("group_no", "item_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stands = F.first(F.when(F.col("repeats").isNull(), F.col("chunk_id")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("stands", F.when(F.col("name") != "", stands))
    same = F.when(F.col("stands").isNotNull() & (F.col("stands") != F.col("chunk_id")), F.col("stands")).otherwise(F.coalesce("repeats", F.lit("")))
    return rows.select("query_id", "group_no", "item_no", "chunk_id", "role", F.col("heading").alias("heading_path"), "reason", (same == "").alias("included"), same.alias("duplicate_of"))


def first_of_text(rows: DataFrame, text: str, order: list[str], by: list[str]) -> DataFrame:
    """``duplicate_of``: the first row with the same normalised text, or NULL for that row itself."""
    name = F.lower(clean(F.col(text)))
    first = F.first("chunk_id").over(Window.partitionBy(*by, name).orderBy(*order))
    return rows.withColumn("duplicate_of", F.when((name != "") & (first != F.col("chunk_id")), first))


def answer_source(requested: Column, n_chunks: Column, hit: Column, n_sources: Column) -> Column:
    """knowledge_base, else web_search if a verified source is there, else model_prior."""
    known = requested.isin("knowledge_base", "web_search", "model_prior")
    chosen = F.when(known, requested).when((n_chunks > 0) & hit, "knowledge_base").when(n_sources > 0, "web_search").otherwise("model_prior")
    return F.when((chosen == "web_search") & (n_sources == 0), "model_prior").otherwise(chosen)


def verified_source(url: Column, title: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    return (F.trim(F.coalesce(title, F.lit(""))) != "") & (F.startswith(u, F.lit("https://")) | F.startswith(u, F.lit("http://")))


def warnings(mode: Column, relevance: Column, n_chunks: Column, source: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.array_compact(
        F.array(
            F.when(n_chunks == 0, "no_evidence_found").otherwise(none),
            F.when((mode == "scoped_fallback") | relevance.isin("unknown", "unavailable"), "relevance_not_confirmed").otherwise(none),
            F.when(source == "model_prior", "answer_source_mode:model_prior").otherwise(none),
            F.when(source == "web_search", "answer_source_mode:web_search").otherwise(none),
        )
    )


def render(grouped: DataFrame, items: DataFrame) -> DataFrame:
    """One text of evidence for each question: groups in order, omitted duplicates named."""
    rows = grouped.join(items.select("query_id", "chunk_id", "source_marker", "text"), ["query_id", "chunk_id"])
    line = F.when(F.col("included"), F.concat_ws("\n", F.concat(F.lit("["), "role", F.lit("]")), "source_marker", "text")).otherwise(F.concat(F.lit("- omitted: "), "source_marker", F.lit(" (same as "), "duplicate_of", F.lit(")")))
    groups = rows.groupBy("query_id", "group_no").agg(F.first("heading_path").alias("heading_path"), F.array_sort(F.collect_list(F.struct("item_no", line.alias("line")))).alias("l"))
    text = F.concat_ws("\n", F.concat(F.lit("### evidence "), F.col("group_no").cast("string")), F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return groups.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("group_no", text.alias("t")))).alias("g")).select("query_id", F.array_join(F.transform("g", lambda x: x["t"]), "\n\n").alias("evidence"))
