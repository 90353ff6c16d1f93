"""Retrieval over a chunk table: channels, fusion, reserves, budgets, hydration and expansion.

The engine is batched: ``queries`` has one row for each question with query_id, text
and scope (array of document ids; NULL is the whole corpus, an empty array nothing).
``chunks`` has chunk_id, document_id, location, part, primary_page, text, text_search,
retrieval_role, parent_id, heading_path, standard_number, clause_number.  Every
ordering ends with chunk_id, so results are reproducible.
"""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import reciprocal_rank
from ..functions.text import clauses, normal_standard, normal_title, query_terms, route, standards
from ..sources.shared_files import written
from .postings import FIELD_WEIGHTS, blocks, bm25

STORAGE = ("document_id", "location", "chunk_id")
#: Weights of the channels that have one.
CHANNEL_WEIGHTS = {"like": 0.35, "standard_exact": 8.0, "clause_exact": 10.0, "source_title_exact": 12.0}
EXACT_CHANNELS = ("standard_exact", "clause_exact")
CHANNEL_ORDER = ["bm25", "like", "standard_exact", "clause_exact", "source_title_exact", "semantic"]


def in_scope(scope: Column, document_id: Column) -> Column:
    return scope.isNull() | F.array_contains(scope, document_id)


def _ranked(rows: DataFrame, channel: str, k: int, *order: Column, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).withColumn("channel", F.lit(channel))


_COLUMNS = ("query_id", "chunk_id", "document_id", "channel", "rank", "score", "terms")


def bm25_channel(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Field-weighted BM25; statistics over all retrieval rows, scope applied before the cut.  The score is negative, as in full-text engines: less is better; nine decimals, so that ties are ties."""
    index = chunks.where("retrieval_role = 'retrieval' AND text_search <> ''")
    fields = {f: w for f, w in FIELD_WEIGHTS.items() if f in chunks.columns}
    asked = queries.select("query_id", "scope", query_terms(F.col("text")).alias("terms"))
    scored = bm25(index, asked, k, fields, round_to=9, scoped="document_id").withColumns({"score": -F.col("score"), "channel": F.lit("bm25")})
    return scored.join(asked.select("query_id", "terms"), "query_id").select(*_COLUMNS)


#: Questions whose terms or vectors one task holds at a time.
BLOCK = 4096


def _passes(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else empty


#: Places of ids' hashes: what is broadcast of any number of ids has at most so many rows.
PLACES = 1 << 20


def among(chunks: DataFrame, ids: DataFrame, column: str = "chunk_id") -> DataFrame:
    """The rows of ``chunks`` whose ``column`` may be in that of ``ids``, taken in the scan: all that are, and of the others about one in PLACES for each id.

    What joins them with ``ids`` then shuffles the text of few rows.
    """
    place = lambda: F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(PLACES))
    asked = ids.select(place().alias("_place")).distinct()
    return chunks.withColumn("_place", place()).join(F.broadcast(asked), "_place", "left_semi").drop("_place")


def like_channel(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Literal substring match of up to 24 terms, ASCII case ignored, in storage order.

    One automaton of a block's terms reads each text once, whatever the number of terms; a task keeps the first k rows
    of each question, so the result before ranking has k rows a question and task.
    """
    asked = queries.select("query_id", "scope", F.slice(F.filter(query_terms(F.col("text")), lambda t: F.length(t) >= 2), 1, 24).alias("terms")).where(F.size("terms") > 0)
    rows = chunks.where("retrieval_role = 'retrieval'").select(*[F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(STORAGE)], F.lower("text_search").alias("low"), *STORAGE)
    kinds = chunks.select(*STORAGE).schema
    schema = T.StructType([T.StructField("q", T.IntegerType()), *kinds])
    session = chunks.sparkSession
    numbered = T.StructType([T.StructField("q", T.IntegerType()), *queries.select("query_id").schema])
    parts = []
    for block in blocks(asked, BLOCK):
        terms: dict[str, list[int]] = {}
        for n, row in enumerate(block):
            for term in dict.fromkeys(row["terms"]):
                terms.setdefault(term, []).append(n)
        scopes = [None if row["scope"] is None else frozenset(map(str, row["scope"])) for row in block]
        shared = session.sparkContext.broadcast((terms, scopes))
        found = rows.mapInArrow(_first_holding(shared, k, schema.names), schema)
        names = session.createDataFrame([(n, row["query_id"]) for n, row in enumerate(block)], numbered)
        parts.append(found.join(F.broadcast(names), "q").drop("q"))
    met = _passes(parts, chunks.select(*STORAGE).limit(0).join(queries.select("query_id").limit(0), F.lit(True)))
    ranked = _ranked(met.withColumn("score", F.lit(0.0)), "like", k, *[F.col(c) for c in STORAGE])
    return ranked.join(asked.select("query_id", "terms"), "query_id").select(*_COLUMNS)


def _matcher(terms: dict[str, list[int]]):
    """Function from a text to the numbers of the questions that have a term in it."""
    try:
        import ahocorasick
    except ImportError:
        return lambda low: {n for term, own in terms.items() if term in low for n in own}
    automaton = ahocorasick.Automaton()
    for term, own in terms.items():
        automaton.add_word(term, term)
    automaton.make_automaton()

    def held(low: str) -> set[int]:
        return {n for term in {term for _, term in automaton.iter(low)} for n in terms[term]}

    return held


def _first_holding(shared, k: int, names: list[str]):
    def run(batches):
        terms, scopes = shared.value
        held = _matcher(terms)
        best: list[list] = [[] for _ in scopes]  # the k first rows of each question, as a heap with the last one on top
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(4, 7)]
            for a, b, c, low, *own in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if not low:
                    continue
                place = _Last(own)
                for n in held(low):
                    if scopes[n] is not None and a not in scopes[n]:
                        continue
                    heap = best[n]
                    if len(heap) < k:
                        heapq.heappush(heap, place)
                    elif place.before(heap[0]):
                        heapq.heapreplace(heap, place)
        rows = [(n, *place.key) for n, heap in enumerate(best) for place in heap]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names=names)

    return run


class _Last:
    """A storage key that sorts backwards, so that a heap's top is the last row; nulls come first in storage order."""

    __slots__ = ("key", "rank")

    def __init__(self, key: list):
        self.key, self.rank = tuple(key), tuple((x is not None, x) if x is not None else (False, "") for x in key)

    def __lt__(self, other: "_Last") -> bool:
        return other.rank < self.rank

    def before(self, other: "_Last") -> bool:
        return self.rank < other.rank


def exact_channel(chunks: DataFrame, queries: DataFrame, k: int, kind: str) -> DataFrame:
    """Equality on a normalised standard or clause number; each value is ranked on its own."""
    of_query, of_chunk = (standards, lambda: normal_standard(F.col("standard_number"))) if kind == "standard_exact" else (clauses, lambda: F.col("clause_number"))
    asked = queries.select("query_id", "scope", F.explode(of_query(F.col("text"))).alias("value"))
    met = chunks.where("retrieval_role = 'retrieval'").withColumn("value", of_chunk()).where("value <> ''").join(asked, "value").where(in_scope(F.col("scope"), F.col("document_id")))
    ranked = _ranked(met.withColumn("score", F.lit(0.0)), kind, k, *[F.col(c) for c in STORAGE], by=("query_id", "value"))
    return ranked.withColumn("terms", F.array("value")).select(*_COLUMNS)


#: Characters of the pieces by which titles and questions meet.
GRAM = 4


def _grams(value: Column) -> Column:
    """Distinct pieces of GRAM characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(value) - (GRAM - 1)), lambda i: F.substring(value, i, F.lit(GRAM))))


def _one_gram(value: Column) -> Column:
    """The piece with the least hash: a rare one as likely as any, and the same wherever the text stands."""
    return F.array_min(F.transform(_grams(value), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]


def contained_titles(titles: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs of ``titles`` (title) and ``asked`` (q, at least GRAM characters) where one contains the other; titles shorter than GRAM contain nothing.

    What contains a text contains each of its pieces: one piece of the shorter meets all pieces of the longer, by equality.
    """
    long_titles = titles.where(F.length("title") >= GRAM)
    wider = long_titles.withColumn("g", F.explode(_grams(F.col("title")))).join(asked.withColumn("g", _one_gram(F.col("q"))), "g").where(F.contains("title", F.col("q")))
    inside = long_titles.withColumn("g", _one_gram(F.col("title"))).join(asked.withColumn("g", F.explode(_grams(F.col("q")))), "g").where(F.contains("q", F.col("title")))
    return wider.drop("g").unionByName(inside.drop("g").where(F.col("title") != F.col("q")))


def title_channel(chunks: DataFrame, documents: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One seed chunk per document whose title equals, or else contains or is contained in, the question.

    Titles are matched on the documents, not on their chunks.  Only questions without a scope.
    """
    asked = queries.where(F.col("scope").isNull()).select("query_id", F.array("text").alias("terms"), normal_title(F.col("text")).alias("q")).where(F.length("q") >= GRAM)
    titles = documents.select("document_id", normal_title(F.col("source_name")).alias("title")).where("title <> ''")
    met = contained_titles(titles, asked).withColumn("exact", F.col("q") == F.col("title"))
    met = met.withColumn("any_exact", F.max("exact").over(Window.partitionBy("query_id"))).where("exact = any_exact")
    order = ("primary_page", "location", "part", "chunk_id")
    first = Window.partitionBy("document_id").orderBy(*order)
    seeds = chunks.where("retrieval_role = 'retrieval'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return _ranked(seeds.join(met, "document_id").withColumn("score", F.lit(0.0)), "source_title_exact", k, F.col("document_id"), *[F.col(c) for c in order]).select(*_COLUMNS)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def semantic_channel(vectors: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """Top ``k`` by cosine; the scope is applied before the cut.  Exact: every question is compared with every vector in its scope.

    ``vectors``: chunk_id, document_id, embedding; ``query_vectors``: query_id, scope, embedding.  A block of questions
    is a matrix that each task multiplies its batches with; a task keeps the k best rows of each question (ties by
    chunk_id), so the result before ranking has k rows a question and task.
    """
    rows = vectors.select("chunk_id", F.col("document_id"), F.col("document_id").cast("string").alias("_scope"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    kinds = vectors.select("chunk_id", "document_id").schema
    schema = T.StructType([T.StructField("q", T.IntegerType()), *kinds, T.StructField("score", T.DoubleType())])
    session = vectors.sparkSession
    numbered = T.StructType([T.StructField("q", T.IntegerType()), *query_vectors.select("query_id").schema])
    parts = []
    asked = query_vectors.select("query_id", "scope", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    # a block's questions have one dimension; there are as many kinds of blocks as there are dimensions
    for block in (list(same) for mixed in blocks(asked, BLOCK) for _, same in groupby(sorted(mixed, key=lambda r: len(r["v"])), key=lambda r: len(r["v"]))):
        matrix = np.array([row["v"] for row in block], np.float64)
        scopes = [None if row["scope"] is None else frozenset(map(str, row["scope"])) for row in block]
        shared = session.sparkContext.broadcast((matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300), scopes))
        found = rows.mapInArrow(_nearest(shared, k, schema.names), schema)
        names = session.createDataFrame([(n, row["query_id"]) for n, row in enumerate(block)], numbered)
        parts.append(found.join(F.broadcast(names), "q").drop("q"))
    met = _passes(parts, vectors.select("chunk_id", "document_id", F.lit(0.0).alias("score")).limit(0).join(query_vectors.select("query_id").limit(0), F.lit(True)))
    return _ranked(met.withColumn("terms", F.array().cast("array<string>")), "semantic", k, F.col("score").desc(), F.col("chunk_id")).select(*_COLUMNS)


def _nearest(shared, k: int, names: list[str]):
    def run(batches):
        questions, scopes = shared.value
        best = [([], [], []) for _ in scopes]  # scores, chunk ids, document ids
        floor = np.full(len(scopes), -np.inf)
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in (0, 1)]
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                ids, docs, labels = (part.column(i).to_pylist() for i in range(3))
                fits = pc.equal(pc.list_value_length(part.column(3)), questions.shape[1])
                if not pc.all(fits).as_py():  # vectors of another dimension meet nothing; ``vectors.findings`` reports them
                    part = part.filter(fits)
                    ids, docs, labels = (part.column(i).to_pylist() for i in range(3))
                    if not part.num_rows:
                        continue
                flat = part.column(3).flatten().to_numpy(zero_copy_only=False)
                matrix = flat.reshape(part.num_rows, -1)
                size = np.linalg.norm(matrix, axis=1, keepdims=True)
                scores = questions @ (matrix / np.where(size > 0, size, np.nan)).T
                for n, scope in enumerate(scopes):
                    row = scores[n]
                    hit = np.flatnonzero(row >= floor[n])  # not a number meets nothing
                    if scope is not None:
                        hit = [i for i in hit.tolist() if labels[i] in scope]
                    if not len(hit):
                        continue
                    values, keys, places = best[n]
                    values.extend(row[hit].tolist())
                    keys.extend(ids[i] for i in hit)
                    places.extend(docs[i] for i in hit)
                    if len(values) > k:
                        order = sorted(range(len(values)), key=lambda i: (-values[i], keys[i]))[:k]
                        best[n] = tuple([x[i] for i in order] for x in best[n])
                        floor[n] = best[n][0][-1]
        rows = [(n, key, place, value) for n, (values, keys, places) in enumerate(best) for value, key, place in zip(values, keys, places)]
        if rows:
            q, keys, places, values = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(keys, kinds[0]), pa.array(places, kinds[1]), pa.array(values, pa.float64())], names=names)

    return run


def fuse(channels: DataFrame, weights: Column, fusion_k: int = 60) -> DataFrame:
    """Weighted reciprocal ranks summed for each chunk of each question.

    ``weights`` gives a row's channel weight.  Kept beside the sum: its lexical and semantic
    parts, channels and matched terms in order, contributions, the first channel's score.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in CHANNEL_ORDER]), F.col("channel"))
    gain = reciprocal_rank(F.col("rank"), weights, fusion_k)
    rows = channels.withColumn("gain", gain).withColumn("ord", order)
    fused = rows.groupBy("query_id", "chunk_id", "document_id").agg(
        F.sum("gain").alias("fusion"),
        F.sum(F.when(F.col("channel") != "semantic", F.col("gain")).otherwise(0.0)).alias("lexical_fusion"),
        F.sum(F.when(F.col("channel") == "semantic", F.col("gain")).otherwise(0.0)).alias("semantic_fusion"),
        F.min(F.struct("ord", "score"))["score"].alias("score"),
        F.array_sort(F.collect_list(F.struct("ord", "channel", "rank", "gain", "terms"))).alias("_parts"),
        F.min(F.when(F.col("channel") == "semantic", F.col("rank"))).alias("semantic_rank"),
        F.max(F.when(F.col("channel") == "semantic", F.col("score"))).alias("semantic_score"),
        F.max(F.col("channel").isin(*EXACT_CHANNELS)).alias("is_exact"),
    )
    return fused.withColumns(
        {
            "channels": F.array_distinct(F.transform("_parts", lambda p: p["channel"])),
            "matched_terms": F.array_distinct(F.flatten(F.transform("_parts", lambda p: p["terms"]))),
            "contributions": F.map_from_entries(F.transform(F.array_distinct(F.transform("_parts", lambda p: p["channel"])), lambda c: F.struct(c.alias("key"), F.element_at(F.filter("_parts", lambda p: p["channel"] == c), -1)["gain"].alias("value")))),
        }
    ).drop("_parts")


def reserve(fused: DataFrame, lexical: Column, semantic: Column, top_k: int) -> DataFrame:
    """Final order: exact identifiers, then the best lexical rows, then the best semantic rows, then the rest by fusion."""
    by = Window.partitionBy("query_id")
    tie = (F.col("score"), F.col("chunk_id"))
    placed = fused.withColumns(
        {
            "_all": F.row_number().over(by.orderBy(F.col("fusion").desc(), *tie)),
            "_lex": F.when(F.col("lexical_fusion") > 0, F.row_number().over(by.orderBy((F.col("lexical_fusion") > 0).desc(), F.col("lexical_fusion").desc(), *tie))),
            "_sem": F.when(F.col("semantic_fusion") > 0, F.row_number().over(by.orderBy(F.col("semantic_rank").asc_nulls_last(), F.col("semantic_score").desc_nulls_last(), "chunk_id"))),
        }
    )
    tier = F.when(F.col("is_exact"), 0).when(F.col("_lex") <= lexical, 1).when(F.col("_sem") <= semantic, 2).otherwise(3)
    inside = F.when(tier == 1, F.col("_lex")).when(tier == 2, F.col("_sem")).otherwise(F.col("_all"))
    ordered = placed.withColumn("tier", tier).withColumn("rank", F.row_number().over(by.orderBy(tier, inside, "chunk_id")))
    return ordered.where(F.col("rank") <= top_k).drop("_all", "_lex", "_sem")


def plain_order(fused: DataFrame, top_k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.col("fusion").desc(), "score", "chunk_id")
    return fused.withColumn("tier", F.lit(3)).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)


def scoped_fallback(chunks: DataFrame, queries: DataFrame, ranked: DataFrame, top_k: int) -> DataFrame:
    """The first ``top_k`` rows of the scope in storage order, for questions that found nothing."""
    empty = queries.join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    met = chunks.where("retrieval_role = 'retrieval'").join(empty.select("query_id", "scope"), in_scope(F.col("scope"), F.col("document_id")))
    window = Window.partitionBy("query_id").orderBy(*STORAGE)
    return met.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)


def budget(rows: DataFrame, max_chars: int, position: str = "rank", text: str = "text", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Rows until the character budget is used up; the crossing row is cut; an empty text ends the list."""
    before = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(before), F.lit(0))
    stopped = F.coalesce(F.max((F.length(text) == 0).cast("int")).over(before), F.lit(0))
    kept = rows.withColumn("_used", used).withColumn("_stop", stopped).where((F.col("_used") < max_chars) & (F.col("_stop") == 0) & (F.length(text) > 0))
    return kept.withColumn(text, F.expr(f"substring(`{text}`, 1, {max_chars} - _used)")).drop("_used", "_stop")


def hydrate_parents(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each ranked row followed by its context parent, once per question, at the first child that names it."""
    parents = chunks.where("retrieval_role = 'context_only'").select(F.col("chunk_id").alias("parent_id"), "document_id", F.col("text").alias("_parent_text"), F.col("location").alias("_parent_location"))
    met = ranked.where("parent_id <> ''").join(parents, ["parent_id", "document_id"])
    first = Window.partitionBy("query_id", "parent_id").orderBy("rank")
    met = met.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    extra = met.select("query_id", F.col("parent_id").alias("chunk_id"), "document_id", F.col("_parent_location").alias("location"), F.col("_parent_text").alias("text"), (F.col("rank") + 0.5).alias("position"), F.lit("parent").alias("role"), F.col("chunk_id").alias("context_for"))
    own = ranked.select("query_id", "chunk_id", "document_id", "location", "text", F.col("rank").cast("double").alias("position"), F.lit("anchor").alias("role"), F.lit(None).cast("string").alias("context_for"))
    return own.unionByName(extra)


def expand(anchors: DataFrame, chunks: DataFrame, max_chars: int, max_chunks: int) -> DataFrame:
    """Anchors with their parents and same-heading siblings, anchors first, within an item cap and a character budget.

    Anchors are exempt from both limits.  A sibling list is cut at ``max_chunks`` rows of its group.
    """
    group = ["query_id", "document_id", "heading_path"]
    base = written(anchors.select("query_id", "chunk_id", "document_id", "heading_path", "parent_id", "rank"), "anchors")
    order = [F.col("primary_page").asc_nulls_last(), F.col("location"), F.col("part"), F.col("chunk_id")]
    columns = ["query_id", "chunk_id", "document_id", "location", "part", "primary_page", "text"]
    groups = base.where(F.size("heading_path") > 0).groupBy(*group).agg(F.count("*").alias("n_anchors"))
    # a question's siblings are among the first max_chunks rows of their group, its anchors counted, whoever asks: these are found without texts
    inside = Window.partitionBy("document_id", "heading_path").orderBy(*order)
    first = chunks.where("retrieval_role = 'retrieval' and size(heading_path) > 0").select("chunk_id", "document_id", "heading_path", "location", "part", "primary_page")
    first = first.withColumn("_n", F.row_number().over(inside)).where(F.col("_n") <= max_chunks).drop("_n")
    near = first.join(groups, ["document_id", "heading_path"]).join(base.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") + F.col("n_anchors") <= max_chunks)
    near = written(near.select(*columns[:-1]), "siblings")
    near = near.join(among(chunks.where("retrieval_role = 'retrieval'"), near).select("chunk_id", "document_id", "text"), ["chunk_id", "document_id"]).select(*columns, F.lit("sibling").alias("role"))
    own = base.join(among(chunks, base).select("chunk_id", "location", "part", "primary_page", "text"), "chunk_id").select(*columns, F.lit("anchor").alias("role"))
    up = base.where("parent_id <> ''").select("query_id", "parent_id", "document_id").distinct()
    parents = among(chunks.where("retrieval_role = 'context_only'").select(F.col("chunk_id").alias("parent_id"), "document_id", "location", "part", "primary_page", "text"), up, "parent_id")
    up = up.join(parents, ["parent_id", "document_id"]).withColumnRenamed("parent_id", "chunk_id").select(*columns, F.lit("parent").alias("role"))
    rows = own.unionByName(up).unionByName(near)
    by = Window.partitionBy("query_id").orderBy(F.when(F.col("role") == "anchor", 0).otherwise(1), F.col("document_id"), *order)
    rows = rows.withColumn("position", F.row_number().over(by))
    before = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_used", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    kept = rows.where((F.col("role") == "anchor") | ((F.col("position") <= max_chunks) & (F.col("_used") < max_chars) & (F.length("text") > 0)))
    return kept.withColumn("text", F.when(F.col("role") == "anchor", F.col("text")).otherwise(F.expr(f"substring(text, 1, greatest(0, {max_chars} - cast(_used as int)))"))).drop("_used")


def should_expand(route_type: Column, policy: Column, has_heading: Column, n_anchors: Column, top_k: int) -> Column:
    """Forced policies always expand; ``auto`` needs a heading and either a risk question or few anchors."""
    few = n_anchors < max(2, top_k)
    return (n_anchors > 0) & ~policy.isin("none", "off", "") & ((policy != "auto") | (has_heading & ((route_type == "risk_condition") | few)))


def retrieval_mode(has_groups: Column, semantic_used: Column, lexical_used: Column, hit: Column, fell_back: Column, any_rows: Column) -> Column:
    return (
        F.when(has_groups & semantic_used, "hybrid_hierarchical").when(has_groups, "hierarchical").when(semantic_used & lexical_used & hit, "hybrid_semantic")
        .when(semantic_used & hit, "semantic").when(fell_back, "scoped_fallback").when(any_rows, "hybrid_lexical").otherwise("lexical")
    )


def retrieve(
    chunks: DataFrame, documents: DataFrame, queries: DataFrame, top_k: int = 6, query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, semantic_top_k: int = 40,
    bm25_weight: float = 1.0, vector_weight: float = 2.0, fusion_k: int = 60, adaptive: bool = False, lexical_reserve: int | None = None, semantic_reserve: int | None = None,
) -> DataFrame:
    """Ranked chunks of every question over all channels: one row for each (query_id, rank)."""
    if bm25_weight < 0 or vector_weight < 0 or fusion_k <= 0:
        raise ValueError("weights must not be negative and fusion_k must be positive")
    k = max(top_k * 8, 32)
    parts = [bm25_channel(chunks, queries, k), like_channel(chunks, queries, k), exact_channel(chunks, queries, k, "standard_exact"), exact_channel(chunks, queries, k, "clause_exact"), title_channel(chunks, documents, queries, k)]
    if vectors is not None and query_vectors is not None:
        parts.append(semantic_channel(vectors, query_vectors, semantic_top_k))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    routes = queries.select("query_id", route(F.col("text"), top_k).alias("route"))
    fixed = F.create_map(*[x for c, w in CHANNEL_WEIGHTS.items() for x in (F.lit(c), F.lit(w))])
    lexical, vector, title = (F.col("route.bm25_weight"), F.col("route.vector_weight"), F.col("route.title_weight")) if adaptive else (F.lit(bm25_weight), F.lit(vector_weight), F.lit(CHANNEL_WEIGHTS["source_title_exact"]))
    weight = F.when(F.col("channel") == "bm25", lexical).when(F.col("channel") == "semantic", vector).when(F.col("channel") == "source_title_exact", title).otherwise(F.element_at(fixed, F.col("channel")))
    fused = fuse(rows.join(routes, "query_id").withColumn("_w", weight), F.col("_w"), fusion_k)
    if not adaptive:
        ranked = plain_order(fused, top_k)
    else:
        fused = fused.join(routes, "query_id")
        ranked = reserve(fused, F.lit(lexical_reserve) if lexical_reserve is not None else F.col("route.lexical_reserve"), F.lit(semantic_reserve) if semantic_reserve is not None else F.col("route.semantic_reserve"), top_k).drop("route")
    ranked = written(ranked, "ranked")
    body = among(chunks, ranked).select("chunk_id", *[c for c in chunks.columns if c not in ("chunk_id", "document_id")])
    return ranked.join(body, "chunk_id")


#: Columns that a row's own metadata (JSON) never overrides.
TYPED = ["retrieval_role", "chunk_type", "clause_number", "standard_number", "page_numbers", "heading_path", "quality_flags", "needs_review", "content_hash", "table_id", "image_id", "table_source"]


def row_metadata(rows: DataFrame, metadata: str = "metadata_json") -> DataFrame:
    """``rows`` with ``metadata`` (map of text): the row's JSON object, with its typed columns laid over it.  What is no JSON object is empty."""
    typed = [c for c in TYPED if c in rows.columns]
    own = F.coalesce(F.from_json(F.when(F.trim(metadata).startswith("{"), F.col(metadata)), "map<string,string>"), F.create_map().cast("map<string,string>"))
    value = lambda c: F.to_json(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
    over = F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in typed]))
    kept = F.map_filter(own, lambda k, _: ~k.isin(*typed)) if typed else own
    return rows.withColumn("metadata", F.map_concat(kept, over) if typed else own)


def anchor_payload(ranked: DataFrame) -> DataFrame:
    """What an answer keeps of its anchors: identity, place and source, no text."""
    return ranked.select("query_id", "rank", "chunk_id", "document_id", "location", *[c for c in ("source_marker", "metadata") if c in ranked.columns])
