"""Registered retrieval queries over the benchmark texts, documents, pages and vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import reciprocal_rank
from ..functions.text import basename, index_tokens, route
from ..operators import evidence, inverted, retrieval, search
from ..operators.evaluation import query_metrics, scope_leaks, summary
from ..operators.postings import bm25, phrase_hits, postings, tokenised
from ..operators.rerank import rerank_baseline
from ..sources.shared_files import shared_dir
from .common import benchmark_queries, documents, lexical_index, read

QUERY_TERMS_SQL = r"""
q AS (
  SELECT item_id AS query_id, text,
         list_distinct_ordered[1:24] AS terms
  FROM (SELECT item_id, text, list_filter(toks, lambda t, i: list_position(toks, t) = i) AS list_distinct_ordered
        FROM (SELECT item_id, text, list_filter(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2) AS toks FROM benchmark))
)"""

#: The operators' own terms of a question: ASCII words and dotted numbers of two characters or more, 24 at most.
OPERATOR_TERMS_SQL = r"""
q3 AS (
  SELECT query_id, text, list_filter(a, lambda t, i: list_position(a, t) = i)[1:24] AS terms
  FROM (SELECT item_id AS query_id, text, list_concat(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_-]*|\d+(?:\.\d+)+|[一-鿿]+'), lambda x: lower(x)), lambda x: length(x) >= 2),
          regexp_extract_all(text, '(?:第\s*)?([0-9]+(?:\.[0-9]+){1,5})(?:\s*条)?', 1)) AS a FROM benchmark)
)"""
#: Type of a trimmed question ``t`` without Han characters.
ROUTE_KIND_SQL = r"""CASE
  WHEN regexp_matches(t, '(^|[^\p{L}\p{N}_])(?i:GB|JGJ|CECS|DBJ|CJJ|DL|TB|JG)\s*[-—]?\s*\d{2,6}(?:\s*[-—]\s*\d{4})?($|[^\p{L}\p{N}_])') OR regexp_matches(t, '[0-9]+(?:\.[0-9]+){1,5}') THEN 'exact_identifier'
  WHEN regexp_matches(t, '%|℃|(?i:mm|cm|m|mpa|kpa|pa|kn|n|°c|kg|t)($|[^\p{L}\p{N}_])') AND regexp_matches(t, '(?i:mm|cm|m|mpa|kpa|pa|kn|n|°c|kg|t)($|[^\p{L}\p{N}_])|[%℃][\p{L}\p{N}_]') THEN 'numeric_unit'
  WHEN length(t) >= 16 THEN 'natural_semantic' ELSE 'general' END"""
#: Ranks of the BM25 channel (field weight 2) and of the substring channel, 32 at most each.
CHANNEL_CTES = (
    OPERATOR_TERMS_SQL
    + r""",
tok3 AS (SELECT doc_id, source, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS toks FROM documents WHERE text <> ''),
stats3 AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_tokens FROM tok3),
qt3 AS (SELECT query_id, unnest(terms) AS term FROM q3),
tf3 AS (SELECT doc_id, term, 2.0 * count(*) AS f FROM (SELECT doc_id, unnest(toks) AS term FROM tok3) WHERE term IN (SELECT term FROM qt3) GROUP BY 1, 2),
df3 AS (SELECT term, count(*) AS doc_freq FROM tf3 GROUP BY 1),
sc3 AS (
  SELECT query_id, tf3.doc_id,
         round(sum(CASE WHEN ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) END
             * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avg_tokens))), 9) AS score
  FROM tf3 JOIN df3 USING (term) JOIN qt3 USING (term) JOIN tok3 USING (doc_id), stats3 GROUP BY 1, 2
),
lex3 AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc3) WHERE rank <= 32),
sub3 AS (
  SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY source, lang, doc_id) AS rank
                 FROM (SELECT DISTINCT query_id, doc_id, source, lang FROM documents JOIN qt3 ON contains(lower(text), term))) WHERE rank <= 32
)"""
)

BM25_CTES = (
    r"""
tok AS (SELECT doc_id, source, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS toks FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_tokens FROM tok),
qt AS (SELECT query_id, unnest(terms) AS term FROM q),
tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS f FROM (SELECT doc_id, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS doc_freq FROM tf GROUP BY 1),
sc AS (
  SELECT query_id, tf.doc_id, source,
         round(sum(CASE WHEN ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) END
             * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avg_tokens))), 6) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN tok USING (doc_id), stats GROUP BY 1, 2, 3
)"""
)


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Ranks by the table's persisted index, which the first query over these files builds; no text is scanned after that."""
    found = inverted.search(spark, lexical_index(spark, sf_dir), benchmark_queries(spark, sf_dir).drop("scope"), k, round_to=6)
    return found.select("query_id", "chunk_id", "score", "rank")


def _top(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(_bm25(spark, sf_dir, 10))


def bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bm25_topk``, over the texts themselves."""
    return _top(bm25(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), 10, {"text_search": 1.0}, round_to=6))


def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bm25_topk``, reading only blocks that can matter."""
    return _top(inverted.search(spark, lexical_index(spark, sf_dir), benchmark_queries(spark, sf_dir).drop("scope"), 10, round_to=6, prune=True))


BM25_TOPK = f"WITH {QUERY_TERMS_SQL}, {BM25_CTES} SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"


def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field weights: page heading 5, body 2, path 3; the questions are the pages' own headings (every 20th page)."""
    pages = read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("chunk_id"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_replace("html", "<[^>]*>", " ").alias("body"), F.regexp_replace("url", "^[a-z]+://", "").alias("path")
    )
    asked = pages.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.slice(F.array_distinct(index_tokens(F.col("heading"))), 1, 24).alias("terms"))
    found = bm25(pages, asked, 5, {"heading": 5.0, "body": 2.0, "path": 3.0}, round_to=6)
    return found.select("query_id", F.col("chunk_id").alias("page_id"), "score", F.col("rank").cast("long").alias("rank"))


BM25_FIELDS = r"""
WITH p AS (
  SELECT page_id,
         regexp_extract_all(lower(strip_accents(regexp_extract(html, '<h1>([^<]*)</h1>', 1))), '[\p{L}\p{N}]+') AS th,
         regexp_extract_all(lower(strip_accents(regexp_replace(html, '<[^>]*>', ' ', 'g'))), '[\p{L}\p{N}]+') AS tb,
         regexp_extract_all(lower(strip_accents(regexp_replace(url, '^[a-z]+://', ''))), '[\p{L}\p{N}]+') AS tp
  FROM pages
), stats AS (SELECT count(*) AS n_docs, avg(len(th) + len(tb) + len(tp)) AS avg_tokens FROM p),
qt AS (SELECT query_id, unnest(list_filter(th, lambda t, i: list_position(th, t) = i)[1:24]) AS term FROM (SELECT page_id AS query_id, th FROM p WHERE page_id % 20 = 0)),
hit AS (
  SELECT page_id, term, 5.0 AS w FROM (SELECT page_id, unnest(th) AS term FROM p) UNION ALL
  SELECT page_id, term, 2.0 FROM (SELECT page_id, unnest(tb) AS term FROM p) UNION ALL
  SELECT page_id, term, 3.0 FROM (SELECT page_id, unnest(tp) AS term FROM p)
), tf AS (SELECT page_id, term, CAST(sum(w) AS DOUBLE) AS f FROM hit WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS doc_freq FROM tf GROUP BY 1),
sc AS (
  SELECT query_id, page_id, round(sum(CASE WHEN ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) END
         * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(th) + len(tb) + len(tp)) / avg_tokens))), 6) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN p USING (page_id), stats GROUP BY 1, 2
)
SELECT query_id, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM sc) WHERE rank <= 5
"""


def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and term frequency of every term."""
    fields = {"text_search": 1.0}
    found = postings(tokenised(documents(spark, sf_dir), fields), fields)
    return found.groupBy("term", "chunk_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("n").alias("term_freq"))


POSTINGS_STATS = r"""
SELECT term, count(DISTINCT doc_id) AS doc_freq, count(*) AS term_freq
FROM (SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY term
"""


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``postings_stats``, from an index that is built anew each time."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    inverted.commit(spark, path, documents(spark, sf_dir), fields={"text_search": 1.0})
    return inverted.term_stats(spark, path).select("term", "doc_freq", F.col("term_freq").cast("long").alias("term_freq"))


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``postings_stats``, from the persisted index."""
    return inverted.term_stats(spark, lexical_index(spark, sf_dir)).select("term", "doc_freq", F.col("term_freq").cast("long").alias("term_freq"))


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where all tokens of a benchmark text stand together."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("phrase"))
    found = phrase_hits(documents(spark, sf_dir), b, {"text_search": 1.0})
    return found.groupBy("query_id", F.col("chunk_id").alias("doc_id")).agg(F.count("*").alias("n_hits"))


PHRASE_CTES = r"""
t AS (SELECT doc_id, source, lang, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents),
ph AS (SELECT item_id AS query_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS p FROM benchmark),
pos AS (SELECT doc_id, w, i, w[i] AS a, w[i + 1] AS b FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
met AS (SELECT query_id, doc_id, i FROM ph JOIN pos ON a = p[1] AND (len(p) = 1 OR b = p[2]) WHERE len(p) > 0 AND w[i:i + len(p) - 1] = p)
"""
PHRASE_MATCH = f"WITH {PHRASE_CTES} SELECT query_id, doc_id, count(*) AS n_hits FROM met GROUP BY 1, 2"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as unscoped questions."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit(None).cast("array<string>").alias("scope"))


def like_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring channel in storage order: documents that hold any term of a benchmark text."""
    found = retrieval.like_channel(documents(spark, sf_dir), _questions(spark, sf_dir), 32)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


LIKE_CHANNEL = f"WITH {CHANNEL_CTES} SELECT query_id, doc_id, rank FROM sub3"


def exact_id_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by a standard number that the question spells with other spacing and case, ranked in storage order."""
    part = read(spark, sf_dir, "part")
    number = F.lpad(F.pmod(F.col("p_partkey"), F.lit(60)).cast("string"), 4, "0")
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("document_id"), F.col("p_type").alias("location"), F.concat(F.lit("GB "), number, F.lit("—2010")).alias("standard_number"), F.lit("").alias("clause_number"), F.lit("retrieval").alias("retrieval_role"))
    asked = spark.range(60).select(F.col("id").alias("query_id"), F.concat(F.lit("what does gb"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit("-2010 say of it")).alias("text"), F.lit(None).cast("array<string>").alias("scope"))
    found = retrieval.exact_channel(chunks, asked, 20, "standard_exact")
    return found.select(F.element_at("terms", 1).alias("value"), F.col("chunk_id").alias("p_partkey"), F.col("rank").cast("long").alias("rank"), F.round(reciprocal_rank(F.col("rank"), 8.0), 9).alias("gain"))


EXACT_ID = r"""
SELECT value, p_partkey, rank, round(8.0 / (60 + rank), 9) AS gain FROM (
  SELECT concat('gb', lpad(CAST(p_partkey % 60 AS VARCHAR), 4, '0'), '-2010') AS value, p_partkey, row_number() OVER (PARTITION BY p_partkey % 60 ORDER BY p_brand, p_type, p_partkey) AS rank FROM part
) WHERE rank <= 20
"""


def title_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose normalised title contains, or is contained in, a question (the heading of every 20th page); equal titles hide contained ones; 64 a question."""
    pages = read(spark, sf_dir, "pages")
    names = pages.select(F.col("page_id").alias("document_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("source_name"))
    chunks = pages.select(F.col("page_id").alias("chunk_id"), F.col("page_id").alias("document_id"), F.col("url").alias("location"), F.lit(0).alias("part"), F.lit(1).alias("primary_page"), F.lit("retrieval").alias("retrieval_role"))
    asked = pages.where("page_id % 20 = 0").select(F.col("page_id").alias("query_id"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("text"), F.lit(None).cast("array<string>").alias("scope"))
    found = retrieval.title_channel(chunks, names, asked, 64)
    return found.select("query_id", F.col("chunk_id").alias("page_id"), F.col("rank").cast("long").alias("rank"))


TITLE_CHANNEL = r"""
WITH n AS (
  SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages
), m AS (
  SELECT page_id, regexp_replace(trim(regexp_replace(lower(regexp_replace(t, '(?i)\.(?:pdf|docx?|txt|md)$', '')), '(?:\(\d+\)|（\d+）)$', '')), '[^0-9a-z一-鿿]+', '', 'g') AS title,
         regexp_replace(trim(regexp_replace(lower(regexp_replace(h, '(?i)\.(?:pdf|docx?|txt|md)$', '')), '(?:\(\d+\)|（\d+）)$', '')), '[^0-9a-z一-鿿]+', '', 'g') AS q
  FROM n
), met AS (
  SELECT a.page_id AS query_id, b.page_id, a.q = b.title AS exact FROM m a JOIN m b ON b.title <> '' AND (a.q = b.title OR contains(b.title, a.q) OR (length(b.title) >= 4 AND contains(a.q, b.title)))
  WHERE a.page_id % 20 = 0 AND length(a.q) >= 4
)
SELECT * FROM (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id) AS rank FROM (SELECT *, max(exact) OVER (PARTITION BY query_id) AS any_exact FROM met) WHERE exact = any_exact) WHERE rank <= 64
"""


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every 20th vector, itself left out."""
    e = read(spark, sf_dir, "embeddings")
    return _cosine(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit(None).cast("array<string>").alias("scope")))


def cosine_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same within the vector's own label: the scope is applied before the cut."""
    e = read(spark, sf_dir, "embeddings")
    return _cosine(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.array(F.col("label").cast("string")).alias("scope")))


def _cosine(e: DataFrame, asked: DataFrame) -> DataFrame:
    vectors = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("document_id"), "embedding")
    found = retrieval.semantic_channel(vectors, asked, 64).where("query_id <> chunk_id").withColumn("score", F.round("score", 6))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", F.col("chunk_id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def _cosine_sql(extra: str) -> str:
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id {extra} WHERE a.vec_id % 20 = 0)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, asked = documents(spark, sf_dir), _questions(spark, sf_dir)
    return retrieval.bm25_channel(chunks, asked, 32).unionByName(retrieval.like_channel(chunks, asked, 32))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal ranks of the BM25 and substring channels, ten documents a question."""
    weight = F.when(F.col("channel") == "like", retrieval.CHANNEL_WEIGHTS["like"]).otherwise(1.0)
    found = retrieval.plain_order(retrieval.fuse(_channels(spark, sf_dir), weight), 10)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.round("fusion", 9).alias("fusion"), F.array_join("channels", ",").alias("channels"), F.col("rank").cast("long").alias("rank"))


RRF_CTES = f"""{CHANNEL_CTES},
fused AS (
  SELECT query_id, doc_id, coalesce(1.0 / (60 + l.rank), 0) AS lex_gain, l.rank AS lex_rank, s.rank AS sub_rank, coalesce(-l.score, 0.0) AS score
  FROM lex3 l FULL JOIN sub3 s USING (query_id, doc_id)
)"""
RRF_FUSION = f"""
WITH {RRF_CTES}, f AS (SELECT *, lex_gain + coalesce(0.35 / (60 + sub_rank), 0) AS fusion FROM fused)
SELECT query_id, doc_id, round(fusion, 9) AS fusion, concat_ws(',', CASE WHEN lex_rank IS NOT NULL THEN 'bm25' END, CASE WHEN sub_rank IS NOT NULL THEN 'like' END) AS channels, rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, score, doc_id) AS rank FROM f) WHERE rank <= 10
"""


def adaptive_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final order with reserves of three lexical and three semantic rows; the substring channel stands in for the semantic one."""
    rows = _channels(spark, sf_dir)
    rows = rows.withColumn("score", F.when(F.col("channel") == "like", -F.col("rank").cast("double")).otherwise(F.col("score"))).withColumn("channel", F.when(F.col("channel") == "like", "semantic").otherwise(F.col("channel")))
    fused = retrieval.fuse(rows, F.when(F.col("channel") == "semantic", 2.0).otherwise(1.0))
    found = retrieval.reserve(fused, F.lit(3), F.lit(3), 10)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("tier").cast("int").alias("tier"), F.col("rank").cast("long").alias("rank"))


ADAPTIVE_RESERVE = f"""
WITH {RRF_CTES}, f AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex_gain + coalesce(2.0 / (60 + sub_rank), 0) DESC, coalesce(nullif(score, 0.0), -sub_rank), doc_id) AS any_rank FROM fused
), t AS (SELECT *, CAST(CASE WHEN lex_rank <= 3 THEN 1 WHEN sub_rank <= 3 THEN 2 ELSE 3 END AS INTEGER) AS tier FROM f)
SELECT query_id, doc_id, tier, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE tier WHEN 1 THEN lex_rank WHEN 2 THEN sub_rank ELSE any_rank END, doc_id) AS rank FROM t) WHERE rank <= 10
"""


def budgeted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First documents of each source within 12,000 characters; the crossing one is cut."""
    rows = documents(spark, sf_dir).select(F.col("document_id").alias("query_id"), F.col("chunk_id").alias("doc_id"), "text")
    kept = retrieval.budget(rows, 12_000, "doc_id")
    return kept.select(F.col("query_id").alias("source"), "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


BUDGETED = """
SELECT source, doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_hash FROM (
  SELECT source, doc_id, substr(text, 1, CAST(12000 - used AS BIGINT)) AS t, used FROM (
    SELECT source, doc_id, text, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM documents)
  WHERE used < 12000)
"""


def scoped_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that no document holds word for word get the first rows of their scope in storage order."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("scope"))
    found = retrieval.scoped_fallback(documents(spark, sf_dir), q, phrase_match(spark, sf_dir), 3)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"))


SCOPED_FALLBACK = f"""
WITH {PHRASE_CTES}
SELECT query_id, doc_id, rank FROM (
  SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY source, lang, doc_id) AS rank
  FROM benchmark b JOIN documents d ON d.source = concat('src', item_id % 20) WHERE item_id NOT IN (SELECT query_id FROM met)
) WHERE rank <= 3
"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as children of one context row for each source; the heading is the language."""
    d = documents(spark, sf_dir)
    child = d.select(F.format_string("d%09d", "chunk_id").alias("chunk_id"), "document_id", "location", "part", "primary_page", "text", "retrieval_role", F.concat(F.lit("p:"), "document_id").alias("parent_id"), F.array("location").alias("heading_path"))
    parent = d.select("document_id").distinct().select(
        F.concat(F.lit("p:"), "document_id").alias("chunk_id"), "document_id", F.lit("").alias("location"), F.lit(0).alias("part"), F.lit(1).alias("primary_page"), F.concat(F.lit("about "), "document_id").alias("text"),
        F.lit("context_only").alias("retrieval_role"), F.lit("").alias("parent_id"), F.array().cast("array<string>").alias("heading_path"),
    )
    return child.unionByName(parent)


def _ranked(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The first ``k`` documents of each question as rows of the tree."""
    best = _bm25(spark, sf_dir, k).select("query_id", F.format_string("d%09d", "chunk_id").alias("chunk_id"), "rank")
    return best.join(_tree(spark, sf_dir), "chunk_id")


def parent_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ranked document followed by its parent, once per question, at the first child that names it."""
    found = retrieval.hydrate_parents(_ranked(spark, sf_dir, 10), _tree(spark, sf_dir))
    return found.select("query_id", "chunk_id", "position", "role", "context_for")


TOP_CTES = f"{QUERY_TERMS_SQL}, {BM25_CTES}, r AS (SELECT query_id, doc_id, printf('d%09d', doc_id) AS chunk_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc))"
PARENT_HYDRATION = f"""
WITH {TOP_CTES}, top AS (SELECT * FROM r WHERE rank <= 10)
SELECT query_id, chunk_id, CAST(rank AS DOUBLE) AS position, 'anchor' AS role, NULL AS context_for FROM top
UNION ALL SELECT query_id, concat('p:', source), min(rank) + 0.5, 'parent', arg_min(chunk_id, rank) FROM top GROUP BY query_id, source
"""


def same_group_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best documents of each question with their parents and siblings (same source and language), six rows and 12,000 characters."""
    found = retrieval.expand(_ranked(spark, sf_dir, 3), _tree(spark, sf_dir), 12_000, 6)
    return found.select("query_id", "chunk_id", "role", F.col("position").cast("long").alias("position"), F.length("text").cast("long").alias("n_chars"))


SAME_GROUP = f"""
WITH {TOP_CTES}, a AS (SELECT query_id, chunk_id, d.source, d.lang, d.text FROM r JOIN documents d USING (doc_id) WHERE rank <= 3),
g AS (SELECT query_id, source, lang, count(*) AS n FROM a GROUP BY ALL),
sib AS (
  SELECT query_id, chunk_id, source, lang, text FROM (
    SELECT g.query_id, printf('d%09d', doc_id) AS chunk_id, d.source, d.lang, d.text, n, row_number() OVER (PARTITION BY g.query_id, d.source, d.lang ORDER BY doc_id) AS place
    FROM documents d JOIN g USING (source, lang) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = g.query_id AND a.chunk_id = printf('d%09d', doc_id)))
  WHERE place + n <= 6
), every AS (
  SELECT query_id, chunk_id, source, lang AS location, text, 'anchor' AS role FROM a
  UNION ALL SELECT DISTINCT query_id, concat('p:', source), source, '', concat('about ', source), 'parent' FROM a
  UNION ALL SELECT query_id, chunk_id, source, lang, text, 'sibling' FROM sib
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY role <> 'anchor', source, location, chunk_id) AS position FROM every),
used AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM placed)
SELECT query_id, chunk_id, role, position, CAST(CASE WHEN role = 'anchor' THEN length(text) ELSE least(length(text), 12000 - used) END AS BIGINT) AS n_chars
FROM used WHERE role = 'anchor' OR (position <= 6 AND used < 12000 AND length(text) > 0)
"""


def baseline_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 candidates reordered by word hits and fused rank."""
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _bm25(spark, sf_dir, 20).select("query_id", F.col("chunk_id").alias("doc_id"), "rank").join(d, "doc_id").join(q, "query_id")
    rows = rows.select(
        "query_id", "query", F.col("doc_id").alias("chunk_id"), "text", (F.col("rank") - 1).alias("position"), F.lit(None).cast("double").alias("semantic_score"), reciprocal_rank(F.col("rank"), 1.0).alias("fusion"),
        F.lit(None).cast("array<string>").alias("heading_path"), F.lit(True).alias("anchor"), F.lit(False).alias("expanded"),
    )
    return rerank_baseline(rows, 6).select("query_id", F.col("chunk_id").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


BASELINE_RERANK = rf"""
WITH {QUERY_TERMS_SQL}, {BM25_CTES}, r AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20),
w AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\p{{M}}\p{{Pc}}]+', ' ', 'g')), ' +'), lambda x: length(x) >= 2)) AS words FROM benchmark),
s AS (SELECT r.query_id, r.doc_id, len(list_filter(words, lambda x: contains(lower(d.text), x))) * 10.0 + 100.0 / (60 + rank) + 3.0 - (rank - 1) * 0.001 AS score FROM r JOIN w USING (query_id) JOIN documents d USING (doc_id))
SELECT query_id, doc_id, round(score, 6) AS rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 6
"""


def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents of each question as evidence: the first three are anchors, others are made for the anchor of their source, if any."""
    rows = _ranked(spark, sf_dir, 10).select("query_id", "chunk_id", "document_id", "parent_id", "text", "heading_path", F.col("rank").alias("position"))
    heads = rows.where("position <= 3").groupBy("query_id", "document_id").agg(F.min_by("chunk_id", "position").alias("head"))
    items = rows.join(heads, ["query_id", "document_id"], "left").withColumns({"role": F.when(F.col("position") <= 3, "anchor").otherwise("expanded_context"), "context_for": F.when(F.col("position") > 3, F.coalesce("head", F.lit(""))).otherwise("")})
    found = evidence.group_evidence(items)
    return found.select("query_id", F.col("group_no").cast("long").alias("group_no"), F.col("item_no").cast("long").alias("item_no"), "chunk_id", "role", "reason", "included", "duplicate_of")


EVIDENCE_GROUPS = rf"""
WITH {TOP_CTES},
i AS (SELECT query_id, chunk_id, r.source, rank, trim(regexp_replace(replace(replace(d.text, chr(160), ' '), chr(13), ''), '\s+', ' ', 'g')) AS t FROM r JOIN documents d USING (doc_id) WHERE rank <= 10),
h AS (SELECT query_id, source, min(rank) AS at FROM i WHERE rank <= 3 GROUP BY 1, 2),
g AS (
  SELECT i.*, CASE WHEN rank <= 3 THEN 'anchor' ELSE 'expanded_context' END AS role, CASE WHEN rank <= 3 OR h.at IS NOT NULL THEN 1 ELSE 2 END AS kind, CASE WHEN rank <= 3 THEN rank ELSE coalesce(h.at, rank) END AS number
  FROM i LEFT JOIN h USING (query_id, source)
), n AS (
  SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY kind, number) AS group_no, row_number() OVER (PARTITION BY query_id, kind, number ORDER BY role <> 'anchor', rank) AS item_no,
         first_value(CASE WHEN role = 'anchor' THEN chunk_id END) OVER w AS head, first_value(CASE WHEN role = 'anchor' THEN t END) OVER w AS head_text
  FROM g WINDOW w AS (PARTITION BY query_id, kind, number ORDER BY role <> 'anchor', rank)
), c AS (SELECT *, CASE WHEN role <> 'anchor' AND t <> '' AND head_text <> '' AND contains(t, head_text) AND length(t) <= greatest(length(head_text) + 80, floor(length(head_text) * 1.25)) THEN head END AS repeats FROM n),
s AS (SELECT *, first_value(CASE WHEN repeats IS NULL THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY query_id, lower(t) ORDER BY group_no, item_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stands FROM c),
o AS (SELECT *, CASE WHEN t <> '' AND stands IS NOT NULL AND stands <> chunk_id THEN stands ELSE coalesce(repeats, '') END AS same FROM s)
SELECT query_id, group_no, item_no, chunk_id, role, CASE kind WHEN 1 THEN 'parent_or_expanded_context' ELSE 'standalone' END AS reason, same = '' AS included, same AS duplicate_of FROM o
"""


def _library(spark: SparkSession, sf_dir: str):
    """The tree with the columns that whole searches want, and its documents."""
    tree = _tree(spark, sf_dir).withColumns({"text_search": F.col("text"), "standard_number": F.lit(""), "clause_number": F.lit("")})
    names = read(spark, sf_dir, "documents").select(F.col("source").alias("document_id")).distinct().select("document_id", F.concat("document_id", F.lit(".txt")).alias("source_name"), F.lit("ready").alias("status"))
    return tree, names


def _bare_title_sql(value: str) -> str:
    return rf"regexp_replace(trim(regexp_replace(lower(regexp_replace({value}, '(?i)\.(?:pdf|docx?|txt|md)$', '')), '(?:\(\d+\)|（\d+）)$', '')), '[^0-9a-z一-鿿]+', '', 'g')"


def _adaptive_ctes(top_k: int) -> str:
    """``ranked5``: the adaptive order of all candidates over the tree's channels; identifiers and vectors are absent there.

    Without semantic rows, lexical order and fused order are one, so that reserved rows are the first ones.
    """
    half = max(1, top_k // 2)
    return (
        CHANNEL_CTES.replace("rank <= 32", f"rank <= {max(top_k * 8, 32)}")
        + f""",
kind5 AS (SELECT query_id, {ROUTE_KIND_SQL} AS kind, t FROM (SELECT query_id, trim(text) AS t FROM q3)),
route5 AS (
  SELECT query_id, CAST(CASE kind WHEN 'exact_identifier' THEN 1.8 WHEN 'numeric_unit' THEN 1.6 WHEN 'natural_semantic' THEN 0.9 ELSE 1.1 END AS DOUBLE) AS weight,
         CASE kind WHEN 'exact_identifier' THEN {min(top_k, 24)} WHEN 'numeric_unit' THEN {min(top_k, 22)} WHEN 'natural_semantic' THEN {min(top_k, 12)} ELSE {half} END AS reserved
  FROM kind5
), names5 AS (SELECT source, {_bare_title_sql("concat(source, '.txt')")} AS title FROM (SELECT DISTINCT source FROM documents)),
asked5 AS (SELECT query_id, {_bare_title_sql("text")} AS q FROM q3),
named5 AS (SELECT query_id, source, q = title AS exact FROM asked5 JOIN names5 ON title <> '' AND length(q) >= 4 AND (q = title OR (length(title) >= 4 AND (contains(title, q) OR contains(q, title))))),
title5 AS (
  SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY source) AS rank
    FROM (SELECT *, max(exact) OVER (PARTITION BY query_id) AS any_exact FROM named5)
    JOIN (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY lang, doc_id) AS place FROM documents) USING (source) WHERE exact = any_exact AND place = 1)
  WHERE rank <= {max(top_k * 8, 32)}
), fused5 AS (
  SELECT query_id, doc_id, l.rank AS lex_rank, s.rank AS sub_rank, t.rank AS title_rank, coalesce(-l.score, 0.0) AS score
  FROM lex3 l FULL JOIN sub3 s USING (query_id, doc_id) FULL JOIN title5 t USING (query_id, doc_id)
), gained5 AS (
  SELECT *, coalesce(weight / (60 + lex_rank), 0) + coalesce(0.35 / (60 + sub_rank), 0) + coalesce(0.10 / (60 + title_rank), 0) AS fusion FROM fused5 JOIN route5 USING (query_id)
), ranked5 AS (
  SELECT *, CAST(CASE WHEN rank <= reserved THEN 1 ELSE 3 END AS INTEGER) AS tier
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, score, doc_id) AS rank FROM gained5) WHERE rank <= {top_k}
)"""
    )


def retrieve_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels fused with adaptive weights and reserves, six rows a question."""
    chunks, names = _library(spark, sf_dir)
    found = retrieval.retrieve(chunks, names, _questions(spark, sf_dir), 6, adaptive=True)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.col("tier").cast("int").alias("tier"), F.round("fusion", 9).alias("fusion"), F.array_join("channels", ",").alias("channels"))


RETRIEVE_ADAPTIVE = f"""
WITH {_adaptive_ctes(6)}
SELECT query_id, printf('d%09d', doc_id) AS chunk_id, rank, tier, round(fusion, 9) AS fusion,
       concat_ws(',', CASE WHEN lex_rank IS NOT NULL THEN 'bm25' END, CASE WHEN sub_rank IS NOT NULL THEN 'like' END, CASE WHEN title_rank IS NOT NULL THEN 'source_title_exact' END) AS channels
FROM ranked5
"""


def production_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production search over the benchmark texts: six anchors of a pool of thirty, then the context of their groups, 10,000 characters."""
    chunks, names = _library(spark, sf_dir)
    return _passages(search.production_search(chunks, names, _questions(spark, sf_dir)))


def _passages(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("position").cast("long").alias("position"), "chunk_id", "role", "context_for", F.length("text").cast("long").alias("n_chars"))


#: Characters before a row of its question, in the order of a column.
_BEFORE = "coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_STOPPED = "coalesce(max(CAST(length(text) = 0 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY {} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
def _production_sql(top_k: int, max_chars: int) -> str:
    """SQL of the production search with a pool of thirty."""
    return rf"""
WITH {_adaptive_ctes(30)},
pool AS (SELECT query_id, doc_id, rank, fusion, source, lang, text AS full_text, text FROM ranked5 JOIN (SELECT doc_id, source, lang, text FROM documents) USING (doc_id)),
direct AS (
  SELECT query_id, doc_id, rank, fusion, source, lang, full_text, substr(text, 1, CAST(100000 - used AS BIGINT)) AS text
  FROM (SELECT *, {_BEFORE.format("rank")} AS used, {_STOPPED.format("rank")} AS stopped FROM pool) WHERE used < 100000 AND stopped = 0 AND length(text) > 0
), words AS (SELECT item_id AS query_id, lower(text) AS low, list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\p{{M}}\p{{Pc}}]+', ' ', 'g')), ' +'), lambda x: length(x) >= 2)) AS words FROM benchmark),
scored AS (
  SELECT query_id, doc_id, text, len(list_filter(words, lambda x: contains(lower(text), x))) * 10.0 + fusion * 100.0 + CASE WHEN contains(low, lower(lang)) THEN 2.0 ELSE 0.0 END + 3.0 - (rank - 1) * 0.001 AS score FROM direct JOIN words USING (query_id)
), selected AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM scored) WHERE place <= {top_k}),
groups AS (SELECT query_id, source, lang, count(*) AS n, min(rank) AS group_at FROM direct GROUP BY ALL),
every AS (
  SELECT query_id, printf('d%09d', doc_id) AS chunk_id, source, lang, lang AS location, full_text AS text, 'anchor' AS role FROM direct
  UNION ALL SELECT DISTINCT query_id, concat('p:', source), source, NULL, '', concat('about ', source), 'parent' FROM direct
  UNION ALL SELECT query_id, chunk_id, source, lang, lang, text, 'sibling' FROM (
    SELECT g.query_id, printf('d%09d', d.doc_id) AS chunk_id, d.source, d.lang, d.text, n, row_number() OVER (PARTITION BY g.query_id, d.source, d.lang ORDER BY d.doc_id) AS place
    FROM documents d JOIN groups g USING (source, lang) WHERE NOT EXISTS (SELECT 1 FROM direct a WHERE a.query_id = g.query_id AND a.doc_id = d.doc_id)) WHERE place + n <= 24
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY role <> 'anchor', source, location, chunk_id) AS position FROM every),
wide AS (
  SELECT query_id, chunk_id, source, lang, location, role, CASE role WHEN 'anchor' THEN text ELSE substr(text, 1, CAST(100000 - used AS BIGINT)) END AS text
  FROM (SELECT *, {_BEFORE.format("position")} AS used FROM placed) WHERE role = 'anchor' OR (position <= 24 AND used < 100000 AND length(text) > 0)
), heads AS (SELECT query_id, source, lang, arg_min(doc_id, rank) AS head FROM direct SEMI JOIN selected USING (query_id, doc_id) GROUP BY ALL),
around AS (
  SELECT w.query_id, w.chunk_id, w.location, w.text, printf('d%09d', head) AS context_for, group_at
  FROM wide w JOIN heads h ON w.query_id = h.query_id AND w.source = h.source AND (w.role = 'parent' OR w.lang = h.lang) JOIN groups g ON g.query_id = h.query_id AND g.source = h.source AND g.lang = h.lang
  WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.query_id = w.query_id AND printf('d%09d', s.doc_id) = w.chunk_id)
), context AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY group_at, context_for) AS n FROM around) WHERE n = 1),
listed AS (
  SELECT query_id, 0 AS later, place AS a, '' AS b, printf('d%09d', doc_id) AS chunk_id, 'anchor' AS role, NULL AS context_for, text FROM selected
  UNION ALL SELECT query_id, 1, group_at, location, chunk_id, 'context', context_for, text FROM context
), numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY later, a, b, chunk_id) AS position FROM listed)
SELECT query_id, position, chunk_id, role, context_for, CAST(least(length(text), {max_chars} - used) AS BIGINT) AS n_chars
FROM (SELECT *, {_BEFORE.format("position")} AS used, {_STOPPED.format("position")} AS stopped FROM numbered) WHERE used < {max_chars} AND stopped = 0 AND length(text) > 0
"""


PRODUCTION_SEARCH = _production_sql(6, 10_000)


def production_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production search with two anchors and 60,000 characters, so that most rows are context of the anchors' groups."""
    chunks, names = _library(spark, sf_dir)
    return _passages(search.production_search(chunks, names, _questions(spark, sf_dir), 2, 60_000))


PRODUCTION_CONTEXT = _production_sql(2, 60_000)


def plain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain full-text search over the benchmark texts, four rows and 8,000 characters a question."""
    d = documents(spark, sf_dir)
    names = d.select("document_id").distinct().select("document_id", F.concat("document_id", F.lit(".txt")).alias("source_name"), F.lit("ready").alias("status"))
    found = search.plain_search(d, names, _questions(spark, sf_dir), 4, 8_000)
    return found.select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("long").alias("rank"), "mode", F.length("text").cast("long").alias("n_chars"))


PLAIN_SEARCH = r"""
WITH tok AS (SELECT doc_id, text, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS toks FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_tokens FROM tok),
qt AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS f FROM (SELECT doc_id, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS doc_freq FROM tf GROUP BY 1),
sc AS (
  SELECT query_id, tf.doc_id, any_value(text) AS text,
         round(sum(CASE WHEN ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avg_tokens))), 9) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term) JOIN tok USING (doc_id), stats GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc),
u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r WHERE rank <= 4)
SELECT query_id, doc_id, rank, 'lexical' AS mode, CAST(least(length(text), 8000 - used) AS BIGINT) AS n_chars FROM u WHERE used < 8000
"""


def evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose normalised text an earlier document of the corpus already has."""
    found = evidence.first_of_text(documents(spark, sf_dir), "text", ["chunk_id"], [])
    return found.where("duplicate_of is not null").select(F.col("chunk_id").alias("doc_id"), "duplicate_of")


EVIDENCE_DEDUP = r"""
SELECT doc_id, duplicate_of FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lower(trim(regexp_replace(replace(replace(text, chr(160), ' '), chr(13), ''), '\s+', ' ', 'g'))) ORDER BY doc_id) AS duplicate_of FROM documents) WHERE doc_id <> duplicate_of
"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents of a benchmark text: all that hold it word for word, however many."""
    return phrase_match(spark, sf_dir).select("query_id", F.col("doc_id").alias("chunk_id"))


def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query_metrics(_bm25(spark, sf_dir, 30).select("query_id", "chunk_id", "rank"), _gold(spark, sf_dir))
    return found.select("query_id", "n_relevant", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


def ir_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all questions and by length class in one grouping."""
    found = query_metrics(_bm25(spark, sf_dir, 30).select("query_id", "chunk_id", "rank"), _gold(spark, sf_dir))
    kinds = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.length("text") >= 220, "long").otherwise("short").alias("kind"))
    out = summary(found.join(kinds, "query_id").withColumn("config", F.lit("bm25")), "config", "kind", ["hit_10", "recall_10", "mrr_10", "ndcg_10"])
    return out.select("config", "kind", "level", "n_questions", *[F.round(c, 6).alias(c) for c in ("hit_10", "recall_10", "mrr_10", "ndcg_10")])


METRICS_CTES = f"""{QUERY_TERMS_SQL}, {BM25_CTES}, {PHRASE_CTES},
r AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 30),
g AS (SELECT DISTINCT query_id, doc_id FROM met),
n AS (SELECT query_id, count(*) AS n_relevant FROM g GROUP BY 1),
h AS (SELECT r.query_id, r.rank FROM r JOIN g USING (query_id, doc_id)),
a AS (SELECT query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 3) AS h3, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10, count(*) FILTER (rank <= 30) AS h30,
        min(rank) FILTER (rank <= 10) AS first, sum(1.0 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM h GROUP BY 1),
m AS (SELECT n.query_id, n_relevant, coalesce(h1, 0) AS h1, coalesce(h3, 0) AS h3, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(h30, 0) AS h30, coalesce(1.0 / first, 0.0) AS mrr_10,
        coalesce(dcg / list_sum(list_transform(range(1, least(n_relevant, 10) + 1), lambda i: 1.0 / log2(i + 1))), 0.0) AS ndcg_10 FROM n LEFT JOIN a USING (query_id))
"""
IR_METRICS = f"WITH {METRICS_CTES} SELECT query_id, n_relevant, " + ", ".join(f"CAST(h{k} > 0 AS DOUBLE) AS hit_{k}, round(h{k} / {k}.0, 6) AS precision_{k}, round(h{k} / n_relevant, 6) AS recall_{k}" for k in (1, 3, 5, 10, 30)) + ", round(mrr_10, 6) AS mrr_10, round(ndcg_10, 6) AS ndcg_10 FROM m"
IR_SUMMARY = f"""
WITH {METRICS_CTES}, k AS (SELECT 'bm25' AS config, CASE WHEN length(text) >= 220 THEN 'long' ELSE 'short' END AS kind, m.* FROM m JOIN benchmark ON item_id = query_id)
SELECT config, kind, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE 'part' END AS level, count(*) AS n_questions, round(avg(CAST(h10 > 0 AS DOUBLE)), 6) AS hit_10, round(avg(h10 / n_relevant), 6) AS recall_10, round(avg(mrr_10), 6) AS mrr_10, round(avg(ndcg_10), 6) AS ndcg_10
FROM k GROUP BY GROUPING SETS ((config), (config, kind))
"""


def scope_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unscoped results held against a scope of five sources: what would have leaked."""
    ranked = _bm25(spark, sf_dir, 10).join(documents(spark, sf_dir).select("chunk_id", "document_id"), "chunk_id")
    scopes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("query_id", F.concat(F.lit("src"), F.pmod(F.col("query_id") + F.col("i"), F.lit(20)).cast("string")).alias("document_id"))
    return scope_leaks(ranked, scopes).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("document_id").alias("source"))


SCOPE_LEAKAGE = f"""
WITH {QUERY_TERMS_SQL}, {BM25_CTES}, r AS (SELECT query_id, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10),
s AS (SELECT item_id AS query_id, concat('src', (item_id + i) % 20) AS source FROM benchmark, range(0, 5) t(i))
SELECT query_id, doc_id, source FROM r ANTI JOIN s USING (query_id, source)
"""


def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").withColumn("r", route(F.col("text")))
    return rows.select("conv_id", "turn", "r.query_type", "r.bm25_weight", "r.vector_weight", F.col("r.lexical_reserve").cast("int").alias("lexical_reserve"), "r.hierarchy_policy")


ROUTE_QUERIES = r"""
WITH u AS (SELECT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'user'),
k AS (SELECT *, """ + ROUTE_KIND_SQL + r""" AS query_type FROM u)
SELECT conv_id, turn, query_type,
  CAST(CASE query_type WHEN 'exact_identifier' THEN 1.8 WHEN 'numeric_unit' THEN 1.6 WHEN 'natural_semantic' THEN 0.9 ELSE 1.1 END AS DOUBLE) AS bm25_weight,
  CAST(CASE query_type WHEN 'exact_identifier' THEN 0.55 WHEN 'numeric_unit' THEN 0.85 WHEN 'natural_semantic' THEN 2.35 ELSE 1.75 END AS DOUBLE) AS vector_weight,
  CAST(CASE query_type WHEN 'exact_identifier' THEN 24 WHEN 'numeric_unit' THEN 22 WHEN 'natural_semantic' THEN 12 ELSE 15 END AS INTEGER) AS lexical_reserve,
  CASE query_type WHEN 'general' THEN 'auto' ELSE 'off' END AS hierarchy_policy
FROM k
"""


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme, host, last path part and page parameter of every page URL."""
    url = F.col("url")
    return read(spark, sf_dir, "pages").select(
        "page_id", F.try_parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url(url, F.lit("HOST")).alias("host"),
        basename(F.try_parse_url(url, F.lit("PATH"))).alias("leaf"), F.try_parse_url(url, F.lit("QUERY"), F.lit("page")).alias("page"),
    )


URL_PARTS = r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)/*$', 1) AS leaf,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages
"""

QUERIES = {
    "bm25_scan": bm25_scan, "bm25_pruned": bm25_pruned, "index_build": index_build, "index_terms": index_terms,
    "bm25_topk": bm25_topk, "bm25_fields": bm25_fields, "postings_stats": postings_stats, "phrase_match": phrase_match, "like_channel": like_channel, "exact_id_channel": exact_id_channel, "title_channel": title_channel,
    "cosine_topk": cosine_topk, "cosine_scoped": cosine_scoped, "rrf_fusion": rrf_fusion, "adaptive_reserve": adaptive_reserve, "budgeted_context": budgeted_context, "scoped_fallback": scoped_fallback,
    "parent_hydration": parent_hydration, "same_group_expansion": same_group_expansion, "baseline_rerank": baseline_rerank, "evidence_dedup": evidence_dedup, "evidence_groups": evidence_groups,
    "retrieve_adaptive": retrieve_adaptive, "production_search": production_search, "production_context": production_context, "plain_search": plain_search, "ir_metrics": ir_metrics, "ir_summary": ir_summary,
    "scope_leakage": scope_leakage, "route_queries": route_queries, "url_parts": url_parts,
}
SQL = {
    "bm25_scan": BM25_TOPK, "bm25_pruned": BM25_TOPK, "index_build": POSTINGS_STATS, "index_terms": POSTINGS_STATS,
    "bm25_topk": BM25_TOPK, "bm25_fields": BM25_FIELDS, "postings_stats": POSTINGS_STATS, "phrase_match": PHRASE_MATCH, "like_channel": LIKE_CHANNEL, "exact_id_channel": EXACT_ID, "title_channel": TITLE_CHANNEL,
    "cosine_topk": _cosine_sql(""), "cosine_scoped": _cosine_sql("AND a.label = b.label"), "rrf_fusion": RRF_FUSION, "adaptive_reserve": ADAPTIVE_RESERVE, "budgeted_context": BUDGETED, "scoped_fallback": SCOPED_FALLBACK,
    "parent_hydration": PARENT_HYDRATION, "same_group_expansion": SAME_GROUP, "baseline_rerank": BASELINE_RERANK, "evidence_dedup": EVIDENCE_DEDUP, "evidence_groups": EVIDENCE_GROUPS, "plain_search": PLAIN_SEARCH, "retrieve_adaptive": RETRIEVE_ADAPTIVE, "production_search": PRODUCTION_SEARCH, "production_context": PRODUCTION_CONTEXT, "ir_metrics": IR_METRICS, "ir_summary": IR_SUMMARY,
    "scope_leakage": SCOPE_LEAKAGE, "route_queries": ROUTE_QUERIES, "url_parts": URL_PARTS,
}
