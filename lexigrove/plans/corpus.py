"""Registered queries over documents: text measures, duplicates, chunks, indexes, profiles, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.identity import content_hash, document_id
from ..operators import benchmarks, chunking, corpus, gates
from ..operators.folders import ancestors, apply_edits
from ..sources.secrets import credentials as found_credentials
from .common import read, texts


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    return d.select("doc_id", X.token_count(F.col("text")).alias("n_tokens"), X.char_count(F.col("text")).alias("n_visible"), X.encoding_anomaly(F.col("text")).alias("anomaly"))


TOKEN_COUNT = r"""
SELECT doc_id,
  CAST(len(regexp_extract_all(text, '[㐀-鿿]')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + (len(regexp_extract_all(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s\x{a0}]')) + 3) // 4 AS BIGINT) AS n_tokens,
  CAST(greatest(len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]')), len(regexp_extract_all(text, '[^\s]'))) AS BIGINT) AS n_visible,
  len(regexp_extract_all(text, chr(65533))) >= greatest(2, length(text) // 8) AS anomaly
FROM documents
"""


def clean_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(X.clean(F.col("text")), 256).alias("clean_hash"), F.length(X.clean_lines(F.col("text"))).cast("long").alias("n_line_chars"), content_hash(F.col("text")).alias("content_hash"), document_id(F.col("source"), F.sha2("text", 256)).alias("document_id"))


def own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document itself says, on one line and cut for display; where it says nothing, its source."""
    d = texts(spark, sf_dir, "documents").withColumn("words", benchmarks.own_words(F.col("text"), F.col("source")))
    return d.select("doc_id", F.sha2("words", 256).alias("words_hash"), F.length("words").cast("long").alias("n_chars_shown"))


OWN_WORDS = r"""
WITH s AS (SELECT doc_id, source, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)\A.*?内容：', ''), '(?s)\n?来源：\[KB:.*\z', ''), '\A\s*(?:表头：)?', ''), '｜', ' | '), '\s+', ' ', 'g')) AS w FROM documents),
c AS (SELECT doc_id, rtrim(left(CASE WHEN w = '' THEN trim(regexp_replace(coalesce(source, ''), '\s+', ' ', 'g')) ELSE w END, 900)) AS words FROM s)
SELECT doc_id, sha256(words) AS words_hash, length(words) AS n_chars_shown FROM c
"""


CLEAN_TEXT_HASH = r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS clean_hash,
  CAST(length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS BIGINT) AS n_line_chars,
  sha1(lower(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')))) AS content_hash, substr(sha256(concat(source, ':', sha256(text))), 1, 20) AS document_id
FROM documents
"""


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.duplicate_groups(read(spark, sf_dir, "documents"), F.sha2("text", 256), "doc_id")


DUPLICATE_GROUPS = "SELECT sha256(text) AS digest, count(*) AS n_rows, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def canonical_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.canonical(read(spark, sf_dir, "documents"), content_hash(F.col("text")), ["doc_id"], ["source"], "doc_id")
    return found.select("doc_id", "source", "canonical_id")


CANONICAL_DOC = r"SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY source, sha1(lower(trim(regexp_replace(text, '[ \t\n]+', ' ', 'g')))) ORDER BY doc_id) AS canonical_id FROM documents"


def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines on at least 2 % of a source's documents (documents stand in for pages)."""
    lines = texts(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("text"))
    found = chunking.boilerplate(lines, "source", "doc_id", "text", share=0.02)
    return found.select("source", F.col("text").alias("line"), "on_pages", "n_pages")


BOILERPLATE = r"""
WITH l AS (SELECT source, doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents),
n AS (SELECT source, count(DISTINCT doc_id) AS n_pages FROM l GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
s AS (SELECT source, line, count(DISTINCT doc_id) AS on_pages FROM l WHERE length(line) BETWEEN 2 AND 40 GROUP BY 1, 2)
SELECT source, line, on_pages, n_pages FROM s JOIN n USING (source) WHERE on_pages >= n_pages * 0.02
"""


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.fixed_chunks(texts(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("part").cast("long").alias("part"), F.col("start").cast("long").alias("start"), F.length("text").cast("long").alias("n_chars"), F.sha1("text").alias("digest"))


FIXED_CHUNKS = """
SELECT doc_id, part, part * 1040 AS start, CAST(length(t) AS BIGINT) AS n_chars, sha1(t) AS digest FROM (
  SELECT doc_id, part, substr(text, CAST(part * 1040 + 1 AS BIGINT), 1200) AS t
  FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 1200 THEN 1 ELSE CAST(ceil((length(text) - 1200) / 1040.0) AS BIGINT) + 1 END)) AS part FROM documents WHERE length(text) > 0))
"""


def profile_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.profile(read(spark, sf_dir, "documents"), "lang", "source")


PROFILE = "SELECT lang, source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY 1, 2"


def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to index again: those whose fingerprint the published snapshot (all but every tenth) lacks."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws(":", "source", F.sha2("text", 256)), 256).alias("fingerprint"))
    published = d.where("doc_id % 10 <> 0")
    return corpus.changed(d, published, "doc_id", "fingerprint")


INCREMENTAL = "SELECT doc_id, sha256(concat(source, ':', sha256(text))) AS fingerprint FROM documents WHERE doc_id % 10 = 0"


def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and personal data masked in documents and conversations; a digest of each result."""
    rows = texts(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text").unionByName(read(spark, sf_dir, "conversations").select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn", "text"))
    return rows.select("kind", "id", "turn", X.has_secret(F.col("text")).alias("found"), F.sha1(X.redact(F.col("text"))).alias("digest"))


def _redacted(column: str) -> str:
    out = column
    for pattern, mark in X.SECRETS:
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


REDACT = f"""
SELECT kind, id, turn, {" OR ".join(f"regexp_matches(text, '{p}')" for p, _ in X.SECRETS)} AS found, sha1({_redacted("text")}) AS digest
FROM (SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS turn, text FROM documents UNION ALL SELECT 'conversation', conv_id, turn, text FROM conversations)
"""


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct dotted numbers in documents, in order."""
    d = texts(spark, sf_dir, "documents").select("doc_id", X.clauses(F.col("text"), None).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("place", "clause")).select("doc_id", F.col("place").cast("long").alias("place"), "clause")


IDENTIFIERS = r"""
SELECT doc_id, CAST(i - 1 AS BIGINT) AS place, c[i] AS clause FROM (
  SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, list_filter(m, lambda t, i: list_position(m, t) = i) AS c FROM (SELECT doc_id, regexp_extract_all(text, '(?:第\s*)?([0-9]+(?:\.[0-9]+){1,5})(?:\s*条)?', 1) AS m FROM documents)))
"""


def folder_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below every URL folder, by exploded ancestors instead of prefix comparison."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "")
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(ancestors(path))).alias("folder"))
    return rows.groupBy("folder").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


FOLDER_CLOSURE = r"""
WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', ''), '/') AS w FROM pages)
SELECT folder, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT DISTINCT page_id, array_to_string(w[1:n], '/') AS folder FROM (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS n FROM p)) GROUP BY 1
"""


def folder_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL folders after a batch of edits of those right below a host: by the path's length renamed, moved to the top (the first of equal names), or deleted; and the pages left in each."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", "")
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder_id")).where("folder_id <> ''")
    every = pages.select(F.explode(ancestors(F.col("folder_id"))).alias("relative_path")).distinct()
    folders = every.select(F.col("relative_path").alias("folder_id"), F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1).alias("parent_id"), F.regexp_extract("relative_path", "([^/]*)$", 1).alias("name"), "relative_path")
    kind = F.length("relative_path") % 3
    edits = folders.where(F.size(F.split("relative_path", "/")) == 2).select(
        F.col("relative_path").alias("edit_id"), F.when(kind == 0, "rename").when(kind == 1, "move").otherwise("delete").alias("action"), "folder_id", F.lit("").alias("parent_id"), F.concat(F.lit("old-"), "name").alias("name")
    )
    after, left = apply_edits(folders, pages, edits)
    counts = left.groupBy("folder_id").agg(F.count("*").alias("n_pages"))
    return after.join(counts, "folder_id", "left").select("folder_id", "parent_id", "relative_path", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


FOLDER_EDITS = r"""
WITH p AS (SELECT page_id, regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', ''), '^(.*)/[^/]*$', 1) AS folder_id FROM pages),
w AS (SELECT page_id, folder_id, string_split(folder_id, '/') AS w FROM p WHERE folder_id <> ''),
f AS (SELECT DISTINCT array_to_string(w[1:n], '/') AS path FROM (SELECT w, unnest(range(1, len(w) + 1)) AS n FROM w)),
e AS (
  SELECT path AS old, string_split(path, '/')[1] AS host, string_split(path, '/')[2] AS name, length(path) % 3 AS kind FROM f WHERE len(string_split(path, '/')) = 2
), moved AS (SELECT name, min(old) AS old FROM e WHERE kind = 1 AND name NOT IN (SELECT path FROM f) GROUP BY name),
c AS (
  SELECT old, host || '/old-' || name AS new, host AS parent_id, 'rename' AS action FROM e WHERE kind = 0 AND host || '/old-' || name NOT IN (SELECT path FROM f)
  UNION ALL SELECT old, name, '', 'move' FROM moved UNION ALL SELECT old, NULL, NULL, 'delete' FROM e WHERE kind = 2
), a AS (
  SELECT f.path AS folder_id, CASE WHEN f.path = c.old THEN c.parent_id ELSE regexp_extract(f.path, '^(.*)/[^/]*$', 1) END AS parent_id, coalesce(c.new || substr(f.path, length(c.old) + 1), f.path) AS relative_path
  FROM f LEFT JOIN c ON array_to_string(string_split(f.path, '/')[1:2], '/') = c.old WHERE c.action IS DISTINCT FROM 'delete'
)
SELECT folder_id, parent_id, relative_path, (SELECT count(*) FROM p WHERE p.folder_id = a.folder_id) AS n_pages FROM a
"""


def document_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as documents and their texts as pages: pages by kind, warnings of short texts, toxic ones for review, and the first thirty to look at."""
    d = read(spark, sf_dir, "documents")
    toxic = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = d.join(toxic, "doc_id", "left").withColumn("document_id", F.col("source"))
    none = F.array().cast("array<string>")
    pages = rows.select(
        "document_id", F.col("doc_id").alias("page_number"), F.when(F.col("lang") == "en", F.array(F.lit("native"))).otherwise(F.array(F.lit("page:OCR"))).alias("methods"),
        F.when(F.col("n_chars") < 500, F.array(F.lit("short"))).otherwise(none).alias("warnings"), (F.col("toxic") == 1).alias("needs_review"),
    )
    chunks = rows.select("document_id", F.when(F.col("lang") != "fr", "retrieval").otherwise("context_only").alias("retrieval_role"), (F.col("n_chars") > 4000).alias("is_cross_page"))
    found = corpus.document_records(rows.select("document_id").distinct(), pages, chunks)
    return found.withColumn("review_pages", F.array_join(F.col("review_pages").cast("array<string>"), ","))


DOCUMENT_PROFILE = """
WITH d AS (SELECT source, doc_id, lang, n_chars, coalesce(toxic, 0) = 1 AS review FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))
SELECT source AS document_id, count(*) AS n_pages, count(*) FILTER (lang IS DISTINCT FROM 'en') AS n_ocr_pages, count(*) FILTER (lang = 'en') AS n_native_pages, count(*) FILTER (n_chars < 500) AS n_warning_pages,
  count(*) FILTER (review) AS n_review_pages, count(*) FILTER (lang <> 'fr') AS n_children, count(*) FILTER (lang <> 'fr' AND n_chars > 4000) AS n_cross_page_children,
  coalesce(array_to_string((list(doc_id ORDER BY doc_id) FILTER (n_chars < 500 OR review))[1:30], ','), '') AS review_pages
FROM d GROUP BY source
"""


def credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold values like credentials, by the rules of the file scan, and of which kinds."""
    d = texts(spark, sf_dir, "documents").select("doc_id", found_credentials(F.col("text")).alias("kinds"))
    return d.where(F.size("kinds") > 0).select("doc_id", F.array_join("kinds", ",").alias("kinds"))


CREDENTIALS = r"""
WITH f AS (
  SELECT doc_id, regexp_matches(text, 'sk-[A-Za-z0-9_-]{16,}') AS k,
    regexp_matches(text, '(?i)(?:api[_-]?key|apikey|token|secret|password)\s*[''"]?\s*[:=]\s*(?:''[^''"\r\n]{8,}''|"[^''"\r\n]{8,}")') AS a FROM documents
)
SELECT doc_id, concat_ws(',', CASE WHEN k THEN 'key' END, CASE WHEN a THEN 'assignment' END) AS kinds FROM f WHERE k OR a
"""


def sentence_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child chunks packed from sentences: counts and sizes for each document (rows only, no SQL)."""
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_children("text")).alias("part", "body"))
    return rows.select("doc_id", "part", X.token_count(F.col("body")).alias("n_tokens"), F.sha1("body").alias("digest"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of pages without scripts and styles (tags become blanks), and the title."""
    bare = F.regexp_replace("html", r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.sha1(X.index_clean(F.regexp_replace(bare, "<[^>]*>", " "))).alias("digest"))


HTML_TEXT = r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, sha1(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n]+', ' ', 'g'))) AS digest FROM pages
"""


def metadata_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: share of documents with a language and with a text."""
    return gates.metadata_coverage(read(spark, sf_dir, "documents"), ["lang", "text"], "source")


COVERAGE_STATS = "SELECT source, round(avg(CAST(trim(coalesce(lang, '')) <> '' AS DOUBLE)), 6) AS lang_coverage, round(avg(CAST(trim(coalesce(text, '')) <> '' AS DOUBLE)), 6) AS text_coverage FROM documents GROUP BY 1"


def longest_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest document of each source and language; of equal lengths the first."""
    return corpus.representatives(read(spark, sf_dir, "documents"), ["source", "lang"], "n_chars", "doc_id")


LONGEST = "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1"


def structure_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as converted documents, a block a turn: structure units of each (rows only)."""
    c = read(spark, sf_dir, "conversations")
    blocks = c.select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("string").alias("block_id"), F.format_string("t%06d", "turn").alias("location"), "text", F.lit("text").alias("block_type"), F.lit("native").alias("extraction_method"),
        (F.floor(F.col("turn") / 4) + 1).cast("int").alias("page_number"), F.array(F.lit(0.0), F.col("turn").cast("double"), F.lit(1.0), F.col("turn") + 1.0).alias("bbox"), F.lit("").alias("label"), F.lit(False).alias("encoding_anomaly"),
    )
    found = chunking.structure_units(blocks)
    return found.select("document_id", "unit_no", F.size("block_ids").alias("n_blocks"), F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("pages"), "is_cross_page", F.sha1("text").alias("digest"))


def packed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns packed, in order, into units of about 400 characters (rows only)."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").alias("pos"), F.col("turn").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.pack_units(rows, 400).select("document_id", "unit_no", F.array_join("chunk_ids", ",").alias("chunk_ids"), "n_chars")


QUERIES = {
    "own_words": own_words, "folder_edits": folder_edits, "document_profile": document_profile, "credentials": credentials,
    "token_count": token_count, "clean_text_hash": clean_text_hash, "duplicate_groups": duplicate_groups, "canonical_doc": canonical_doc, "boilerplate_lines": boilerplate_lines, "fixed_chunks": fixed_chunks,
    "profile_by_type": profile_by_type, "incremental_skip": incremental_skip, "redact": redact, "identifiers": identifiers, "folder_closure": folder_closure, "sentence_children": sentence_children, "html_text": html_text,
    "metadata_coverage": metadata_coverage, "longest_representative": longest_representative, "structure_units": structure_units, "packed_units": packed_units,
}
SQL = {
    "own_words": OWN_WORDS, "folder_edits": FOLDER_EDITS, "document_profile": DOCUMENT_PROFILE, "credentials": CREDENTIALS,
    "token_count": TOKEN_COUNT, "clean_text_hash": CLEAN_TEXT_HASH, "duplicate_groups": DUPLICATE_GROUPS, "canonical_doc": CANONICAL_DOC, "boilerplate_lines": BOILERPLATE, "fixed_chunks": FIXED_CHUNKS,
    "profile_by_type": PROFILE, "incremental_skip": INCREMENTAL, "redact": REDACT, "identifiers": IDENTIFIERS, "folder_closure": FOLDER_CLOSURE, "html_text": HTML_TEXT, "metadata_coverage": COVERAGE_STATS, "longest_representative": LONGEST,
}
