"""Registered queries for metrics, gates, samples, splits, reconciliation, history and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import box_iou, polygon_area
from ..functions.ocr_results import ocr_rows
from ..functions.scores import severity
from ..operators import activation_gates as eight
from ..operators import evaluation, folders, gates, history, instances, reconcile, reports, sampling, vectors
from .common import read


def refusal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic rows as expected refusals, poor rows as predicted ones."""
    rows = read(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("expected_no_answer"), (F.col("quality") == 0).alias("predicted_no_answer"))
    found = evaluation.refusal_metrics(rows)
    return found.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "false_abstention")])


REFUSAL = """
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fn, count(*) FILTER (toxic <> 1) AS a FROM labels),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM c)
SELECT tp, fp, fn, round(p, 9) AS precision, round(q, 9) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 9) AS f1, round(CASE WHEN a > 0 THEN fp / a ELSE 0.0 END, 9) AS false_abstention FROM r
"""


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.percentiles(read(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95")])


PERCENTILES = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1"


def nan_aware_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh value made NaN first, so that there is something to leave out."""
    rows = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    found = evaluation.finite_mean(rows, "v", "event_type")
    return found.select("event_type", F.round("mean", 6).alias("mean"), "n_not_finite")


NAN_MEAN = "SELECT event_type, round(avg(value) FILTER (event_id % 7 <> 0), 6) AS mean, count(*) FILTER (event_id % 7 = 0 OR value IS NULL) AS n_not_finite FROM events GROUP BY 1"


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the driver's tables: repeated keys, labels without documents, documents without labels, numbers that are not finite."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return gates.together(
        gates.unique(docs, "doc_id"), gates.orphans(labels, docs, "doc_id"), gates.parity(docs, labels, "doc_id").where("detail = 'left_only'"), gates.not_finite(read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")
    )


COVERAGE_GATE = """
SELECT 'not_unique' AS rule, CAST(doc_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM documents GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'orphan', CAST(doc_id AS VARCHAR), '' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT DISTINCT 'parity', CAST(doc_id AS VARCHAR), 'left_only' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'not_finite', CAST(o_orderkey AS VARCHAR), 'o_totalprice' FROM orders WHERE isnan(o_totalprice) OR isinf(o_totalprice)
"""


def contiguity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose user turns alone are not numbered without gaps."""
    rows = read(spark, sf_dir, "conversations")
    first = rows.agg(F.min("turn")).first()[0] or 0
    return gates.contiguous(rows.where("role <> 'system'"), "conv_id", "turn", first)


CONTIGUITY = """
SELECT 'not_contiguous' AS rule, CAST(conv_id AS VARCHAR) AS key, concat_ws(',', min(turn), max(turn), count(turn)) AS detail FROM conversations WHERE role <> 'system' GROUP BY conv_id
HAVING min(turn) <> (SELECT min(turn) FROM conversations) OR max(turn) - min(turn) + 1 <> count(turn) OR count(turn) <> count(DISTINCT turn)
"""


def vector_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows for vectors of which every 50th is broken on purpose (one value not a number)."""
    e = read(spark, sf_dir, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 50 == 0, F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(float("nan"))).otherwise(x.cast("double")))).otherwise(F.col("embedding").cast("array<double>")))
    return vectors.findings(e, "vec_id", 64)


VECTOR_HEALTH = """
SELECT 'not_finite' AS rule, CAST(vec_id AS VARCHAR) AS key FROM embeddings WHERE vec_id % 50 = 0
UNION ALL SELECT 'dimension', CAST(vec_id AS VARCHAR) FROM embeddings WHERE len(embedding) <> 64
UNION ALL SELECT 'repeated_id', CAST(vec_id AS VARCHAR) FROM embeddings GROUP BY vec_id HAVING count(*) > 1
"""


def stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stable_sample(read(spark, sf_dir, "documents"), 50, 20260918, "smoke", "doc_id").select("doc_id", "stable_key")


STABLE_SAMPLE = "SELECT doc_id, sha256(concat_ws(':', '20260918', 'smoke', doc_id)) AS stable_key FROM documents ORDER BY 2, 1 LIMIT 50"


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sampling.quota_sample(read(spark, sf_dir, "documents"), "lang", 10, 7, "lang", "doc_id")
    return found.select("lang", "doc_id", F.col("place").cast("long").alias("place"))


QUOTA_SAMPLE = "SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws(':', '7', 'lang', doc_id)), doc_id) AS place FROM documents) WHERE place <= 10"


def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.coverage_sample(read(spark, sf_dir, "documents"), "source", 40, 7, "cover", "doc_id").select("doc_id", "source", "covers")


COVERAGE_SAMPLE = """
SELECT doc_id, source, covers FROM (SELECT doc_id, source, sha256(concat_ws(':', '7', 'cover', doc_id)) AS k, row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws(':', '7', 'cover', doc_id)), doc_id) = 1 AS covers FROM documents)
ORDER BY covers DESC, k, doc_id LIMIT 40
"""


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a split by row hash would put into more than one part."""
    rows = read(spark, sf_dir, "documents").select(F.sha1("text").alias("digest"), sampling.hash_split(F.col("doc_id"), 3).alias("split"))
    found = sampling.leakage(rows, "digest")
    return found.select("digest", F.array_join("splits", ",").alias("splits"), "n_rows")


SPLIT_LEAKAGE = """
WITH s AS (SELECT sha1(text) AS digest, CAST(concat('0x', substr(md5(concat_ws(':', '3', doc_id)), 1, 8)) AS UBIGINT) / 4294967296.0 AS place FROM documents),
p AS (SELECT digest, CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM s)
SELECT digest, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS n_rows FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1
"""


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split 70/15/15 over groups of equal text, stratified by language, source and toxicity."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    labels = F.array_compact(F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic")))
    samples = d.select(F.col("doc_id").alias("sample_id"), F.sha1("text").alias("digest"), labels.alias("labels"))
    return sampling.stratified_split(samples, 11).withColumnRenamed("sample_id", "doc_id")


STRATIFIED = """
WITH s AS (SELECT doc_id, coalesce(sha1(text), concat('null:', doc_id)) AS digest, list_filter([lang, source, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels FROM documents LEFT JOIN labels USING (doc_id)),
g AS (SELECT digest, count(*) AS n FROM s GROUP BY 1), l AS (SELECT digest, unnest(labels) AS label FROM s), c AS (SELECT label, count(*) AS held FROM l GROUP BY 1),
k AS (SELECT digest, label FROM (SELECT digest, label, row_number() OVER (PARTITION BY digest ORDER BY held, label) AS i FROM (SELECT DISTINCT digest, label, held FROM l JOIN c USING (label))) WHERE i = 1),
o AS (SELECT digest, n, coalesce(label, '') AS stratum, sha256(concat_ws(':', '11', 'split', digest)) AS place FROM g LEFT JOIN k USING (digest)),
p AS (SELECT *, 63 - floor(log2(n)) AS size, floor(CAST(concat('0x', substr(place, 1, 4)) AS UBIGINT) * 64 / 65536) AS part FROM o),
m AS (SELECT digest, (coalesce(sum(n) OVER (PARTITION BY stratum ORDER BY size, part, place, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2) / sum(n) OVER (PARTITION BY stratum) AS middle FROM p)
SELECT doc_id, CASE WHEN middle < 0.7 THEN 'train' WHEN middle < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split FROM s JOIN m USING (digest)
"""

def balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the balanced split gives every label of 20 rows or more its shares to within one group."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    labels = F.array_compact(F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic")))
    samples = d.select(F.col("doc_id").alias("sample_id"), F.sha1("text").alias("digest"), labels.alias("labels"))
    found = sampling.balance(samples, sampling.balanced_split(samples, 11))
    own = F.coalesce("digest", F.concat(F.lit("null:"), F.col("sample_id").cast("string")))
    largest = samples.select(F.explode("labels").alias("label"), own.alias("own")).groupBy("label", "own").agg(F.count("*").alias("n")).groupBy("label").agg(F.max("n").alias("most"))
    met = found.where("held >= 20").join(largest, "label")
    return met.groupBy("label", "held").agg(F.sum("rows").alias("n_rows"), F.min(F.abs("off") <= F.col("most")).alias("within")).select("label", "held", "n_rows", "within")


BALANCED_LABELS = """
WITH s AS (SELECT unnest(list_filter([lang, source, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL)) AS label FROM documents LEFT JOIN labels USING (doc_id))
SELECT label, count(*) AS held, count(*) AS n_rows, true AS within FROM s GROUP BY label HAVING count(*) >= 20
"""


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names as recognised texts, in the four shapes that recognisers return."""
    box = "array(array(s_suppkey, 1.5), array(s_suppkey + 10, 1), array(s_suppkey + 9, 7))"
    shapes = [f"to_json(named_struct('boxes', array({box}), 'txts', array(s_name), 'scores', array(0.5)))", f"to_json(named_struct('polys', array({box}), 'texts', array('', s_name)))"]
    row = f"concat('[', to_json({box}), ',', to_json(struct(s_name)):c1, ',0.25]')".replace("to_json(struct(s_name)):c1", "concat('\"', s_name, '\"')")
    shapes += [f"concat('[', {row}, ',[1]]')", f"concat('[[', {row}, '], 0.7]')"]
    chosen = F.expr("CASE s_suppkey % 4 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(shapes)) + " END")
    found = ocr_rows(read(spark, sf_dir, "supplier").select("s_suppkey", chosen.alias("result")))
    return found.select("s_suppkey", F.col("order").cast("long").alias("place"), "text", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(3)).alias("y1"), "confidence")


OCR_RESULTS = """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN 1 ELSE 0 END AS place, s_name AS text, CASE WHEN s_suppkey % 4 <> 1 THEN CAST(s_suppkey AS DOUBLE) END AS x0, CASE WHEN s_suppkey % 4 <> 1 THEN CAST(7 AS DOUBLE) END AS y1,
       CAST(CASE s_suppkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN NULL ELSE 0.25 END AS DOUBLE) AS confidence FROM supplier
"""


POOLS = [("long", "n_chars >= 3000", 25), ("english", "lang = 'en'", 35), ("source", "source = 'src1'", 25), ("short", "n_chars < 400", 20)]


def quota_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four quota pools drawn one after the other from the documents."""
    found = sampling.pools(read(spark, sf_dir, "documents"), [(name, F.expr(rule), quota) for name, rule, quota in POOLS], 5, "doc_id")
    return found.select("pool", "doc_id", "reused")


def _pools_sql() -> str:
    parts, used = [], "SELECT NULL::BIGINT AS doc_id WHERE false"
    for i, (name, rule, quota) in enumerate(POOLS):
        parts.append(f"u{i} AS ({used}), p{i} AS (SELECT '{name}' AS pool, doc_id, doc_id IN (SELECT doc_id FROM u{i}) AS reused FROM documents WHERE {rule} ORDER BY 3, sha256(concat_ws(':', '5', '{name}', doc_id)), doc_id LIMIT {quota})")
        used = f"SELECT doc_id FROM u{i} UNION SELECT doc_id FROM p{i}"
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(POOLS)))


def quota_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with other than ten drawn documents."""
    drawn = sampling.quota_sample(read(spark, sf_dir, "documents").where("n_chars < 120"), "lang", 10, 7, "lang", "doc_id")
    quotas = read(spark, sf_dir, "documents").select("lang").distinct().withColumn("quota", F.lit(10).cast("long"))
    return sampling.quota_report(drawn, quotas, "lang")


QUOTA_REPORT = """
WITH d AS (SELECT lang, least(count(*), 10) AS n FROM documents WHERE n_chars < 120 GROUP BY 1)
SELECT lang, coalesce(n, 0) AS n, CAST(10 AS BIGINT) AS quota FROM (SELECT DISTINCT lang FROM documents) LEFT JOIN d USING (lang) WHERE coalesce(n, 0) <> 10
"""


def reconcile_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against line items: orders without a line, lines without an order, orders with more lines than one."""
    return reconcile.reconcile(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey")


RECONCILE = """
WITH e AS (SELECT o_orderkey AS orderkey, count(*) AS n_expected FROM orders GROUP BY 1), a AS (SELECT l_orderkey AS orderkey, count(*) AS n_actual FROM lineitem GROUP BY 1),
m AS (SELECT coalesce(e.orderkey, a.orderkey) AS orderkey, coalesce(n_expected, 0) AS n_expected, coalesce(n_actual, 0) AS n_actual FROM e FULL JOIN a ON e.orderkey = a.orderkey)
SELECT *, CASE WHEN n_expected = 0 THEN 'added' WHEN n_actual < n_expected THEN 'missing' ELSE 'duplicate' END AS issue FROM m WHERE n_actual <> n_expected
"""


def pairing_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.pairing(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")


PAIRING = "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'right_only' WHEN l.doc_id IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"


def nth_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third event of every user."""
    return history.nth(read(spark, sf_dir, "events"), "user_id", 3, F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


NTH_RUN = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 3"


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(read(spark, sf_dir, "events"), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "ts")


LATEST_RUN = "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.with_previous(read(spark, sf_dir, "events"), "user_id", "event_id", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "previous_event_id")


PREVIOUS_RUN = "SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_event_id FROM events"


def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.last_turns(read(spark, sf_dir, "conversations"), 4).select("conv_id", "turn", "role", F.col("from_end").cast("long").alias("from_end"))


LAST_N = "SELECT conv_id, turn, role, from_end FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM conversations) WHERE from_end <= 4"


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user: count and the highest event type by alphabet as rank."""
    rows = read(spark, sf_dir, "events")
    return history.severity_rollup(rows, ["user_id"], F.ascii("event_type") * 1000 + F.length("event_type"), "event_type", "event_id").select("user_id", "n", F.col("highest_rank").cast("int").alias("highest_rank"), "highest")


SEVERITY_ROLLUP = """
SELECT user_id, count(*) AS n, CAST(max(ascii(event_type) * 1000 + length(event_type)) AS INTEGER) AS highest_rank, arg_max(event_type, (ascii(event_type) * 1000 + length(event_type)) * 1000000000 - event_id) AS highest FROM events GROUP BY 1
"""


def severity_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening levels of line items read as damaged shares."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(severity(F.col("l_discount"), F.col("l_quantity")).alias("level"), "l_returnflag").agg(F.count("*").alias("n"))


SEVERITY_SCREEN = "SELECT CASE WHEN l_quantity <= 0 THEN 'undetermined' WHEN l_discount < 0.01 THEN 'low' WHEN l_discount < 0.05 THEN 'medium' ELSE 'high' END AS level, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2"


def bbox_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes within an order (at most seven lines each); boxes are made from line item numbers."""
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = F.col("l_partkey") % 40 + F.lit(0.0), F.col("l_suppkey") % 40 + F.lit(0.0)
    boxes = l.select("l_orderkey", "l_linenumber", F.array(x, y, x + F.col("l_quantity"), y + F.col("l_quantity")).alias("box"))
    found = instances.box_pairs(boxes, 0.3, ["l_orderkey"], "l_linenumber")
    return found.select("l_orderkey", "a", "b", F.round("iou", 9).alias("iou"))


BBOX_IOU = """
WITH b AS (SELECT l_orderkey, l_linenumber AS k, l_partkey % 40 AS x, l_suppkey % 40 AS y, l_quantity AS q FROM lineitem),
p AS (SELECT a.l_orderkey, a.k AS a, b.k AS b, greatest(0.0, least(a.x + a.q, b.x + b.q) - greatest(a.x, b.x)) * greatest(0.0, least(a.y + a.q, b.y + b.q) - greatest(a.y, b.y)) AS i, a.q * a.q + b.q * b.q AS s FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.k < b.k)
SELECT l_orderkey, a, b, round(i / (s - i), 9) AS iou FROM p WHERE s - i > 0 AND i / (s - i) >= 0.3
"""


def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shoelace area of triangles made from parts, and the overlap of two boxes."""
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    xs, ys = F.array(F.lit(0.0), size, F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), size + 1)
    one, two = F.array(F.lit(0.0), F.lit(0.0), size, size), F.array(size / 2, F.lit(0.0), size * 2, size)
    return p.select("p_partkey", polygon_area(xs, ys).alias("area"), F.round(box_iou(one, two), 9).alias("iou"))


POLYGON = "SELECT p_partkey, p_size * (p_size + 1) / 2.0 AS area, round(CASE WHEN p_size > 0 THEN (p_size * p_size / 2.0) / (p_size * p_size + 1.5 * p_size * p_size - p_size * p_size / 2.0) ELSE 0.0 END, 9) AS iou FROM part"


def events_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the retrieval set: daily tumbling windows."""
    found = history.tumbling(read(spark, sf_dir, "events"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


EVENTS_WINDOW = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def rare_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages with fewer documents than half of the median language and source pair."""
    rows = read(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("label"))
    return sampling.rare_labels(rows)


RARE_LABELS = "WITH c AS (SELECT concat_ws('/', lang, source) AS label, count(*) AS n FROM documents GROUP BY 1), f AS (SELECT quantile_cont(CAST(n AS DOUBLE), 0.5) * 0.5 AS floor FROM c) SELECT label, n, floor FROM c, f WHERE n < floor"


def scope_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active and resolved scopes: what both hold, and what only one does."""
    d = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    parts = folders.compare_scopes(d.where("lang = 'en'"), d.where("n_chars >= 1000"))
    return parts.join(d.select("document_id", "source"), "document_id").groupBy("source", "part").agg(F.count("*").alias("n"))


SCOPE_SETS = "SELECT source, CASE WHEN lang = 'en' AND n_chars >= 1000 THEN 'both' WHEN lang = 'en' THEN 'active_only' ELSE 'resolved_only' END AS part, count(*) AS n FROM documents WHERE lang = 'en' OR n_chars >= 1000 GROUP BY 1, 2"


def json_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON properties with a fallback for what does not parse."""
    return read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("parsed"))


JSON_METADATA = "SELECT event_id, json_valid(props) AS parsed FROM events"

def activation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands against activation of an index over the documents, with faults of every kind by id: old versions, failed pages, orphans, rows without postings."""
    d, labels, bench = (read(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    known = labels.groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality_score"), F.max("toxic").alias("toxic"))
    none = F.array().cast("array<string>")
    number, own = F.col("doc_id"), F.col("doc_id").cast("string").alias("document_id")
    # digests before the join, so that no text is shuffled
    short = d.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_sha256"))
    documents = short.join(known, "doc_id", "left").select(
        own, F.col("source").alias("source_path"), F.col("lang").alias("source_name"), "source_sha256", "quality_score", F.concat(F.lit("index.v"), (number % 3 + 1).cast("string")).alias("index_version"),
        F.when(number % 50 == 0, 2).otherwise(1).alias("page_count"), F.when(number % 97 == 0, F.array(F.lit(1))).alias("failed_pages"), F.when(F.col("toxic") == 1, F.array(F.lit("unreadable"))).otherwise(none).alias("severe_warnings"),
    )
    held = d.where(number % 10 != 0).select(own.alias("chunk_id"), own, F.lit("retrieval").alias("retrieval_role"), F.col("text").alias("text_search"))
    item = F.concat(F.lit("b"), F.col("item_id").cast("string"))
    tables = {
        "documents": documents, "pages": d.select(own, F.lit(1).alias("page_number")), "postings": d.where(number % 31 != 0).select(own.alias("chunk_id")),
        "chunks": held.unionByName(bench.select(item.alias("chunk_id"), item.alias("document_id"), F.lit("retrieval").alias("retrieval_role"), F.col("text").alias("text_search"))),
    }
    expected = bench.select(item.alias("name"), F.col("text").alias("query"), F.when(F.col("item_id") % 5 != 0, F.array(F.col("item_id").cast("string"))).otherwise(none).alias("expected_document_ids"), none.alias("expected_standards"), none.alias("expected_tokens"))
    outcomes = bench.select(item.alias("name"), (F.col("item_id") % 4 != 0).alias("passed"))
    manifest = labels.agg(F.lit(True).alias("required_passed"), F.count("*").alias("document_count"))
    scopes = d.groupBy(F.col("source").alias("name")).agg(F.array(F.min("doc_id").cast("string"), F.max("doc_id").cast("string")).alias("document_ids"))
    return eight.findings(tables, expected, outcomes, manifest, scopes, least_version=2)


ACTIVATION_GATES = r"""
WITH d AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source, lang, text, sha256(coalesce(text, '')) AS sha, q, coalesce(toxic, 0) AS toxic, doc_id % 97 = 0 AS failed
  FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS q, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)
), live AS (SELECT id FROM d WHERE doc_id % 10 <> 0 AND text <> '' UNION ALL SELECT concat('b', item_id) FROM benchmark WHERE text <> ''),
posted AS (SELECT id FROM d WHERE doc_id % 31 <> 0),
copies AS (SELECT sha, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1),
n AS (SELECT count(*) AS total, count(*) FILTER (trim(source) <> '') AS a, count(*) FILTER (trim(lang) <> '') AS b, count(q) AS c FROM d),
f AS (
  SELECT 'schema' AS gate, 'index_version' AS rule, id AS key, 'index.v1' AS detail FROM d WHERE doc_id % 3 = 0
  UNION ALL SELECT 'integrity', 'orphan', concat('b', item_id), '' FROM benchmark
  UNION ALL SELECT 'integrity', 'parity', id, 'left_only' FROM live WHERE id NOT IN (SELECT id FROM posted)
  UNION ALL SELECT 'integrity', 'parity', id, 'right_only' FROM posted WHERE id NOT IN (SELECT id FROM live)
  UNION ALL SELECT 'quality_metadata', 'coverage_incomplete', name, concat(have, '/', total)
    FROM (SELECT total, unnest(['source_path', 'source_name', 'quality_score']) AS name, unnest([a, b, c]) AS have FROM n) WHERE have < total
  UNION ALL SELECT 'quality_metadata', 'duplicate_source_sha256', sha, CAST(n AS VARCHAR) FROM copies
  UNION ALL SELECT 'quality_metadata', 'failed_pages', id, '1' FROM d WHERE failed
  UNION ALL SELECT 'quality_metadata', 'quality_below_threshold', id, '' FROM d WHERE q < 0.65
  UNION ALL SELECT 'quality_metadata', 'severe_warning', id, '' FROM d WHERE toxic = 1 AND NOT failed
  UNION ALL SELECT 'quality_metadata', 'page_coverage', id, '' FROM d WHERE doc_id % 50 = 0
)
SELECT * FROM f
UNION ALL SELECT DISTINCT 'database_health', 'gate_failed', gate, '' FROM f
UNION ALL SELECT 'no_duplicate_source_sha256', 'duplicate_source_sha256', sha, CAST(n AS VARCHAR) FROM copies
UNION ALL SELECT 'representative_queries', 'no_assertion', concat('b', item_id), '' FROM benchmark WHERE item_id % 5 = 0
UNION ALL SELECT 'representative_queries', 'not_met', concat('b', item_id), '' FROM benchmark WHERE item_id % 4 = 0
UNION ALL SELECT 'build_manifest', 'document_count_differs', '', concat(m, '/', total) FROM n, (SELECT count(*) AS m FROM labels) WHERE m <> total
UNION ALL SELECT 'selected_scope_available', 'unavailable_document', source, CAST(doc_id AS VARCHAR) FROM (
  SELECT source, min(doc_id) AS doc_id FROM d GROUP BY 1 UNION ALL SELECT source, max(doc_id) FROM d GROUP BY 1) WHERE doc_id % 10 = 0
"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of pages by host and number modulo 20 that stand for one file name: conflicting ones are gone, and so are those of other documents."""
    host = F.regexp_extract("url", r"^[a-z]+://(?:[a-z]+\.)?([^/?#]*)", 1)
    marker = F.concat(F.lit("[KB:"), host, F.lit(":page "), (F.col("page_id") % 20).cast("string"), F.lit("]"))
    rows = read(spark, sf_dir, "pages").select(marker.alias("marker"), F.when(F.col("page_id") % 9 != 0, host).otherwise("other").alias("document_id"), F.regexp_extract("url", "^([^?#]*)", 1).alias("source_name"))
    return reports.citation_catalog(rows)


CITATIONS = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://(?:[a-z]+\.)?([^/?#]*)', 1) AS host, regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '([^/]*)/*$', 1) AS name FROM pages WHERE page_id % 9 <> 0)
SELECT concat('[KB:', host, ':page ', page_id % 20, ']') AS marker, host AS document_id, min(name) AS source_name, concat('page ', page_id % 20) AS location
FROM p WHERE name <> '' AND host <> '' GROUP BY host, page_id % 20 HAVING count(DISTINCT name) = 1
"""

QUERIES = {
    "activation_gates": activation_gates, "citations": citations,
    "balanced_labels": balanced_labels, "ocr_results": ocr_results,
    "refusal_metrics": refusal_metrics, "latency_percentiles": latency_percentiles, "nan_aware_mean": nan_aware_mean, "coverage_gate": coverage_gate, "contiguity_gate": contiguity_gate, "vector_health": vector_health,
    "stable_sample": stable_sample, "quota_sample": quota_sample, "coverage_sample": coverage_sample, "split_leakage": split_leakage, "stratified_split": stratified_split, "quota_pools": quota_pools, "quota_report": quota_report, "reconcile_identities": reconcile_identities, "pairing_full_outer": pairing_full_outer,
    "nth_run_per_source": nth_run, "latest_run": latest_run, "previous_run": previous_run, "last_n_history": last_n_history, "severity_rollup": severity_rollup, "severity_screen": severity_screen, "bbox_iou_pairs": bbox_iou_pairs,
    "polygon_areas": polygon_areas, "events_window": events_window, "rare_labels": rare_labels, "scope_sets": scope_sets, "json_metadata": json_metadata,
}
SQL = {
    "activation_gates": ACTIVATION_GATES, "citations": CITATIONS,
    "balanced_labels": BALANCED_LABELS, "ocr_results": OCR_RESULTS,
    "refusal_metrics": REFUSAL, "latency_percentiles": PERCENTILES, "nan_aware_mean": NAN_MEAN, "coverage_gate": COVERAGE_GATE, "contiguity_gate": CONTIGUITY, "vector_health": VECTOR_HEALTH,
    "stable_sample": STABLE_SAMPLE, "quota_sample": QUOTA_SAMPLE, "coverage_sample": COVERAGE_SAMPLE, "split_leakage": SPLIT_LEAKAGE, "stratified_split": STRATIFIED, "quota_pools": _pools_sql(), "quota_report": QUOTA_REPORT, "reconcile_identities": RECONCILE, "pairing_full_outer": PAIRING,
    "nth_run_per_source": NTH_RUN, "latest_run": LATEST_RUN, "previous_run": PREVIOUS_RUN, "last_n_history": LAST_N, "severity_rollup": SEVERITY_ROLLUP, "severity_screen": SEVERITY_SCREEN, "bbox_iou_pairs": BBOX_IOU,
    "polygon_areas": POLYGON, "events_window": EVENTS_WINDOW, "rare_labels": RARE_LABELS, "scope_sets": SCOPE_SETS, "json_metadata": JSON_METADATA,
}
