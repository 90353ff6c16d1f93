"""URL rules: a blocked Bloom filter in front of an exact hash join, in DataFrame operations only.

A rule is a pair (host, path); it fits its host and every subdomain when the URL's
path starts with the rule's path.  Each URL yields the few candidate keys that a
rule could have (host suffixes of the label counts that occur among the rules, path
prefixes of the lengths that occur).  The blocked Bloom filter keeps one 64-bit word
for each block; a key reads one block only.  Keys that pass are joined exactly with
the rules, which removes the filter's false positives, and the longest rule wins.

Defined results for odd input
- null URL, or one without ``://``: empty host and path, no rule, default verdict;
- repeated rows: each gets its own output row;
- equal rules listed twice with both verdicts: block wins;
- other columns of the input are kept under their own names; those named like a result column are replaced by it;
- URLs of any length are judged whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import ascii_lower, field_name

RULE_SCHEMA = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("verdict", T.StringType())])


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as (host, path, verdict) rows."""
    return spark.createDataFrame(rules, RULE_SCHEMA)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict columns.

    Two aggregates of the rules reach the driver: their number, and the distinct label
    counts and path lengths (short lists bounded by the longest rule).  Only the filter is
    broadcast, and its size is bounded (``bloom.MAX_BLOCKS``, full at two million rules;
    beyond that it passes more and the result stays the same).  Each distinct host and path
    is looked up once; the exact joins are left to the planner, which broadcasts small sides
    and splits skewed ones.
    """
    keys = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.concat(ascii_lower(F.col("host")), F.col("path")).alias("key"), ascii_lower(F.col("host")).alias("h"), F.col("path").alias("p"), "verdict")
        .groupBy("key", "h", "p").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), F.col("verdict").alias("v")))["v"].alias("rule_verdict"))
    )
    shape = keys.agg(
        F.count("*").alias("n"),
        F.sort_array(F.collect_set(F.size(F.split("h", r"\.")))).alias("labels"),
        F.sort_array(F.collect_set(F.length("p"))).alias("lengths"),
    ).first()
    taken = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    address = F.col(f"`{url}`").cast("string")
    base = pages.select(*taken, host_of(address).alias("host"), path_of(address).alias("path"))
    if not shape["n"]:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    words, blocks = bloom.build(keys, "key", shape["n"])
    dots = F.length("host") - F.length(F.translate("host", ".", ""))
    suffixes = F.array_compact(F.array(*[F.when(dots >= k - 1, F.substring_index("host", ".", -k)) for k in shape["labels"]]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in shape["lengths"]]))
    tries = base.select("host", "path").distinct().withColumn("h", F.explode(suffixes)).withColumn("key", F.explode(F.transform(prefixes, lambda p: F.concat("h", p))))
    tries = tries.withColumn("block", bloom.block_of(F.col("key"), blocks))
    possible = tries.join(F.broadcast(words), "block").where(F.col("word").bitwiseAND(bloom.mask_of(F.col("key"))) == bloom.mask_of(F.col("key")))
    exact = possible.select("host", "path", "key", "h").join(keys.select("key", "h", "rule_verdict"), ["key", "h"])
    best = exact.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key"), F.col("rule_verdict").alias("v"))).alias("rule_found"))
    found = field_name(base, "rule_found")
    return base.join(best.withColumnRenamed("rule_found", found), ["host", "path"], "left").select(
        *taken, "host", "path", F.col(f"{found}.key").alias("rule"), F.coalesce(F.col(f"{found}.v"), F.lit(default)).alias("verdict")
    )


#: The fixed rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
