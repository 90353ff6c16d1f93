"""Shared pieces of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inverted
from ..session import spread
from ..sources.shared_files import shared_dir

TOKENS_SQL = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose text is worked on row by row."""
    return spread(read(spark, sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a chunk table: one retrieval row each."""
    d = texts(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("lang").alias("location"), F.lit(0).alias("part"), F.lit(1).alias("primary_page"),
        F.col("text"), F.col("text").alias("text_search"), F.lit("retrieval").alias("retrieval_role"), F.col("n_chars"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as unscoped questions with up to 24 terms of two characters or more."""
    from ..functions.text import index_tokens

    b = read(spark, sf_dir, "benchmark")
    terms = F.slice(F.array_distinct(F.filter(index_tokens(F.col("text")), lambda t: F.length(t) >= 2)), 1, 24)
    return b.select(F.col("item_id").alias("query_id"), "text", terms.alias("terms"), F.lit(None).cast("array<string>").alias("scope"))


def lexical_index(spark: SparkSession, sf_dir: str) -> str:
    """Path of the documents table's persisted index in the shared folder; built if these files have none yet."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet").where("path LIKE '%.parquet'")
    # one row: what files there are, from their names, lengths and times
    known = files.agg(F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(",", "path", "length", F.unix_micros("modificationTime"))))), 256)).first()[0]
    path = f"{shared_dir(spark)}/lexical-{known[:32]}"
    if inverted.snapshot(spark, path) is None:
        inverted.commit(spark, path, documents(spark, sf_dir), fields={"text_search": 1.0}, key="chunk_id", carry=("document_id", "location"))
    return path
