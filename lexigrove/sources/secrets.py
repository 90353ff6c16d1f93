"""Scan of files for values that look like credentials, before a bundle leaves the house."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of text files, the size up to which they are read, and what counts as a credential.
TEXT_SUFFIXES = ("json", "md", "txt", "mjs", "js", "yaml", "yml")
MOST_BYTES = 5 * 1024 * 1024
CREDENTIALS = {
    "key": r"sk-[A-Za-z0-9_-]{16,}",
    "assignment": r"""(?i)(?:api[_-]?key|apikey|token|secret|password)\s*['"]?\s*[:=]\s*(['"])[^'"\r\n]{8,}\1""",
}


def credentials(text: Column) -> Column:
    """Names of the kinds of credentials in a text, none for NULL."""
    return F.coalesce(F.array_compact(F.array(*[F.when(text.rlike(pattern), kind) for kind, pattern in CREDENTIALS.items()])), F.array().cast("array<string>"))


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, most: int = MOST_BYTES) -> DataFrame:
    """(path, size, kind) of files below ``folder`` that hold a credential; one row a kind.

    Files of other kinds or over ``most`` bytes are not opened: the size reaches the scan as a filter.  Bytes that are no UTF-8 are read
    as replacement characters.  See ``unread`` for text files that are too large to be looked at.
    """
    files = _files(spark, folder, suffixes).where(F.col("length") <= most)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.col("length").alias("size"), F.explode(credentials(text)).alias("kind"))


def unread(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TEXT_SUFFIXES, most: int = MOST_BYTES) -> DataFrame:
    """(path, size) of text files over ``most`` bytes, which ``scan`` leaves alone."""
    return _files(spark, folder, suffixes).where(F.col("length") > most).select("path", F.col("length").alias("size"))


def _files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return every.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*suffixes))


def refuse(spark: SparkSession, folder: str) -> None:
    """Raises if any file below ``folder`` holds a credential; names the file, never the value."""
    first = scan(spark, folder).select("path", "kind").orderBy("path", "kind").first()
    if first is not None:
        raise ValueError(f"{first['kind']} in {first['path']}")
