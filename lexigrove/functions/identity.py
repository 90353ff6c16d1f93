"""Ids, digests and canonical JSON as expressions."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import index_clean


def short_digest(*parts: Column, length: int = 20, separator: str = ":") -> Column:
    """First characters of the SHA-256 of the joined parts."""
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def document_id(path: Column, digest: Column) -> Column:
    return short_digest(path, digest)


def folder_id(relative_path: Column) -> Column:
    return short_digest(relative_path)


def run_id(given: Column, path: Column, time: Column, digest: Column) -> Column:
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(short_digest(path, time, digest, separator="·"))


def snapshot_id(canonical: Column) -> Column:
    return short_digest(canonical, length=24)


def content_hash(search_text: Column) -> Column:
    """SHA-1 of the lower-cased index text."""
    return F.sha1(F.lower(index_clean(search_text)))


def canonical_json(**columns: Column) -> Column:
    """Compact JSON object with sorted keys."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


@F.pandas_udf(T.StringType())
def name_uuid(values: pd.Series) -> pd.Series:
    """UUID version 5 in the URL namespace."""
    return values.map(lambda v: None if v is None else str(uuid.uuid5(uuid.NAMESPACE_URL, v)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embedding(values: pd.Series) -> pd.Series:
    """512 signed token buckets from an eight-byte digest, unit length; the sign has a bit of its own."""

    def one(text):
        import numpy as np

        out = np.zeros(512, np.float32)
        for token in (text or "").lower().split():
            raw = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            out[raw % 512] += 1.0 if raw >> 32 & 1 else -1.0
        norm = float(np.sqrt((out * out).sum()))
        return out / norm if norm else out

    return values.map(one)


def table_digest(rows: DataFrame, *keys: str, buckets: int = 4096) -> DataFrame:
    """One digest of a whole table that does not depend on row order or layout.

    Rows are digested, each bucket of row digests is digested in sorted order (a bucket
    holds 1/buckets of the rows, so raise it with the table), and the buckets' digests
    are digested in turn: no task ever sees all rows.
    """
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]), 256)
    parts = rows.select(row.alias("d")).groupBy(F.pmod(F.xxhash64("d"), F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256).alias("digest"))
