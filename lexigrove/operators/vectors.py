"""Vector rows: encoding, publication, health checks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import table_digest
from ..functions.scores import finite


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


def encode(rows: DataFrame, load, text: str = "text_search", batch: int = 256) -> DataFrame:
    """``rows`` with unit-length ``embedding``; ``load`` makes an ``Encoder`` once in each worker."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in parts:
            found = [np.asarray(model.encode(values.iloc[i : i + batch].tolist()), np.float32) for i in range(0, len(values), batch)]
            matrix = np.concatenate(found) if found else np.zeros((0, 1), np.float32)
            yield pd.Series(list(matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12)))

    return rows.withColumn("embedding", run(text))


def norm(column: str = "embedding"):
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def findings(vectors: DataFrame, key: str = "chunk_id", dimension: int | None = None) -> DataFrame:
    """(rule, key) of broken vector rows: missing or repeated id, wrong dimension, non-finite value, zero length."""
    rows = vectors.select(F.col(key).cast("string").alias("key"), "embedding")
    wide = F.lit(dimension) if dimension else F.size("embedding")
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce("key", F.lit("")) == "", "missing_id"), F.when(F.size("embedding") != wide, "dimension"),
            F.when(F.exists("embedding", lambda x: ~finite(x)), "not_finite"), F.when(norm() == 0, "zero_norm"),
        )
    )
    repeated = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_id").alias("rule"), "key")
    return rows.select(F.explode(rules).alias("rule"), "key").unionByName(repeated)


def consistency(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(rule, chunk_id) where vectors and retrieval chunks disagree: missing, orphaned, or stale by content hash."""
    own = chunks.where("retrieval_role = 'retrieval' AND text_search <> ''").select("chunk_id", F.col("content_hash").alias("a"))
    met = own.join(vectors.select("chunk_id", F.col("content_hash").alias("b")), "chunk_id", "fullouter")
    rule = F.when(F.col("b").isNull(), "missing_vector").when(F.col("a").isNull(), "orphan_vector").when(F.col("a") != F.col("b"), "stale_vector")
    return met.select(rule.alias("rule"), "chunk_id").where("rule is not null")


def unit_health(vectors: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Counts of all and of non-unit vectors, and the dimensions seen, in one row."""
    return vectors.agg(F.count("*").alias("n_vectors"), F.count_if(F.abs(norm() - 1) > tolerance).alias("n_not_unit"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """Digest of (chunk_id, content_hash), for the guard that a vector set belongs to its corpus."""
    return table_digest(rows, "chunk_id", "content_hash")
