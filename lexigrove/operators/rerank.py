"""Reranking: a deterministic baseline as an expression, and a model behind an interface."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HAN


class Reranker(Protocol):
    """Scores (question, text) pairs; loaded once in every worker."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def question_words(query: Column) -> Column:
    parts = F.split(F.trim(F.regexp_replace(F.lower(query), rf"(?U)[^\w{HAN}]+", " ")), " +")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 2))


def baseline_score(query: Column, text: Column, position: Column, semantic: Column, fusion: Column, heading: Column, anchor: Column, expanded: Column) -> Column:
    """Word hits, similarity, fused rank, heading hits and the row's standing; earlier rows win ties."""
    low = F.lower(text)
    hits = F.size(F.filter(question_words(query), lambda w: F.contains(low, w)))
    heads = F.size(F.filter(F.coalesce(heading, F.array().cast("array<string>")), lambda h: F.contains(F.lower(query), F.lower(h))))
    close = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(semantic, F.lit(0.0))))
    standing = F.when(anchor, 3.0).when(expanded, -1.0).otherwise(0.0)
    return hits * 10.0 + close * 8.0 + F.greatest(F.lit(0.0), F.coalesce(fusion, F.lit(0.0))) * 100.0 + heads * 2.0 + standing - position * 0.001


def rerank_baseline(rows: DataFrame, top_k: int) -> DataFrame:
    """``rows``: query_id, query, chunk_id, text, position (from 0), semantic_score, fusion, heading_path, anchor, expanded."""
    score = baseline_score(*[F.col(c) for c in ("query", "text", "position", "semantic_score", "fusion", "heading_path", "anchor", "expanded")])
    window = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "chunk_id")
    return rows.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k).withColumn("reranker", F.lit("deterministic-baseline"))


def rerank_model(rows: DataFrame, load, top_k: int) -> DataFrame:
    """Rows by a model's scores; a question with any score that is missing or not finite falls back to the baseline.

    ``load`` makes a ``Reranker``; it runs once in each Python worker.
    """

    @F.pandas_udf("double")
    def predict(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for query, text in parts:
            yield pd.Series(model.predict(list(zip(query, text)))).astype(float)

    scored = rows.withColumn("_model", predict("query", "text"))
    bad = F.max((F.col("_model").isNull() | F.isnan("_model") | (F.abs("_model") == float("inf"))).cast("int")).over(Window.partitionBy("query_id")) == 1
    base = baseline_score(*[F.col(c) for c in ("query", "text", "position", "semantic_score", "fusion", "heading_path", "anchor", "expanded")])
    scored = scored.withColumn("_bad", bad).withColumn("rerank_score", F.when(F.col("_bad"), base).otherwise(F.col("_model")))
    window = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), F.when(F.col("_bad"), F.col("chunk_id")).otherwise(""), "position")
    ranked = scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top_k)
    return ranked.withColumn("reranker", F.when(F.col("_bad"), "deterministic-baseline").otherwise("model")).drop("_model", "_bad")
