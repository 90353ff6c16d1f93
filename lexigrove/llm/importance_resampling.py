"""Quality by importance resampling.

Two generative models over hashed word n-grams are counted: one of target text (labelled
as good), one of all raw text.  A document's score is the mean log ratio of the two over
its n-grams (unigrams and bigrams; a word that repeats the one before it is one feature
of its own).  Rows are drawn without replacement by Gumbel top-k: each key is the score
plus scaled Gumbel noise that depends on the id alone, and the k largest keys stay.

Scale.  Resampling by importance adds unit noise to the log ratio summed over a text's
n-grams; with the mean over n of them, so that length does not decide, that is noise of
scale 1/n.  ``temperature`` is one value for all texts, 1/200: the noise of a text of 200
n-grams.  A larger one draws more at random.  k is a parameter (a share of the scored
rows, ``share``); left out, it is the number of rows whose score reaches the cut that best
tells good from bad labels.

The raw model and k count every document.  The target model and the cut are fitted on a
bounded sample of labelled rows (TRAIN_ROWS good and as many bad ones, those with the
smallest hash of the id); only its ids are broadcast.

Defined results for odd input: a text without words has no score and is rejected; rows
that tie with the k-th key all stay; repeated rows are drawn alike; null ids or labels do
not train; with no good labels every row with words stays, with no bad ones too; texts
count whole, however long; columns may have any names and stay as they are; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field_name, lean, map_rows, materialise, table

BUCKET_BITS = 14
TRAIN_ROWS = 20_000
#: Scale of the Gumbel noise, in units of the mean log ratio (see above).
TEMPERATURE = 0.005
SEED = 17
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None) -> np.ndarray:
    """Buckets of the text's word unigrams and bigrams; bucket 0 is kept for repeated words."""
    words = np.array([zlib.crc32(w) for w in _TOKEN.findall(text.encode("utf-8", "surrogatepass").lower())] if text else [], np.uint64)
    if not len(words):
        return np.zeros(0, np.int64)
    shift, most = np.uint64(64 - BUCKET_BITS), np.uint64((1 << BUCKET_BITS) - 1)
    single = words * _MIX >> shift
    pair = (words[:-1] * np.uint64(0x9E3779B1) + words[1:]) * _MIX >> shift
    out = np.concatenate([single, pair]) % most + np.uint64(1)
    out[len(words) :][words[:-1] == words[1:]] = 0
    return out.astype(np.int64)


def score(text: str | None, ratio: np.ndarray) -> float | None:
    """Mean log ratio of target to raw model over the text's n-grams."""
    found = features(text)
    return float(ratio[found].mean()) if len(found) else None


def sample_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, quality) of at most about ``rows`` rows of each class, by hash of the id; a bounded table."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("good", F.col("quality") > 0)
    counts = {r["good"]: r["n"] for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    limit = F.when(F.col("good"), F.lit(int((1 << 20) * min(1.0, rows / max(1, counts.get(True, 0)))))).otherwise(F.lit(int((1 << 20) * min(1.0, rows / max(1, counts.get(False, 0))))))
    return known.where(draw < limit).select("doc_id", "good")


class Resampler:
    """Fitted ratio table, cut, noise and k-th key."""

    def __init__(self, ratio: np.ndarray, cut: float, temperature: float = TEMPERATURE):
        self.ratio, self.cut, self.temperature = ratio, cut, temperature
        self.least_key = float("-inf")

    def key(self, key: str, value: str) -> Column:
        """The score with the row's noise."""
        return F.col(value) + self.temperature * gumbel(F.col(key))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the key only."""
    uniform = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = TRAIN_ROWS, share: float | None = None, temperature: float = TEMPERATURE) -> tuple[Resampler, DataFrame]:
    """The fitted resampler and its keys: a written (doc_id, score, key) table of every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    sample = sample_labels(labels, rows)
    size = 1 << BUCKET_BITS
    marked = own.join(F.broadcast(sample), "doc_id", "left").select("text", "good")

    def count(batches):
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for value, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = features(value)
                if len(found):
                    own = np.bincount(found, minlength=size)
                    raw += own
                    if good:
                        target += own
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "raw": pa.array(raw[at], pa.int64()), "target": pa.array(target[at], pa.int64())})

    found = marked.mapInArrow(lean(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(size), np.zeros(size)
    raw[found["bucket"].to_numpy(int)] = found["raw"].to_numpy(float)
    target[found["bucket"].to_numpy(int)] = found["target"].to_numpy(float)
    ratio = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size)) if target.sum() else np.zeros(size)
    model = Resampler(ratio, float("-inf"), temperature)
    keys = materialise(scored(own, model, "text", "score").select("doc_id", "score", model.key("doc_id", "score").alias("key")), "resample-keys")
    known = keys.join(F.broadcast(sample), "doc_id").where("score is not null").select("score", "good").toPandas()
    model.cut = best_cut(known["score"].to_numpy(float), known["good"].to_numpy(bool)) if target.sum() else float("-inf")
    wanted = keys.where(F.col("score") >= model.cut).count() if share is None else round(share * keys.where("score is not null").count())
    model.least_key = kth_largest(keys.where("key is not null").select("key"), wanted)
    return model, keys


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best balanced accuracy; -inf if there is only one class.  Ties go to the lowest cut."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(scores, kind="stable")
    ranked, kind = scores[order], good[order]
    bad_below = np.concatenate(([0], np.cumsum(~kind))) / (~kind).sum()
    good_below = np.concatenate(([0], np.cumsum(kind))) / kind.sum()
    at = int(np.argmax(bad_below - good_below))
    return float("-inf") if at == 0 else float((ranked[at - 1] + ranked[at]) / 2) if at < len(ranked) else float(ranked[-1])


def kth_largest(keys: DataFrame, k: int, bins: int = 1024, collect: int = 4096) -> float:
    """Exact k-th largest of the one column, by counting in ever narrower bins; +inf for k = 0."""
    name = keys.columns[0]
    if k <= 0:
        return float("inf")
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if n == 0 or k >= n:
        return float("-inf")
    while n > collect and high > low:
        width = (high - low) / bins
        place = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)).alias("bin")
        inside = keys.where(F.col(name).between(low, high))
        parts = sorted(inside.groupBy(place).agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect(), reverse=True)
        for part in parts:
            if k <= part["n"]:
                break
            k -= part["n"]
        if (part["low"], part["high"]) == (low, high):
            break
        low, high, n = part["low"], part["high"], part["n"]
    if high == low:
        return float(low)
    rest = sorted((r[0] for r in keys.where(F.col(name).between(low, high)).collect()), reverse=True)
    return float(rest[k - 1])


def scored(docs: DataFrame, model: Resampler, text: str, into: str) -> DataFrame:
    """``docs`` with the score in a new column ``into``.  No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])

    def run(batch):
        return {n: batch.column(n) for n in batch.schema.names} | {into: [score(t, shared.value) for t in batch.column(text).to_pylist()]}

    return map_rows(docs, run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the draw keeps.  Texts are scored twice rather than shuffled."""
    model, _ = fit(docs, labels, text, **options)
    into, number = field_name(docs, "own_score"), field_name(docs, "own_number")
    found = scored(docs.withColumn(number, F.col("doc_id").cast("long")), model, text, into)
    return found.where(model.key(number, into) >= model.least_key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model, keys = fit(docs, labels)
    return keys.select("doc_id", "score", "key", F.coalesce(F.col("key") >= model.least_key, F.lit(False)).alias("selected"))
