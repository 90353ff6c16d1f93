"""Language identification of possibly multilingual documents by mixture inference.

Training counts hashed byte trigrams for each labelled language over a bounded, fixed
sample of labelled rows.  A document is read as a sequence of short segments, each
drawn from one language; expectation-maximisation estimates the document's language
proportions from the segments' n-gram likelihoods.  The language set grows greedily
while the penalised likelihood (Bayesian information criterion) improves, and the
language with the largest share of the chosen set is predicted.

Defined results for odd input: null text, or one without any letter, is ``und`` with
score 0; with no labelled rows every document is ``und``; null ids never train and are
not held out; repeated rows are judged alike; texts are read whole, however long; columns
may have any names, and those named like a result column (``lang_pred``, ``score``,
``lang_shares``) are replaced by it; an empty table gives an empty result; more than
LANGUAGES labels are an error, as a model of so many would not fit a worker.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, table

BUCKET_BITS = 16
SEGMENT = 48
ROUNDS = 12
#: Labelled rows that train each language at most, chosen by hash of their id.
TRAIN_ROWS = 4000
#: Languages that a model may have (a quarter of a megabyte each).
LANGUAGES = 1000
_LETTER = re.compile(r"[^\W\d_]")


def normal(text: str) -> np.ndarray:
    """Lower-cased letters as UTF-8 bytes, everything else as single spaces, one space at either end."""
    kept = " ".join(re.findall(r"[^\W\d_]+", text.lower()))
    return np.frombuffer(f" {kept} ".encode("utf-8", "surrogatepass"), np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram at every position."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    key = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


class Model:
    """Smoothed log probabilities, one row for each language in name order."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        size = 1 << BUCKET_BITS
        rows = [np.log((counts[k] + 0.1) / (counts[k].sum() + 0.1 * size)) for k in self.languages]
        self.logs = np.array(rows, np.float32).reshape(len(rows), size)

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """Predicted language, its share, and the shares of the chosen set."""
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, {}
        keys = grams(normal(text))
        if not len(keys):
            return "und", 0.0, {}
        starts = np.arange(0, len(keys), SEGMENT)
        parts = np.add.reduceat(self.logs[:, keys], starts, axis=1, dtype=np.float64)
        chosen, shares, best = [], None, -np.inf
        penalty = 0.5 * np.log(len(starts) + 1) + 3.0
        while len(chosen) < len(self.languages):
            tries = []
            for k in range(len(self.languages)):
                if k not in chosen:
                    tries.append((*expect_maximise(parts[[*chosen, k]]), k))
            value, share, k = max(tries, key=lambda x: (x[0], -x[2]))
            if value - penalty * len(chosen) <= best:
                break
            best = value - penalty * len(chosen)
            chosen, shares = [*chosen, k], share
            if len(starts) == 1:
                break
        at = int(np.argmax(shares))
        return self.languages[chosen[at]], float(min(1.0, max(0.0, shares[at]))), {self.languages[k]: float(s) for k, s in zip(chosen, shares)}


def expect_maximise(parts: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and mixing proportions of the segments (columns) under the given languages (rows)."""
    count = len(parts)
    if count == 1:
        return float(parts.sum()), np.ones(1)
    share = np.full(count, 1.0 / count)
    top = parts.max(axis=0)
    likely = np.exp(parts - top)
    for _ in range(ROUNDS):
        joint = share[:, None] * likely
        new = (joint / joint.sum(axis=0)).mean(axis=1)
        done = np.abs(new - share).max() < 1e-4
        share = np.maximum(new, 1e-9)
        share /= share.sum()
        if done:
            break
    return float((np.log((share[:, None] * likely).sum(axis=0)) + top).sum()), share


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model from (key, lang, text) rows; at most about ``rows`` of each language, drawn by hash of the key.

    Counts are summed by Spark; the driver gets the finished table of at most
    languages x 2**BUCKET_BITS numbers.
    """
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("own_size"))
    names = [r["lang"] for r in sizes.select("lang").limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not names:
        return Model({})
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) * F.col("own_size") < F.lit(rows * 1_000_000)
    sample = labelled.select("key", "lang", "text").join(F.broadcast(sizes), "lang").where(draw)  # as many rows as languages

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    own = sums.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                    own += np.bincount(grams(normal(text)), minlength=1 << BUCKET_BITS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int64()), "n": pa.array(own[at], pa.int64())})

    partial = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    found = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {name: np.zeros(1 << BUCKET_BITS) for name in names}
    for lang, own in found.groupby("lang"):
        counts[lang][own["bucket"].to_numpy()] = own["n"].to_numpy()
    return Model(counts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and lang_shares.  No shuffle."""
    plain = [c for c in docs.columns if c == text or c.lower() not in ("lang_pred", "score", "lang_shares")]
    base = docs.select(*[F.col(f"`{c}`") for c in plain])
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", T.MapType(T.StringType(), T.DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch):
        found = [shared.value.infer(t) for t in batch.column(text).to_pylist()]
        names, scores, shares = zip(*found) if found else ((), (), ())
        return {n: batch.column(n) for n in batch.schema.names} | {"lang_pred": list(names), "score": list(scores), "lang_shares": [list(s.items()) for s in shares]}

    return map_rows(base, run, schema)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.where(F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select(F.col("doc_id").alias("key"), "lang", "text")
    found = predict(docs.select("doc_id", "text"), train(labelled))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
