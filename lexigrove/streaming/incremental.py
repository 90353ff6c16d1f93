"""Structured Streaming: incremental indexing, append-only logs, windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import changed, replaced


def source(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


#: Parts of an index by hash of the key; a batch rewrites only the parts that its documents fall into.
BUCKETS = 64


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")


def index_stream(rows: DataFrame, build: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "document_id", version: str = "version") -> StreamingQuery:
    """Keep an index table up to date: each batch's new or changed documents replace their rows.

    ``rows`` has ``key``, ``fingerprint`` and ``version``, all of which ``build`` keeps.  Of a document's versions the
    greatest counts (of equal ones the greater fingerprint), in a batch and across batches.  A batch writes the parts that it changes under
    ``target/v=<batch id>``, so a batch that is run again after a failure gives the same; the
    index is the newest complete version of every part.  Parts that two newer complete
    versions replace are deleted, so a reader of the version before still finds its files.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in batch.columns]), F.struct(version, "fingerprint")).alias("r")).select("r.*")
        before = read_index(spark, target, number)
        fresh = latest
        if before is not None:
            known = before.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(F.col(version).alias("v"), F.col("fingerprint").alias("f"))).alias("_known"))
            newer = F.col("_known").isNull() | (F.struct(F.col(version).alias("v"), F.col("fingerprint").alias("f")) > F.col("_known"))
            fresh = changed(latest, before.select(key, "fingerprint").distinct(), key).join(known, F.col(key) == F.col("_key"), "left").where(newer).drop("_key", "_known")
        touched = sorted(r[0] for r in fresh.select(_bucket(key)).distinct().collect())  # BUCKETS numbers at most
        built = build(fresh)
        rows = built if before is None else replaced(before.where(_bucket(key).isin(touched)), built, key)
        if touched:
            rows.withColumn("part", _bucket(key)).write.mode("overwrite").partitionBy("part").parquet(f"{target}/v={number:08d}")
            _drop_replaced(spark, target, number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _files(spark: SparkSession, target: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path, path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, target: str, before: int | None = None) -> dict[int, list[int]]:
    """Batch numbers of complete versions that hold each part, oldest first."""
    path, files = _files(spark, target)
    found: dict[int, list[int]] = {}
    if files.exists(path(target)):
        for version in sorted(s.getPath().getName() for s in files.listStatus(path(target))):
            if version.startswith("v=") and (before is None or int(version[2:]) < before) and files.exists(path(f"{target}/{version}/_SUCCESS")):
                for part in files.listStatus(path(f"{target}/{version}")):
                    name = part.getPath().getName()
                    if name.startswith("part="):
                        found.setdefault(int(name[5:]), []).append(int(version[2:]))
    return found


def _drop_replaced(spark: SparkSession, target: str, number: int) -> None:
    path, files = _files(spark, target)
    for part, versions in _versions(spark, target, number + 1).items():
        for old in versions[:-2]:
            files.delete(path(f"{target}/v={old:08d}/part={part}"), True)


def read_index(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The index: the newest complete version of every part, or of those before a batch number."""
    parts = [f"{target}/v={versions[-1]:08d}/part={part}" for part, versions in sorted(_versions(spark, target, before).items())]
    return spark.read.parquet(*parts) if parts else None


def dedupe_events(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Append-only events once each; state older than the watermark is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str | None = "1 hour", time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of tumbling or sliding windows, final once the watermark has passed.

    ``late=None`` keeps a watermark that the events already have.
    """
    w = F.window(time, width, slide) if slide else F.window(time, width)
    marked = events.withWatermark(time, late) if late else events
    found = marked.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", by: str = "user_id") -> DataFrame:
    found = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count("*").alias("n"))
    return found.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), by, "n")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to a Parquet log."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
