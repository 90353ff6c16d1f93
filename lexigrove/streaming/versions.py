"""Document versions as a stream: keyed state decides which version counts, whatever order they come in.

A version is a row with a key, an event time, a fingerprint of its content and an operation (``upsert``
or ``delete``).  Of a key's versions the one with the greatest event time counts; at one time a delete
comes after an upsert, and of two upserts the greater fingerprint.  The state of a key is that order's
maximum so far, so repeated, late and out-of-order versions change nothing that a newer one has decided.

Output are changes only: an upsert when content differs from what was put out before, a delete when
something is there to delete.  A deleted key keeps its state until the watermark has passed the delete
(a timer), after which older versions cannot come any more; then the state goes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import inverted

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = T.StructType([T.StructField("micros", T.LongType()), T.StructField("gone", T.BooleanType()), T.StructField("fingerprint", T.StringType()), T.StructField("shown", T.StringType())])


class LatestVersion(StatefulProcessor):
    """State: (event time in microseconds, deleted?, fingerprint) of the newest version, and the fingerprint last put out (null: none)."""

    def __init__(self, columns: list[str], micros: str, operation: str, fingerprint: str):
        self.columns, self.micros, self.operation, self.fingerprint = columns, micros, operation, fingerprint

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", STATE)

    def _order(self, row: Row) -> tuple:
        return row[self.micros], row[self.operation] == "delete", row[self.fingerprint] or ""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=self._order)
        order = self._order(newest)
        before = self.known.get() if self.known.exists() else None
        if before is not None and order <= (before[0], before[1], before[2]):
            return
        shown = before[3] if before is not None else None
        gone = order[1]
        self.known.update((order[0], gone, order[2], None if gone else order[2]))
        if gone:
            self.handle.registerTimer(order[0] // 1000)
        if gone and shown is not None or not gone and shown != order[2]:
            yield Row(**{c: newest[c] for c in self.columns})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.known.exists() and self.known.get()[1]:
            self.known.clear()
        return iter([])


def latest_versions(versions: DataFrame, key: str = "document_id", time: str = "version", late: str = "1 hour", operation: str = "op", fingerprint: str = "fingerprint") -> DataFrame:
    """The stream of changes of a stream of versions; versions later than ``late`` behind the newest are dropped by the watermark."""
    versions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    micros = next(n for n in ("own_micros" + "_" * k for k in range(len(versions.columns) + 1)) if n not in versions.columns)
    processor = LatestVersion(versions.columns, micros, operation, fingerprint)
    return versions.withWatermark(time, late).withColumn(micros, F.unix_micros(time)).groupBy(key).transformWithState(processor, versions.schema, "Update", "eventTime")


def newest(versions: DataFrame, key: str = "document_id", time: str = "version", operation: str = "op", fingerprint: str = "fingerprint") -> DataFrame:
    """The same over a table at rest: the version that counts of every key that is not deleted."""
    order = F.struct(F.col(time), F.col(operation) == "delete", F.coalesce(F.col(fingerprint), F.lit("")))
    best = versions.groupBy(key).agg(F.max_by(F.struct(*versions.columns), order).alias("r")).select("r.*")
    return best.where(F.col(operation) != "delete")


def keep_indexed(changes: DataFrame, path: str, checkpoint: str, fields: dict[str, float] | None = None, key: str = "document_id", carry: tuple[str, ...] = (), operation: str = "op") -> StreamingQuery:
    """Applies changes to an inverted index, one commit a batch over all its tables.

    The commit records the batch's number, so a batch that runs again after a failure finds it and does nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        state = inverted.snapshot(spark, path)
        if state is not None and state.get("batch", -1) >= number:
            batch.write.format("noop").mode("overwrite").save()  # the state still has to be brought to this batch
            return
        batch.persist()
        try:
            upserts, deletes = batch.where(F.col(operation) != "delete"), batch.where(F.col(operation) == "delete")
            inverted.commit(spark, path, upserts, deletes, fields, key, carry, note={"batch": number})
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
