"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; unset, a fresh one, which only a local session (tests) may have."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexigrove-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so later jobs start from files that outlive executors.

    With ``small`` (ids and links, not texts) rows are dealt to as many tasks as there are cores first, so that many
    tasks with few rows each do not leave a file each.
    """
    small_batches(df.sparkSession)
    return write_table(few_files(df) if small else df, table_path(df.sparkSession, name))


def few_files(df: DataFrame) -> DataFrame:
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))


#: Bytes of rows in one Arrow batch: an executor and its Python workers hold several batches at a time.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES unless something else than Spark's default is set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "64m"):
        spark.conf.set(name, BATCH_BYTES)


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours that nothing reads any more, on whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; files that give fewer splits than there are cores are dealt out once."""
    small_batches(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def field_name(df: DataFrame, stem: str) -> str:
    """A column name made from ``stem`` that ``df`` does not use yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes held by a string column: one aggregate row reaches the driver."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column).cast("long")), F.lit(0))).first()[0])


#: Rows that a Python function holds at a time; Arrow batches may be larger.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what Python makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@functools.cache
def _trim():
    """glibc's malloc_trim, or None where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hands memory that Arrow's pool and the C library keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


#: Caches that tasks of one operator keep for one another (``functools`` caches), to be emptied by tasks of any other.
RESIDENT: list = []


def lean(function, tables: int = 0, keeps=None):
    """``function`` for ``mapInArrow`` (or, of one or two tables, for ``applyInArrow``), which gives back memory when it is through.

    Workers outlive their tasks: what the largest task made them keep would count beside every later stage.  Resident
    caches other than ``keeps`` are emptied first.
    """

    def begin() -> None:
        for cache in RESIDENT:
            if cache is not keeps:
                cache.cache_clear()

    def stream(batches):
        begin()
        yield from function(batches)
        give_back()

    def one(group: pa.Table) -> pa.Table:
        begin()
        out = function(group)
        give_back()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        begin()
        out = function(left, right)
        give_back()
        return out

    return (stream, one, two)[tables]


def map_rows(df: DataFrame, function, schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with a function from one Arrow batch to one dict of columns."""
    small_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in slices(batches):
            columns = function(batch)
            yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(lean(run), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema])


def sorted_by_id(texts: DataFrame, range_bytes: int) -> DataFrame:
    """(doc_id, text) sorted within and across tasks by doc_id (null first) and a hash of the text.

    A range exchange of about ``range_bytes`` of text a task; its bounds come from Spark's own sample of keys.  The
    input's partition ends the key, so that rows that repeat an id and a text any number of times are dealt out too;
    unlike a row's number it is the same when a lost task runs again.
    """
    tasks = max(1, -(-total_bytes(texts, "text") // range_bytes))
    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.spark_partition_id().alias("at"))
    key = [F.col("doc_id").asc_nulls_first(), "tie", "at"]
    return keyed.repartitionByRange(tasks, *key).sortWithinPartitions(*key).select("doc_id", "text")
