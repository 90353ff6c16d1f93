"""Vector archives (NPZ) as a partitioned data source: tasks read row ranges of the members, the driver headers only.

    spark.dataSource.register(VectorArchive)
    spark.read.format("vector_archive").option("path", file).load()      # chunk_id string, vector array<float>

The archive lies where driver and executors can open it.  A member that is stored can be entered at
any row; one that is deflated is read through from its beginning by every task of it, which costs
time, not memory.  ``read_vectors`` checks besides that no id repeats.
"""

from __future__ import annotations

import ast
import struct
import zipfile
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The bounds of an archive that is read.
MOST_ROWS, MOST_DIM, MOST_RATIO = 1_000_000, 8192, 250
#: Rows of a task, unless the option ``rows`` says otherwise, and of a batch.
ROWS, BATCH = 65536, 4096
SCHEMA = "chunk_id string, vector array<float>"


def header(file: BinaryIO) -> tuple[np.dtype, tuple[int, ...]]:
    """Kind and shape of an array from the beginning of its member; the array itself is not read."""
    magic = file.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("a member is no array")
    size = struct.unpack("<H", file.read(2))[0] if magic[6] == 1 else struct.unpack("<I", file.read(4))[0]
    said = ast.literal_eval(file.read(size).decode("latin1"))
    kind = np.dtype(said["descr"])
    if kind.hasobject or said["fortran_order"]:
        raise ValueError("arrays of objects or in column order are not read")
    return kind, said["shape"]


def _checked(path: str, most_rows: int, most_dim: int, most_ratio: int) -> int:
    """Number of rows, after all that headers can tell."""
    with zipfile.ZipFile(path) as archive:
        for entry in archive.infolist():
            if entry.compress_size and entry.file_size / entry.compress_size > most_ratio:
                raise ValueError("archive expands too far")
        with archive.open("vectors.npy") as file:
            kind, shape = header(file)
        with archive.open("chunk_ids.npy") as file:
            ids, n = header(file)
    if len(shape) != 2 or kind.kind != "f" or len(n) != 1 or ids.kind not in "US" or shape[0] != n[0] or shape[0] > most_rows or shape[1] > most_dim:
        raise ValueError("vectors have the wrong shape or kind")
    return shape[0]


class Rows(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


def _rows(file: BinaryIO, first: int, last: int) -> Iterator[np.ndarray]:
    kind, shape = header(file)
    one = kind.itemsize * int(np.prod(shape[1:], dtype=np.int64))
    file.seek(one * first, 1)
    for at in range(first, last, BATCH):
        n = min(BATCH, last - at)
        data = file.read(one * n)
        if len(data) < one * n:
            raise ValueError("a member ends before its last row")
        yield np.frombuffer(data, kind).reshape(n, *shape[1:])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.bounds = [int(options.get(n, most)) for n, most in (("most_rows", MOST_ROWS), ("most_dim", MOST_DIM), ("most_ratio", MOST_RATIO))]

    def partitions(self) -> list[Rows]:
        n = _checked(self.path, *self.bounds)
        return [Rows(at, min(at + self.rows, n)) for at in range(0, n, self.rows)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(self.path) as one, zipfile.ZipFile(self.path) as two, one.open("vectors.npy") as vectors, two.open("chunk_ids.npy") as ids:
            for matrix, names in zip(_rows(vectors, partition.first, partition.last), _rows(ids, partition.first, partition.last), strict=True):
                if not np.isfinite(matrix).all():
                    raise ValueError("vectors are not finite")
                flat = pa.array(matrix.astype(np.float32).reshape(-1))
                offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array([x.decode() if isinstance(x, bytes) else str(x) for x in names]), pa.ListArray.from_arrays(offsets, flat)], names=["chunk_id", "vector"])


class VectorArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_vectors(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """(chunk_id, vector) of an archive after all checks; one number reaches the driver."""
    spark.dataSource.register(VectorArchive)
    rows = spark.read.format("vector_archive").option("path", path).options(**options).load()
    if rows.groupBy("chunk_id").count().where("count > 1").limit(1).count():
        raise ValueError("vectors are not finite or ids repeat")
    return rows


def write_archive(path: str, ids: list[str], vectors: np.ndarray, compressed: bool = False) -> None:
    """A small archive of the same form, for tests and exports from the driver."""
    (np.savez_compressed if compressed else np.savez)(path, vectors=vectors, chunk_ids=np.array(ids, dtype=str))


def vector_rows(frame: DataFrame) -> DataFrame:
    """Rows as publication wants them: (chunk_id, dimensions, vector)."""
    return frame.select("chunk_id", F.size("vector").alias("dimensions"), "vector")
