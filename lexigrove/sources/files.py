"""File sources and sinks: scans, grouping by content, DOCX text, inventories, JSON, CSV, snapshots, pointers."""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from typing import Protocol
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import document_id, table_digest
from ..functions.text import basename

#: File kinds that are read, and pictures that are scanned.
DOCUMENT_SUFFIXES = ("pdf", "docx", "txt", "md")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = DOCUMENT_SUFFIXES) -> DataFrame:
    """Files below ``folder`` with content digest; only the kinds asked for are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(x for s in suffixes for x in (s, s.upper())) + "}").load(folder)
    return rows.select("path", basename(F.col("path")).alias("name"), F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).alias("suffix"), "length", "modificationTime", F.sha2("content", 256).alias("sha256"), "content")


def source_groups(files: DataFrame) -> DataFrame:
    """Equal contents once: the first path (case ignored) is canonical, the others are aliases."""
    order = Window.partitionBy("sha256").orderBy(F.lower("path"), "path")
    first = files.withColumns({"n": F.row_number().over(order), "canonical": F.first("path").over(order)})
    return first.select("path", "name", "suffix", "length", "sha256", "canonical", (F.col("n") == 1).alias("is_canonical"), document_id(F.col("canonical"), F.col("sha256")).alias("document_id"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures below ``folder`` ordered by name."""
    return scan(spark, folder, IMAGE_SUFFIXES).orderBy(F.lower("name"), "path")


class PageReader(Protocol):
    """Reader of paged files (for example PDF with text layer or recognition): yields (page_number, text, method)."""

    def pages(self, content: bytes) -> Iterator[tuple[int, str, str]]: ...


_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """(location, text) of the paragraphs with text in body, headers and footers of a DOCX file."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = [n for n in archive.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*)\.xml", n)]
        for part in sorted(parts, key=lambda n: (n != "word/document.xml", n)):
            for number, paragraph in enumerate(ElementTree.fromstring(archive.read(part)).iter(f"{_WORD}p"), 1):
                text = "".join(t.text or "" for t in paragraph.iter(f"{_WORD}t")).strip()
                if text:
                    out.append((f"{part[5:-4]}:paragraph:{number}", text))
    return out


BLOCKS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("document_id", "block_id", "location", "text", "block_type", "extraction_method")] + [T.StructField("page_number", T.IntegerType()), T.StructField("error", T.StringType())]
)


def convert(files: DataFrame, reader: PageReader | None = None) -> DataFrame:
    """Blocks of files by kind: DOCX paragraphs, plain text paragraphs, pages through ``reader``.

    A file that cannot be read gives one row with the error instead of stopping the scan.
    ``files``: document_id, suffix, content.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                try:
                    if f.suffix == "docx":
                        found = [(loc, text, "paragraph", "docx:xml", None) for loc, text in docx_blocks(f.content)]
                    elif f.suffix in ("txt", "md"):
                        found = [(f"paragraph:{n}", p.strip(), "paragraph", "text", None) for n, p in enumerate(re.split(r"\n\s*\n", f.content.decode("utf-8", "replace")), 1) if p.strip()]
                    elif reader is not None:
                        found = [(f"page:{n}", text, "page", method, n) for n, text, method in reader.pages(f.content)]
                    else:
                        raise ValueError(f"no reader for {f.suffix}")
                    rows += [(f.document_id, f"{f.document_id}:{i}", loc, text, kind, method, page, None) for i, (loc, text, kind, method, page) in enumerate(found, 1)]
                except Exception as error:  # one bad file is a row, not a failed job
                    rows.append((f.document_id, f"{f.document_id}:0", "", "", "error", "", None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=BLOCKS.names).astype({"page_number": "Int32"})

    return files.select("document_id", "suffix", "content").mapInPandas(run, BLOCKS)


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path below the folder, size, sha256) of every file."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_replace("path", r"^.*?/" + re.escape(os.path.basename(folder.rstrip("/"))) + "/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_inventory(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths that are missing, unexpected or changed."""
    met = expected.select("path", F.col("size").alias("a"), F.col("sha256").alias("x")).join(actual.select("path", F.col("size").alias("b"), F.col("sha256").alias("y")), "path", "fullouter")
    issue = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "unexpected").when((F.col("a") != F.col("b")) | (F.col("x") != F.col("y")), "changed")
    return met.select("path", issue.alias("issue")).where("issue is not null")


def binding(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """(path, sha256, n_items, content_digest) of input files: their bytes, and, with ``rows``, what was read from them.

    A run that names its inputs so can be told apart from one over other inputs.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
    if rows is None:
        return files.select("path", "sha256", F.lit(None).cast("long").alias("n_items"), F.lit(None).cast("string").alias("content_digest"))
    return files.join(F.broadcast(table_digest(rows, *sorted(rows.columns)))).select("path", "sha256", F.col("n_rows").alias("n_items"), F.col("digest").alias("content_digest"))


def require_fresh(spark: SparkSession, *paths: str) -> None:
    """Raises if any output path is there already, before anything is computed for it."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise FileExistsError(path)


# -- records ------------------------------------------------------------------------


def read_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool = True) -> DataFrame:
    """JSON lines, or one JSON document per file; unknown fields go, absent ones are null."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).json(path)


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines with keys in sorted order; never over existing files."""
    rows.select(*sorted(rows.columns)).write.mode("errorifexists").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with nested columns as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema]).write.mode("errorifexists").option("header", "true").csv(path)


def export_csv(rows: DataFrame, path: str, most: int = 100_000) -> int:
    """A small table as one CSV file with byte-order mark, for spreadsheet programs; refuses larger ones."""
    data = rows.limit(most + 1).toPandas()
    if len(data) > most:
        raise ValueError(f"more than {most} rows: use write_csv")
    data.to_csv(path, index=False, encoding="utf-8-sig")
    return len(data)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; one of more than ``most`` rows is an error."""
    data = rows.limit(most + 1).collect()
    if len(data) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, data)])


# -- snapshots ----------------------------------------------------------------------


def publish(tables: dict[str, DataFrame], root: str) -> str:
    """An immutable snapshot directory with one Parquet table per entry; existing files are never touched."""
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")
    return path


def _atomic(path: str, text: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "w", encoding="utf-8") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(temporary, path)


def write_pointer(path: str, payload: dict) -> None:
    """The driver's pointer to the active snapshot: replaced as a whole or not at all."""
    _atomic(path, json.dumps(payload, ensure_ascii=False, sort_keys=True, indent=2))


def read_pointer(path: str, most: int = 1 << 20) -> dict | None:
    if not os.path.exists(path):
        return None
    if os.path.getsize(path) > most:
        raise ValueError("pointer file is too large")
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def merge_manifest(path: str, profile: str, entry: dict, outputs: dict[str, str], fallback_reason: str | None = None) -> dict:
    """The driver's run manifest with this profile's entry in place of an earlier one; a file that does not parse is begun anew."""
    try:
        held = read_pointer(path) or {}
    except ValueError:
        held = {}
    held = held if isinstance(held, dict) else {}
    profiles = held.get("profiles")
    held["profiles"] = {**(profiles if isinstance(profiles, dict) else {}), profile: {**entry, "outputs": dict(outputs), "fallback": fallback_reason is not None, "fallback_reason": (fallback_reason or "")[:1000]}}
    write_pointer(path, held)
    return held


def import_vectors(path: str, most_rows: int = 1_000_000, most_dim: int = 8192, most_ratio: int = 250) -> tuple[list[str], object]:
    """Ids and matrix of an old NPZ archive after checks of size, kind, shape and finite values."""
    import numpy as np

    with zipfile.ZipFile(path) as archive:
        for entry in archive.infolist():
            if entry.compress_size and entry.file_size / entry.compress_size > most_ratio:
                raise ValueError("archive expands too far")
    with np.load(path, allow_pickle=False) as data:
        matrix, ids = data["vectors"], [str(x) for x in data["chunk_ids"]]
    if matrix.ndim != 2 or matrix.dtype.kind != "f" or len(matrix) != len(ids) or len(ids) > most_rows or matrix.shape[1] > most_dim:
        raise ValueError("vectors have the wrong shape or kind")
    if not np.isfinite(matrix).all() or len(set(ids)) != len(ids):
        raise ValueError("vectors are not finite or ids repeat")
    return ids, matrix.astype(np.float32)
