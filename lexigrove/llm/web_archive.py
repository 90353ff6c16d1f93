"""Web archives: a converter from legacy ARC files to WARC, and readers and writers of both.

An ARC archive starts with a version block that tells how many fields a record's header line
has; each record is such a line and as many bytes as the line declares.  The converter walks
the lines and lengths, and gives every record what WARC wants besides: an identifier (a name
based UUID of archive and offset), an ISO 8601 time, a type from scheme and content, and
SHA-1 digests of block and payload.  Of records with equal payloads one is a response, the
others revisit it.

Payloads are shuffled once, by (digest, archive), so that no key gathers more than an archive
holds; which record stays is decided on narrow rows that count each payload once an archive.
A later copy inside an archive leaves its payload behind before the shuffle.  Archives are
written by Spark's text writer (committed as any Spark table) and read as ``binaryFile`` rows:
an archive is at most 2 GB, and those written here hold a shuffle partition each.

Defined results for odd input
- null html: an empty payload; null or empty URL: ``-`` in both archives; blanks and control
  characters of a URL are written as ``%XX``;
- null page_id: no source in the archive, null when read back, after all numbers in the choice
  of the response;
- repeated rows and ties on page_id: one of them is the response, by time and identifier;
- a header line that does not fit its version: the rest of that archive becomes one ``resource``
  record, marked ``WARC-Truncated``; so does a record shorter than it declares;
- texts of any length are whole (one record has to fit a worker's memory);
- an empty table gives an empty archive and no rows; other columns of the input are not archived.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialise, slices, small_batches, table, table_path

#: Fixed values of the two ARC versions: the fields of a record's header line, URL first and length last.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What ends a WARC record.
RECORD_END = "\r\n\r\n"
#: Header of the HTTP block that carries a page's id through both archives.
SOURCE_HEADER = b"X-Source-Id"

#: Bytes of records that ``write_arc`` puts into one archive; a longer record has one of its own.
ARCHIVE_BYTES = 4 << 20
#: Capture time of pages that have none.
CAPTURED = "19700101000000"

ARC_SCHEMA = T.StructType([T.StructField("archive", T.StringType()), T.StructField("content", T.BinaryType())])
RECORD_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("ip", T.StringType()),
    T.StructField("time", T.StringType()), T.StructField("mime", T.StringType()), T.StructField("source_id", T.LongType()), T.StructField("truncated", T.BooleanType()), T.StructField("head", T.BinaryType()),
    T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
])
WARC_SCHEMA = T.StructType([
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("time", T.StringType()), T.StructField("source_id", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("digest_ok", T.BooleanType()), T.StructField("refers_to_id", T.StringType()),
    T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def digest_of(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- legacy archives -----------------------------------------------------------------


def arc_version_block(name: str, version: int, captured: str = CAPTURED) -> bytes:
    body = f"{version} 0 lexigrove\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": captured, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(url: bytes, body: bytes, version: int, name: str, offset: int, captured: str = CAPTURED, mime: str = "text/html") -> bytes:
    fields = {"IP-address": "0.0.0.0", "Archive-date": captured, "Content-type": mime, "Result-code": "200", "Checksum": hashlib.md5(body).hexdigest(), "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}
    safe = re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url) or b"-"
    return safe + b" " + " ".join(fields[f] for f in ARC_FIELDS[version][1:]).encode() + b"\n" + body + b"\n"


def http_block(source: int | None, payload: bytes) -> bytes:
    lines = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    if source is not None:
        lines.append(SOURCE_HEADER + b": %d" % source)
    return b"\r\n".join(lines) + b"\r\n\r\n" + payload


def write_arc(pages: DataFrame, versions: tuple[int, ...] = (1, 2), archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content) rows: the pages (page_id, url, html) as ARC archives, whose versions take turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, name, held, size = TaskContext.get().partitionId(), 0, "", [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], schema=arrow_schema(ARC_SCHEMA))

        for batch in slices(batches):
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                body = http_block(page, html or b"")
                if held and size + len(body) > archive_bytes:
                    yield row()
                    held = []
                if not held:
                    name, version = f"pages-{part:06d}-{number:06d}.arc", versions[(part + number) % len(versions)]
                    number += 1
                    held = [arc_version_block(name, version)]
                    size = len(held[0])
                held.append(arc_record(url or b"", body, version, name, size))
                size += len(held[-1])
        if held:
            yield row()

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("binary"), F.col("html").cast("binary")).mapInArrow(run, ARC_SCHEMA)


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(archive, content) rows of archive files on any file system that Spark reads, gzip members or plain."""
    small_batches(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("archive"), "content")


def _open(content: bytes) -> io.BufferedIOBase:
    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, bytes], bytes, bool]]:
    """(offset, header fields, block, whole) of every record of one archive, the version block left out.

    A line that does not fit gives no fields: the rest of the archive is that record's block.
    """
    file, version, offset, first = _open(content), 1, 0, True
    while line := file.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        names = ARC_FIELDS[version]
        if first and line.startswith(b"filedesc:"):  # its version is known from its block only, but length comes last in both
            length = line.split()[-1]
            names, fields = ["URL", "Archive-length"], [line.split(b" ", 1)[0], length]
        else:
            fields = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1)
        if len(fields) != len(names) or not fields[-1].isdigit():
            yield start, {}, line + file.read(), False
            return
        block = file.read(length := int(fields[-1]))
        offset += len(block)
        if first and line.startswith(b"filedesc:"):
            head = block.split(None, 1)
            version = 2 if head and head[0] == b"2" else 1
        else:
            yield start, dict(zip(names, fields, strict=True)), block, len(block) == length
        first = False


def _iso(date: bytes) -> str:
    """14 digits (fewer: padded with the earliest) as ISO 8601."""
    digits = date.decode("ascii", "replace")
    if not re.fullmatch(r"\d{4,17}", digits):
        digits = CAPTURED
    d = (digits + "00000101000000"[len(digits):])[:14] if len(digits) < 14 else digits[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _typed(archive: str, offset: int, fields: dict[str, bytes], block: bytes, whole: bool) -> dict:
    """What WARC says of one legacy record."""
    name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{offset}"))
    head, payload, source, kind = b"", block, None, "resource"
    mime = fields.get("Content-type", b"application/octet-stream").decode("utf-8", "replace")
    if block.startswith(b"HTTP/") and (cut := re.search(rb"\r?\n\r?\n", block)):
        head, payload, kind, mime = block[: cut.end()], block[cut.end() :], "response", "application/http; msgtype=response"
        if found := re.search(rb"(?im)^" + SOURCE_HEADER + rb":\s*(-?\d{1,19})\s*$", head):
            source = int(found[1])
    return {
        "archive": archive, "record_id": name, "kind": kind, "uri": fields.get("URL", b"-").decode("utf-8", "replace"), "ip": fields.get("IP-address", b"-").decode("utf-8", "replace"), "time": _iso(fields.get("Archive-date", b"")),
        "mime": mime, "source_id": source, "truncated": not whole, "head": head, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest_of(payload),
    }


def arc_rows(archives: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Every record of the archives (archive, content), with the identifiers, times, types and digests that WARC wants.

    Of equal payloads of ``min_bytes`` or more in an archive, a record that comes after another of smaller source id has no payload here.
    """
    arrow = arrow_schema(RECORD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            archive, content = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            least: dict[str, tuple] = {}
            rows, size = [], 0
            for record in arc_records(content or b""):
                row = _typed(archive, *record)
                key = (row["source_id"] is None, row["source_id"] or 0, row["time"], row["record_id"])
                if row["payload_digest"] in least and least[row["payload_digest"]] < key:
                    row["payload"] = None
                elif row["payload_bytes"] >= min_bytes:
                    least[row["payload_digest"]] = key
                rows.append(row)
                size += len(row["payload"] or b"")
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    small_batches(archives.sparkSession)
    return archives.select("archive", "content").mapInArrow(run, RECORD_SCHEMA)


# -- from ARC to WARC ----------------------------------------------------------------


def convert(archives: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The archives' records, each with ``keeper`` (source_id, time, record_id, uri of the response) where it revisits one.

    Payloads of ``min_bytes`` or more that are equal are kept once: by the record with the
    smallest source id (then time, then identifier).  Shorter ones are all kept.
    """
    rows = arc_rows(archives, min_bytes)
    key = F.struct(F.col("source_id").isNull().alias("none"), F.col("source_id"), F.col("time"), F.col("record_id"), F.col("uri"))
    # one row for a payload and archive, written: the archives are read twice, not three times
    members = materialise(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "archive").agg(F.min(key).alias("least"), F.count("*").alias("n")), "payloads", small=True)
    shared = members.groupBy("payload_digest").agg(F.min("least").alias("keeper"), F.sum("n").alias("copies")).where("copies > 1")
    by_archive = members.select("payload_digest", "archive").join(shared.select("payload_digest", "keeper"), "payload_digest")
    joined = rows.join(by_archive, ["payload_digest", "archive"], "left")
    revisits = F.col("keeper.record_id") != F.col("record_id")
    return joined.select(*[c for c in rows.columns if c != "payload"], F.when(~F.coalesce(revisits, F.lit(False)), F.col("payload")).alias("payload"), F.when(revisits, F.col("keeper")).alias("keeper"))


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the blank lines that end it."""
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*fields, ("Content-Length", str(len(block)))])
    return WARC_VERSION + b"\r\n" + lines + b"\r\n" + block


def _as_warc(r: dict) -> bytes:
    keeper = r["keeper"]
    block = r["head"] if keeper else r["head"] + (r["payload"] or b"")
    fields = [("WARC-Type", "revisit" if keeper else r["kind"]), ("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", r["time"]), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]),
              ("Content-Type", r["mime"]), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("WARC-Payload-Length", str(r["payload_bytes"]))]
    if r["source_id"] is not None:
        fields.append(("WARC-Source-Id", str(r["source_id"])))
    if r["truncated"]:
        fields.append(("WARC-Truncated", "unspecified"))
    if keeper:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{keeper['record_id']}>"), ("WARC-Refers-To-Target-URI", keeper["uri"]), ("WARC-Refers-To-Date", keeper["time"])]
        if keeper["source_id"] is not None:
            fields.append(("WARC-Refers-To-Source-Id", str(keeper["source_id"])))
    return warc_record(fields, block)


def write_warc(records: DataFrame, path: str) -> None:
    """Records of ``convert`` as compressed WARC files, one a task, each beginning with a ``warcinfo`` record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in slices(batches):
            made = []
            if first:
                name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}#{TaskContext.get().partitionId()}")
                made.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", _iso(CAPTURED.encode())), ("Content-Type", "application/warc-fields")], b"software: lexigrove\r\nformat: WARC File Format 1.1\r\n"))
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(made + [_as_warc(r) for r in batch.to_pylist()], pa.binary())], names=["value"])

    small_batches(records.sparkSession)
    made = records.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields with names in lower case, block) of every record of one file."""
    file = _open(content)
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = file.read(length := int(fields["content-length"]))
        if len(block) < length:
            raise ValueError("the file ends inside a record")
        yield fields, block


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of WARC files, warcinfo left out; length and digest are those of the payload read, or a revisit's declared ones."""
    arrow = arrow_schema(WARC_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows, size = [], 0
            for fields, block in warc_records(batch.column(1)[0].as_py()):
                if (kind := fields["warc-type"]) == "warcinfo":
                    continue
                cut = re.search(rb"\r?\n\r?\n", block) if fields["content-type"].startswith("application/http") else None
                data, declared = block[cut.end() if cut else 0 :], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                own = kind != "revisit"
                found = digest_of(data) if own else declared
                rows.append({
                    "record_type": kind, "record_id": fields["warc-record-id"], "uri": fields.get("warc-target-uri"), "time": fields.get("warc-date"), "source_id": _number(fields.get("warc-source-id")),
                    "payload_bytes": len(data) if own else _number(fields.get("warc-payload-length")), "payload_digest": found, "digest_ok": found == declared,
                    "refers_to_id": fields.get("warc-refers-to"), "refers_to": _number(fields.get("warc-refers-to-source-id")), "payload": data if own and payload else None,
                })
                size += len(data) if payload else 0
                if size > 1 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return read_archives(spark, path, "*.gz").mapInArrow(run, WARC_SCHEMA)


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Writes the pages as WARC files under ``path``, by way of legacy archives, and returns the records read back."""
    write_warc(convert(write_arc(pages), min_bytes), path)
    return read_warc(pages.sparkSession, path, payload=False)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_pages(table(spark, sf_dir, "pages"), table_path(spark, "warc"))
    return found.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 comes as 40 hexadecimal digits: each five are four letters of base32.
OP13_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, array_to_string(list_transform(range(32), lambda k:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS INTEGER) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest
  FROM p
), r AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS nth, first_value(page_id) OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS keeper FROM q
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN keeper END AS refers_to FROM r
"""
