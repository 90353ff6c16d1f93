"""Detection runs, conversations and web results as tables."""

from __future__ import annotations

import html
import re
from typing import Protocol
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import run_id
from ..operators.reconcile import last_wins

FINDING = T.StructType(
    [
        T.StructField("index", T.IntegerType()), T.StructField("class_id", T.IntegerType()), T.StructField("class_name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("box", T.ArrayType(T.DoubleType())),
        T.StructField("area", T.StructType([T.StructField("area_pixels", T.LongType()), T.StructField("area_ratio", T.DoubleType())])), T.StructField("screening_severity", T.StructType([T.StructField("level", T.StringType())])),
    ]
)
SUMMARY = T.StructType(
    [
        T.StructField("run_id", T.StringType()), T.StructField("source_folder", T.StringType()), T.StructField("created_at", T.StringType()),
        T.StructField("results", T.ArrayType(T.StructType([T.StructField("image_name", T.StringType()), T.StructField("status", T.StringType()), T.StructField("damage_findings", T.ArrayType(FINDING))]))),
    ]
)


def catalog(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """Runs found as ``batch_summary.json`` below a folder and in an archive; the archive wins per run."""
    parts = []
    for priority, (path, glob) in enumerate([(folder, "batch_summary.json"), (archive, "*.json")]):
        if path:
            parts.append(spark.read.schema(SUMMARY).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).json(path).withColumn("path", F.input_file_name()).withColumn("priority", F.lit(priority)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("run_id", run_id(F.col("run_id"), F.col("path"), F.col("created_at"), F.xxhash64(F.to_json("results")).cast("string")))
    return last_wins(rows, ["run_id"], "priority", "created_at", "path")


def findings(runs: DataFrame) -> DataFrame:
    """One row per finding, heavy fields left out; pictures without findings keep a row."""
    images = runs.select("run_id", "source_folder", F.explode("results").alias("r"))
    rows = images.select("run_id", F.col("r.image_name").alias("image_name"), F.col("r.status").alias("status"), F.explode_outer("r.damage_findings").alias("f"))
    return rows.select("run_id", "image_name", "status", F.col("f.index").alias("finding_index"), "f.class_name", "f.score", "f.area.area_pixels", "f.area.area_ratio", F.col("f.screening_severity.level").alias("level"))


MESSAGES = T.StructType([T.StructField(n, T.StringType()) for n in ("message_id", "conversation_id", "role", "content")] + [T.StructField("created_at", T.TimestampType()), T.StructField("status", T.StringType())])


def append_messages(rows: DataFrame, path: str) -> None:
    """Append to the message log, partitioned by nothing: readers order by time and id."""
    rows.select(*[F.col(f.name).cast(f.dataType) for f in MESSAGES]).write.mode("append").parquet(path)


def conversation_state(events: DataFrame) -> DataFrame:
    """Latest title and archive flag of each conversation from its event log, newest first."""
    return last_wins(events, ["conversation_id"], "updated_at", "event_id").where("not archived").orderBy(F.col("updated_at").desc(), "conversation_id")


class WebSearch(Protocol):
    """Provider of raw search pages; no network access is built in."""

    def fetch(self, query: str) -> str: ...


def parse_results(page: str, most: int = 5) -> list[dict[str, str]]:
    """Title, URL and snippet of a search page: RSS items, else result anchors; each URL once."""
    items = [(_inner(i, "link"), _inner(i, "title"), _inner(i, "description")) for i in re.findall(r"(?is)<item\b.*?</item>", page)]
    if not items:
        items = [(html.unescape(u), t, "") for u, t in re.findall(r'(?is)<a\b[^>]*\bclass="[^"]*result[^"]*"[^>]*\bhref="([^"]+)"[^>]*>(.*?)</a>', page)]
        items += [(html.unescape(u), t, "") for u, t in re.findall(r'(?is)<a\b[^>]*\bhref="([^"]+)"[^>]*\bclass="[^"]*result[^"]*"[^>]*>(.*?)</a>', page)]
    out: dict[str, dict[str, str]] = {}
    for url, title, snippet in items:
        target = parse_qs(urlsplit(url).query).get("uddg", [url])[0]
        target, title = unquote(target).strip(), _plain(title)
        if target.startswith(("http://", "https://")) and title and target not in out:
            out[target] = {"url": target, "title": title, "snippet": _plain(snippet)}
    return list(out.values())[:most]


def _inner(item: str, tag: str) -> str:
    found = re.search(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", item)
    return html.unescape(re.sub(r"(?s)^<!\[CDATA\[(.*)\]\]>$", r"\1", found[1].strip())) if found else ""


def _plain(text: str) -> str:
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())
