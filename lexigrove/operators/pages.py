"""Page and document level results of conversion: page sets, regions and pictures, text, table and vision metrics, figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import runs
from ..functions.text import char_count

#: Fixed value: below it a recogniser's line counts as unsure.
LOW_CONFIDENCE = 0.65
#: What a near-white scanned page may hold at most: dark pixels, area of text boxes (shares), characters; below which grey a pixel is dark.
NOISE_PIXELS, NOISE_BOXES, NOISE_CHARS, WHITE = 0.001, 0.0005, 2, 245.0
#: A spot counts from so many pixels, share of the page's pixels, width or height in pixels, share of either.
SPOT_PIXELS, SPOT_SHARE, SPOT_SIDE, SPOT_SIDE_SHARE = 24, 0.00008, 8, 0.02
#: The figures of a plan line (type, column, caption).
FIGURES = [("original", "original_image_path", "損傷原圖"), ("recognition_overlay", "annotated_image_path", "識別覆蓋圖"), ("repair_preview", "construction_image_path", "修復後示意圖")]


def _pages(name: str) -> Column:
    """Positive page numbers, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(name), F.array().cast("array<int>")), lambda p: p > 0)))


def page_sets(reports: DataFrame) -> DataFrame:
    """Reports with consistent page lists: intentional blanks are no failures, failures are of low quality, recovered pages are neither.

    ``reports``: page_count and the lists intentional_blank, scan_noise_only, recovered, failed, low_quality.
    """
    clean = reports.withColumns({c: _pages(c) for c in ("intentional_blank", "scan_noise_only", "recovered", "failed", "low_quality")})
    intended = F.array_union("intentional_blank", "scan_noise_only")
    clean = clean.withColumn("_intended", intended).withColumn("failed", F.array_except("failed", "_intended"))
    return clean.withColumns(
        {
            "effective_pages": F.greatest(F.lit(0), F.col("page_count") - F.size("_intended")),
            "low_quality": F.array_sort(F.array_except(F.array_union("low_quality", "failed"), "_intended")),
            "recovered": F.array_except(F.array_except("recovered", "_intended"), "failed"),
        }
    ).drop("_intended")


def attach_regions(images: DataFrame, regions: DataFrame) -> DataFrame:
    """Pictures with what was read in their region, by id or else by an equal box on the page; the last region wins.

    Two equi-joins, one on each key.  ``images``: document_id, page_number, image_id, bbox; ``regions`` the same and
    region_no, vision_raw, vision_summary, vision_search.
    """
    found = ["vision_raw", "vision_summary", "vision_search"]
    page = ["document_id", "page_number"]
    kept = regions.select(*page, F.col("image_id").alias("_id"), F.col("bbox").alias("_box"), F.struct("region_no", *found).alias("r"))
    own = images.select(*page, "image_id", "bbox")
    by_id = own.join(kept.where(F.coalesce("_id", F.lit("")) != ""), [*page]).where(F.col("image_id") == F.col("_id"))
    by_box = own.withColumn("_key", F.col("bbox").cast("string")).join(kept.where(F.size("_box") > 0).withColumn("_key", F.col("_box").cast("string")).drop("_id", "_box"), [*page, "_key"])
    last = by_id.select(*page, "image_id", "r").unionByName(by_box.select(*page, "image_id", "r")).groupBy(*page, "image_id").agg(F.max("r").alias("r"))
    return images.join(last, [*page, "image_id"], "left").select(*images.columns, *[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in found])


def text_metrics(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a document: characters by source, block and anomaly counts, confidence of recognised blocks.

    ``pages``: document_id, native_chars, hidden_chars, layout_chars, ocr_chars, encoding_anomaly, text_source;
    ``blocks``: document_id, confidence.
    """
    sums = [F.sum(c).alias(c) for c in ("native_chars", "hidden_chars", "layout_chars", "ocr_chars")]
    sources = [F.count_if(F.col("text_source") == s).alias(f"{s}_pages") for s in ("docling_ocr_inferred", "hidden_pdf_ocr")]
    of_pages = pages.groupBy("document_id").agg(*sums, F.count_if("encoding_anomaly").alias("encoding_anomaly_pages"), *sources)
    n, seen, low = F.col("n_blocks"), F.col("n_confidence"), F.col("n_low_confidence")
    of_blocks = blocks.groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.count("confidence").alias("n_confidence"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("n_low_confidence"))
    met = of_pages.join(of_blocks, "document_id", "left").fillna(0, ["n_blocks", "n_confidence", "n_low_confidence"])
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    return met.withColumns({"confidence_coverage": ratio(seen, n), "low_confidence_ratio": ratio(low, seen)})


def table_metrics(tables: DataFrame) -> DataFrame:
    """One row a document.  ``tables``: document_id, html (canonical or empty), extraction_method, needs_review, quality_flags."""
    valid, candidate = F.coalesce("html", F.lit("")) != "", F.col("extraction_method") == "candidate:vector-drawings"
    n = F.count("*")
    return tables.groupBy("document_id").agg(
        n.alias("n_tables"), F.count_if(~candidate).alias("n_structured"), F.count_if(candidate).alias("n_candidates"), F.count_if(valid).alias("n_valid"), F.count_if(~valid).alias("n_invalid"), F.count_if("needs_review").alias("n_review"),
        F.count_if(valid & ~F.col("needs_review")).alias("n_confirmed"), F.round(F.count_if(valid) / n, 4).alias("valid_ratio"), F.round(F.count_if("needs_review") / n, 4).alias("review_ratio"),
        F.count_if(F.array_contains(F.coalesce("quality_flags", F.array().cast("array<string>")), "table_source_conflict")).alias("n_conflicts"),
    )


def vision_metrics(regions: DataFrame) -> DataFrame:
    """One row a document.  ``regions``: document_id, vision_summary, ocr_text, model."""
    text = lambda c: F.coalesce(c, F.lit("")) != ""
    models = F.array_sort(F.collect_set(F.when(text("model"), F.col("model"))))
    return regions.groupBy("document_id").agg(F.count("*").alias("n_regions"), F.count_if(text("vision_summary") | text("ocr_text")).alias("n_successful"), models.alias("models"))


def render_counts(results: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a run: pictures to render, and why the others are skipped.

    ``results``: run_id, image_name, status, n_findings; ``lines``: run_id, image_name, repair_method, method_display_name.
    """
    named = (F.trim(F.coalesce("repair_method", F.lit(""))) != "") & (F.trim(F.coalesce("method_display_name", F.lit(""))) != "")
    planned = lines.where(named).select("run_id", "image_name").distinct().withColumn("planned", F.lit(True))
    why = F.when(F.col("status") == "failed", "failed").when((F.coalesce("status", F.lit("")) != "success") | (F.col("n_findings") == 0), "no_detection").when(F.col("planned").isNull(), "without_plan").otherwise("render")
    met = results.join(planned, ["run_id", "image_name"], "left").withColumn("why", why)
    return met.groupBy("run_id").agg(*[F.count_if(F.col("why") == w).alias(n) for w, n in (("render", "n_render"), ("no_detection", "skipped_no_detection"), ("failed", "skipped_failed"), ("without_plan", "skipped_without_plan"))])


def enrich_references(references: DataFrame, documents: DataFrame, headings: DataFrame) -> DataFrame:
    """References of the knowledge base with their document's name and heading where they have none of their own.

    ``references``: source_type, document_id, source_ref, source_name, heading_path; ``documents``: document_id,
    source_name; ``headings``: source_marker, heading_path.
    """
    names = documents.select("document_id", F.col("source_name").alias("_name"))
    paths = headings.select(F.col("source_marker").alias("source_ref"), F.col("heading_path").alias("_path")).dropDuplicates(["source_ref"])
    met = references.join(names, "document_id", "left").join(paths, "source_ref", "left")
    own = F.col("source_type") == "knowledge_base"
    return met.withColumns(
        {
            "source_name": F.when(own & F.col("source_name").isNull(), F.coalesce("_name", F.lit(""))).otherwise(F.col("source_name")),
            "heading_path": F.when(own & (F.coalesce(F.size("heading_path"), F.lit(-1)) <= 0) & F.col("_path").isNotNull(), F.col("_path")).otherwise(F.col("heading_path")),
        }
    ).select(*references.columns)


def figures(lines: DataFrame) -> DataFrame:
    """Three figure rows for each plan line; a figure without a path is a placeholder."""
    rows = F.array(*[F.struct(F.lit(n).alias("figure_no"), F.lit(kind).alias("figure_type"), F.nullif(F.col(path), F.lit("")).alias("path"), F.lit(caption).alias("caption")) for n, (kind, path, caption) in enumerate(FIGURES, 1)])
    found = lines.select("line_id", F.inline(rows))
    return found.withColumn("availability", F.when(F.col("path").isNull(), "placeholder").otherwise("available"))


NOISE = T.StructType([T.StructField("foreground_ratio", T.DoubleType()), T.StructField("n_significant", T.IntegerType()), T.StructField("n_noise", T.IntegerType())])


def spots(grey: np.ndarray) -> tuple[float, int, int]:
    """Share of dark pixels, and the numbers of eight-connected spots that count and that do not (none are looked for on a darker page)."""
    dark = grey < WHITE
    ratio = float(dark.mean()) if dark.size else 1.0
    if not dark.any() or ratio > NOISE_PIXELS:
        return ratio, 0, 0
    rows, starts, ends, labels, count = runs(dark)
    own = labels - 1
    area = np.bincount(own, weights=ends - starts, minlength=count)
    least, most = np.full((2, count), np.iinfo(np.int64).max), np.full((2, count), -1)
    for n, (low, high) in enumerate(((starts, ends - 1), (rows, rows))):
        np.minimum.at(least[n], own, low)
        np.maximum.at(most[n], own, high)
    wide, tall = most - least + 1
    height, width = grey.shape
    counts = (area >= max(SPOT_PIXELS, round(dark.size * SPOT_SHARE))) | (wide >= max(SPOT_SIDE, int(width * SPOT_SIDE_SHARE))) | (tall >= max(SPOT_SIDE, int(height * SPOT_SIDE_SHARE)))
    return ratio, int(counts.sum()), int(count - counts.sum())


@F.pandas_udf(NOISE)
def page_spots(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """``spots`` of grey pages, one byte a pixel."""
    rows = [spots(np.frombuffer(p, np.uint8).reshape(int(h), int(w)).astype(np.float32)) for p, w, h in zip(pixels, width, height)]
    return pd.DataFrame(rows, columns=NOISE.names)


def scan_noise(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, page_number, foreground_ratio, n_significant, n_noise, scan_noise_only): near-white scans with nothing but specks.

    ``pages``: document_id, page_number, pixels, width, height (of the picture), page_width, page_height, has_table;
    ``blocks``: document_id, page_number, text, bbox.  Text boxes may be absent or tiny; a text without a box counts as text.
    """
    shown = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    area = F.when(F.size("bbox") == 4, F.greatest(F.lit(0.0), F.get("bbox", 2) - F.get("bbox", 0)) * F.greatest(F.lit(0.0), F.get("bbox", 3) - F.get("bbox", 1)))
    sums = shown.groupBy("document_id", "page_number").agg(F.sum(char_count(F.col("text"))).alias("chars"), F.sum(area).alias("boxes"), F.count_if(area.isNull()).alias("bare"))
    met = pages.withColumn("s", page_spots("pixels", "width", "height")).join(sums, ["document_id", "page_number"], "left")
    tiny = (F.coalesce("chars", F.lit(0)) <= NOISE_CHARS) & (F.coalesce("bare", F.lit(0)) == 0) & (F.coalesce("boxes", F.lit(0.0)) / F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height")) <= NOISE_BOXES)
    only = ~F.coalesce("has_table", F.lit(False)) & (F.col("s.foreground_ratio") <= NOISE_PIXELS) & (F.col("s.n_significant") == 0) & tiny
    return met.select("document_id", "page_number", "s.*", only.alias("scan_noise_only"))
