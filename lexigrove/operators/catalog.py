"""The catalog of source documents: registration, removal, listing by folder, bootstrap from a manifest, conversion cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folders import documents_below

COLUMNS = ["document_id", "path", "name", "extension", "size_bytes", "modified_ns", "sha256", "status", "relative_path", "error"]
#: What a reusable conversion must be.
SCHEMA_VERSION, READY = "conversion.v2", ("ready", "success_with_warnings")


def nocase(*names: str) -> list[Column]:
    """Ordering without regard to ASCII case."""
    return [F.lower(F.col(n)) for n in names]


def register(catalog: DataFrame, ready: DataFrame) -> DataFrame:
    """Catalog with documents that are converted already; rows of the same id are replaced, nothing is extracted again.

    ``ready``: document_id, path, size_bytes, modified_ns, sha256, relative_path.
    """
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    rows = ready.select("document_id", "path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("extension"), "size_bytes", "modified_ns", "sha256", F.lit("ready").alias("status"), "relative_path", F.lit("").alias("error"))
    return catalog.select(*COLUMNS).join(rows.select("document_id"), "document_id", "left_anti").select(*COLUMNS).unionByName(rows)


def remove(catalog: DataFrame, index: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalog and index without the given documents."""
    gone = ids.select("document_id").distinct()
    return catalog.join(gone, "document_id", "left_anti"), index.join(gone, "document_id", "left_anti")


def listed(catalog: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Documents by name; below the given folders if these resolve to any, else all (a list is a view, not a scope)."""
    if roots is not None and not roots.isEmpty():
        catalog = documents_below(catalog, roots)
    return catalog.orderBy(*nocase("name"), "document_id")


def ready_ids(catalog: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids of ready documents below the given folders; no folder gives none (this is a scope)."""
    return documents_below(catalog.where("status = 'ready'"), roots).where("document_id <> ''").orderBy(*nocase("name"), "document_id").select("document_id")


def managed_name(name: Column, sha256: Column, taken: Column) -> Column:
    """File name of a managed copy: its own, or with the digest's beginning before the suffix if that is taken by other content."""
    stem, suffix = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return F.when(taken, F.concat(stem, F.lit("-"), F.substring(sha256, 1, 8), suffix)).otherwise(name)


def active_ids(manifest: DataFrame) -> DataFrame:
    """Sorted distinct document ids of a manifest's sources."""
    return manifest.where(F.coalesce("document_id", F.lit("")) != "").select("document_id").distinct().orderBy("document_id")


def bootstrap(catalog: DataFrame, manifest: DataFrame, files: DataFrame, owners: DataFrame, default_owner: str = "production") -> tuple[DataFrame, DataFrame]:
    """(documents to register, documents whose file is gone): sources of the manifest that the catalog lacks.

    ``manifest``: document_id, source_path, source_sha256; ``files``: path, size_bytes, modified_ns of what exists;
    ``owners``: document_id, owner (the first by name counts).  The owner names the folder.
    """
    owner = owners.groupBy("document_id").agg(F.min("owner").alias("owner"))
    wanted = manifest.where(F.coalesce("document_id", F.lit("")) != "").dropDuplicates(["document_id"]).join(catalog.select("document_id"), "document_id", "left_anti")
    met = wanted.join(files.select(F.col("path").alias("source_path"), "size_bytes", "modified_ns"), "source_path", "left").join(owner, "document_id", "left")
    found = met.where(F.col("size_bytes").isNotNull()).select("document_id", F.col("source_path").alias("path"), "size_bytes", "modified_ns", F.col("source_sha256").alias("sha256"), F.coalesce("owner", F.lit(default_owner)).alias("relative_path"))
    return found, met.where(F.col("size_bytes").isNull()).select("document_id").orderBy("document_id")


def cached_conversions(sources: DataFrame, cache: DataFrame, stage_version: str, backend: str = "docling", blank_review: bool = False) -> DataFrame:
    """Sources with a conversion that may be used again: same content, path, id, schema, stage and backend, and ready.

    ``sources``: path, sha256; ``cache``: cache_no (order of the cache folders), source_path, source_sha256,
    document_id, schema_version, stage_version, status, backend, n_failed_pages.  The first fitting one counts.
    """
    own_id = F.substring(F.sha2(F.concat_ws(":", "path", "sha256"), 256), 1, 20)
    fits = cache.where((F.col("schema_version") == SCHEMA_VERSION) & (F.col("stage_version") == stage_version) & F.startswith("backend", F.lit(backend)) & F.col("status").isin(*READY))
    if blank_review:
        fits = fits.where("n_failed_pages = 0")
    asked = sources.select("path", "sha256", own_id.alias("document_id"))
    met = asked.join(fits.select(F.col("source_path").alias("path"), F.col("source_sha256").alias("sha256"), "document_id", "cache_no"), ["path", "sha256", "document_id"])
    return met.groupBy("path", "sha256", "document_id").agg(F.min("cache_no").alias("cache_no"))
