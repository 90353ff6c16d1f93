"""Publication of vector sets: checked, written, read back, verified, and only then described; snapshots and their restoration.

A vector set is a Parquet table; its descriptor, a table of one row beside it, is written
last.  A set without a descriptor does not count as published and is written anew.
Everything runs through Spark, so any file system that the session reaches will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import table_digest
from .vectors import findings, norm

#: Columns of a published vector row, and how near a stored vector must be to what was sent.
IDENTITY = ("chunk_id", "content_hash", "document_id")
NEAR = 1e-6
SCHEMA = "schema_version string, name string, dimension int, count long, model_name string, source_fingerprint string, digest string, normalized boolean, status string"
VERSION = "vectors.v1"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or nothing if there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def digest(vectors: DataFrame) -> str:
    """Digest of identities and vectors, whatever their order or layout."""
    text = vectors.withColumn("_v", F.array_join(F.transform("embedding", lambda x: F.hex(F.encode(x.cast("string"), "utf-8"))), ","))
    return table_digest(text, *IDENTITY, "_v").first()["digest"]


def records(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a published set, by id."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}/vectors").orderBy("chunk_id")


def descriptor(spark: SparkSession, root: str, name: str) -> dict | None:
    found = _read(spark, f"{root.rstrip('/')}/{name}/descriptor")
    row = None if found is None else found.first()
    return None if row is None else row.asDict()


def differences(sent: DataFrame, stored: DataFrame) -> DataFrame:
    """(rule, chunk_id) where stored rows are not what was sent: missing, added, another identity, another vector."""
    a = sent.select("chunk_id", F.struct("content_hash", "document_id").alias("i"), F.col("embedding").alias("v"))
    b = stored.select("chunk_id", F.struct("content_hash", "document_id").alias("j"), F.col("embedding").alias("w"))
    met = a.join(b, "chunk_id", "fullouter")
    far = (F.size("v") != F.size("w")) | F.exists(F.zip_with("v", "w", lambda x, y: F.abs(x - y)), lambda d: F.isnull(d) | F.isnan(d) | (d > NEAR))
    rule = F.when(F.col("w").isNull(), "missing").when(F.col("v").isNull(), "added").when(~F.col("i").eqNullSafe(F.col("j")), "identity").when(far, "vector")
    return met.select(rule.alias("rule"), "chunk_id").where("rule is not null")


def _refuse(found: DataFrame, what: str) -> None:
    row = found.first()
    if row is not None:
        raise ValueError(f"{what}: {row['rule']}")


def publish_vectors(vectors: DataFrame, root: str, name: str, model_name: str, source_fingerprint: str) -> dict:
    """The descriptor of the published set.  Publishing the same set again changes nothing and returns what is there.

    ``vectors``: chunk_id, content_hash, document_id, embedding (array of numbers), all present and unique.  They are
    stored at unit length.  Under a name that is taken by another corpus or model nothing is written.
    """
    spark, base = vectors.sparkSession, f"{root.rstrip('/')}/{name}"
    if vectors.isEmpty():
        raise ValueError("no vectors to publish")
    dimension = vectors.select(F.size("embedding")).first()[0]
    _refuse(findings(vectors, dimension=dimension), "vectors refused")
    unnamed = vectors.where((F.coalesce("document_id", F.lit("")) == "") | (F.coalesce("content_hash", F.lit("")) == ""))
    _refuse(unnamed.select(F.lit("identity").alias("rule")), "vectors refused")
    unit = vectors.select(*IDENTITY, F.transform("embedding", lambda x: (x.cast("double") / norm()).cast("float")).alias("embedding"))
    old = descriptor(spark, root, name)
    if old is not None:
        if (old["source_fingerprint"], old["model_name"]) != (source_fingerprint, model_name):
            raise ValueError("this name is published for another corpus or model")
        stored = records(spark, root, name)
        _refuse(differences(unit, stored), "published set differs")
        if digest(stored) != old["digest"]:
            raise ValueError("published set differs: digest")
        return old
    unit.write.mode("overwrite").parquet(f"{base}/vectors")  # what an interrupted attempt left is replaced
    stored = records(spark, root, name)
    _refuse(differences(unit, stored), "stored set differs")
    row = (VERSION, name, dimension, stored.count(), model_name, source_fingerprint, digest(stored), True, "ready")
    spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{base}/descriptor")
    return descriptor(spark, root, name)


def healthy(spark: SparkSession, root: str, name: str) -> bool:
    """Whether a set is published and still what its descriptor says."""
    about, stored = descriptor(spark, root, name), _read(spark, f"{root.rstrip('/')}/{name}/vectors")
    return about is not None and stored is not None and stored.count() == about["count"] and digest(stored) == about["digest"]


def export_snapshot(spark: SparkSession, root: str, name: str, target: str) -> str:
    """Copy of a healthy set under a path that is free; returns its digest."""
    if not healthy(spark, root, name):
        raise ValueError("only a healthy set can be exported")
    records(spark, root, name).write.mode("errorifexists").parquet(target)
    found = digest(spark.read.parquet(target))
    if found != descriptor(spark, root, name)["digest"]:
        raise ValueError("the copy differs")
    return found


def restore_snapshot(spark: SparkSession, snapshot: str, root: str, about: dict, expected_digest: str) -> str:
    """Brings a snapshot back under the name in its descriptor ``about``: ``ready``, or ``already_restored`` if it is there and healthy."""
    copy = spark.read.parquet(snapshot)
    if not expected_digest or digest(copy) != expected_digest or about["digest"] != expected_digest:
        raise ValueError("the snapshot is not the one expected")
    name = about["name"]
    if _read(spark, f"{root.rstrip('/')}/{name}/vectors") is not None:
        if not healthy(spark, root, name):
            raise ValueError("another set stands under this name")
        return "already_restored"
    publish_vectors(copy, root, name, about["model_name"], about["source_fingerprint"])
    if not healthy(spark, root, name):
        raise ValueError("the restored set is not healthy")
    return "ready"


def publish_embeddings(index: DataFrame, load, root: str, name: str, model_name: str) -> dict:
    """Encodes the retrieval rows of an index and publishes their vectors under the corpus' fingerprint."""
    from .vectors import encode, fingerprint

    rows = index.where("retrieval_role = 'retrieval' AND text_search <> ''")
    return publish_vectors(encode(rows, load).select(*IDENTITY, "embedding"), root, name, model_name, fingerprint(rows).first()["digest"])


def migrate_archive(index: DataFrame, pointer: str, root: str, name: str, model_name: str) -> dict:
    """Moves the active corpus from a vector archive to a published set: ``ready``, or ``already_migrated``.

    The pointer's payload names the archive (vector_archive, and archive_sha256 of its bytes).  Its vectors are read in ranges, joined to
    the retrieval rows of ``index`` by chunk_id, published and verified; only then does the pointer name the set (vector_set),
    under the lock and with everything else as it was.  What fails before leaves the pointer alone, and a set that was
    published by then is taken up by the next attempt.  Vectors without a retrieval row, rows without a vector, an archive
    that is not the one named, and a pointer that changes meanwhile are refused.
    """
    from ..sources.vector_archive import read_vectors
    from .activation import _active, _publish, exclusive
    from .vectors import fingerprint

    spark = index.sparkSession
    with exclusive(f"{pointer}.lock", spark=spark) as lease:
        before = _active(pointer)
        if before is None or not before.get("active"):
            raise ValueError("there is no active corpus")
        if before.get("vector_set"):
            if not healthy(spark, before["vector_set"]["root"], before["vector_set"]["name"]):
                raise ValueError("the active set is not healthy")
            return {"status": "already_migrated", **before["vector_set"]}
        archive, expected = before.get("vector_archive"), before.get("archive_sha256")
        if not archive or not expected:
            raise ValueError("the active corpus names no vector archive")
        found = spark.read.format("binaryFile").load(archive).select(F.sha2("content", 256).alias("sha256")).first()
        if found is None or found["sha256"] != expected:
            raise ValueError("the archive is not the one expected")
        rows = index.where("retrieval_role = 'retrieval' AND text_search <> ''").select(*IDENTITY, "text_search")
        vectors = read_vectors(spark, archive).select("chunk_id", F.col("vector").alias("embedding"))
        sides = rows.select("chunk_id", F.lit(True).alias("a")).join(vectors.select("chunk_id", F.lit(True).alias("b")), "chunk_id", "fullouter")
        _refuse(sides.where("a is null or b is null").select(F.when(F.col("a").isNull(), "vector without a row").otherwise("row without a vector").alias("rule")), "archive refused")
        about = publish_vectors(rows.select(*IDENTITY).join(vectors, "chunk_id"), root, name, model_name, fingerprint(rows).first()["digest"])
        if not healthy(spark, root, name):
            raise ValueError("the published set is not healthy")
        if _active(pointer) != before:
            raise ValueError("the pointer changed during the migration")
        moved = {"root": root, "name": name, "digest": about["digest"], "count": about["count"], "dimension": about["dimension"]}
        _publish(pointer, {**before, "vector_set": moved}, lease)
        return {"status": "ready", **moved}
