"""Vector code compression: product quantisation in whole numbers, entries found by exponion search.

A vector is cut into equal consecutive parts; each part position has a codebook, and a code is the
index of the nearest entry.  The search starts at the entry a vector had in the round before and scans
that entry's neighbours, sorted by distance, while they lie within twice the distance between vector
and start: by the triangle inequality no entry farther off can be as near as the start.  Distances are
exact 64-bit integers, compared as squares (neighbour's square at most four times the vector's), and
equal distances go to the lower index.

Vectors and codes are written once a round, as whole numbers, and read by the next; sums of a round
are added up in tasks first, so that one row an entry and task is shuffled.  What is broadcast is the
codebooks, parts x entries numbers at most.  The driver receives the first entries and one row an
entry a round.

Defined results for odd input
- null vectors and those with null, NaN or infinite components are dropped;
- so are those that cannot be cut like the others: another length than the first kept id's, or none that
  the parts divide; and components from 2**19 on, whose squared distances may leave 64 bits when summed up;
- a label's error beyond 64 bits is null;
- fewer vectors than entries: as many entries as there are vectors; an empty table has an empty result;
- null vec_id: after all numbers among the first entries; repeated ids and ties are ordered by their components;
- equal rows each have a row of their own; entries that nothing is assigned to stay as they are;
- other columns are kept by ``encode`` under their names, those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, drop_table, small_batches, table, table_path, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole components from this on are dropped: (2 * 2**27)**2, summed over 64 components or times four over a part's, has to fit 64 bits.
LARGEST = 1 << 27


def whole_numbers(rows: DataFrame, vector: str, scale: int, name: str) -> DataFrame:
    """``rows`` whose vector is finite throughout, with its components as floor(scale * x) in column ``name``."""
    v = F.col(f"`{vector}`")
    kept = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LARGEST)))
    return kept.withColumn(name, F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))


class Search:
    """The codebooks of all parts (parts x entries x width), each entry with its neighbours by distance."""

    def __init__(self, books: np.ndarray):
        self.parts, self.entries, self.width = books.shape
        self.flat = books.reshape(-1, self.width).astype(np.int64)
        gaps = ((books[:, :, None, :].astype(np.int64) - books[:, None, :, :].astype(np.int64)) ** 2).sum(axis=3)
        order = np.argsort(gaps, axis=2, kind="stable")  # ties: lower index first
        self.gaps = np.take_along_axis(gaps, order, axis=2).reshape(-1, self.entries)
        self.near = (order + (np.arange(self.parts) * self.entries)[:, None, None]).reshape(-1, self.entries)

    def nearest(self, vectors: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared distances) of vectors (n x parts*width), started at codes ``start`` (n x parts)."""
        n = len(vectors)
        points = vectors.reshape(n * self.parts, self.width).astype(np.int64)
        rows = (start.astype(np.int64) + np.arange(self.parts) * self.entries).reshape(-1)
        best_d = ((points - self.flat[rows]) ** 2).sum(axis=1)
        best = rows.copy()
        reach = np.zeros(len(rows), np.int64)  # neighbours inside the radius, counted from the sorted gaps
        bound = 4 * best_d
        step = 1 << max(0, self.entries.bit_length() - 1)
        while step:  # binary search in each start's own list
            ahead = reach + step
            inside = (ahead <= self.entries) & (self.gaps[rows, np.minimum(ahead, self.entries) - 1] <= bound)
            reach = np.where(inside, ahead, reach)
            step >>= 1
        by_reach = np.argsort(-reach, kind="stable")
        counts = np.bincount(reach, minlength=self.entries + 1)
        beyond = len(rows) - np.cumsum(counts)  # how many scan more than k neighbours
        for k in range(self.entries):
            live = by_reach[: beyond[k]]
            if not len(live):
                break
            entry = self.near[rows[live], k]
            d = ((points[live] - self.flat[entry]) ** 2).sum(axis=1)
            better = (d < best_d[live]) | ((d == best_d[live]) & (entry < best[live]))
            at = live[better]
            best_d[at], best[at] = d[better], entry[better]
        return (best.reshape(n, self.parts) - np.arange(self.parts) * self.entries), best_d.reshape(n, self.parts)


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _codes(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def assign(rows: DataFrame, books: np.ndarray, whole: str, code: str, error: str) -> DataFrame:
    """``rows`` with each vector's code renewed (one byte a part) and its squared error; a null code starts at entry 0."""
    spark = rows.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(books)
    schema = T.StructType([f for f in rows.schema if f.name not in (code, error)] + [T.StructField(code, T.BinaryType()), T.StructField(error, T.LongType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                before = some.column(code)
                start = np.zeros((some.num_rows, search.parts), np.uint8) if before.null_count else _codes(before, search.parts)
                found, d = search.nearest(_vectors(some.column(whole)), start)
                made = {code: pa.array([c.tobytes() for c in found.astype(np.uint8)], pa.binary()), error: pa.array(d.sum(axis=1))}
                yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else some.column(f.name) for f in arrow], schema=arrow)

    return rows.mapInArrow(run, schema)


def book_sums(rows: DataFrame, parts: int, entries: int, width: int, whole: str, code: str) -> DataFrame:
    """(slot, n, sums): how many parts each entry has and their componentwise sums; slot is part * entries + entry."""
    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                slots = (_codes(batch.column(1), parts).astype(np.int64) + np.arange(parts) * entries).reshape(-1)
                n += np.bincount(slots, minlength=len(n))
                np.add.at(sums, slots, _vectors(batch.column(0)).astype(np.int64).reshape(-1, width))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], schema=arrow_schema(schema))

    partial = rows.select(whole, code).mapInArrow(run, schema)
    wide = [F.sum(F.col("sums")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    return partial.groupBy("slot").agg(F.sum("n").alias("n"), *wide)


def renewed(books: np.ndarray, sums: list) -> np.ndarray:
    """Entries replaced by floor(sum / count); those without a row stay."""
    books = books.copy()
    flat = books.reshape(-1, books.shape[2])
    for slot, n, *total in sums:
        flat[slot] = [int(s) // int(n) for s in total]
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray | None]:
    """(kept rows with ``code`` binary and ``error`` long, codebooks), trained on all kept rows from the first ids' vectors."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    spark = rows.sparkSession
    taken = {c.lower() for c in rows.columns} | {"code", "error"}
    whole = next(n for n in ("whole_vector" + "_" * k for k in range(len(taken) + 1)) if n not in taken)
    base = whole_numbers(rows.drop("code", "error"), vector, scale, whole)
    order = [F.col(f"`{vec_id}`").asc_nulls_last(), F.col(whole)]
    # one row tells the length, then at most ``entries`` rows are the first codebooks
    first = base.where(F.size(whole) % parts == 0).select(vec_id, whole).orderBy(*order).limit(1).collect()
    if not first:
        return base.drop(whole).limit(0).withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")}), None
    width = len(first[0][whole]) // parts
    base = base.where(F.size(whole) == parts * width).withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")})
    start = np.array([r[whole] for r in base.select(vec_id, whole).orderBy(*order).limit(entries).collect()], np.int64)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width).transpose(1, 0, 2))
    state, path = base, None
    for _ in range(rounds):
        state, old = assign(state, books, whole, "code", "error"), path
        state = write_table(state, path := table_path(spark, "codes"))
        books = renewed(books, book_sums(state, parts, len(start), width, whole, "code").collect())
        if old:
            drop_table(spark, old)
    return assign(state, books, whole, "code", "error").drop(whole), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = encode(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    found = write_table(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), table_path(spark, "coded"))
    # written, so that the planner knows its size: few labels are broadcast, many are joined by a shuffle that splits skew
    by_label = write_table(found.groupBy("label").agg(F.try_sum("error").alias("label_error")).coalesce(1), table_path(spark, "label_errors"))
    joined = found.join(by_label, found["label"].eqNullSafe(by_label["label"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(None if books is None else books_digest(books)).cast("string").alias("codebooks_sha256"))


def _sql() -> str:
    """Plain assignments: every part against every entry, ties to the lower index."""
    assign = "SELECT p.vec_id, p.part, p.x, arg_min(b.entry, [d(p.x, b.c), b.entry]) AS entry, min(d(p.x, b.c)) AS err FROM parts p JOIN {b} b USING (part) GROUP BY ALL"
    renew = """SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM {b} b LEFT JOIN (
      SELECT part, entry, [fl(sum(x[1]), count(*)), fl(sum(x[2]), count(*)), fl(sum(x[3]), count(*)), fl(sum(x[4]), count(*))] AS c FROM {a} GROUP BY ALL) m USING (part, entry)"""
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, CAST(k AS INTEGER) AS part, v[4 * k + 1 : 4 * k + 4] AS x FROM kept, range(16) t(k)
), b0 AS (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x AS c FROM parts QUALIFY entry < 64
), a1 AS ({_expand(assign.format(b="b0"))}), b1 AS ({_expand(renew.format(b="b0", a="a1"))}), a2 AS ({_expand(assign.format(b="b1"))}), b2 AS ({_expand(renew.format(b="b1", a="a2"))}), a3 AS ({_expand(assign.format(b="b2"))}
), coded AS (SELECT vec_id, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(err) AS BIGINT) AS error FROM a3 GROUP BY vec_id
), books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), books
"""


def _expand(sql: str) -> str:
    """The SQL's two shorthands: d(x, c), a squared distance of four components, and fl(s, n), a floored quotient."""
    sql = re.sub(r"\bd\((\S+?), (\S+?)\)", lambda m: "(" + " + ".join(f"({m[1]}[{k}] - {m[2]}[{k}]) * ({m[1]}[{k}] - {m[2]}[{k}])" for k in range(1, 5)) + ")", sql)
    return re.sub(r"\bfl\((sum\(x\[\d\]\)), count\(\*\)\)", r"CAST((\1 - ((\1 % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)", sql)


OP12_SQL = _sql()
