"""Context-triggered piecewise hashing of documents.

A rolling hash over the last seven bytes cuts the text wherever it meets a multiple of
the block size, so an edit moves the cuts near it only.  Each piece gives one letter of
a signature; a second signature uses twice the block size.  Two fingerprints are
compared at the block size they share, by the edit distance of their signatures
(insertion and deletion cost 1, replacement 2), computed bit-parallel.

The block size is the least with at most 64 letters, so a fingerprint is short however
long the text, and comparing two takes constant time.

Defined results for odd input: null text counts as empty, whose fingerprint is
``3::``; equal fingerprints have likeness 1; documents are ordered by id (null first),
equal ids by a hash of the text, repeated rows in any order; a single document is its own
next one; very long texts are read whole; only doc_id and text are read, so other columns
may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialise, slices, sorted_by_id, table

ROLLING = 7
LETTERS = 64
SMALLEST = 3
#: Letters that two signatures must share in one run before likeness counts.
RUN = 7
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes of text in one range of ids.
RANGE_BYTES = 16 << 20


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last ROLLING bytes at every position: their sum, their weighted sum and a shifted exclusive-or."""
    n = len(data)
    wide = np.zeros(n + ROLLING, np.uint32)
    wide[ROLLING:] = data
    total = np.zeros(n, np.uint32)
    weighted = np.zeros(n, np.uint32)
    mixed = np.zeros(n, np.uint32)
    for back in range(ROLLING):
        own = wide[ROLLING - back : ROLLING - back + n]
        total += own
        weighted += own * np.uint32(ROLLING - back)
        mixed ^= own << np.uint32(5 * back)
    return total + weighted + mixed


def _signature(raw: bytes, cuts: np.ndarray) -> str:
    """One letter for each piece of the text; ``cuts`` are the pieces' ends, the text's end left out."""
    out, start = [], 0
    for end in [*cuts.tolist(), len(raw)]:
        if end > start:
            out.append(_ALPHABET[zlib.crc32(raw[start:end]) & 63])
            start = end
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    """``block:signature:signature at twice the block``; the block is the least, of SMALLEST times powers of two, with at most LETTERS letters.

    Cuts of a block size are among those of half of it: one pass finds how far each place stays a cut.  In a run of
    one character the hash stands still, and only its first place may be a cut.
    """
    if not raw:
        return f"{SMALLEST}::"
    rolled = _rolling(np.frombuffer(raw, np.uint8)).astype(np.uint64) + np.uint64(1)
    at = np.flatnonzero((rolled % np.uint64(SMALLEST) == 0) & np.append(True, rolled[1:] != rolled[:-1]))
    at = at[at + 1 < len(raw)]
    rest = rolled[at] // np.uint64(SMALLEST)
    level = np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))  # factors of two
    power = 0
    while np.count_nonzero(level >= power) >= LETTERS:
        power += 1
    first, second = (_signature(raw, at[level >= p] + 1) for p in (power, power + 1))
    return f"{SMALLEST << power}:{first}:{second}"


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation per letter of ``b``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        met = row & where.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def _same(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    run = min(RUN, max(1, min(len(a), len(b)) // 4))
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    distance = len(a) + len(b) - 2 * common_letters(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; fingerprints whose block sizes differ by more than a factor of two have no common ground."""
    if a == b:
        return 1.0
    (x, a1, a2), (y, b1, b2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    if x == y:
        return max(_same(a1, b1), _same(a2, b2))
    if x == 2 * y:
        return _same(a1, b2)
    if y == 2 * x:
        return _same(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many of the first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())]
)


#: Results, and the first and last text of each task (``edge`` is 0 or 1), whose neighbours are elsewhere.
_STREAMED = T.StructType([*SCHEMA, T.StructField("part", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("text", T.StringType())])


def fingerprint_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness to each other and to the next document.

    Rows are sorted by id across tasks (a range exchange; texts move once) and each streams past the next one.  A
    task's last row meets the first one of the task after it in a small join of two rows a task; the order of tasks is
    a running value over one row a task.
    """
    schema = arrow_schema(_STREAMED)
    done = len(SCHEMA)

    def edge(kind: int, part: int, doc_id, text: str) -> pa.RecordBatch:
        row = {f.name: [None] for f in schema} | {"doc_id": [doc_id], "part": [part], "edge": [kind], "text": [text]}
        return pa.RecordBatch.from_pydict(row, schema)

    def run(batches):
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = fingerprint(text.encode("utf-8", "surrogatepass"))
                if held is None:
                    yield edge(0, part, doc_id, text)
                else:
                    rows.append(_row(held, (text, mine)))
                held = doc_id, text, mine
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*rows), schema)), *(pa.nulls(len(rows), f.type) for f in list(schema)[done:])], schema=schema)
        if held is not None:
            yield edge(1, part, held[0], held[1])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = materialise(sorted_by_id(texts, range_bytes).mapInArrow(run, _STREAMED), "fingerprints")
    columns = [f.name for f in SCHEMA]
    first = found.where("edge = 0").select("part", F.col("text").alias("following"))
    tasks = Window.orderBy("part")
    whole = tasks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = first.select("part", F.coalesce(F.lead("part").over(tasks), F.min("part").over(whole)).alias("after"))  # the last is followed by the very first
    last = found.where("edge = 1").select("part", "doc_id", "text").join(order, "part").join(first.withColumnRenamed("part", "after"), "after")
    arrow = arrow_schema(SCHEMA)

    def close(batches):
        for batch in slices(batches, 16):
            rows = []
            for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following"))):
                mine, other = (fingerprint(t.encode("utf-8", "surrogatepass")) for t in (text, following))
                rows.append(_row((doc_id, text, mine), (following, other)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return found.where("edge is null").select(*columns).unionAll(last.select("doc_id", "text", "following").mapInArrow(close, SCHEMA))


def _row(own: tuple, following: tuple) -> tuple:
    doc_id, text, mine = own
    changed = edited(text, following[0]).encode("utf-8", "surrogatepass")
    other = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), mine, other, likeness(mine, other), likeness(mine, following[1])


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
