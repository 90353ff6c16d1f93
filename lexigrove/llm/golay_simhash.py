"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The 64 bits of a fingerprint are read as three 23-bit segments (the third is padded with
zeros).  The perfect binary Golay code [23, 12, 7] assigns every 23-bit word to the one
codeword within three bits.  A word's keys are the codeword indices of all words within
one bit of it: one key, or six if the word is three bits from its codeword.  Two words
that differ in at most one bit always share a key.

Pigeonhole: of three errors over three segments, leaving out the segment with most of
them leaves two segments with at most one error each, so two fingerprints that link
share a pair of keys for some pair of segments.  Fingerprints meet on such 24-bit pairs
of indices, are verified exactly, and give a spanning forest of each bucket instead of
all its pairs.  Links join into components by alternating star contraction.

Exact copies collapse to one fingerprint before anything is joined, so a bucket holds
distinct fingerprints only (8 bytes each).  A task compares chunks of fixed size; the
chunks of a large bucket are dealt out in pairs.

Defined results for odd input: null or blank text has fingerprint zero and links like
any other; null ids never become a component's id unless all are null; repeated rows
share their component; an empty table gives an empty result; other columns may have any
names; texts are read whole, however long they are.
"""

from __future__ import annotations

import functools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom, shingle_overlap
from .common import arrow_schema, drop_table, few_files, field_name, lean, map_rows, materialise, slices, table, table_path, write_table

SHINGLE = 3
SEED = 42
MAX_ERRORS = 3
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Fingerprints of a bucket that one task compares with one another; larger buckets are cut.
CHUNK = 4096


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])] or [xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        own = hashes[at : at + (1 << 14)]
        set_bits += np.unpackbits(own.view(np.uint8), bitorder="little").reshape(len(own), 64).sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(hashes)).tolist())


@functools.cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each 12-bit half-word pattern's shift, and the error pattern (weight 3 at most) of each remainder."""
    one_bit = []
    for i in range(23):
        value = 1 << i
        for b in range(22, 10, -1):
            if value >> b & 1:
                value ^= GENERATOR << (b - 11)
        one_bit.append(value)
    low = np.zeros(1 << 12, np.uint16)
    high = np.zeros(1 << 11, np.uint16)
    for table_, base in ((low, 0), (high, 12)):
        for i in range(len(table_).bit_length() - 1):
            table_[np.arange(len(table_)) >> i & 1 == 1] ^= one_bit[base + i]
    errors = np.zeros(1 << 11, np.uint32)
    for i in range(23):
        errors[one_bit[i]] = 1 << i
        for j in range(i):
            errors[one_bit[i] ^ one_bit[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[one_bit[i] ^ one_bit[j] ^ one_bit[k]] = 1 << i | 1 << j | 1 << k
    return np.concatenate([low, high]), errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within three bits of each 23-bit word."""
    tables, errors = _syndromes()
    syndrome = tables[words & 0xFFF] ^ tables[(1 << 12) + (words >> 12)]
    return ((words ^ errors[syndrome]) >> 11).astype(np.uint32)


def segment_keys(words: np.ndarray) -> np.ndarray:
    """Indices of all words within one bit: an array of (words, 24), repeats included."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.uint32)
    return codeword_index(words[:, None] ^ flips[None, :])


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of every distinct pair of segment keys: pair number above two 12-bit indices."""
    words = [((prints >> np.uint64(23 * s)) & np.uint64((1 << 23) - 1)).astype(np.uint32) for s in range(3)]
    own = []
    for w in words:
        keys = np.sort(segment_keys(w), axis=1)
        fresh = np.concatenate((np.ones((len(w), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :6]  # a word has one key or six
        own.append((np.take_along_axis(keys, order, 1), np.take_along_axis(fresh, order, 1)))
    rows, out = [], []
    for n, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, fa), (kb, fb) = own[a], own[b]
        pairs = (np.int64(n) << 24) | (ka[:, :, None].astype(np.int64) << 12) | kb[:, None, :]
        keep = fa[:, :, None] & fb[:, None, :]
        rows.append(np.nonzero(keep)[0])
        out.append(pairs[keep])
    return np.concatenate(rows), np.concatenate(out)


def forest(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links (positions) among ``left``, or between ``left`` and ``right``, at MAX_ERRORS bits or fewer."""
    both = left if right is None else np.concatenate([left, right])
    boss = list(range(len(both)))

    def find(i: int) -> int:
        while boss[i] != i:
            boss[i] = boss[boss[i]]
            i = boss[i]
        return i

    out = []
    other, shift = (left, 0) if right is None else (right, len(left))
    step = max(1, (1 << 21) // max(1, len(other)))
    for at in range(0, len(left), step):
        near = np.bitwise_count(left[at : at + step, None] ^ other[None, :]) <= MAX_ERRORS
        for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
            i, j = i + at, j + shift
            if i == j:
                continue
            a, b = find(i), find(j)
            if a != b:
                boss[a] = b
                out.append((i, j))
    return out


LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
#: Links, and the chunks of buckets that hold more than one.
_FOUND = T.StructType([*LINKS, T.StructField("key", T.LongType()), T.StructField("no", T.IntegerType()), T.StructField("fps", T.BinaryType())])


def _pairs_of(left: np.ndarray, right: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` as two arrays of fingerprints (signed)."""
    both = left if right is None else np.concatenate([left, right])
    found = np.array(forest(left.view(np.uint64), None if right is None else right.view(np.uint64)), np.int64).reshape(-1, 2)
    return both[found[:, 0]], both[found[:, 1]]


def link_fingerprints(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) whose closure joins every two fingerprints (column ``fp``, distinct, signed) at three bits or fewer.

    A task holds one chunk of a bucket at a time.  The chunks of larger buckets are written
    and meet in pairs, which are dealt out over all tasks.
    """
    keyed = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())])
    spark = prints.sparkSession

    def keys(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 1 << 12):
                own = fps[at : at + (1 << 12)]
                rows, found = fuzzy_keys(own.view(np.uint64))
                yield pa.RecordBatch.from_pydict({"key": found, "fp": own[rows]}, arrow_schema(keyed))

    # a fingerprint gives some 80 keys: few input tasks would make all of them
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    meets = prints.select("fp").repartition(tasks).mapInArrow(lean(keys), keyed)
    schema = arrow_schema(_FOUND)

    def linked(a: list, b: list) -> pa.RecordBatch:
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.nulls(len(a), f.type) for f in list(schema)[2:])], schema=schema)

    def verify(batches):
        key, no, held, size = None, 0, [], 0

        def close(last: bool):
            """Links inside the chunk held; the chunk itself if its bucket has others."""
            nonlocal held, size, no
            own = np.concatenate(held) if held else np.zeros(0, np.int64)
            held, size = [], 0
            if len(own) > 1:
                a, b = _pairs_of(own)
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
            chunk_row = None
            if len(own) and (no or not last):
                chunk_row = pa.RecordBatch.from_pydict({"a": [None], "b": [None], "key": [int(key)], "no": [no], "fps": [own.tobytes()]}, schema)
            no += 1
            return chunk_row

        for batch in batches:
            ks = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(ks):
                continue
            bounds = [0, *(np.flatnonzero(np.diff(ks)) + 1).tolist(), len(ks)]
            out_a, out_b = [], []
            for s, e in zip(bounds, bounds[1:]):
                if ks[s] != key:
                    if size + no > 1 and (row := close(True)) is not None:
                        yield row
                    key, no, held, size = ks[s], 0, [], 0
                while s < e:
                    take = min(e - s, chunk - size)
                    held.append(fps[s : s + take])
                    s, size = s + take, size + take
                    if size == chunk and (row := close(False)) is not None:
                        yield row
            if out_a:
                yield linked(out_a, out_b)
        out_a, out_b = [], []
        if size and (row := close(True)) is not None:
            yield row
        if out_a:
            yield linked(out_a, out_b)

    found = materialise(meets.repartition("key").sortWithinPartitions("key").mapInArrow(lean(verify), _FOUND), "buckets", small=True)
    left = found.where("fps is not null").select("key", "no", "fps")
    right = left.select("key", F.col("no").alias("no2"), F.col("fps").alias("fps2"))

    def across(batches):
        arrow = arrow_schema(LINKS)
        for batch in slices(batches, 1):
            a, b = _pairs_of(*(np.frombuffer(batch.column(c)[0].as_py(), np.int64) for c in ("fps", "fps2")))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=arrow)

    crossed = left.join(right, "key").where("no < no2").repartition(tasks).select("fps", "fps2").mapInArrow(lean(across), LINKS)
    return found.where("fps is null").select("a", "b").unionAll(crossed).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node reachable.

    Alternating star contraction: each round hangs neighbours on the smallest one seen
    from either side; every round is a written table, dropped once the next one stands.
    Rounds grow with the logarithm of the longest chain.  Only one number a round reaches the driver.
    """
    spark, path = links.sparkSession, table_path(links.sparkSession, "star")
    edges = write_table(few_files(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), path)
    before = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # every larger neighbour, and the node itself, hang on the smallest one seen from u
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        itself = low.where("m < u").select("u", F.col("m").alias("v"))
        star = large.unionAll(itself).where("u <> v").distinct()
        # small star: neighbours that are not larger, and the node, hang on the smallest
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new_path = table_path(spark, "star")
        new = write_table(few_files(small), new_path)
        drop_table(spark, path)
        now = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, edges, path = now, new, new_path


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest of the text, fp) with the fingerprint as a signed long.  No shuffle."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batch):
        prints = np.array([simhash(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        return {"doc_id": batch.column(0), "digest": batch.column(1), "fp": prints}

    value = F.col(f"`{text}`").cast("string")
    return map_rows(docs.select(F.col("doc_id").cast("long"), F.xxhash64(value).alias("digest"), value.alias("text")), run, schema)


def _rooted(marked: DataFrame, links: DataFrame) -> DataFrame:
    """``marked`` with root (the smallest fp of the component) and component_id (its smallest doc_id) for every row."""
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links)
    rooted = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(ids, "root").select("fp", "component_id", "root")
    return marked.join(of_print, "fp").select(*marked.columns, "component_id", "root")


def _by_bits(docs: DataFrame, text: str) -> DataFrame:
    marked = materialise(fingerprints(docs, text), "simhash", small=True)
    return _rooted(marked, link_fingerprints(marked.select("fp").distinct()))


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest doc_id of its component."""
    return _by_bits(docs, text).select("doc_id", "fp", "component_id")


def overlapping(docs: DataFrame, similarity: Fraction, shingle: int, text: str = "text") -> DataFrame:
    """(doc_id, digest, fp, n, sim, component_id, root) for every row; links are texts whose word shingles have this Jaccard similarity or more.

    The Golay code links the SimHashes of the shingle sets; those links are verified on the
    sets, and what lies farther apart than three bits is completed exactly (``shingle_overlap``).
    """
    nodes, sketches = shingle_overlap.shingle_nodes(docs, shingle, text)
    named = nodes.groupBy(F.col("sim")).agg(F.min("fp").alias("fp"))
    near = link_fingerprints(named.select(F.col("sim").alias("fp"))).join(named.select(F.col("sim").alias("a"), F.col("fp").alias("x")), "a").join(named.select(F.col("sim").alias("b"), F.col("fp").alias("y")), "b")
    equal = nodes.select("sim", "fp").distinct().join(named.withColumnRenamed("fp", "x"), "sim").where("x <> fp").select("x", F.col("fp").alias("y"))
    proposed = near.select("x", "y").unionAll(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = shingle_overlap.links(docs, nodes, shingle_overlap.sketch(sketches), proposed, shingle, similarity, components, text)
    return _rooted(nodes, links)


def keep_one(docs: DataFrame, text: str = "text", similarity: Fraction | None = None, shingle: int = SHINGLE) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id (of several texts with it, the one with the least digest).

    Without ``similarity`` texts link by bits, as in ``near_duplicates``; with it, by the overlap of their shingles.
    A row is known by doc_id and text together, so rows that share an id, or have none, stand for their own texts;
    of rows that repeat both, one stays.  Columns may have any names; rows keep all of them.  Very long texts are read
    whole; an empty table stays empty.

    A Bloom filter of the rows that may go lets all others through in the scan; only what it stops is shuffled.
    """
    found = materialise(_by_bits(docs, text) if similarity is None else overlapping(docs, similarity, shingle, text), "components", small=True).groupBy("root", "doc_id", "digest").agg(F.count("*").alias("copies"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("best")).select("root", "best.doc_id", "best.digest")
    best = materialise(best, "first-rows", small=True)
    stays = F.col("g.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("g.digest") == F.col("b.digest"))
    doubtful = found.alias("g").join(best.alias("b"), "root").where(~stays | (F.col("g.copies") > 1)).select(F.xxhash64("g.doc_id", "g.digest").alias("key"))
    own_id, own_digest, own_key, flag, place = (field_name(docs, stem) for stem in ("row_id", "row_digest", "row_key", "row_flag", "row_place"))
    plain = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_digest, F.xxhash64(F.col(f"`{text}`").cast("string")))
    rows = bloom.marked(rows.withColumn(own_key, F.xxhash64(own_id, own_digest)), own_key, materialise(doubtful, "doubtful", small=True), "key", flag)
    order = [F.xxhash64(F.col(f"`{f.name}`")) for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = rows.where(F.col(flag)).withColumn(place, F.row_number().over(Window.partitionBy(own_id, own_digest).orderBy(*order))).where(F.col(place) == 1)
    best_id, best_digest = field_name(first, "best_id"), field_name(first, "best_digest")
    best = best.select(F.col("doc_id").alias(best_id), F.col("digest").alias(best_digest))
    kept = first.join(best, F.col(own_id).eqNullSafe(F.col(best_id)) & (F.col(own_digest) == F.col(best_digest)), "left_semi")
    return rows.where(~F.col(flag)).select(*plain).unionAll(kept.select(*plain))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
