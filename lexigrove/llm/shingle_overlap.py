"""Links between texts whose word-shingle sets have a Jaccard similarity of at least t.

SimHash alone cannot give this: at t = 0.8 two fingerprints of 64 bits differ in about ten
bits, far beyond what a few Golay segments tell apart from chance.  ``golay_simhash``
therefore links what its code finds and this module completes the links exactly:

Prefixes.  Under one global order of shingles, two sets with a similarity of at least t
share a shingle among the first n - ceil(t n) + 1 of each.  The order puts shingles that
many texts hold last; how many hold them comes from a sketch of fixed size that counts
every text, so common lines fall outside the prefixes.  Any order gives the same pairs.

Pivots.  Sets meet on prefix shingles.  Each bucket's smallest set (by its name, a hash)
is compared with all others of the bucket, and so are the pairs that the Golay code
proposes.  What is alike joins into components.

Neighbours.  In buckets that still hold several components, each member is compared with
the one that follows it in an order of the bucket's own.  A member of a large group of
near copies has a bucket for each shingle of its prefix, so it meets several others of
its group, while the pairs stay no more than the members.

Rest.  In buckets that still hold several components, the members outside the bucket's
largest component are compared with the members of all other components.  So every pair
that is similar enough is either compared or already connected.

Pairs are decided on the whole sets.  Texts with the same set are one node.  A text with
fewer words than a shingle is one shingle; blank and null texts have the empty set.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import arrow_schema, lean, materialise, slices

#: Counters of the sketch, and counters in one of its rows.
COUNTERS = 1 << 19
PART = 1 << 15
#: Members that share a bucket in one task; shingles counted more often are dealt out by salt.
BUCKET = 1 << 15

#: Rounds in which neighbours are compared before all pairs that are left.
TURNS = 2

_BYTES = 6  # of a shingle's hash
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def hashed_shingles(text: str | None, size: int) -> np.ndarray:
    """64-bit hash of every run of ``size`` words, in text order (ASCII case ignored)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w) for w in words], np.uint64)
    found = np.zeros(len(own) - size + 1, np.uint64)
    for k in range(size):
        found = (found ^ (found >> np.uint64(29))) * _PRIME + own[k : k + len(found)]
    found = (found ^ (found >> np.uint64(32))) * _MIX
    return found ^ (found >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the text's shingles."""
    return np.unique(hashed_shingles(text, size) >> np.uint64(16))


def majority(hashes: np.ndarray) -> int:
    """SimHash: the bits that are set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        own = hashes[at : at + (1 << 14)]
        bits += np.unpackbits(own.view(np.uint8), bitorder="little").reshape(len(own), 64).sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * bits > len(hashes)).tolist())


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // _BYTES, 8), np.uint8)
    out[:, :_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, _BYTES)
    return out.view("<u8").ravel()


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``least``; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least.denominator * both >= least.numerator * (len(a) + len(b) - both)


NODES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sim", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())]
)
#: ``np`` holds the set's size above 32 bits of the shingle's place in the set's order.
PREFIX = T.StructType([T.StructField("h", T.LongType()), T.StructField("salt", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("np", T.LongType())])
MET = T.StructType([T.StructField("h", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("np", T.LongType()), T.StructField("pivot", T.LongType()), T.StructField("pivot_np", T.LongType())])
SETS = T.StructType([T.StructField("fp", T.LongType()), T.StructField("packed", T.BinaryType())])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, digest of the text, text)."""
    value = F.col(f"`{text}`").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(value).alias("digest"), value.alias("text"))


def shingle_nodes(docs: DataFrame, size: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """A written row (doc_id, digest, fp, n, sim) for every document, and the rows of each task's sketch.

    fp names the set, sim is its SimHash.  A task counts a set once.
    """
    arrow = arrow_schema(NODES)

    def run(batches):
        counts, seen = np.zeros(COUNTERS, np.uint32), set()
        for batch in batches:
            for part in slices([batch], 128):
                fps, ns, sims, fresh = [], [], [], []
                for value in part.column(2).to_pylist():
                    found = np.unique(hashed_shingles(value, size))
                    short = np.unique(found >> np.uint64(16))
                    fp = xxhash.xxh64_intdigest(_pack(short))
                    fps.append(fp)
                    ns.append(len(short))
                    sims.append(majority(found))
                    if fp not in seen:
                        seen.add(fp)
                        fresh.append(short)
                if fresh:
                    counts += np.bincount((np.concatenate(fresh) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
                blank = [pa.nulls(len(fps), f.type) for f in list(arrow)[5:]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(ns, pa.int64()), pa.array(np.array(sims, np.uint64).view(np.int64)), *blank], schema=arrow)
        if seen:
            for at in range(0, COUNTERS, PART):
                yield pa.RecordBatch.from_pydict({f.name: [None] for f in list(arrow)[:5]} | {"part": [at // PART], "counts": [counts[at : at + PART].tobytes()]}, arrow)

    found = materialise(keyed(docs, text).mapInArrow(lean(run), NODES), "nodes", small=True)
    return found.where("counts is null").drop("part", "counts"), found.where("counts is not null").select("part", "counts")


def sketch(rows: DataFrame) -> np.ndarray:
    """The tasks' counters summed up: COUNTERS numbers reach the driver, whatever the input."""
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    arrow = arrow_schema(kind)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(counts, np.uint32 if len(counts) == 4 * PART else np.uint64)
                sums[part] = sums[part] + own if part in sums else own.astype(np.uint64)
        for part, own in sums.items():
            yield pa.RecordBatch.from_pydict({"part": [part], "counts": [own.tobytes()]}, arrow)

    out = np.zeros(COUNTERS, np.uint64)
    for row in rows.repartition("part").mapInArrow(lean(run), kind).collect():
        out[row["part"] * PART : (row["part"] + 1) * PART] += np.frombuffer(row["counts"], np.uint64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def _prefixes(texts: DataFrame, size: int, least: Fraction, counts: np.ndarray) -> DataFrame:
    """(h, salt, fp, np): each set's first n - ceil(t n) + 1 shingles, rare ones first; a task gives a set once.

    salt is 0, or from 1 on for a shingle that is counted too often for one task.
    """
    arrow = arrow_schema(PREFIX)
    table = texts.sparkSession.sparkContext.broadcast(counts)
    usual = int(counts.mean())  # what chance gives any counter

    def run(batches):
        known = table.value
        seen = set()
        for batch in batches:
            for part in slices([batch], 128):
                hs, salts, fps, nps = [], [], [], []
                for value in part.column(0).to_pylist():
                    own = shingles(value, size)
                    n = len(own)
                    fp = xxhash.xxh64_intdigest(_pack(own))
                    if not n or fp in seen:
                        continue
                    seen.add(fp)
                    held = known[(own % np.uint64(COUNTERS)).astype(np.int64)]
                    take = n - -(-least.numerator * n // least.denominator) + 1
                    order = np.argsort(held, kind="stable")[:take]
                    hs.append(own[order])
                    ways = 1 + np.maximum(held[order].astype(np.int64) - usual, 0).astype(np.uint64) // np.uint64(BUCKET)
                    salts.append(np.where(ways > 1, 1 + np.uint64(fp) % ways, 0))
                    fps.append(np.full(take, fp, np.uint64))
                    nps.append((np.int64(n) << 32) + np.arange(take))
                if hs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(nps))], schema=arrow
                    )

    return texts.select("text").mapInArrow(lean(run), PREFIX)


def _meet(prefixes: DataFrame) -> DataFrame:
    """(h, fp, np, pivot, pivot_np) for the members of every bucket with several sets.

    Rows of a bucket stream past in order; only its first one, the pivot, is remembered.
    """
    arrow = arrow_schema(MET)

    def run(batches):
        key, pivot, before, waiting = None, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, salt, fp, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            change = np.append(True, (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]))
            if key == (h[0], salt[0]):
                change[0] = False
            fresh = change | np.append(before != fp[0], fp[1:] != fp[:-1])  # several tasks may bring one set
            where = np.flatnonzero(fresh)
            h, salt, fp, size, change = h[where], salt[where], fp[where], size[where], change[where]
            before = int(batch.column(2)[batch.num_rows - 1].as_py())
            if not len(h):
                continue
            starts = np.flatnonzero(change)
            owner = np.searchsorted(starts, np.arange(len(h)), "right") - 1  # -1: of the bucket that is open
            pivots = fp[starts[np.maximum(owner, 0)]] if len(starts) else np.zeros(len(h), np.int64)
            sizes = size[starts[np.maximum(owner, 0)]] if len(starts) else np.zeros(len(h), np.int64)
            if pivot is not None:
                pivots[owner < 0], sizes[owner < 0] = pivot
            ends = np.append(starts[1:], len(h))
            alone = (ends - starts == 1) & (salt[starts] == 0)
            keep = np.ones(len(h), bool)
            keep[starts[alone]] = False
            head = waiting and owner[0] < 0  # the open bucket's first row has company now
            columns = [h, fp, size, pivots, sizes]
            rows = [np.append(x, c[keep]) for x, c in zip([key[0], *pivot, *pivot], columns)] if head else [c[keep] for c in columns]
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], schema=arrow)
            if len(starts):
                last = starts[-1]
                key, pivot, waiting = (h[last], salt[last]), (fp[last], size[last]), bool(alone[-1])
            elif head:
                waiting = False

    return prefixes.repartition("h", "salt").sortWithinPartitions("h", "salt", "fp", "np").mapInArrow(lean(run), MET)


def _may_reach(least: Fraction, x: str, y: str):
    """Whether sets of these sizes can be alike if they share nothing before the places given.

    It holds for the first shingle that two sets share; pairs that fail it here pass it there.
    """
    num, den = least.numerator, least.denominator
    size = lambda c: F.shiftright(F.col(c), 32)
    left = lambda c: size(c) - F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    return (den * F.least(size(x), size(y)) >= num * F.greatest(size(x), size(y))) & ((num + den) * F.least(left(x), left(y)) >= num * (size(x) + size(y)))


def _ordered(x: str, y: str):
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _unsettled(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """Written rows (h, fp, np, root, most, slot) of buckets that hold several components.

    most is the bucket's largest component; slots of a bucket have about BUCKET members each.
    """
    rooted = rows.select("h", "fp", "np").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("h", "fp", "np", F.coalesce("root", "fp").alias("root"))
    sizes = rooted.groupBy("h", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("most"), F.count("*").alias("kinds"), F.sum("c").alias("all")).where("kinds > 1")
    slot = F.pmod(F.col("fp"), F.lit(1) + F.floor(F.col("all") / BUCKET))
    return materialise(rooted.join(mixed, "h").select("h", "fp", "np", "root", "most", slot.alias("slot")), name, small=True)


def _neighbours(unsettled: DataFrame, least: Fraction, turn: int) -> DataFrame:
    """Pairs of members of different components that stand side by side in an order of the bucket's own: no more than members."""
    beside = Window.partitionBy("h", "slot").orderBy(F.xxhash64("h", "fp", F.lit(turn)), "fp")
    rows = unsettled.select("*", *(F.lead(c).over(beside).alias(f"{c}2") for c in ("fp", "np", "root")))
    sizes = [F.shiftright(F.col(c), 32) for c in ("np", "np2")]  # they may share shingles before this one, so places say nothing here
    return rows.where((F.col("root") != F.col("root2")) & (least.denominator * F.least(*sizes) >= least.numerator * F.greatest(*sizes))).select(*_ordered("fp", "fp2")).distinct()


def _rest(unsettled: DataFrame, least: Fraction) -> DataFrame:
    """All pairs of one bucket whose components differ (inside the bucket's largest component none do)."""
    other = unsettled.where("root <> most").select("h", F.col("fp").alias("fp2"), F.col("np").alias("np2"), F.col("root").alias("root2"))
    met_again = unsettled.join(other, "h").where((F.col("root") != F.col("root2")) & _may_reach(least, "np", "np2"))
    return met_again.select(*_ordered("fp", "fp2")).distinct()


def _sets_of(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, text: str) -> DataFrame:
    """(fp, packed) for the sets of ``pairs``, read from one document each.

    The Bloom filter of those documents is asked in the scan, so no text is shuffled; what
    it lets through by mistake is not asked for later.
    """
    wanted = pairs.select(F.col("a").alias("fp")).unionAll(pairs.select("b")).distinct()
    first = nodes.groupBy("fp").agg(F.min(F.struct("doc_id", "digest")).alias("d")).join(wanted, "fp", "left_semi")
    keys = materialise(first.select(F.xxhash64("d.doc_id", "d.digest").alias("key")), "wanted", small=True)
    arrow = arrow_schema(SETS)

    def run(batches):
        seen = set()
        for batch in batches:
            for part in slices([batch], 128):
                fps, packs = [], []
                for value in part.column(0).to_pylist():
                    packed = _pack(shingles(value, size))
                    fp = xxhash.xxh64_intdigest(packed)
                    if fp not in seen:
                        seen.add(fp)
                        fps.append(fp)
                        packs.append(packed)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(packs, pa.binary())], schema=arrow)

    texts = keyed(docs, text).withColumn("key", F.xxhash64("doc_id", "digest"))
    return materialise(bloom.possible(texts, "key", keys, "key").select("text").mapInArrow(lean(run), SETS), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction, name: str) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    left = sets.select(F.col("fp").alias("a"), F.col("packed").alias("pa"))
    right = sets.select(F.col("fp").alias("b"), F.col("packed").alias("pb"))
    arrow = arrow_schema(PAIRS)

    def run(batches):
        for batch in batches:
            for part in slices([batch], 128):
                keep = [similar(_unpack(x), _unpack(y), least) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], schema=arrow)

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb")
    return materialise(joined.mapInArrow(lean(run), PAIRS).distinct(), name, small=True)


def links(docs: DataFrame, nodes: DataFrame, counts: np.ndarray, proposed: DataFrame, size: int, least: Fraction, components, text: str = "text") -> DataFrame:
    """Links (a, b) whose closure joins every two sets with a similarity of at least ``least``.

    ``proposed`` are pairs (a, b) that another method found; they are verified first, with the pivots'.
    """
    met = materialise(_meet(_prefixes(keyed(docs, text), size, least, counts)), "met", small=True)
    by_pivot = met.where((F.col("fp") != F.col("pivot")) & _may_reach(least, "np", "pivot_np")).select(*_ordered("fp", "pivot"))
    tried = materialise(by_pivot.unionAll(proposed.select("a", "b")).distinct(), "pairs", small=True)
    found = _verified(tried, _sets_of(docs, nodes, tried, size, text), least, "links")
    open_rows = met
    for turn in range(TURNS + 1):
        name = f"turn{turn}"
        open_rows = _unsettled(open_rows, materialise(components(found), "roots", small=True), f"open-{name}")
        chosen = _neighbours(open_rows, least, turn) if turn < TURNS else _rest(open_rows, least)
        pairs = materialise(chosen.join(tried, ["a", "b"], "left_anti"), name, small=True)
        if pairs.isEmpty():
            continue
        found = found.unionAll(_verified(pairs, _sets_of(docs, nodes, pairs, size, text), least, f"{name}-links"))
        tried = tried.unionAll(pairs)
    return found
