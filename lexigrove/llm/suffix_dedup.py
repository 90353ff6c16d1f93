"""Exact repeats of long byte strings, found with longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier in the
corpus (smaller doc_id, or earlier in the same document).  The longest previous factor
(LPF) of a position is the longest match that starts earlier.  In suffix order it is found
at the nearest neighbours with a smaller position, before and after; a position's string
is a later copy if its LPF reaches ``length``.

The corpus is too large for one suffix array, so positions are dealt out first by a rule
that sends equal strings to the same place: every ``length``-byte window has an anchor,
the ``GRAM``-byte string in it with the least hash.  Neighbouring windows share their
anchor, so a window run is shipped once, with the text it spans.

1. Blocks of documents list their anchors' hashes and how often they occur; those that
   occur twice anywhere come back to the blocks.  Hashes travel packed.
2. Anchors with over HOT occurrences (a common line among ever other neighbours) would
   fill their bucket.  Their windows are listed one by one by their own hash instead, and
   only windows that recur count; each goes to a bucket of its own hash.
3. Blocks ship the runs at recurring anchors, and recurring windows, to their buckets.
   Of equal ones in a block only the first is shipped, the others are later copies at
   once, so what many documents share arrives once a block and spelling.
4. Buckets put the suffixes of each anchor's runs in order, compute the LPF array from
   previous and next smaller positions, and send removed ranges home.
5. Blocks cut the ranges out.

Bytes decide everywhere; a hash collision only brings together runs that then differ.
The text is shuffled once and read from that shuffle by every step.

Defined results for odd input: null text is empty and stays null; texts shorter than
``length`` stay as they are; rows with equal doc_id are ordered by a hash of the text, null
ids first; a repeated row is a later copy of the first; very long texts are cut as a whole;
columns may have any names: reports replace columns of the same name, and without reports
(``report=False``) rows keep exactly their columns; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, field_name, lean, table, total_bytes

LENGTH = 100
GRAM = 40
BLOCK_BYTES = 8 << 20
SLAB = 1 << 18
#: Occurrences from which an anchor's windows are dealt out one by one.
HOT = 1024
_BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit polynomial hash of every ``gram`` bytes."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    up, down = _powers(max(SLAB * 2, 1 << (n - 1).bit_length()))
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(data * up[:n], out=sums[1:])
    out = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: running minima from both ends of blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def window_runs(texts: list[bytes], length: int, gram: int):
    """Window runs of some documents: (document, first window, last window, anchor, anchor hash), joined text, starts, hashes of all grams.

    Positions are in the joined text.
    """
    joined = b"".join(texts)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    none = np.zeros(0, np.int64)
    if len(joined) < length:
        return (none, none, none, none, none.astype(np.uint64)), joined, starts, none.astype(np.uint64)
    hashes = gram_hashes(np.frombuffer(joined, np.uint8), gram)
    bits = np.uint64(max(20, len(hashes).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_least(ranked, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    valid = np.zeros(len(least) + 1, np.int8)
    long_enough = np.flatnonzero(np.diff(starts) >= length)
    np.add.at(valid, starts[long_enough], 1)
    np.add.at(valid, starts[long_enough + 1] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    anchor = least[at]
    first = np.concatenate(([True], (np.diff(anchor) != 0) | (np.diff(at) != 1)))[: len(at)]
    low = at[first]
    high = at[np.concatenate((first[1:], [True]))[: len(at)]]
    anchor = anchor[first]
    # anchors are least hashes: dealt out as they are, they would crowd into the first buckets
    return (np.searchsorted(starts, low, "right") - 1, low, high, anchor, _spread(hashes[anchor])), joined, starts, hashes


def _spread(hashes: np.ndarray) -> np.ndarray:
    out = hashes * np.uint64(0xC2B2AE3D27D4EB4F)
    return (out ^ (out >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)


def window_hashes(hashes: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Hash of the windows at the given places, from the grams at their quarters."""
    out = np.zeros(len(at), np.uint64)
    for k in range(4):
        out = _spread(out ^ hashes[at + k * (length - gram) // 3])
    return out


def _slabs(texts: list[bytes]):
    """(number of the first document, documents) in pieces of about SLAB bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLAB:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def longest_previous_factors(suffixes: list[bytes]) -> list[int]:
    """LPF array of the given suffixes: for each, the longest prefix that one with a smaller position also has.

    The stack holds positions that ascend, so what lies below one is its previous smaller position in suffix order,
    with the prefix that both have; the position that takes it off is its next smaller one.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    out = [0] * len(order)
    stack: list[tuple[int, int]] = []
    before = b""
    for position in order:
        own = suffixes[position]
        shared = common_prefix(before, own)
        while stack and stack[-1][0] > position:
            larger, with_smaller = stack.pop()
            out[larger] = max(with_smaller, shared)
            shared = min(shared, with_smaller)
        stack.append((position, shared if stack else 0))
        before = own
    for position, with_smaller in stack:
        out[position] = with_smaller
    return out


def later_copies(contexts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Byte ranges of each context (one anchor's runs, in corpus order) whose windows occur in an earlier one.

    Equal contexts are told apart first: all but the first are later copies throughout.
    """
    place: dict[bytes, int] = {}
    same = [place.setdefault(c, i) for i, c in enumerate(contexts)]
    out: list[list[tuple[int, int]]] = [[] if same[i] == i else [(0, len(c))] for i, c in enumerate(contexts)]
    if len(place) > 1:
        owners = [(i, s) for i in place.values() for s in range(len(contexts[i]) - length + 1)]
        for (i, s), factor in zip(owners, longest_previous_factors([contexts[i][s:] for i, s in owners])):
            if factor >= length:
                if out[i] and out[i][-1][1] >= s:
                    out[i][-1] = (out[i][-1][0], max(out[i][-1][1], s + factor))
                else:
                    out[i].append((s, s + factor))
    return out


class _Plan:
    """Names and sizes that all passes share."""

    def __init__(self, docs: DataFrame, blocks: int, length: int, gram: int, hot: int):
        self.blocks, self.buckets = blocks, blocks
        self.length, self.gram, self.hot = length, gram, hot
        self.id, self.tie, self.had, self.raw, self.block = (field_name(docs, stem) for stem in ("own_id", "own_tie", "own_had", "own_raw", "own_block"))

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


    def packs(self, values: np.ndarray, counts: np.ndarray, home: int) -> pa.Table:
        """Rows (bucket, home, hashes, counts) of sorted distinct hashes."""
        order = np.argsort(self.bucket(values), kind="stable")
        values, counts = values[order], np.minimum(counts[order], 0xFFFF).astype(np.uint16)
        cuts = np.searchsorted(self.bucket(values), np.arange(self.buckets + 1)).tolist()
        rows = [(b, values[s:e].tobytes(), counts[s:e].tobytes()) for b, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
        columns = zip(*rows) if rows else ((), (), ())
        bucket, hashes, packed = columns
        return pa.table({"bucket": bucket, "home": [home] * len(rows), "hashes": hashes, "counts": packed}, arrow_schema(ANCHORS))

    def ordered(self, block: pa.Table) -> pa.Table:
        """The block's rows in corpus order."""
        ids = block.column(self.id)
        filled = ids.fill_null(0).to_numpy()
        return block.take(pa.array(np.lexsort((block.column(self.tie).to_numpy(), filled, ids.is_valid().to_numpy()))))


ANCHORS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("home", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("counts", T.BinaryType())])
#: Hashes that recur: of anchors, of anchors with too many occurrences, or (``windows``) of these ones' windows.
RECUR = T.StructType([T.StructField("_blk", T.IntegerType()), T.StructField("hashes", T.BinaryType()), T.StructField("hot", T.BinaryType()), T.StructField("windows", T.BinaryType())])
RUNS = T.StructType(
    [T.StructField("bucket", T.IntegerType()), T.StructField("home", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("hashes", "valid", "ids", "ties", "rows", "lows", "offsets", "sizes", "text", "done"))]
)
RANGES = T.StructType([T.StructField("_blk", T.IntegerType()), T.StructField("ranges", T.BinaryType())])


def _joined(parts: list[bytes | None]) -> np.ndarray:
    """Sorted hashes of several packs."""
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(p, np.uint64) for p in parts if p)]))


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _places(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run number, place) of every window of the runs low..high."""
    sizes = high - low + 1
    run = np.repeat(np.arange(len(low)), sizes)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[run]


def _list_anchors(plan: _Plan):
    def run(block: pa.Table) -> pa.Table:
        found = [window_runs(part, plan.length, plan.gram)[0][4] for _, part in _slabs(block.column(plan.raw).to_pylist())]
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return plan.packs(values, counts, block.column(plan.block)[0].as_py())

    return run


def _list_windows(plan: _Plan):
    """Hashes of the windows at hot anchors."""

    def run(block: pa.Table, lists: pa.Table) -> pa.Table:
        hot = _joined(lists.column("hot").to_pylist()) if block.num_rows else ()
        if not len(hot):
            return arrow_schema(ANCHORS).empty_table()
        found = []
        for _, part in _slabs(block.column(plan.raw).to_pylist()):
            (_, low, high, _, anchors), _, _, hashes = window_runs(part, plan.length, plan.gram)
            hit = _among(anchors, hot)
            if hit.any():
                found.append(window_hashes(hashes, _places(low[hit], high[hit])[1], plan.length, plan.gram))
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return plan.packs(values, counts, block.column(plan.block)[0].as_py())

    return run


def _find_recurring(plan: _Plan, windows: bool):
    """Which of a bucket's hashes occur twice or more, for each block that has them."""

    def run(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()]
        homes = np.repeat(group.column("home").to_numpy(), [len(p) for p in parts])
        counts = np.concatenate([np.frombuffer(c, np.uint16) for c in group.column("counts").to_pylist()]).astype(np.int64)
        values, place = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(place, weights=counts)[place]
        hot = (total > plan.hot) & (not windows)
        values, keep = values[place], total >= 2
        values, homes, hot = values[keep], homes[keep], hot[keep]
        order = np.argsort(homes, kind="stable")
        values, homes, hot = values[order], homes[order], hot[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(homes)) + 1, [len(homes)])) if len(homes) else np.zeros(1, np.int64)
        out: dict[str, list] = {f.name: [] for f in RECUR}
        for s, e in zip(cuts.tolist(), cuts[1:].tolist()):
            own, often = values[s:e], hot[s:e]
            out["_blk"].append(int(homes[s]))
            out["hashes"].append(None if windows else own[~often].tobytes())
            out["hot"].append(None if windows else own[often].tobytes())
            out["windows"].append(own.tobytes() if windows else None)
        return pa.table(out, arrow_schema(RECUR))

    return run


def _ship_runs(plan: _Plan):
    length = plan.length

    def run(block: pa.Table, lists: pa.Table) -> pa.Table:
        if not block.num_rows or not lists.num_rows:
            return arrow_schema(RUNS).empty_table()
        wanted, hot, windows = (_joined(lists.column(c).to_pylist()) for c in ("hashes", "hot", "windows"))
        block = plan.ordered(block)
        texts = block.column(plan.raw).to_pylist()
        seen: set = set()
        kept: list[tuple] = []
        done: list[int] = []

        def take(value: int, doc: int, inside: int, offset: int, text: bytes) -> None:
            key = (value, offset, text)
            if key not in seen:
                seen.add(key)
                kept.append((value, doc, inside, offset, text))
            elif done and done[-3] == doc and done[-2] <= inside <= done[-1]:
                done[-1] = max(done[-1], inside + len(text))
            else:
                done.extend((doc, inside, inside + len(text)))

        for begin, part in _slabs(texts):
            (docs, low, high, anchor, hashes), joined, starts, grams = window_runs(part, length, plan.gram)
            hit = np.flatnonzero(_among(hashes, wanted))
            columns = (docs[hit], low[hit], high[hit] + length, anchor[hit] - low[hit], hashes[hit], low[hit] - starts[docs[hit]])
            for doc, s, e, offset, value, inside in zip(*(c.tolist() for c in columns)):
                take(value, begin + doc, inside, offset, joined[s:e])
            often = np.flatnonzero(_among(hashes, hot))
            if len(often) and len(windows):
                of, at = _places(low[often], high[often])
                own = window_hashes(grams, at, length, plan.gram)
                met = np.flatnonzero(_among(own, windows))
                doc_of = docs[often][of[met]]
                for value, doc, s, inside in zip(own[met].tolist(), doc_of.tolist(), at[met].tolist(), (at[met] - starts[doc_of]).tolist()):
                    take(value, begin + doc, inside, 0, joined[s : s + length])
        home = block.column(plan.block)[0].as_py()
        out: dict[str, list] = {f.name: [] for f in RUNS}

        def emit(bucket: int, **columns) -> None:
            for name in out:
                out[name].append(columns.get(name))
            out["bucket"][-1], out["home"][-1] = bucket, home

        if done:
            emit(home % plan.buckets, done=np.array(done, np.int64).tobytes())
        if kept:
            values = np.array([k[0] for k in kept], np.uint64)
            rows = np.array([k[1] for k in kept], np.int64)
            lows = np.array([k[2] for k in kept], np.int64)
            offsets = np.array([k[3] for k in kept], np.int16)
            sizes = np.array([len(k[4]) for k in kept], np.int32)
            ids = block.column(plan.id)
            valid, ids, ties = ids.is_valid().to_numpy()[rows].astype(np.uint8), ids.fill_null(0).to_numpy()[rows], block.column(plan.tie).to_numpy()[rows]
            order = np.argsort(values, kind="stable")
            cuts = np.searchsorted(plan.bucket(values[order]), np.arange(plan.buckets + 1))
            for b, (s, e) in enumerate(zip(cuts, cuts[1:])):
                if e > s:
                    own = order[s:e]
                    arrays = {"hashes": values, "valid": valid, "ids": ids, "ties": ties, "rows": rows, "lows": lows, "offsets": offsets, "sizes": sizes}
                    emit(b, text=b"".join(kept[i][4] for i in own.tolist()), **{n: a[own].tobytes() for n, a in arrays.items()})
        return pa.table(out, arrow_schema(RUNS))

    return run


def _judge_runs(plan: _Plan):
    kinds = {"hashes": np.uint64, "valid": np.uint8, "ids": np.int64, "ties": np.int64, "rows": np.int64, "lows": np.int64, "offsets": np.int16, "sizes": np.int32}

    def run(group: pa.Table) -> pa.Table:
        out: dict[int, list[np.ndarray]] = {}
        packs = group.to_pylist()
        for p in packs:
            if p["done"]:
                out.setdefault(p["home"], []).append(np.frombuffer(p["done"], np.int64).reshape(-1, 3))
        packs = [p for p in packs if p["text"]]
        if packs:
            cols = {n: np.concatenate([np.frombuffer(p[n], k) for p in packs]) for n, k in kinds.items()}
            homes = np.repeat([p["home"] for p in packs], [len(p["sizes"]) // 4 for p in packs])
            text = b"".join(p["text"] for p in packs)
            ends = np.cumsum(cols["sizes"], dtype=np.int64)
            order = np.lexsort((cols["lows"], cols["rows"], homes, cols["ties"], cols["ids"], cols["valid"], cols["offsets"], cols["hashes"]))
            values, offsets = cols["hashes"][order], cols["offsets"][order]
            # equal windows have their anchor at the same place, but runs may begin at other distances from it
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))
            starts = (ends - cols["sizes"])[order].tolist()
            stops = ends[order].tolist()
            removed: list[tuple[int, int, int, int]] = []
            rows, lows, home_of = cols["rows"][order].tolist(), cols["lows"][order].tolist(), homes[order].tolist()
            rank = np.lexsort((cols["lows"][order], cols["rows"][order], homes[order], cols["ties"][order], cols["ids"][order], cols["valid"][order])) if len(order) else order
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if e - s < 2:
                    continue
                members = range(s, e) if offsets[s] == offsets[e - 1] else sorted(range(s, e), key=place.__getitem__)
                for i, ranges in zip(members, later_copies([text[starts[i] : stops[i]] for i in members], plan.length)):
                    removed += [(home_of[i], rows[i], lows[i] + a, lows[i] + b) for a, b in ranges]
            if removed:
                found = np.array(removed, np.int64)
                found = found[np.argsort(found[:, 0], kind="stable")]
                bounds = np.concatenate(([0], np.flatnonzero(np.diff(found[:, 0])) + 1, [len(found)]))
                for s, e in zip(bounds, bounds[1:]):
                    out.setdefault(int(found[s, 0]), []).append(found[s:e, 1:])
        return pa.table({"_blk": list(out), "ranges": [np.concatenate(v).tobytes() for v in out.values()]}, arrow_schema(RANGES))

    return run


def _cut(plan: _Plan, schema: T.StructType, text: str | None, report: bool):
    arrow = arrow_schema(schema)

    def run(block: pa.Table, lists: pa.Table) -> pa.Table:
        if not block.num_rows:
            return arrow.empty_table()
        block = plan.ordered(block)
        texts = block.column(plan.raw).to_pylist()
        found = np.concatenate([np.frombuffer(r, np.int64).reshape(-1, 3) for r in lists.column("ranges").to_pylist()] or [np.zeros((0, 3), np.int64)])
        found = found[np.lexsort((found[:, 1], found[:, 0]))]
        cuts = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).tolist()
        kept, removed, spans = [], [], []
        for i, raw in enumerate(texts):
            parts, at, gone, n, stop = [], 0, 0, 0, -1
            for s, e in found[cuts[i] : cuts[i + 1], 1:].tolist():
                if s > stop:
                    parts.append(raw[at:s])
                    n += 1
                    gone += e - s
                    at = stop = e
                elif e > stop:
                    gone += e - stop
                    at = stop = e
            parts.append(raw[at:])
            kept.append(b"".join(parts))
            removed.append(gone)
            spans.append(n)
        made = {"n_bytes": [len(t) for t in texts], "n_removed": removed, "n_spans": spans}
        if text is None:
            made["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in kept]
        if not report:
            made = {}
        if text is not None:
            made[text] = [k.decode("utf-8", "ignore") if valid else None for k, valid in zip(kept, block.column(plan.had).to_pylist())]
        return pa.table([pa.array(made[f.name], f.type) if f.name in made else block.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return run


def remove_repeats(docs: DataFrame, text: str = "text", digest: bool = False, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot: int = HOT, report: bool = True) -> DataFrame:
    """``docs`` with later copies cut out of ``text``, and n_bytes, n_removed, n_spans unless ``report`` is false.

    With ``digest`` the text is left out and kept_sha256 (of the remaining bytes) comes
    instead.  Remaining bytes that no longer form a character are left out of the text.
    """
    if not 8 <= gram < length:
        raise ValueError("an anchor must be shorter than the strings looked for")
    spark = docs.sparkSession
    # at least a block a task; a block has a row for each bucket at most, so there are no more buckets than blocks
    plan = _Plan(docs, max(-(-total_bytes(docs, f"`{text}`") // block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))), length, gram, hot)
    names = ["n_bytes", "n_removed", "n_spans"] if report else []
    replaced = {*names, *(["kept_sha256"] if digest else [])}
    plain = [c for c in docs.columns if c != text and c.lower() not in replaced]
    value = F.col(f"`{text}`").cast("string")
    base = docs.select(
        *[F.col(f"`{c}`") for c in plain], F.col("doc_id").cast("long").alias(plan.id), F.xxhash64(value).alias(plan.tie), value.isNotNull().alias(plan.had), F.coalesce(value.cast("binary"), F.lit(b"")).alias(plan.raw),
        F.pmod(F.xxhash64(F.col("doc_id"), value, F.spark_partition_id()), F.lit(plan.blocks)).cast("int").alias(plan.block),
    )
    # the input's partition deals out rows that repeat an id and a text; it is the same when a lost task runs again
    blocks = base.groupBy(plan.block)
    recurring = blocks.applyInArrow(lean(_list_anchors(plan), 1), ANCHORS).groupBy("bucket").applyInArrow(lean(_find_recurring(plan, False), 1), RECUR)
    windows = blocks.cogroup(recurring.groupBy("_blk")).applyInArrow(lean(_list_windows(plan), 2), ANCHORS).groupBy("bucket").applyInArrow(lean(_find_recurring(plan, True), 1), RECUR)
    runs = blocks.cogroup(recurring.unionAll(windows).groupBy("_blk")).applyInArrow(lean(_ship_runs(plan), 2), RUNS)
    ranges = runs.groupBy("bucket").applyInArrow(lean(_judge_runs(plan), 1), RANGES)
    fields = [docs.schema[c] for c in docs.columns if c in plain or (c == text and not digest)]
    fields = [T.StructField(text, T.StringType()) if f.name == text else f for f in fields]
    schema = T.StructType([*fields, *([T.StructField("kept_sha256", T.StringType())] if digest else []), *(T.StructField(n, T.LongType()) for n in names)])
    return blocks.cogroup(ranges.groupBy("_blk")).applyInArrow(lean(_cut(plan, schema, None if digest else text, report), 2), schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, bytes]]:
    """(n_bytes, n_removed, n_spans, kept) of documents in corpus order, by a table of every string (for tests)."""
    first: set[bytes] = set()
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in first:
                gone[s : s + length] = b"\1" * length
            first.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT rid, base, strlen(h) // 2 AS n, substr(h, CAST(2 * base + 1 AS BIGINT), 1198) AS piece FROM (SELECT rid, h, unnest(range(0, strlen(h) // 2 - 99, 500)) AS base FROM d WHERE strlen(h) >= 200)),
w AS (SELECT rid, base + i AS p, md5(substr(piece, CAST(2 * i + 1 AS BIGINT), 200)) AS s FROM (SELECT rid, base, piece, unnest(range(0, least(500, n - 99 - base))) AS i FROM pieces)),
f AS (SELECT s, min(rid * 100000000 + p) AS first_at FROM w GROUP BY s HAVING count(*) > 1),
later AS (SELECT w.rid, w.p FROM w JOIN f USING (s) WHERE w.rid * 100000000 + w.p > f.first_at),
runs AS (
  SELECT rid, min(p) AS lo, max(p) + 100 AS hi
  FROM (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS k
        FROM (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM later))
  GROUP BY rid, k
), gone AS (SELECT rid, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(struct_pack(lo := lo, hi := hi) ORDER BY lo) AS r FROM runs GROUP BY rid),
kept AS (
  SELECT rid, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS k
  FROM (SELECT rid, h, CASE WHEN i = 1 THEN 0 ELSE r[i - 1].hi END AS a, CASE WHEN i > len(r) THEN strlen(h) // 2 ELSE r[i].lo END AS b
        FROM (SELECT rid, h, r, unnest(range(1, len(r) + 2)) AS i FROM d JOIN gone USING (rid)))
  GROUP BY rid
)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN gone USING (rid) LEFT JOIN kept USING (rid)
"""
