"""Benchmark decontamination with a generalised suffix automaton over words.

All test items are read into one suffix automaton whose symbols are normalised words.
Training text streams through it: the automaton keeps the longest suffix of the words
read so far that occurs in some item, clipped to the window length, so each word costs
amortised constant work.  Where the matched length reaches a window, the window's words
are hit and the items that hold it are known from the state.

Normalisation: A-Z are lower-cased; words are runs of ASCII digits, a-z and all
characters from U+0080 on.  A window is ``window`` consecutive words of an item; an item
with fewer words, but not none, is one window.

The items' total word count is checked; beyond ``max_words`` they are split into several
automata of bounded size.  Up to AT_ONCE of them are broadcast and run over one stream;
further ones run in rounds over the written result, so no limit drops items and neither
the driver nor a worker ever holds more.  An automaton is packed: states with one edge,
nearly all of them, take a place in arrays.

Defined results for odd input: null or empty text has no words and is clean; null item
ids or texts take part as ids ``null`` left out and texts without words; repeated items
count once for each distinct id; repeated rows are judged alike; very long texts are
streamed whole; an empty benchmark leaves everything clean; columns may have any names:
``find_contamination`` replaces those named like its results, ``decontaminate`` keeps all.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field_name, map_rows, materialise, table

WINDOW = 13
#: Words of an automaton (about 60 MB in a worker), and automata that one stage holds.
MAX_WORDS = 250_000
AT_ONCE = 4

_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for key, words in items:
            if words:
                coded.append((key, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]))
        for _, symbols in coded:
            last = 0
            for s in symbols:
                last = self._extend(last, s)
        self.windows: dict[int, set] = defaultdict(set)  # state of a full window -> items
        self.short: dict[int, list[tuple[int, object]]] = defaultdict(list)  # state -> whole items that are shorter
        for key, symbols in coded:
            state = 0
            for i, s in enumerate(symbols):
                state = self._clip(self.next[state][s])
                if i + 1 >= window:
                    self.windows[state].add(key)
            if len(symbols) < window:
                self.short[state].append((len(symbols), key))
        self.shortest = min([window, *(len(s) for _, s in coded)])
        self.marks: dict[int, tuple] = {}  # short items that end wherever the state does
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = (*self.marks.get(self.link[state], ()), *self.short.get(state, ()))
            if own:
                self.marks[state] = own
        self._pack()

    def _pack(self) -> None:
        """Edges in arrays where a state has one only, in a table of the others; links and lengths in arrays."""
        self.symbol, self.target = array("i", [-1]) * len(self.next), array("i", [-1]) * len(self.next)
        self.branches: dict[int, dict[int, int]] = {}
        for state, edges in enumerate(self.next):
            if len(edges) == 1:
                ((self.symbol[state], self.target[state]),) = edges.items()
            elif edges:
                self.branches[state] = edges
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.windows = {state: frozenset(keys) for state, keys in self.windows.items()}
        del self.next, self.short

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.next) - 1

    def _split(self, state: int, via: int, symbol: int) -> int:
        """A state for the strings of ``via`` that are no longer than those reached from ``state``."""
        half = self._new(self.length[state] + 1, self.link[via], dict(self.next[via]))
        self.link[via] = half
        while state >= 0 and self.next[state].get(symbol) == via:
            self.next[state][symbol] = half
            state = self.link[state]
        return half

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:  # already there, from an earlier item
            via = self.next[last][symbol]
            return via if self.length[via] == self.length[last] + 1 else self._split(last, via, symbol)
        state = self._new(self.length[last] + 1, 0, {})
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = state
            last = self.link[last]
        if last >= 0:
            via = self.next[last][symbol]
            self.link[state] = via if self.length[via] == self.length[last] + 1 else self._split(last, via, symbol)
        return state

    def _clip(self, state: int) -> int:
        """The state of the window-long suffix of the state's strings."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges [start, end), merged and ascending, and the items whose windows occur."""
        found: list[tuple[int, int]] = []
        items: set = set()
        symbols = list(map(self.vocabulary.get, words))
        if len(symbols) < self.shortest:
            return found, items
        known = np.fromiter((s is not None for s in symbols), bool, len(symbols))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        symbol, target, branches, none = self.symbol, self.target, self.branches, {}
        link, length, window, marks = self.link, self.length, self.window, self.marks
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start < self.shortest:
                continue
            state = matched = 0
            for i in range(start, end):
                s = symbols[i]
                after = target[state] if symbol[state] == s else branches.get(state, none).get(s, -1)
                while after < 0 and state:
                    state = link[state]
                    matched = length[state]
                    after = target[state] if symbol[state] == s else branches.get(state, none).get(s, -1)
                if after >= 0:
                    state = after
                    matched += 1
                    if matched >= window:
                        matched = window
                        while length[link[state]] >= window:
                            state = link[state]
                        found.append((i + 1 - window, i + 1))
                        items |= self.windows[state]
                    for size, key in marks.get(state, none):
                        if size <= matched:
                            found.append((i + 1 - size, i + 1))
                            items.add(key)
        return merge(found), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending ranges without overlap or touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _automata(benchmark: DataFrame, item_id: str, text: str, window: int, max_words: int):
    """Items as automata of at most ``max_words`` words each (one item alone may be longer).

    Test sets are read in whole: their words are what is broadcast, block by block.
    """
    rows = benchmark.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{text}`").alias("t")).where("i is not null and t is not null").orderBy("i").toLocalIterator()
    block, size = [], 0
    for row in rows:
        words = words_of(row["t"])
        if block and size + len(words) > max_words:
            yield Automaton(block, window)
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    if block:
        yield Automaton(block, window)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with ``hit_spans`` (array of word ranges), ``n_words`` and ``hit_items``.  No shuffle of the documents."""
    names = ("hit_spans", "hit_items", "n_words")
    plain = [F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in names]
    return _matched(docs.select(*plain), benchmark, names, text, item_id, item_text, window, max_words)


def _matched(docs: DataFrame, benchmark: DataFrame, names: tuple[str, str, str], text: str, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with spans, items and number of words in columns of the given names."""
    context = docs.sparkSession.sparkContext
    kinds = ("array<struct<s:long,e:long>>", "array<string>", "long")
    out = docs.withColumns({n: F.lit(None).cast(k) for n, k in zip(names, kinds)})
    made = 0
    for automaton in _automata(benchmark, item_id, item_text, window, max_words):
        if made and made % AT_ONCE == 0:
            out = materialise(out, "matched")
        out = _pass(out, context.broadcast(automaton), names, text)
        made += 1
    return out if made else _pass(out, context.broadcast(Automaton([], window)), names, text)


def _pass(docs: DataFrame, automaton, names: tuple[str, str, str], text: str) -> DataFrame:
    spans_name, items_name, count_name = names

    def run(batch):
        columns = {name: batch.column(name) for name in batch.schema.names}
        spans, items, counts = [], [], []
        before = zip(batch.column(spans_name).to_pylist(), batch.column(items_name).to_pylist())
        for value, (old_spans, old_items) in zip(batch.column(text).to_pylist(), before):
            words = words_of(value)
            found, keys = automaton.value.match(words)
            found = merge(found + [(x["s"], x["e"]) for x in old_spans or ()])
            spans.append([{"s": s, "e": e} for s, e in found])
            items.append(sorted({*map(str, keys), *(old_items or ())}))
            counts.append(len(words))
        return columns | {spans_name: spans, items_name: items, count_name: counts}

    return map_rows(docs, run, docs.schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 5, remove: str = "documents", **options) -> DataFrame:
    """Training rows without test content; columns stay as they are, whatever their names.

    A document is contaminated if its hit words are at least ``percent`` per cent of its
    words (and not none).  ``remove="documents"`` drops those and leaves all others as
    they are; ``remove="spans"`` cuts the hit words out of contaminated documents instead.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"unknown way to remove: {remove}")
    spans_name, items_name, count_name, flag = (field_name(docs, stem) for stem in ("own_spans", "own_items", "own_count", "own_flag"))
    found = _matched(docs, benchmark, (spans_name, items_name, count_name), text, **options)
    hits = F.aggregate(spans_name, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    flagged = found.withColumn(flag, (hits > 0) & (hits * 100 >= F.col(count_name) * percent))
    plain = [F.col(f"`{c}`") for c in docs.columns]
    if remove == "documents":
        return flagged.where(~F.col(flag)).select(*plain)

    def run(batch):
        columns = {name: batch.column(name) for name in batch.schema.names}
        rows = zip(batch.column(text).to_pylist(), batch.column(spans_name).to_pylist(), batch.column(flag).to_pylist())
        return columns | {text: [cut_words(t, [(x["s"], x["e"]) for x in s]) if b else t for t, s, b in rows]}

    return map_rows(flagged, run, flagged.schema).select(*plain)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the given ranges; what stands between hit words goes too."""
    raw = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(raw.translate(_NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("hit_items")), 256).alias("items_sha256"), ((hits > 0) & (20 * hits >= F.col("n_words"))).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, set[int], set]:
    """Number of words, hit word positions and items, by comparing every window everywhere (for tests)."""
    words, hit, keys = words_of(text), set(), set()
    for key, item in items:
        own = words_of(item)
        size = min(window, len(own))
        for j in range(len(own) - size + 1 if size else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[j : j + size]:
                    hit.update(range(i, i + size))
                    keys.add(key)
    return len(words), hit, keys


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)
), hits AS (SELECT dw.rid, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, gram)),
per AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM hits GROUP BY rid
), covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per USING (rid) LEFT JOIN covered USING (rid)
"""
