"""SentencePiece encoding and decoding with a max-plus scan over chunks.

A text's segmentation is a best path through its characters.  Cut the text into chunks
anywhere: what a chunk needs to know of everything before it is the boundary state, the
piece that covers the cut.  A chunk turns each possible incoming state into outgoing
states with a weight, its transfer matrix; matrices combine by the associative max-plus
product, the incoming state of every chunk follows from a scan, and each chunk is then
traced back on its own.

Weights.  In a unigram model a path weighs the sum of its pieces' scores and the state is
how far the covering piece reaches.  In a BPE model the encoding is the one path whose
neighbouring pieces all stand as they are when the two are encoded together; such pairs
weigh 0, all others minus infinity, and the state is the covering piece itself.  Both
give the ids that the library gives for the same model file.

Within a chunk no piece reaches over the start of a word (a blank after something else),
so all states meet there and words between are encoded once and remembered; a chunk
without such a place is worked through for every incoming state.  Where no piece of the
model joins a letter to another kind of character, words are taken apart there as well.

Defined results for odd input: null text is empty and has no ids; characters without a
piece become byte pieces, or the unknown id if the model has none; repeated rows each get
their ids; a long text is known by its SHA-256, so equal ones are encoded once; a column
named like a result column (``token_ids``, the decoded text's) is replaced by the result,
all others stay under their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import struct
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RESIDENT, arrow_schema, field_name, lean, slices, table

BLANK = "▁"
CHUNK = 1 << 16
#: Words that a worker remembers, in each of two generations.
MEMORY = 160_000
NONE = float("-inf")
_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_START = re.compile(f"[^{BLANK}]{BLANK}")
#: Words taken apart where letters meet other characters.
_LETTER = re.compile(r"[^\W\d_]")
_PARTS = re.compile(rf"{BLANK}*(?:[^\W\d_]+|(?:[\W\d_](?<!{BLANK}))+)|{BLANK}+")


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; varints as ints, fixed 32-bit and nested messages as bytes."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Pieces, scores and rules of a model file, with encoding and decoding."""

    def __init__(self, path: str, unigram: bool | None = None):
        with open(path, "rb") as file:
            data = file.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        trainer: dict[int, object] = {}
        rules: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        own_kind = trainer.get(3, 1) == 1
        self.unigram = own_kind if unigram is None else unigram
        self.library = None
        if self.unigram == own_kind:  # single words may be left to the library
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        if rules.get(2):
            raise ValueError("models that rewrite characters are not supported: normalise the text first")
        self.dummy = bool(rules.get(3, 1))
        self.squeeze = bool(rules.get(4, 1))
        # kinds: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte
        self.unknown = kinds.index(2)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.hidden = frozenset(i for i, k in enumerate(kinds) if k in (2, 3))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (1, 4)}
        self.rank = {p: self.scores[i] for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.starts = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        for piece in self.ids:
            if re.search(f"[^{BLANK}]{BLANK}", piece):
                raise ValueError("pieces that reach over the start of a word are not supported")
        self.least = min(self.scores) - 10.0
        kind = lambda c: bool(_LETTER.match(c))
        apart = all(BLANK in (a, b) or kind(a) == kind(b) for piece in self.ids for a, b in zip(piece, piece[1:]))
        self.parts = _PARTS if apart else _WORD
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spelt = ["" if i in self.hidden else p for i, p in enumerate(self.pieces)]
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[list(self.byte_of)] = True
        self._pairs: dict[tuple[str, str], bool] = {}

    # -- text to pieces -------------------------------------------------------------

    def prepare(self, text: str) -> str:
        """The text with visible blanks, as the model's rules say."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.dummy else "") + text.replace(" ", BLANK)

    def merge(self, text: str) -> list[str]:
        """BPE by its definition: join the best-scoring pair, leftmost first, until none is a piece."""
        parts = list(text)
        get = self.rank.get
        values = [get(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while values:
            best = max(values)
            if best == NONE:
                break
            at = values.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del values[at]
            if at:
                values[at - 1] = get(parts[at - 1] + parts[at], NONE)
            if at < len(values):
                values[at] = get(parts[at] + parts[at + 1], NONE)
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Do two pieces stand as they are when encoded together?"""
        if left == "" or (right[0] == BLANK and left[-1] != BLANK):
            return True
        key = (left, right)
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > MEMORY:
                self._pairs.clear()
            found = self._pairs[key] = self.merge(left + right) == [left, right]
        return found

    def _from(self, text: str, at: int):
        """Pieces that start at ``at``: all known ones, and the single character if it is not one."""
        end = min(len(text), at + self.longest)
        stop = at + 1
        if text[at] not in self.ids:
            yield text[at]
        while stop <= end and text[at:stop] in self.starts:
            if text[at:stop] in self.ids:
                yield text[at:stop]
            stop += 1

    def _weight(self, left: str, piece: str) -> float:
        if self.unigram:
            found = self.ids.get(piece)
            return self.least if found is None else self.scores[found]
        return 0.0 if self._fits(left, piece) else NONE

    def _state(self, text: str, end: int, cut: int, piece: str) -> tuple[int, str]:
        """Reach beyond the cut, and the covering piece if it still matters: at a word start it does not."""
        meets = end < len(text) and text[end] == BLANK and end > 0 and text[end - 1] != BLANK
        return (end - cut, "" if self.unigram or meets else piece)

    def paths(self, text: str, begin: int, last: str, cut: int) -> dict[tuple[int, str], tuple[float, list[str]]]:
        """Best ways from position ``begin`` (after piece ``last``) to the first piece end at or after ``cut``.

        Keyed by outgoing state: reach beyond the cut, and the covering piece in a BPE model.
        """
        if begin >= cut:
            return {self._state(text, begin, cut, last): (0.0, [])}
        # at each position: for every last piece that matters, its weight and the way back
        reach: dict[int, dict[str, tuple[float, int, str, str]]] = {begin: {last if not self.unigram else "": (0.0, -1, "", "")}}
        final: dict[tuple[int, str], tuple[float, int, str, str]] = {}
        for at in range(begin, cut):
            here = reach.get(at)
            if not here:
                continue
            for piece in self._from(text, at):
                end = at + len(piece)
                for left, (weight, *_) in here.items():
                    gain = self._weight(left, piece)
                    if gain == NONE:
                        continue
                    new = (weight + gain, at, left, piece)
                    if end >= cut:
                        state = self._state(text, end, cut, piece)
                        if state not in final or new[0] > final[state][0]:
                            final[state] = new
                    else:
                        slot = reach.setdefault(end, {})
                        name = "" if self.unigram else piece
                        if name not in slot or new[0] > slot[name][0]:
                            slot[name] = new
        out = {}
        for state, (weight, at, left, piece) in final.items():
            way = [piece]
            while at != begin or reach[at][left][1] >= 0:
                _, at, left, piece = reach[at][left]
                if at < 0:
                    break
                way.append(piece)
            out[state] = (weight, way[::-1])
        return out

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of one word (blanks only in front) by the best path."""
        ways = self.paths(word, 0, "", len(word))
        pieces = max((w for (reach, _), w in ways.items() if reach == 0), key=lambda w: w[0])[1]
        return tuple(i for p in pieces for i in self.spell(p))

    def _by_library(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the library, in one call.

        It puts a blank in front of a text.  A word without one stands behind a character of the other kind, to which
        no piece joins it, and that character's ids are cut off.
        """
        before = {kind: (c, len(self.library.encode(c))) for kind, c in ((True, "."), (False, "a"))}
        asked, cuts = [], []
        for w in words:
            if w[0] == BLANK:
                asked.append(w[1:])
                cuts.append(0)
            else:
                c, n = before[bool(_LETTER.match(w))]
                asked.append(c + w)
                cuts.append(n)
        return {w: array("i", ids[n:] if n else ids).tobytes() for w, n, ids in zip(words, cuts, self.library.encode(asked, num_threads=1))}

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word (as bytes of int32), remembered; new words go to the library in one call where it can take them."""
        got = list(map(self.memory.get, words))
        gaps, at = [], -1
        try:
            while True:  # list.index walks over what is known without a step of Python
                at = got.index(None, at + 1)
                gaps.append(at)
        except ValueError:
            pass
        if not gaps:
            return got
        new = {words[i] for i in gaps}
        older = self.older
        known = {w: older[w] for w in new if w in older}
        new = [w for w in new if w not in known]
        if self.library is not None and self.dummy and not self.squeeze:
            bare = self.parts is _PARTS
            plain = [w for w in new if len(w) <= 64 and (1 < len(w) if w[0] == BLANK else bare) and BLANK not in w[1:]]
            if plain:
                known |= self._by_library(plain)
        for w in new:
            if w not in known:
                known[w] = np.array(self._word(w), np.int32).tobytes()
        if len(self.memory) + len(known) > MEMORY:  # two generations: what was not asked for lately goes
            self.older, self.memory = self.memory, known if len(known) <= MEMORY else {}
        else:
            self.memory |= known
        for i in gaps:
            got[i] = known[words[i]]
        return got

    def spell(self, piece: str) -> list[int]:
        """Ids of one piece; a character without a piece is spelt in bytes."""
        found = self.ids.get(piece)
        if found is not None:
            return [found]
        if self.bytes:
            return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text in one piece."""
        return self.encode_many([text])[0].tolist()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; their new words are looked up together."""
        parts = [self.parts.findall(self.prepare(t)) for t in texts]
        found = iter(self.words([w for own in parts for w in own]))
        ids = [np.frombuffer(b"".join(islice(found, len(own))), np.int32) for own in parts]
        return ids if self.bytes else [np.array(self._fuse(x.tolist()), np.int32) for x in ids]

    def _fuse(self, ids: list[int]) -> list[int]:
        """Neighbouring unknowns count as one, as in the library."""
        if self.bytes or self.unknown not in ids:
            return ids
        return [x for i, x in enumerate(ids) if x != self.unknown or not i or ids[i - 1] != x]

    def decode(self, ids) -> str:
        """The text that ids spell; bytes that form no character become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if not self.is_byte[ids].any():
            text = "".join(map(self.spelt.__getitem__, ids.tolist())).replace(BLANK, " ")
            return text[1:] if self.dummy and text.startswith(" ") else text
        ids = ids.tolist()
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i not in self.hidden:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(BLANK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text

    # -- chunks ---------------------------------------------------------------------

    def incoming(self, text: str, cut: int) -> list[tuple[int, str]]:
        """States in which a chunk may be entered at ``cut``: reach and covering piece."""
        if cut == 0:
            return [(0, "")]
        out = set()
        for start in range(max(0, cut - self.longest), cut):
            for piece in self._from(text, start):
                if start + len(piece) >= cut:
                    out.add(self._state(text, start + len(piece), cut, piece))
        return sorted(out)

    def _pinch(self, text: str, low: int, high: int) -> tuple[int, int] | None:
        """First and last word start in [low, high], if any: every path passes through them."""
        first = _START.search(text, max(low - 1, 0))
        if first is None or first.end() - 1 > high:
            return None
        at = text.rfind(BLANK, 0, high + 1)
        while at > 0 and text[at - 1] == BLANK:
            at = text.rfind(BLANK, 0, at)
        return first.end() - 1, at

    def transfer(self, text: str, cut: int, end: int) -> dict[tuple[int, str], dict[tuple[int, str], float]]:
        """The chunk [cut, end) as a max-plus matrix; ``text`` also holds what lies within one piece of the chunk."""
        out = {}
        for reach, last in self.incoming(text, cut):
            pinched = self._pinch(text, cut + reach, end)
            if pinched is None:
                ways = {s: w for s, (w, _) in self.paths(text, cut + reach, last, end).items()}
            else:
                head = max((w for (r, _), (w, _) in self.paths(text, cut + reach, last, pinched[0]).items() if r == 0), default=NONE)
                middle, tail = self._rest(text, *pinched, end)
                ways = {s: head + middle + w for s, (w, _) in tail.items()} if head != NONE else {}
            if ways:
                out[(reach, last)] = ways
        return out

    def _rest(self, text: str, first: int, last: int, end: int):
        """Weight of the words between two word starts, and the ways from the last one to the end of the chunk."""
        middle = 0.0
        if self.unigram:
            for word in _WORD.findall(text[first:last]):
                middle += self.paths(word, 0, "", len(word))[(0, "")][0]
        return middle, self.paths(text, last, "", end)

    def trace(self, text: str, cut: int, end: int, state: tuple[int, str], leave: tuple[int, str]) -> list[int]:
        """Ids of the pieces that start in the chunk after state ``state`` and leave it in ``leave``."""
        reach, last = state
        pinched = self._pinch(text, cut + reach, end)
        if not pinched:
            ways = self.paths(text, cut + reach, last, end)
            return [i for p in ways[leave][1] for i in self.spell(p)]
        head = max((w for (r, _), w in self.paths(text, cut + reach, last, pinched[0]).items() if r == 0), key=lambda w: w[0])
        out = [i for p in head[1] for i in self.spell(p)]
        out.extend(np.frombuffer(b"".join(self.words(self.parts.findall(text[pinched[0] : pinched[1]]))), np.int32).tolist())
        tail = self.paths(text, pinched[1], "", end)
        return out + [i for p in tail[leave][1] for i in self.spell(p)]


def combine(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices; associative."""
    out: dict = {}
    for state, row in a.items():
        new: dict = {}
        for middle, weight in row.items():
            for leave, gain in b.get(middle, {}).items():
                if weight + gain > new.get(leave, NONE):
                    new[leave] = weight + gain
        if new:
            out[state] = new
    return out


def solve(matrices: list[dict]) -> list[tuple]:
    """(incoming, outgoing) state of every chunk on the best path: a scan forward, then the choice backward."""
    ahead = []
    total: dict = {(0, ""): {(0, ""): 0.0}}
    for m in matrices:
        total = combine(total, m)
        ahead.append(total[(0, "")])
    leave = max((s for s in ahead[-1] if s[0] == 0), key=lambda s: (ahead[-1][s], s))
    out = []
    for n in range(len(matrices) - 1, -1, -1):
        before = ahead[n - 1] if n else {(0, ""): 0.0}
        state = max((s for s in before if leave in matrices[n].get(s, {})), key=lambda s: (before[s] + matrices[n][s][leave], s))
        out.append((state, leave))
        leave = state
    return out[::-1]


@functools.lru_cache(maxsize=2)
def model(path: str, unigram: bool | None = None) -> PieceModel:
    return PieceModel(path, unigram)


RESIDENT.append(model)


CHUNKS = T.StructType(
    [T.StructField("row_key", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("cut", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]
)


def _split(prepared: str, chunk: int, longest: int):
    """(number, cut, end, text) of chunks; the text holds ``longest`` characters more at either side."""
    for n, at in enumerate(range(0, len(prepared), chunk)):
        low, stop = max(0, at - longest), min(len(prepared), at + chunk)
        yield n, at - low, stop - low, prepared[low : min(len(prepared), stop + longest)]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Arrow lists of int32 arrays."""
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])), type=kind)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", chunk: int = CHUNK, unigram: bool | None = None, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``token_ids`` (array of int), and with the text that these spell if ``decoded`` names a column.

    Texts up to ``chunk`` characters are encoded where they stand, without a shuffle.  Only
    longer ones are dealt out in chunks: one task set makes the matrices, a scan over each
    document's small matrices gives the boundary states, and the chunks are traced back.
    """
    plain = [c for c in docs.columns if c == text or c.lower() not in ("token_ids", (decoded or "").lower())]
    base = docs.select(*[F.col(f"`{c}`") for c in plain])
    schema = T.StructType([*base.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])])
    arrow = arrow_schema(schema)
    value = F.col(f"`{text}`")
    is_long = F.coalesce(F.length(value) > chunk, F.lit(False))

    def whole(batches):
        codec = model(model_path, unigram)
        for batch in slices(batches, 128):
            ids = codec.encode_many([t or "" for t in batch.column(text).to_pylist()])
            texts = [pa.array([codec.decode(x) for x in ids], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names), _lists(ids, arrow.field("token_ids").type), *texts], schema=arrow)

    short = base.where(~is_long).mapInArrow(lean(whole, keeps=model), schema)
    # equal long texts have equal ids: they are encoded once and joined back by their digest
    own_key = field_name(base, "row_key")
    long_rows = base.where(is_long).withColumn(own_key, F.sha2(value, 256))
    unique = long_rows.select(F.col(own_key).alias("row_key"), value.alias("text")).dropDuplicates(["row_key"])

    def chunks(batches):
        codec = model(model_path, unigram)
        out = arrow_schema(CHUNKS)
        for batch in slices(batches, 16):
            for row_key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(row_key, *c) for c in _split(codec.prepare(t), chunk, codec.longest)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    pieces = unique.mapInArrow(lean(chunks, keeps=model), CHUNKS).repartition("row_key", "chunk")
    states = T.StructType([T.StructField("row_key", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("matrix", T.StringType())])

    def matrices(batches):
        codec = model(model_path, unigram)
        out = arrow_schema(states)
        for batch in slices(batches, 64):
            made = [repr(codec.transfer(t, c, e)) for t, c, e in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist(), batch.column("end").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("chunk"), pa.array(made, pa.string())], schema=out)

    path = T.StructType([T.StructField("row_key", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("state", T.StringType())])

    def scan(group: pa.Table) -> pa.Table:
        import ast

        group = group.sort_by("chunk")
        found = solve([ast.literal_eval(m) for m in group.column("matrix").to_pylist()])
        return pa.table({"row_key": group.column("row_key"), "chunk": group.column("chunk"), "state": [repr(s) for s in found]}, arrow_schema(path))

    found = pieces.mapInArrow(lean(matrices, keeps=model), states).groupBy("row_key").applyInArrow(scan, path)
    traced = T.StructType([T.StructField("row_key", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def trace(batches):
        import ast

        codec = model(model_path, unigram)
        out = arrow_schema(traced)
        for batch in slices(batches, 64):
            ids = []
            for t, c, e, s in zip(*(batch.column(n).to_pylist() for n in ("text", "cut", "end", "state"))):
                ids.append(codec.trace(t, c, e, *ast.literal_eval(s)))
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), batch.column("chunk"), pa.array(ids, pa.list_(pa.int32()))], schema=out)

    parts = pieces.join(found, ["row_key", "chunk"]).mapInArrow(lean(trace, keeps=model), traced)
    whole_ids = parts.groupBy("row_key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("token_ids"))
    other_key = field_name(long_rows, "whole_key")
    giant = long_rows.join(whole_ids.withColumnRenamed("row_key", other_key), F.col(own_key) == F.col(other_key)).select(*[F.col(f"`{c}`") for c in plain], "token_ids")
    return short.unionByName(decode_documents(giant, model_path, to=decoded) if decoded else giant)


def decode_documents(encoded: DataFrame, model_path: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its ids spell."""
    plain = [c for c in encoded.columns if c.lower() != to.lower()]
    base = encoded.select(*[F.col(f"`{c}`") for c in plain])
    schema = T.StructType([*base.schema.fields, T.StructField(to, T.StringType())])
    arrow = arrow_schema(schema)

    def run(batches):
        codec = model(model_path)
        for batch in slices(batches, 32):
            texts = [codec.decode(() if x is None else x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names), pa.array(texts, pa.string())], schema=arrow)

    return base.mapInArrow(lean(run, keeps=model), schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded").select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
