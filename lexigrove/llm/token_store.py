"""Token-id files with Elias-Fano encoded document boundaries.

Documents are dealt into ranges of ascending doc_id, encoded, and written as segment
files: one concatenated array of ids (16 bits each while the vocabulary allows, else
32) and the documents' end offsets in Elias-Fano form.  The low bits of the offsets are
packed; the high bits form a bit vector in which the k-th one gives the k-th offset;
sampled positions of ones (the select structure) make any offset a constant-time
lookup.  That takes about 2 + log2(ids/documents) bits a document instead of 64.

A segment is one byte string (see ``write_segment``); Spark stores segments as rows of a
Parquet table, so any file system that Spark writes to will do.  Segment bases (ids of all
segments before) are a running sum over the segments of a task, and over one row a task.

Defined results for odd input: null text has only the end id; documents with equal
ids are kept in the order of a hash of their texts, repeated rows in any order; null ids
come first; a very long text is one document of one segment; only doc_id and text are
read, so other columns may have any names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialise, slices, sorted_by_id, table

MAGIC = b"LXG1"
SAMPLE = 256
#: Ids in one segment, and bytes of text in one range of doc_id.
SEGMENT_IDS = 1 << 21
RANGE_BYTES = 24 << 20
END_ID = 1
#: Words whose ids a worker remembers, in each of two generations.
MEMORY = 500_000


class EliasFano:
    """Non-decreasing integers in near-minimal space, with select by sampled ones."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.count, self.low_bits = count, low_bits
        self.low, self.high, self.samples = low, high, samples
        self._low = np.frombuffer(low, np.uint8)
        self._high = np.frombuffer(high, np.uint8)
        self._samples = np.frombuffer(samples, np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        count = len(values)
        top = int(values[-1]) if count else 0
        bits = max(0, (top // count).bit_length() - 1) if count else 0
        values = values.astype(np.uint64)
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if bits else np.zeros(0, np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(count)
        high = np.zeros(int(ones[-1]) + 1 if count else 0, np.uint8)
        high[ones] = 1
        pack = lambda a: np.packbits(a, bitorder="little").tobytes()
        return cls(count, bits, pack(low), pack(high), ones[::SAMPLE].astype(np.uint32).tobytes())

    def select(self, k: int) -> int:
        """The k-th value (from 0): walk on from the nearest sampled one."""
        at = int(self._samples[k // SAMPLE])
        left = k % SAMPLE
        byte, bit = divmod(at, 8)
        word = int(self._high[byte]) >> bit << bit
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = int(self._high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        start = k * self.low_bits
        low = 0
        if self.low_bits:
            first, last = start // 8, (start + self.low_bits + 7) // 8
            low = int.from_bytes(self._low[first:last].tobytes(), "little") >> (start - 8 * first) & ((1 << self.low_bits) - 1)
        return (one - k) << self.low_bits | low

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        ones = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.count]
        out = (ones - np.arange(self.count)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self._low, count=self.count * self.low_bits, bitorder="little").reshape(self.count, self.low_bits)
            out = out | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out.astype(np.int64)


def write_segment(ids: np.ndarray, ends: np.ndarray, width: int) -> bytes:
    """Header, Elias-Fano boundaries, ids.  All numbers little-endian."""
    ef = EliasFano.of(ends)
    head = struct.pack("<4sBBxxQQIII", MAGIC, width, ef.low_bits, len(ids), ef.count, len(ef.low), len(ef.high), len(ef.samples))
    return b"".join([head, ef.low, ef.high, ef.samples, ids.astype(f"<u{width}").tobytes()])


def read_segment(data: bytes) -> tuple[np.ndarray, EliasFano]:
    """Ids and the boundaries of one segment; raises ValueError if the bytes are not one."""
    size = struct.calcsize("<4sBBxxQQIII")
    if len(data) < size or data[:4] != MAGIC:
        raise ValueError("not a token segment")
    _, width, low_bits, n_ids, count, n_low, n_high, n_samples = struct.unpack("<4sBBxxQQIII", data[:size])
    at = [size, size + n_low, size + n_low + n_high, size + n_low + n_high + n_samples]
    if len(data) != at[3] + n_ids * width:
        raise ValueError("token segment is cut short")
    ef = EliasFano(count, low_bits, data[at[0] : at[1]], data[at[1] : at[2]], data[at[2] : at[3]])
    return np.frombuffer(data, f"<u{width}", n_ids, at[3]), ef


#: Fixed value: how the tokenizers that ``WordEncoder`` takes split text, and the marks of their special tokens.
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = "<|"


class WordEncoder:
    """``tokenizer.encode`` for whole texts, word by word.

    For tokenizers that lower-case, split by SPLIT_RULE and encode each part by itself, closing it with a piece of its
    own: the ids of a text are those of its parts, and parts are remembered in two generations.  Here the rule is
    spelt out for ASCII and Latin letters; texts with anything else, or with what may be a special token, go to the
    tokenizer whole.  New parts go to it as one text.
    """

    LETTER = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
    NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
    PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
    #: Here lower case is a matter of single characters, and str knows the same blanks.
    OTHER = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _fresh(self, parts: list[str]) -> dict[str, bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.kind)
        ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
        if len(ends) != len(parts) or ends[-1] != len(ids):
            return {w: np.array(x.ids, self.kind).tobytes() for w, x in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False))}
        raw, width, start, out = ids.tobytes(), ids.itemsize, 0, {}
        for w, end in zip(parts, ends):
            out[w] = raw[width * start : width * end]
            start = end
        return out

    def _find(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of parts that the younger generation lacks; they join it."""
        older = self.older
        known = {p: older[p] for p in missing if p in older}
        need = [p for p in missing if p not in known]
        if need:
            known |= self._fresh(need)
        if len(self.memory) + len(known) > MEMORY:
            self.older, self.memory = self.memory, known if len(known) <= MEMORY else {}
        else:
            self.memory |= known
        return known

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        parts = [None if self.OTHER.search(t) or SPECIAL in t else self.PARTS.findall(t.lower()) for t in texts]
        get = self.memory.get
        got = [list(map(get, p or ())) for p in parts]
        gaps: list[tuple[list, int, str]] = []
        for own, found in zip(parts, got):
            at = -1
            try:
                while True:  # list.index walks over what is known without a step of Python
                    at = found.index(None, at + 1)
                    gaps.append((found, at, own[at]))
            except ValueError:
                pass
        if gaps:
            known = self._find({part for _, _, part in gaps})
            for found, at, part in gaps:
                found[at] = known[part]
        whole = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, parts) if p is None], add_special_tokens=False))
        return [np.array(next(whole).ids, self.kind) if p is None else np.frombuffer(b"".join(found), self.kind) for p, found in zip(parts, got)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


class PlainEncoder:
    """The tokenizer as it is, for files that ``WordEncoder`` does not suit."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if self.wide else np.uint16

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def splits_words(path: str) -> bool:
    """Whether the file's rules are those that ``WordEncoder`` spells out."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    steps = [x.get("type") for x in (rules["normalizer"] or {}).get("normalizers", [])]
    first = ((rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
    split = first.get("pattern", {}).get("Regex") == SPLIT_RULE and first.get("invert") and first.get("behavior") == "Removed"
    model = rules["model"]
    special = all(x["content"].startswith(SPECIAL) for x in rules["added_tokens"])
    return bool(steps == ["NFC", "Replace", "Lowercase"] and split and special and model.get("type", "BPE") == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"])


@functools.lru_cache(maxsize=1)
def encoder_of(path: str):
    """One encoder for all tasks of a Python worker: what it remembers serves the next task."""
    return (WordEncoder if splits_words(path) else PlainEncoder)(path)


SEGMENTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])


def encode_segments(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Segment rows in ascending (part, seq); each holds whole documents in ascending doc_id.  Texts move once."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = arrow_schema(SEGMENTS)

    def run(batches):
        gc.disable()  # nothing here makes cycles, and the memory of chunks is long to walk over
        from pyspark import TaskContext

        encoder, part, seq = encoder_of(tokenizer_path), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], encoder.kind)
        doc_ids, held, size = [], [], 0

        def flush():
            nonlocal doc_ids, held, size, seq
            ends = np.cumsum([len(x) for x in held])
            row = {"part": [part], "seq": [seq], "n_ids": [size], "doc_ids": [doc_ids], "data": [write_segment(np.concatenate(held), ends, 4 if encoder.wide else 2)]}
            doc_ids, held, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in slices(batches, 64):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist())):
                ids = np.concatenate([ids, tail])
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    return sorted_by_id(texts, range_bytes).mapInArrow(run, SEGMENTS)


ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def with_bases(segments: DataFrame) -> DataFrame:
    """Segments with ``base``, the number of ids in all segments before: a running sum inside each part, and one over the parts.

    The sum over parts is one row for each task that wrote segments, about as much as Spark keeps of each task; the bases
    are one small row for each segment of SEGMENT_IDS ids (a few thousand for 30 GB of text).
    """
    sizes = segments.select("part", "seq", "n_ids")
    zero = F.lit(0).cast("long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), zero).alias("part_base"))
    inside = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("seq"))), zero).alias("inner"))
    # one row a segment goes to where the segments are: their ids are not shuffled
    return segments.join(F.broadcast(inside.join(parts, "part").select("part", "seq", (F.col("part_base") + F.col("inner")).alias("base"))), ["part", "seq"])


def read_back(segments: DataFrame) -> DataFrame:
    """One row per document from written segments: id, start, number of ids, and the checksum of all its ids.

    Where a document lies is asked of the select structure, document by document.
    """
    schema = arrow_schema(ROWS)

    def run(batches):
        for batch in slices(batches, 1):
            base, doc_ids, data = (batch.column(c)[0].as_py() for c in ("base", "doc_ids", "data"))
            ids, boundaries = read_segment(data)
            ends = np.fromiter(map(boundaries.select, range(boundaries.count)), np.int64, boundaries.count)
            starts = np.concatenate(([0], ends[:-1]))
            wide = ids.astype("<u4")
            sums = [zlib.crc32(wide[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": doc_ids, "start": starts + base, "n_tokens": ends - starts, "ids_crc32": sums}, schema)

    return with_bases(segments).select("base", "doc_ids", "data").mapInArrow(run, ROWS)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_back(materialise(encode_segments(docs, public_tokenizers.path("word_bpe_49k.json")), "token-segments"))
