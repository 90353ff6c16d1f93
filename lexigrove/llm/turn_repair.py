"""Conversation structure repair by a scan of min-plus matrices.

The roles of a sound conversation spell ``(s?(ua)+)?`` by their initials.  Its automaton has four
states (nothing yet, after s, after u, after a), so a turn is a 4x4 matrix: the cheapest way from
state to state with that turn kept, given another role or deleted, and any number of empty turns
inserted before it.  Elements are pairs (cost, audit), the audit being the edits' initials in order;
matrices multiply by (min, +) on costs and concatenation on audits.  Two edits of equal cost over the
same turns are never a prefix of one another, as whatever follows the prefix would be inserts that
cost more; so the ASCII-least audit of a product is made of the least audits of its factors, the
product is associative, and the audit alone tells the repaired turns.

Turns are sorted by (conversation, turn) into ranges.  A task multiplies the turns that it holds of a
conversation in a balanced tree, short runs by a table it remembers; conversations that go over the
edge of a range send one element a range to rounds of associative reduction, in which a group holds
FAN elements at most.  Faults need no order: equal turns of a conversation are counted with partial
aggregates.  Texts are shuffled once, for the repaired conversations; what decides is narrow.

Defined results for odd input
- null role or text: one space (so an unknown role and a blank text); null turn: before all others;
- null conv_id: one conversation of its own, whose id is null;
- several rows of one turn: ordered by role, then by the text's MD5; equal rows stand together, and all
  but the first of them are duplicates;
- roles beginning with other letters than s, u, a: kept by no edit; an empty role has no initial;
- a conversation without rows after damage: zeros, empty audit, hash of the empty string;
- very long conversations: cost and audit come from all ranges in parallel.  The audit is one string, and
  SHA-256 is sequential, so its repaired turns stream through one task, which holds one Arrow batch and
  the audit;
- an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialise, slices, small_batches, table

#: Prices of the edits; a truncated turn that is not deleted costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The automaton: state and initial to state.  An inserted or rerole'd turn is user or assistant, whichever the state takes.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FREE = {0: 2, 1: 2, 2: 3, 3: 2}
ACCEPT = (0, 3)
#: Elements that one group of a reduction round combines, and turns whose product is remembered.
FAN, RUN = 16, 8

BLANK_CLASS = r"[^\x20\x09-\x0D]"

Matrix = tuple  # 16 elements, row by row: (cost, audit) or None


def product(x: Matrix, y: Matrix) -> Matrix:
    """The matrix of x's turns followed by y's."""
    made = []
    for i in range(0, 16, 4):
        row = x[i : i + 4]
        for j in range(4):
            best = None
            for k in range(4):
                a, b = row[k], y[4 * k + j]
                if a is not None and b is not None:
                    cost = a[0] + b[0]
                    if best is None or cost < best[0]:
                        best = (cost, a[1] + b[1])
                    elif cost == best[0]:
                        best = min(best, (cost, a[1] + b[1]))
            made.append(best)
    return tuple(made)


UNIT: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def _closure() -> Matrix:
    """Any number of inserts: each moves a state to the one state it can lead to; five leave no new cheapest way."""
    once = tuple((INSERT, "I") if FREE[i] == j else None for i in range(4) for j in range(4))
    total, power = UNIT, UNIT
    for _ in range(5):
        power = product(power, once)
        total = tuple(min((e for e in pair if e is not None), default=None) for pair in zip(total, power, strict=True))
    return total


CLOSURE = _closure()


@lru_cache(maxsize=64)
def turn_matrix(kind: str) -> Matrix:
    """A turn: ``x`` has to be deleted; s, u, a or o (another role), in capitals if truncated."""
    ways: list[list[tuple[int, str]]] = [[] for _ in range(16)]
    initial, extra = kind.lower(), TRUNCATED * kind.isupper()
    for i in range(4):
        ways[4 * i + i].append((DELETE, "D"))
        if initial != "x":
            ways[4 * i + FREE[i]].append((REROLE + extra, "R"))
            if (i, initial) in STEPS:
                ways[4 * i + STEPS[i, initial]].append((extra, "K"))
    return product(CLOSURE, tuple(min(w, default=None) for w in ways))


@lru_cache(maxsize=1 << 15)
def run_matrix(kinds: str) -> Matrix:
    """The product of at most RUN turns."""
    if len(kinds) == 1:
        return turn_matrix(kinds)
    half = len(kinds) // 2
    return product(run_matrix(kinds[:half]), run_matrix(kinds[half:]))


class Tree:
    """Products of runs of turns in order, like a binary counter: log n open factors, each joined with one of its own size."""

    def __init__(self):
        self.open: list[tuple[int, Matrix]] = []
        self.left = ""

    def add(self, kind: str) -> None:
        self.left += kind
        if len(self.left) == RUN:
            self._push(run_matrix(self.left))
            self.left = ""

    def _push(self, matrix: Matrix) -> None:
        rank = 0
        while self.open and self.open[-1][0] == rank:
            matrix = product(self.open.pop()[1], matrix)
            rank += 1
        self.open.append((rank, matrix))

    def value(self) -> Matrix:
        total = run_matrix(self.left) if self.left else None
        for _, matrix in reversed(self.open):
            total = matrix if total is None else product(matrix, total)
        return total if total is not None else UNIT


def cheapest(matrix: Matrix) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    total = product(matrix, CLOSURE)
    return min(total[j] for j in ACCEPT if total[j] is not None)


# -- rows and faults -----------------------------------------------------------------

ROW_SCHEMA = "conv_id, turn, role, text"


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations harmed in a way that (conv_id, turn) decides: rows dropped, emptied, cut, repeated or given role user."""
    c = conversations.select("conv_id", "turn", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")])
    harm = F.crc32(key.cast("binary")) % 20
    c = c.withColumn("harm", harm).where("harm != 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def narrow(rows: DataFrame) -> DataFrame:
    """What decides about a row: (conv_id, turn, role, mark, blank, cut), mark being the text's digest."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    last = F.regexp_extract(text, rf"({BLANK_CLASS})[\x20\x09-\x0D]*\z", 1)
    return rows.select("conv_id", "turn", role.alias("role"), F.md5(text.cast("binary")).alias("mark"), (last == "").alias("blank"), (~last.isin("", ".", "!", "?")).alias("cut"))


def counted(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, mark) with their number ``n`` and whether the role and text came in an earlier turn.

    Partial counts come before the shuffle, so rows repeated any number of times are a row a task.
    """
    each = rows.groupBy("conv_id", "turn", "role", "mark", "blank", "cut").agg(F.count("*").alias("n"))
    # written: both the counts and what is counted again from them start from files
    each = materialise(each, "turns", small=True)
    first = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    again = each.groupBy("conv_id", "role", "mark").agg(F.min(first)["turn"].alias("first_turn"), F.count("*").alias("turns")).where("turns > 1")
    again = again.select(F.col("conv_id").alias("own_conv"), F.col("role").alias("own_role"), F.col("mark").alias("own_mark"), "first_turn", "turns")
    same = F.col("conv_id").eqNullSafe(F.col("own_conv")) & (F.col("role") == F.col("own_role")) & (F.col("mark") == F.col("own_mark"))
    later = F.col("turns").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first_turn"))
    return each.join(again, same, "left").select("conv_id", "turn", "role", "mark", "blank", "cut", "n", later.alias("later"))


# -- the scan ------------------------------------------------------------------------

#: What a run of turns is known by; ``first`` and ``last`` are initials, turns the ends of the numbered ones.
COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")


def joined(x: dict, y: dict) -> dict:
    """The element of x's turns followed by y's."""
    if not x["n"] or not y["n"]:
        return y if not x["n"] else x
    made = {c: x[c] + y[c] for c in COUNTS}
    made["illegal"] += x["last"] + y["first"] not in ("su", "ua", "au")
    made["turns"] -= x["high"] is not None and x["high"] == y["low"]
    made["first"], made["last"] = x["first"], y["last"]
    made["low"], made["high"] = x["low"] if x["low"] is not None else y["low"], y["high"] if y["high"] is not None else x["high"]
    made["matrix"] = product(x["matrix"], y["matrix"])
    return made


def element(turns: Iterable[tuple]) -> dict:
    """The element of (turn, role, blank, cut, n, later) rows in order."""
    made, tree = {c: 0 for c in COUNTS} | {"first": "", "last": "", "low": None, "high": None}, Tree()
    for turn, role, blank, cut, n, later in turns:
        initial = role[:1]
        if made["n"]:
            made["illegal"] += made["last"] + initial not in ("su", "ua", "au")
        else:
            made["first"] = initial
        made["illegal"] += (n - 1) * (initial + initial not in ("su", "ua", "au"))
        made["last"], made["n"] = initial, made["n"] + n
        if turn is not None:
            made["turns"] += turn != made["high"]
            made["low"], made["high"] = turn if made["low"] is None else made["low"], turn
        repeats = 0 if blank else n - (not later)
        made["blank"] += n * blank
        made["duplicate"] += repeats
        if repeats < n and not blank:
            made["truncated"] += cut
            kind = initial if initial in ("s", "u", "a") else "o"
            tree.add(kind.upper() if cut else kind)
        for _ in range(n if blank else repeats):
            tree.add("x")
    return made | {"matrix": tree.value()}


_ELEMENT = T.StructType(
    [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())]
    + [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]
)


def _packed(e: dict) -> dict:
    found = {k: v for k, v in e.items() if k != "matrix"}
    return found | {"costs": [None if m is None else m[0] for m in e["matrix"]], "audits": [None if m is None else m[1] for m in e["matrix"]]}


def _unpacked(row: dict) -> dict:
    return {k: v for k, v in row.items() if k not in ("costs", "audits")} | {"matrix": tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"], strict=True))}


REPORT = T.StructType([T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [T.StructField("audit", T.StringType())])


def _reported(e: dict) -> dict:
    cost, audit = cheapest(e["matrix"])
    gaps = e["high"] - e["low"] + 1 - e["turns"] if e["low"] is not None else 0
    return {"gaps": gaps, "blank": e["blank"], "duplicate": e["duplicate"], "truncated": e["truncated"], "illegal": e["illegal"], "cost": cost, "audit": audit}


def elements(turns: DataFrame) -> DataFrame:
    """(conv_id, part, whole, element) of each conversation in each range of the sorted turns.

    ``whole`` is false for the first and last conversation of a range, which may go on in the next one.
    """
    kind = turns.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("part", T.LongType()), T.StructField("whole", T.BooleanType()), *_ELEMENT])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ready = TaskContext.get().partitionId(), []

        def conversations() -> Iterator[tuple]:
            def rows() -> Iterator[tuple]:
                for batch in slices(batches):
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

            held, current = [], None
            e = None
            for conv, *row in rows():
                if held and conv != current or len(held) >= 4096:
                    piece = element(held)
                    e, held = piece if e is None else joined(e, piece), []
                if e is not None and conv != current:
                    yield current, e
                    e = None
                current = conv
                held.append(tuple(row))
            if held:
                piece = element(held)
                yield current, piece if e is None else joined(e, piece)

        before, first = None, True
        for conv, e in conversations():
            if before is not None:
                ready.append(before)
            before = {"conv_id": conv, "part": part, "whole": not first} | _packed(e)
            first = False
            if len(ready) >= 512:
                yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                ready = []
        if before is not None:
            ready.append(before | {"whole": False})
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    small_batches(turns.sparkSession)
    order = ["conv_id", "turn", "role", "mark"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.select("conv_id", "turn", "role", "blank", "cut", "n", "later").mapInArrow(run, schema)


def reduced(open_elements: DataFrame) -> DataFrame:
    """One element a conversation, by rounds in which FAN neighbouring parts become one."""
    schema = open_elements.schema
    arrow = arrow_schema(schema)

    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        total = None
        for row in rows:
            e = _unpacked({k: v for k, v in row.items() if k not in ("conv_id", "part", "whole")})
            total = e if total is None else joined(total, e)
        return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "part": rows[0]["part"] // FAN, "whole": False} | _packed(total)], schema=arrow)

    parts, state = open_elements.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0], open_elements
    while True:
        state = state.groupBy("conv_id", F.floor(F.col("part") / FAN).alias("up")).applyInArrow(combine, schema)
        parts = -(-parts // FAN)
        if parts <= 1:
            return state


def structure_report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    found = materialise(elements(counted(narrow(rows))), "elements", small=True)
    schema = T.StructType([found.schema["conv_id"], *REPORT])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [{"conv_id": r["conv_id"]} | _reported(_unpacked({k: v for k, v in r.items() if k not in ("conv_id", "part", "whole")})) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return found.where("whole").unionByName(reduced(found.where("NOT whole"))).mapInArrow(run, schema)


# -- the repaired conversations ------------------------------------------------------


def replay(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns: the audit's edits done on the rows in order."""
    state, rows = 0, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = STEPS[state, role[:1]]
        else:
            state = FREE[state]
            role = "assistant" if state == 3 else "user"
        yield edit, role, text


def repaired_turns(rows: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, at, edit, role, text) of every repaired turn; ``at`` counts from 0.  Sorted within a task, one task a conversation."""
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("at", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    arrow = arrow_schema(schema)
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    body = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long"), role.alias("role"), F.md5(text.cast("binary")).alias("mark"), text.alias("text"))
    heads = report.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("mark"), F.col("audit").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def source() -> Iterator[tuple]:
            for batch in slices(batches):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        stream, ahead = source(), []

        def turns(conv) -> Iterator[tuple[str, str]]:
            for row in stream:
                if row[1] == 0:
                    ahead.append(row)
                    return
                yield row[2], row[3]

        made, size = [], 0
        ahead += [row] if (row := next(stream, None)) else []
        while ahead:
            conv, _, _, audit = ahead.pop()
            own = turns(conv)
            for at, (edit, role, text) in enumerate(replay(audit, own)):
                made.append((conv, at, edit, role, text))
                size += len(text)
                if size > 1 << 20 or len(made) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)
                    made, size = [], 0
            for _ in own:  # the audit's end is the conversation's: this only moves on to the next head
                pass
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    small_batches(rows.sparkSession)
    dealt = body.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "mark")
    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of turns that come as ``repaired_turns`` gives them: ``role:text`` by lines."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = None, None
        for batch in batches:
            made = []
            for conv, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == 0:
                    if held:
                        made.append({"conv_id": current, "repaired_sha256": held.hexdigest()})
                    held, current = hashlib.sha256(), conv
                held.update(f"{chr(10) if at else ''}{role}:{text}".encode())
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist([{"conv_id": current, "repaired_sha256": held.hexdigest()}], schema=arrow)

    return turns.select("conv_id", "at", "role", "text").mapInArrow(run, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired turns) of conversations (conv_id, turn, role, text)."""
    report = materialise(structure_report(rows), "audits", small=True)
    return report, repaired_turns(rows, report)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    report, turns = repair(damage(conversations))
    found, ids = digests(turns), conversations.select("conv_id").distinct()
    made = ids.join(report.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    made = made.join(found.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")), "left").drop("own")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return made.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
