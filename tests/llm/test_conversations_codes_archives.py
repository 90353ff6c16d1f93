"""Conversation repair, vector codes and web archives against plain versions, and over odd input."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrove.llm import turn_repair, vector_codes, web_archive

# -- op11 ----------------------------------------------------------------------------

SHAPE = re.compile(r"(s?(ua)+)?\Z")


def plain_edits(turns):
    """Cheapest (cost, audit, roles and texts) over all edit sequences of (role, text, fault), by depth-first search with a bound."""
    best = [None]

    def go(at, cost, audit, made):
        if best[0] is not None and cost > best[0][0]:
            return
        if at == len(turns) and SHAPE.match("".join(r[:1] for r, _ in made)):
            found = (cost, audit, made)
            if best[0] is None or found[:2] < best[0][:2]:
                best[0] = found
        initials = "".join(r[:1] for r, _ in made)
        if at < len(turns):
            role, text, fault = turns[at]
            extra = 3 * (fault == "truncated")
            if fault not in ("blank", "duplicate"):
                go(at + 1, cost + extra, audit + "K", [*made, (role, text)])
                for new in ("user", "assistant"):
                    go(at + 1, cost + extra + 3, audit + "R", [*made, (new, text)])
            go(at + 1, cost + 4, audit + "D", made)
        if len(audit) < 2 * len(turns) + 2 and initials[-2:] not in ("uu", "aa", "ss"):
            for new in ("user", "assistant"):
                go(at, cost + 3, audit + "I", [*made, (new, "")])

    go(0, 0, "", [])
    return best[0]


def plain_scan(turns):
    """The same by one pass: for each last initial the cheapest way so far, all states tried."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    offer = lambda d, k, v: d.__setitem__(k, min(d.get(k, v), v, key=lambda e: e[:2]))

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for last, (cost, audit, made) in list(ways.items()):
                for new in ("user", "assistant"):
                    if new[0] in after[last]:
                        offer(ways, new[0], (cost + 3, audit + "I", [*made, (new, "")]))
        return ways

    ways = {"": (0, "", [])}
    for role, text, fault in turns:
        new = {}
        for last, (cost, audit, made) in inserted(ways).items():
            offer(new, last, (cost + 4, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for to, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if to[:1] and to[0] in after[last]:
                        offer(new, to[0], (cost + extra + price, audit + edit, [*made, (to, text)]))
        ways = new
    return min((v for k, v in inserted(ways).items() if k in ("", "a")), key=lambda e: e[:2])


def test_plain_scan_equals_all_edits():
    rng = random.Random(2)
    for _ in range(150):
        turns = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{k}", rng.choice(["", "", "truncated", "blank"])) for k in range(rng.randrange(4))]
        assert plain_edits(turns) == plain_scan(turns)


def plain_row(rows):
    """The result of one conversation's (turn, role, text) rows after damage, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        letters = re.sub(r"[\x20\x09-\x0d]", "", text)
        faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    numbered = [t for t, *_ in rows if t is not None]
    gaps = max(numbered) - min(numbered) + 1 - len(set(numbered)) if numbered else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, made = plain_scan([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()


def plain_damage(rows):
    made = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else re.sub(r"[.!?]", "", text) if harm == 2 else text
        made[conv] += [(turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    for conv in made:
        made[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return made


def as_rows(frame):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r[1:]) for r in frame.select(*names).collect()}


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(rng.randrange(0, 7)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "what", "", " \t", None, f"t{turn}.", "é … end?  "])
            rows.append((conv, None if rng.random() < 0.1 else turn * rng.choice([1, 1, 2]), role, text))
    return rows


def op11(spark, rows, tmp_path, extra=()):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({n: F.lit(7) for n in extra})
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    return turn_repair.op11_turn_repair(spark, str(tmp_path))


def test_turn_repair_equals_all_edits(spark, talks, tmp_path):
    got = as_rows(op11(spark, talks, tmp_path, ("audit", "mark", "part", "n", "harm", "copy", "kind")))
    after = plain_damage(talks)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: plain_row(after[c]) if after[c] else nothing for c in {r[0] for r in talks}}
    assert got == want


def test_turn_repair_on_given_table(spark):
    import pyarrow.parquet as pq

    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.001/conversations.parquet").select(["conv_id", "turn", "role", "text"]).to_pylist()]
    got = as_rows(turn_repair.op11_turn_repair(spark, "/root/testdata/sf0.001"))
    after = plain_damage(rows)
    assert got == {c: plain_row(after[c]) for c in {r[0] for r in rows} if after[c]} | {c: v for c, v in got.items() if not after[c]}


def test_turn_matrices_are_associative():
    rng = random.Random(3)
    for _ in range(60):
        kinds = "".join(rng.choice("suaoxSUA") for _ in range(rng.randrange(1, 40)))
        left = turn_repair.UNIT
        for k in kinds:
            left = turn_repair.product(left, turn_repair.turn_matrix(k))
        tree = turn_repair.Tree()
        for k in kinds:
            tree.add(k)
        assert tree.value() == left
        cut = rng.randrange(len(kinds))
        halves = [turn_repair.Tree(), turn_repair.Tree()]
        for at, k in enumerate(kinds):
            halves[at >= cut].add(k)
        assert turn_repair.product(halves[0].value(), halves[1].value()) == left


def test_very_long_conversation_goes_over_ranges(spark, tmp_path):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["yes.", "no", "", f"word {t}."])) for t in range(5000)] + [(2, 0, "user", "x.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert turn_repair.elements(turn_repair.counted(turn_repair.narrow(frame))).where("conv_id = 1").count() > 2  # it is in several ranges
        report, turns = turn_repair.repair(frame)
        got = {r["conv_id"]: r for r in report.collect()}[1]
        text = turns.where("conv_id = 1").orderBy("at").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted(rows[:-1], key=lambda r: r[1])
    seen, kinds, counts = set(), [], Counter()
    for _, _, role, t in ordered:
        fault = "blank" if not t else "duplicate" if (role, t) in seen else "truncated" if t[-1] not in ".!?" else ""
        seen.add((role, t))
        counts[fault] += 1
        kinds.append("x" if fault in ("blank", "duplicate") else role[0].upper() if fault else role[0])
    names = {"s": "system", "u": "user", "a": "assistant"}
    short = [(names.get(k.lower(), "user"), "", "blank" if k == "x" else "truncated" if k.isupper() else "") for k in kinds]
    cost, audit, _ = plain_scan(short)
    assert (got["cost"], got["audit"]) == (cost, audit)
    assert [got[n] for n in ("blank", "duplicate", "truncated", "gaps")] == [counts["blank"], counts["duplicate"], counts["truncated"], 0]
    assert [(r["role"], r["text"]) for r in text] == [(r, t) for _, r, t in turn_repair.replay(audit, [(r, t) for _, _, r, t in ordered])]
    assert SHAPE.match("".join(r["role"][0] for r in text))


def test_repeated_rows_and_ties(spark, tmp_path):
    rows = [(4, 2, "user", "A."), (4, 2, "user", "A."), (4, 2, "assistant", "B."), (4, 2, "user", "C."), (4, 7, "user", "A."), (4, 7, "user", None)] * 3
    after = plain_damage(rows)
    assert as_rows(op11(spark, rows, tmp_path))[4] == plain_row(after[4])


def test_no_conversations(spark, tmp_path):
    assert op11(spark, [], tmp_path).collect() == []


# -- op12 ----------------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(i, [near(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    sums = Counter()
    for _, found, label in coded:
        sums[label] += sum(d for d, _ in found)
    return sorted((repr(i), "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), sums[label], digest) for i, found, label in coded)


def op12(spark, rows, tmp_path):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({n: F.lit("x") for n in ("code", "error", "whole_vector", "slot")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted((repr(r[0]), *r[1:]) for r in vector_codes.op12_vector_codes(spark, str(tmp_path)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def vectors(seed, n, dims=64, coarse=False):
    rng = np.random.default_rng(seed)
    v = rng.integers(-3, 4, (n, dims)) / 256 if coarse else rng.normal(0, 0.3, (n, dims))
    return [(int(i) * 3 + 1, [float(x) for x in np.float32(v[i])], int(rng.integers(0, 4)) or None) for i in range(n)]


@pytest.mark.parametrize("coarse", [False, True])
def test_codes_equal_plain_version(spark, tmp_path, coarse):
    rows = vectors(4, 260, coarse=coarse)
    rows += [(None, rows[0][1], 1), (rows[3][0], rows[7][1], None), rows[5], (-4, None, 2), (-5, [None] * 64, 2), (-6, [math.nan] * 64, 2), (-7, [math.inf] + [0.0] * 63, 2)]
    random.Random(1).shuffle(rows)
    assert op12(spark, rows, tmp_path) == plain_codes(rows)


def test_codes_of_few_or_no_vectors(spark, tmp_path):
    rows = vectors(6, 5)
    assert op12(spark, rows, tmp_path / "few") == plain_codes(rows)
    assert op12(spark, [], tmp_path / "none") == []
    assert op12(spark, [(1, None, 1), (2, [], 1), (3, [1.0] * 15, 1)], tmp_path / "bad") == []
    mixed = [*rows, (1000, [1.0] * 32, 1), (1001, [1e30] * 64, 1)]
    assert op12(spark, mixed, tmp_path / "mixed") == plain_codes(rows)


def test_exponion_search_equals_scan_and_scans_less():
    rng = np.random.default_rng(2)
    books = rng.integers(-200, 200, (4, 64, 4))
    points = rng.integers(-200, 200, (500, 16))
    search = vector_codes.Search(books)
    d = ((points.reshape(500, 4, 1, 4) - books[None]) ** 2).sum(axis=3)
    for start in (np.zeros((500, 4)), rng.integers(0, 64, (500, 4)), d.argmin(axis=2)):
        codes, errors = search.nearest(points, start)
        assert (codes == d.argmin(axis=2)).all() and (errors == d.min(axis=2)).all()


# -- op13 ----------------------------------------------------------------------------


def plain_pages(rows):
    least = {}
    for i, _, html in rows:
        h = html or ""
        least[h] = min(least.get(h, (True, 0)), (i is None, i or 0))
    made, used = [], set()
    for i, _, html in rows:
        h = html or ""
        first = least[h] == (i is None, i or 0) and h not in used
        if first:
            used.add(h)
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        made.append((i, len(h.encode()), digest, "response" if first else "revisit", None if first or least[h][0] else least[h][1]))
    return sorted(map(repr, made))


def test_archives_equal_plain_version(spark, tmp_path):
    rows = [(5, "http://a b/c\nd", "x"), (3, None, "x"), (None, "", "x"), (7, "u", None), (6, "u", ""), (6, "u", ""), (8, "http://é", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (9, "u", "y" * 9_000_000), (None, "u", "n"),
            *[(100 + k, f"http://h/{k}", f"<p>{k % 37}</p>\r\n\r\n") for k in range(400)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("archive", "content", "payload", "keeper")}).repartition(5)
    found = web_archive.archive_pages(pages, f"{tmp_path}/warc")
    assert sorted(repr((r["source_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in found.collect()) == plain_pages(rows)
    assert found.where("NOT digest_ok").count() == 0
    whole = web_archive.read_warc(spark, f"{tmp_path}/warc")
    ids = {r["record_id"]: r for r in whole.collect()}
    texts = {i: h or "" for i, _, h in rows}
    assert len(ids) == len(rows) and all(ids[r["refers_to_id"]]["record_type"] == "response" for r in ids.values() if r["record_type"] == "revisit")
    assert all(bytes(r["payload"]).decode() == texts[r["source_id"]] for r in ids.values() if r["record_type"] == "response" and r["source_id"] is not None)


def test_short_payloads_are_all_responses(spark, tmp_path):
    rows = [(k, "u", "ab" if k % 2 else "abc") for k in range(10)]
    found = web_archive.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w", min_bytes=3).collect()
    assert Counter((r["payload_bytes"], r["record_type"]) for r in found) == {(2, "response"): 5, (3, "response"): 1, (3, "revisit"): 4}


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert web_archive.op13_warc(spark, str(tmp_path)).collect() == []


def test_foreign_legacy_archives(spark, tmp_path):
    """Both versions, packed record by record or plain, with records of other kinds and damage."""
    record = lambda line, body: line + b" %d\n" % len(body) + body + b"\n"
    one = record(b"filedesc://one.arc 0.0.0.0 19980101000000 text/plain", b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n")
    one += record(b"http://a.b/with blank 1.2.3.4 19980102030405 text/html", b"HTTP/1.0 200 OK\nServer: x\n\n<p>\n\nhi") + b"\n" + record(b"dns:a.b 1.2.3.4 1998 text/dns", b"a.b. 1 IN A 1.2.3.4")
    two = record(b"filedesc://two.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 two.arc", b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n")
    parts = [two, record(b"http://c/ 5.6.7.8 20010102030405 text/html 404 abc http://d/ 77 two.arc", b"HTTP/1.0 404 No\r\n\r\ngone")]
    folder = tmp_path / "arcs"
    folder.mkdir()
    (folder / "one.arc").write_bytes(one + b"broken line\nrest")
    (folder / "two.arc.gz").write_bytes(b"".join(gzip.compress(p) for p in [*parts, b"http://e/ 5.6.7.8 20010102030405 text/html 200 abc - 99 two.arc 500\nshort"]))
    (folder / "empty.arc").write_bytes(b"")
    web_archive.write_warc(web_archive.convert(web_archive.read_archives(spark, str(folder))), f"{tmp_path}/w")
    got = {r["uri"]: r for r in web_archive.read_warc(spark, f"{tmp_path}/w").collect()}
    assert (got["http://a.b/with blank"]["record_type"], got["http://a.b/with blank"]["time"], bytes(got["http://a.b/with blank"]["payload"])) == ("response", "1998-01-02T03:04:05Z", b"<p>\n\nhi")
    assert (got["dns:a.b"]["record_type"], got["dns:a.b"]["time"], bytes(got["dns:a.b"]["payload"])) == ("resource", "1998-01-01T00:00:00Z", b"a.b. 1 IN A 1.2.3.4")
    assert bytes(got["http://c/"]["payload"]) == b"gone" and bytes(got["http://e/"]["payload"]) == b"short" and bytes(got["-"]["payload"]) == b"broken line\nrest"
    assert len(got) == 5


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_warc"])
def test_equals_sql(spark, name):
    import duckdb

    from lexigrove.llm import registry

    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    found = con.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect())
