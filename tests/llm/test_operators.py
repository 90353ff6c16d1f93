"""Each corpus operator against a plain version of itself, and over odd input."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrove.llm import decontaminate, golay_simhash, html_extract, importance_resampling, language_mixture, piece_codec, piecewise_hash, suffix_dedup, token_store, url_filter

ODD = [(None, None), (1, ""), (2, None), (3, "a"), (3, "a"), (4, "word " * 3000), (5, " \n\t "), (6, "Ünïcode … text 🎉"), (7, "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit("en"), "score": F.lit("x"), "N_BYTES": F.lit(1), "component_id": F.lit(2), "token_ids": F.lit(3)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(rng, n, kinds=400):
    return " ".join(f"w{int(rng.random() ** 2 * kinds)}" for _ in range(n))


# -- op1 -----------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<div id="content"><div class="sidebar">Links</div><article><h2>Head &amp; line</h2><p>First,  para<br>graph with <b>bold</b>,
words and more words, to make it long enough to score, of course.</p><p>Second &eacute; para.<p>Third without end
<form><input value="x">Send</form><div class="comments"><p>Nice post, thanks, bye.</p></div></article></div><aside>Ad</aside><footer>Foot</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html_extract.extract_text(PAGE) == "Head & line\n\nFirst, para graph with bold, words and more words, to make it long enough to score, of course.\n\nSecond é para.\n\nThird without end"


def test_html_without_article_takes_the_densest_container():
    text = "Sentence one, with commas, and words. " * 8
    page = f"<html><body><div class='menu'><a href='x'>{'link ' * 50}</a></div><div><div><p>{text}</p><p>{text}</p></div></div><div class='footer'>f</div></body></html>"
    assert html_extract.extract_text(page) == "\n\n".join([text.strip()] * 2)


def test_html_odd_input(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "plain &lt; text"), (5, "u", "<div" * 2000), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<p>x"), (7, "u", "<p>x")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 8 and by[1]["text"] == "" and by[2]["n_chars"] == 0 and by[None]["text"] == "x" and by[4]["text"] == "plain < text" and by[6]["text"] == "deep"


# -- op2 -----------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["http://A.example.NET/en/1?x", "https://b.net/", "http://net/x#/y", "http://notnet/x", "http://x.org/fr/", "http://x.org/FR/", "http://example.com/de", "http://example.com/de/z", "no scheme", None, "", "x://", "http://b.net?q", "http://b.net/en/ http://example.net/en/"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("Host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(rows, url_filter.rules_frame(spark, url_filter.RULES)).collect()}

    def expected(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:at], rest[at:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    assert got == {i: expected(u) for i, u in enumerate(urls)}


def test_bloom_filter_passes_no_wrong_host(spark):
    rules = [(f"h{i}.example", "/", "block") for i in range(500)]
    urls = spark.createDataFrame([(i, f"http://h{i}.example/") for i in range(1500)], "page_id long, url string")
    got = url_filter.judge_urls(urls, url_filter.rules_frame(spark, rules))
    assert got.where("verdict = 'block'").count() == 500 and got.where("verdict = 'block' and page_id >= 500").count() == 0
    assert url_filter.judge_urls(urls, url_filter.rules_frame(spark, [])).where("verdict = 'allow'").count() == 1500


# -- op3 -----------------------------------------------------------------------------

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def in_chunks(codec, text, size):
    prepared = codec.prepare(text)
    if not prepared:
        return []
    parts = list(piece_codec._split(prepared, size, codec.longest))
    states = piece_codec.solve([codec.transfer(t, c, e) for _, c, e, t in parts])
    return [i for (_, c, e, t), (a, b) in zip(parts, states) for i in codec.trace(t, c, e, a, b)]


@settings(max_examples=40, deadline=None)
@given(text=st.text(alphabet="ab cdeghinort .,é日🎉", max_size=80), size=st.integers(3, 40))
def test_chunked_bpe_equals_the_library(library, text, size):
    codec = piece_codec.model(PIECES)
    expected = library.encode(text)
    assert codec.encode(text) == expected and in_chunks(codec, text, size) == expected
    assert codec.decode(expected) == library.decode(expected)


@settings(max_examples=25, deadline=None)
@given(text=st.text(alphabet="ab cdeghinort .,é", max_size=60), size=st.integers(3, 30))
def test_chunked_unigram_reaches_the_best_weight(text, size):
    codec = piece_codec.model(PIECES, True)
    weight = lambda ids: sum(codec.scores[i] if i not in codec.byte_of else 0.0 for i in ids)
    assert weight(in_chunks(codec, text, size)) == pytest.approx(weight(codec.encode(text)))


def test_max_plus_product_is_associative():
    rng = random.Random(1)
    a, b, c = ({i: {j: rng.random() for j in range(4) if rng.random() < 0.8} for i in range(4)} for _ in range(3))
    left, right = piece_codec.combine(piece_codec.combine(a, b), c), piece_codec.combine(a, piece_codec.combine(b, c))
    assert {k: pytest.approx(v) for k, v in left.items()} == right


def test_encode_documents(spark, odd, none, library):
    got = piece_codec.encode_documents(odd, PIECES, chunk=200, decoded="back").collect()
    assert len(got) == len(ODD) and {"lang", "N_BYTES"} <= set(got[0].asDict())
    for r in got:
        assert r["token_ids"] == library.encode(r["text"] or "") and r["back"] == (r["text"] or "")
    assert piece_codec.encode_documents(none, PIECES).count() == 0


# -- op4 -----------------------------------------------------------------------------


def test_fingerprints(spark, odd, none):
    got = sorted(piecewise_hash.fingerprint_edits(odd).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    texts = [t or "" for _, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    for i, r in enumerate(got):
        changed = piecewise_hash.edited(texts[i], texts[(i + 1) % len(texts)]).encode()
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(texts[i]), hashlib.sha256(changed).hexdigest(), piecewise_hash.fingerprint(texts[i].encode()))
        assert r["edited_fingerprint"] == piecewise_hash.fingerprint(changed) and 0 <= r["near_edited"] <= 1
    assert piecewise_hash.fingerprint_edits(none).count() == 0


def test_next_document_across_ranges(spark):
    rng = random.Random(2)
    rows = [(i * 3, words(rng, rng.randint(0, 60))) for i in range(80)]
    got = {r["doc_id"]: r["near_next"] for r in piecewise_hash.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()}
    prints = [piecewise_hash.fingerprint(t.encode()) for _, t in rows]
    assert got == {rows[i][0]: piecewise_hash.likeness(prints[i], prints[(i + 1) % 80]) for i in range(80)}


def plain_signature(raw, block):
    """The signature by its definition: the rolling hash of the last seven bytes at each place, computed anew."""
    out, start, before = [], 0, None
    for i in range(len(raw)):
        window = bytes(7) + raw[: i + 1]
        window = window[-7:]
        total, weighted, mixed = sum(window), 0, 0
        for back, byte in enumerate(reversed(window)):
            weighted += byte * (7 - back)
            mixed ^= byte << 5 * back & 0xFFFFFFFF
        value = (total + weighted + (mixed & 0xFFFFFFFF)) & 0xFFFFFFFF
        if (value + 1) % block == 0 and value != before and i + 1 < len(raw):
            out.append(piecewise_hash._ALPHABET[zlib.crc32(raw[start : i + 1]) & 63])
            start = i + 1
        before = value
    return "".join(out) + piecewise_hash._ALPHABET[zlib.crc32(raw[start:]) & 63]


@pytest.mark.parametrize("raw", [b"a", b"(" * 4000, b"()" * 3000, words(random.Random(7), 900).encode(), "Ünïcode … text 🎉 ".encode() * 40, bytes(range(256)) * 9])
def test_signature_by_definition_and_bounded(raw):
    block, first, second = piecewise_hash.fingerprint(raw).split(":")
    block = int(block)
    assert (first, second) == (plain_signature(raw, block), plain_signature(raw, 2 * block))
    assert len(first) <= 64 and (block == 3 or len(plain_signature(raw, block // 2)) > 64)


def test_likeness_of_an_edit_and_of_strangers():
    rng = random.Random(3)
    base, other = words(rng, 600, 5000), words(rng, 600, 9000)
    a, b, c = (piecewise_hash.fingerprint(t.encode()) for t in (base, base[:1500] + "xyz" + base[1510:], other))
    assert piecewise_hash.likeness(a, a) == 1 and piecewise_hash.likeness(a, b) > 0.8 and piecewise_hash.likeness(a, c) < 0.3


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcd", max_size=12), st.text(alphabet="abcd", max_size=12))
def test_common_letters(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    assert piecewise_hash.common_letters(a, b) == row[-1]


# -- op5 -----------------------------------------------------------------------------


def repeated_corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [words(rng, 40) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [words(rng, rng.randint(0, 40)) for _ in range(2)]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 2), rng.choice(passages)[rng.randint(0, 30) :])
        text = " é".join(parts)
        if rng.random() < 0.2 and out:
            old = rng.choice(out)[1]
            text = old[: len(old) // 2] + "~" + old[len(old) // 2 :]
        if rng.random() < 0.1:
            text = ("ha " * 80) + text
        out.append((i, text))
    return out


@pytest.mark.parametrize("block", [1 << 22, 3000])
def test_suffix_dedup_equals_brute_force(spark, block):
    rows = repeated_corpus(5) + [(60, None), (61, "")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True, block_bytes=block).collect()}
    expected = suffix_dedup.brute_force([(t or "").encode() for _, t in rows])
    assert got == {i: (a, b, c, hashlib.sha256(k).hexdigest()) for (i, _), (a, b, c, k) in zip(rows, expected)}
    assert sum(g[1] for g in got.values()) > 5000


def test_suffix_dedup_odd(spark, odd, none):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and sum(r["text"] is None for r in got) == 2 and {r["lang"] for r in got} == {"en"}
    assert suffix_dedup.remove_repeats(none).count() == 0
    twice = spark.createDataFrame([(1, "x" * 50 + words(random.Random(1), 80))] * 2, "doc_id long, text string")
    assert sorted(r["n_removed"] > 0 for r in suffix_dedup.remove_repeats(twice).collect()) == [False, True]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=8), max_size=20))
def test_previous_factor_lengths(strings):
    raw = [s.encode() for s in strings]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert suffix_dedup.longest_previous_factors(raw) == [max([common(s, t) for t in raw[:i]], default=0) for i, s in enumerate(raw)]


@pytest.mark.parametrize("hot", [1, 4, 10**6])
def test_hot_anchors_give_the_same(spark, hot):
    rng = random.Random(12)
    line = "the very same line of text that stands in every document of this source "
    passage = words(rng, 40)
    rows = [(i, words(rng, rng.randint(3, 30)) + " " + line * rng.randint(1, 2) + (passage if rng.random() < 0.3 else "") + words(rng, rng.randint(0, 30))) for i in range(90)]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), digest=True, block_bytes=2000, hot=hot).collect()}
    assert got == {i: (b, c, hashlib.sha256(k).hexdigest()) for (i, _), (_, b, c, k) in zip(rows, suffix_dedup.brute_force([t.encode() for _, t in rows]))}


# -- op6 -----------------------------------------------------------------------------


def test_resampling_keeps_good_text(spark, none):
    rng = random.Random(4)
    rows = [(i, words(rng, 80)) for i in range(300)] + [(300 + i, " ".join(f"{w}%%%" for w in words(rng, 60).split())) for i in range(60)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_score", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)] + [(300 + i, 0) for i in range(0, 60, 2)] + [(None, 1), (5, None)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in importance_resampling.keep_good(docs, labels).collect()}
    assert set(range(300)) - kept == set() and not kept & set(range(300, 402))
    assert importance_resampling.keep_good(none, labels).count() == 0
    assert importance_resampling.keep_good(docs, labels.where("quality > 5")).count() == 360


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [round(rng.gauss(0, 1), 2) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 1500, 2999):
        assert importance_resampling.kth_largest(rows, k, bins=16, collect=20) == sorted(values, reverse=True)[k - 1]
    assert importance_resampling.kth_largest(rows, 0) == float("inf") and importance_resampling.kth_largest(rows, 3000) == float("-inf")


# -- op7 -----------------------------------------------------------------------------

SAMPLES = {"en": "the quick brown fox and the lazy dog were walking through the old town", "de": "der schnelle braune fuchs und der faule hund gingen durch die alte stadt", "fr": "le rapide renard brun et le chien paresseux marchaient dans la vieille ville"}


def test_language(spark, odd, none):
    rng = random.Random(7)
    make = lambda k, n: " ".join(rng.choice(SAMPLES[k].split()) for _ in range(n))
    rows = [(i, list(SAMPLES)[i % 3], make(list(SAMPLES)[i % 3], 60)) for i in range(90)]
    model = language_mixture.train(spark.createDataFrame(rows, "key long, lang string, text string"))
    assert [model.infer(make(k, 40))[0] for k in SAMPLES] == list(SAMPLES)
    mixed = model.infer(make("en", 200) + " " + make("de", 100))
    assert mixed[0] == "en" and set(mixed[2]) == {"en", "de"} and mixed[1] == pytest.approx(2 / 3, abs=0.15)
    assert model.infer("123 ...")[0] == "und" and model.infer(None) == ("und", 0.0, {})
    got = language_mixture.predict(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    empty = language_mixture.train(spark.createDataFrame([], "key long, lang string, text string"))
    assert {r["lang_pred"] for r in language_mixture.predict(odd, empty).collect()} == {"und"} and language_mixture.predict(none, model).count() == 0


# -- op8 -----------------------------------------------------------------------------


def test_simhash_bits():
    text = "One two  three\tfour"
    parts = ["one two three", "two three four"]
    count = [sum(xxhash.xxh64_intdigest(p.encode(), 42) >> b & 1 for p in parts) for b in range(64)]
    assert golay_simhash.simhash(text) == sum(1 << b for b in range(64) if 2 * count[b] > 2)
    assert golay_simhash.simhash("Only Two") == xxhash.xxh64_intdigest(b"only two", 42) and golay_simhash.simhash(" ") == golay_simhash.simhash(None) == 0


def test_golay_code_is_perfect():
    from math import comb

    words_ = np.arange(1 << 15, dtype=np.uint32) * np.uint32(173) % np.uint32(1 << 23)
    assert sum(comb(23, k) for k in range(4)) * 4096 == 1 << 23
    assert set(len(set(k)) for k in golay_simhash.segment_keys(words_).tolist()) == {1, 6}


def test_links_are_complete(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    prints = set(base.tolist())
    for b in base.tolist() * 6:
        for _ in range(rng.integers(1, 5)):
            b ^= 1 << int(rng.integers(0, 64))
        prints.add(b)
    prints = sorted(prints)
    boss = list(range(len(prints)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                boss[find(i)] = find(j)
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    links = golay_simhash.link_fingerprints(rows, chunk=8)
    joined = {r["node"]: r["root"] for r in golay_simhash.components(links).collect()}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    same = lambda i, j: joined.get(signed[i], signed[i]) == joined.get(signed[j], signed[j])
    assert all(same(i, j) == (find(i) == find(j)) for i in range(len(prints)) for j in range(i))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["root"] for r in golay_simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_near_duplicates_odd(spark, odd, none):
    got = {(r["doc_id"], r["component_id"]) for r in golay_simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (5, 1), (None, 1), (3, 3), (7, 3)} <= got
    kept = [r["doc_id"] for r in golay_simhash.keep_one(odd).collect()]
    assert sorted(kept) == [1, 3, 4, 6] and golay_simhash.near_duplicates(none).count() == 0


# -- op9 -----------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abc ", max_size=60), st.lists(st.text(alphabet="abc ", max_size=20), max_size=5), st.integers(1, 4))
def test_automaton_equals_brute_force(text, items, window):
    items = list(enumerate(items))
    n, hit, keys = decontaminate.brute_force(text, items, window)
    found, got = decontaminate.Automaton([(k, decontaminate.words_of(t)) for k, t in items], window).match(decontaminate.words_of(text))
    assert {i for s, e in found for i in range(s, e)} == hit and got == keys


def test_decontaminate(spark, odd, none):
    rng = random.Random(9)
    items = [(i, words(rng, 30)) for i in range(6)] + [(6, "tiny item"), (7, ""), (8, None), (None, "x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(0, words(rng, 100) + " " + items[2][1]), (1, words(rng, 100)), (2, "A TINY, item!"), (3, items[4][1].upper()), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for most in (10**6, 40):  # one automaton, and several
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs.drop("n_words"), benchmark, max_words=most).collect()}
        for i, text in rows:
            n, hit, keys = decontaminate.brute_force(text, [x for x in items if x[0] is not None])
            assert (got[i]["n_words"], sum(x["e"] - x["s"] for x in got[i]["hit_spans"]), got[i]["hit_items"]) == (n, len(hit), sorted(map(str, keys)))
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, benchmark).collect()} == {1, 4, 5}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, remove="spans").collect()}
    assert cut[3] == "" and cut[2] == "A !" and cut[1] == rows[1][1] and len(cut) == 6
    assert decontaminate.find_contamination(odd, benchmark.limit(0)).count() == len(ODD) and decontaminate.decontaminate(none, benchmark).count() == 0


# -- op10 ----------------------------------------------------------------------------

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    ids = np.arange(100, dtype=np.uint16)
    back, ef = token_store.read_segment(token_store.write_segment(ids, values, 2))
    assert (back == ids).all() and (ef.all() == values).all() and [ef.select(k) for k in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    ends = np.cumsum(np.full(10_000, 700))
    ef = token_store.EliasFano.of(ends)
    assert 8 * (len(ef.low) + len(ef.high) + len(ef.samples)) < 14 * len(ends)
    with pytest.raises(ValueError):
        token_store.read_segment(token_store.write_segment(np.zeros(3, np.uint16), np.array([1, 3]), 2)[:-1])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abT.,'s %é \n\t\x1c\xa0İΣ1<|>", max_size=40))
def test_word_encoder(text):
    encoder = token_store.WordEncoder(WORDS)
    assert encoder.encode(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(spark, odd, none):
    segments = token_store.encode_segments(odd, WORDS, range_bytes=4000)
    got = sorted((r for r in token_store.read_back(token_store.materialise(segments, "t")).collect()), key=lambda r: r["start"])
    encoder = token_store.WordEncoder(WORDS)
    order = {r["i"]: r["h"] for r in spark.createDataFrame([(i, t or "") for i, (_, t) in enumerate(ODD)], "i int, t string").select("i", F.xxhash64("t").alias("h")).collect()}
    rows = [r for _, r in sorted(enumerate(ODD), key=lambda x: (x[1][0] is not None, x[1][0] or 0, order[x[0]]))]
    start = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = [*encoder.encode(text or "").tolist(), 1]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.read_back(token_store.materialise(token_store.encode_segments(none, WORDS), "t")).count() == 0
