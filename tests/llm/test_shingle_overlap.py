"""The near-copy stage against all pairs, over texts whose SimHash is far apart."""

import random
from fractions import Fraction

import pytest

import corpus_pipeline
from lexigrove.llm import golay_simhash, shingle_overlap


def groups(texts):
    """Component of every text by all pairs of word shingles, without the library."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    boss = list(range(len(texts)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                boss[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    line, out = text(12), []

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return words

    for _ in range(30):  # pairs around 0.8, from one to six changed words of 120
        base = text(120)
        out += [base, edited(base, rng.randint(1, 4)), edited(base, rng.randint(2, 6))]
    hot = text(150)
    out += [edited(hot, rng.randint(0, 4)) for _ in range(60)]  # more than one round's neighbours
    out += [text(rng.randint(2, 15)) + line for _ in range(40)]  # a common line and little else
    return [" ".join(w) for w in out] + ["a b c", "A b  c", "a b", "", None]


def test_stage_keeps_one_of_each_group(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups(texts)
    found = {r["doc_id"]: r["component_id"] for r in golay_simhash.overlapping(docs, Fraction(4, 5), 5).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == sorted(set(want))
    by_bits = golay_simhash.near_duplicates(docs)
    assert by_bits.select("component_id").distinct().count() > len(set(want)) + 20


def test_packed_shingles():
    found = shingle_overlap.shingles("one two three four five six", 5)
    assert len(found) == 2 and (shingle_overlap._unpack(shingle_overlap._pack(found)) == found).all()


@pytest.mark.parametrize("similarity", [None, Fraction(4, 5)])
def test_rows_without_own_id(spark, similarity):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (3, e), (3, e)]  # 7 holds two texts, one of them in the component of 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["text"]) for r in golay_simhash.keep_one(docs, similarity=similarity, shingle=5).collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (None, b), (None, c), (7, d), (3, e)], key=repr)
