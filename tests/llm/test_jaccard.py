"""Links and components of near copies against brute force."""

import re

import numpy as np
import pytest

from corpusbench.llm import jaccard
from corpusbench.llm.graph import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    of = {k: k for k in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), find(k)) for k in sets}


def corpus(seed, n=150):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "ÉTÉ", "a\x1cb", "x"]
    base = [list(rng.choice(vocabulary, rng.integers(1, 90))) for _ in range(8)]
    passage = list(rng.choice(vocabulary, 20))
    rows = []
    for k in range(n):
        words = list(base[rng.integers(0, 8)]) if rng.random() < 0.8 else list(rng.choice(vocabulary, rng.integers(1, 60)))
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = str(rng.choice(vocabulary))
        if rng.random() < 0.3:
            words = words + passage
        rows.append((int(k * 3 + 1), " \t\n"[rng.integers(0, 3)].join(words)))
    return rows


@pytest.mark.parametrize(("seed", "common", "slice_"), [(1, 8, 4096), (2, 3, 7), (3, 10**9, 5)])
def test_against_brute_force(spark, monkeypatch, seed, common, slice_):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    rows = corpus(seed) + [(9001, None), (9002, ""), (9003, " \n"), (9004, "One two"), (9005, "one TWO"), (9006, "two one")]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, component long_, rep int".replace("long_", "string")).repartition(4)
    assert {tuple(r) for r in jaccard.near_copies(docs).collect()} == brute(rows)


def test_repeats_nulls_and_empty(spark):
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(4, text), (4, text), (2, text + " x"), (None, text), (7, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.near_copies(docs).collect()), key=str)
    assert got == sorted([(4, 26, 2), (4, 26, 2), (2, 27, 2), (None, 26, None), (7, 0, 7)], key=str)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in jaccard.keep_one_of_each(docs).collect()) == [(False, 2), (False, 7), (True, 0)]
    assert jaccard.near_copies(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_kept_by_their_text(spark):
    x = " ".join(f"x{k}" for k in range(40))
    y, z = " ".join(f"y{k}" for k in range(40)), "one two"
    rows = [(1, x + " tail"), (2, x), (2, y), (2, y), (3, y + " tail"), (4, z), (4, None), (4, ""), (5, z), (6, None), (None, x), (None, x), (7, x + " more"), (7, z.upper())]
    docs = spark.createDataFrame([(*r, b"d", 1) for r in rows], "doc_id long, text string, digest binary, rep int").repartition(3)
    kept = jaccard.keep_one_of_each(docs)
    got = sorted(((r["doc_id"], r["text"] or None) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    assert got == sorted([(1, x + " tail"), (2, y), (4, z), (4, None), (6, None), (None, x), (None, x)], key=str)
    assert jaccard.keep_one_of_each(docs.limit(0)).count() == 0


def test_bit_counts_never_miss():
    rng = np.random.default_rng(8)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 80), dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64))))
        if len(b):
            both = len(np.intersect1d(a, b))
            width = min(len(jaccard.bitmap(a)), len(jaccard.bitmap(b))) * 8
            allowed = jaccard.possible(jaccard.folded([jaccard.bitmap(a)], width), np.array([len(a)]), jaccard.folded([jaccard.bitmap(b)], width), np.array([len(b)]), 80)[0, 0]
            assert allowed or 100 * both < 80 * (len(a) + len(b) - both)


def test_packed_prefixes():
    rng = np.random.default_rng(2)
    key = rng.integers(0, 2**64, 500, dtype=np.uint64)
    key = key[np.argsort(key & np.uint64(2**40 - 1))]
    cls, n = rng.integers(-(2**63), 2**63, 500), rng.integers(1, 10**6, 500)
    got = jaccard.unpacked_prefixes(jaccard.packed_prefixes(key, cls, n))
    assert (got[0] == (key & np.uint64(2**40 - 1))).all() and (got[1] == cls).all() and (got[2] == n).all()


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {tuple(r) for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {(k, 0) for k in range(41)} | {(100, 100), (101, 100), (200, 200), (300, 200), (250, 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
