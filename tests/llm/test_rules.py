"""Quality rules and benchmark decontamination."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusbench.llm import decontam, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_base_counts(spark):
    texts = [None, "", " \n\t ", "a b", "a b c d e a b c d e", "x " * 30, "é|ü 😀 #b\n\nq\nq\n q\nq", "a\x0bb\x0cc\rd\x1ce\xa0f", "a a a a a a", "1 2 3 4 5 6 7 8 9 10 11",
             "l m n o p q r s t u v w l m n o p", "line one\nline two\nline one\n" * 4]
    docs = spark.createDataFrame([(k, t, None, "s", 1) for k, t in enumerate(texts)], "doc_id long, text string, lang string, words string, hashes int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k])[1:7] == counts(t), (k, t)
        assert got[k]["kept"] == (not counts(t)[5])
    assert quality.quality_rules(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(("n", "risk", "level"), [(10, 0.05, 0.05), (100, 0.05, 0.01), (2000, 0.005, 0.003), (5000, 0.02, 0.05), (0, 0.1, 0.05), (59, 0.05, 0.05), (200_000, 0.02, 0.0125), (3_000_000, 0.02, 0.05)])
def test_exact_bound(spark, n, risk, level):
    total, most = 0.0, -1
    for k in range(n + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(risk) + (n - k) * math.log1p(-risk))
        if total > level:
            break
        most = k
    row = spark.range(1).select(quality.most_failures(F.lit(n), risk, F.lit(level)).alias("k")).first()
    assert row["k"] == most


def test_cutoffs_hold_the_risk(spark):
    good = [(k, "en", 2 if k % 400 == 0 else 0, 100) for k in range(4000)]
    bad = [(10_000 + k, "en", 30, 100) for k in range(50)]
    few = [(20_000 + k, "xx", 60, 100) for k in range(20)] + [(30_000, None, 60, 100)]
    zero = {c: F.lit(0).cast("long") for c in ("n_capitals", "n_dup_lines", "n_repeat_words")}
    docs = spark.createDataFrame(good + bad + few, "doc_id long, lang string, n_symbols long, word_chars long").withColumns(
        zero | {"n_lines": F.lit(1), "n_words": F.lit(50), "base_failed": F.lit(False)})
    labels = spark.createDataFrame([(r[0], 1 if r[0] < 10_000 else 0) for r in good + bad] + [(20_000, 1)], "doc_id long, quality int")
    cut = {r["lang"]: r for r in quality.choose_cutoffs(docs, labels).collect()}
    assert cut["en"]["cut_symbols"] == 0.05 and cut["en"]["n_good"] == 4000
    assert cut["xx"]["cut_symbols"] is None


def test_small_languages_get_cutoffs(spark):
    """300 good labels in each of four languages are enough at the default risk, and junk is rejected in each."""
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1000 * j + k, words + (" ## ## ## ##" if k >= 300 else ""), lang, int(k < 300)) for j, lang in enumerate(("en", "de", "fr", None)) for k in range(310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    labels = docs.select("doc_id", "quality")
    got = quality.quality_rules(docs, labels)
    assert {r["doc_id"] for r in got.where("not kept").collect()} == {r[0] for r in rows if not r[3]}
    shares = {(r["lang"], r["quality"]): tuple(r)[2:] for r in quality.rejected_shares(got, docs, labels).collect()}
    assert shares == {(lang, q): (300, 0, 0, 0.0) if q else (10, 0, 10, 1.0) for lang in ("en", "de", "fr", None) for q in (0, 1)}


def test_risk_is_that_of_all_rules_together(spark):
    """1,000 good labels allow fewer than 16 rejections: 8 by one rule pass, 8 and 8 others by two do not."""
    odd = {"a": 8, "b": 8}
    rows = [(10_000 * j + k, lang, 6 if k < 8 else 0, 45 if lang == "b" and 8 <= k < 16 else 0) for j, lang in enumerate(odd) for k in range(1000)]
    counts = spark.createDataFrame(rows, "doc_id long, lang string, n_symbols long, n_capitals long").withColumns(
        {"word_chars": F.lit(100), "n_dup_lines": F.lit(0), "n_lines": F.lit(1), "base_failed": F.lit(False)})
    cut = {r["lang"]: r for r in quality.choose_cutoffs(counts, counts.select("doc_id", F.lit(1).alias("quality"))).collect()}
    assert (cut["a"]["cut_symbols"], cut["a"]["cut_capitals"], cut["a"]["cut_lines"]) == (0.05, 0.4, 0.3)
    assert (cut["b"]["cut_symbols"], cut["b"]["cut_capitals"], cut["b"]["cut_lines"]) == (0.07, 0.4, 0.3)


def shingles_of(text, n):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def leaks(docs, items, share=0.8):
    out = set()
    for i, q in items:
        n = min(5, len(WORD.findall(q or "")))
        s = shingles_of(q, n) if n else set()
        for d, t in docs:
            both = len(s & shingles_of(t, n))
            if s and both >= share * len(s) - 1e-9:
                out.add((d, i, both, len(s)))
    return out


def test_leaks(spark):
    item = [" ".join(f"q{k}x{j}" for j in range(n)) for k, n in enumerate((5, 6, 9, 14, 40, 4))]
    cut = item[4].split()
    texts = ["pad " * 50 + item[0].upper() + " end", "z " + item[4] + " " + item[3], " ".join(cut[:30]), " ".join(cut[:36]), " ".join(cut[2:]) + " tail", item[5], "", None, item[2] * 2,
             "b " + " ".join(item[3].split()[:12]) + " c"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0])]
    docs = spark.createDataFrame([(*r, 1, "i") for r in rows] + [(None, item[4], 1, "i")], "doc_id long, text string, item_id int, h string")
    items = spark.createDataFrame([(k, t, 1) for k, t in enumerate(item)] + [(3, item[3], 1), (9, None, 1), (10, "", 1), (None, item[2], 1)], "item_id long, text string, doc_id int")
    got = {tuple(r)[:4] for r in decontam.contaminated_pairs(docs, items).collect()}
    assert got == leaks(set(rows), set((k, t) for k, t in enumerate(item)))
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows} - {g[0] for g in got}  # the row without an id holds an item too
    assert decontam.contaminated_pairs(docs.limit(0), items).count() == 0 and decontam.contaminated_pairs(docs, items.limit(0)).count() == 0


def test_short_items(spark):
    items = [(1, "solo"), (2, "Two Words"), (3, "three of these"), (4, "one two three four"), (5, "a b c d e"), (6, "solo "), (7, " "), (8, None)]
    texts = ["x SOLO y", "solos", "two words", "two  words more", "three of\nthese", "three of those", "one two three four", "one two three", "a b c d e", "a b c d", "", None, "solo two words three of these " * 2000]
    docs = [(k, t) for k, t in enumerate(texts)]
    got = decontam.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r)[:4] for r in got.collect()} == leaks(docs, items) and got.columns == ["doc_id", "item_id", "n_shared", "n_item", "containment"]


def test_many_sizes_against_brute_force(spark):
    """Items of 1 to 200 words, whole, cut and broken inside longer and shorter documents."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 17, 30, 31, 60, 200])]
    docs = []
    for k in range(150):
        _, q = rng.choice(items)
        w = q.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = word()
        w = w[: max(1, rng.choice([len(w), len(w), int(0.85 * len(w))]))]
        docs.append((k, " ".join([word() for _ in range(rng.choice([0, 3, 80]))] + w + [word() for _ in range(rng.choice([0, 5]))])))
    got = decontam.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks(docs, items)
    assert {tuple(r)[:4] for r in got.collect()} == want and len(want) > 50


def test_rows_are_dropped_by_their_own_text(spark):
    item = "these seven words are a test item"
    rows = [(1, "clean text"), (1, f"x {item}"), (None, item), (None, "also clean"), (2, None), (3, ""), (4, item.upper()), (5, "clean text"), (5, "clean text")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, item_id int")
    kept = decontam.drop_contaminated(docs, spark.createDataFrame([(1, item), (2, "tesT")], "item_id long, text string"))
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(map(repr, spark.createDataFrame([r for r in rows if "item" not in (r[1] or "").lower()], "doc_id long, text string").collect()))
    assert decontam.drop_contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
