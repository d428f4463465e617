"""Language models and the toxicity machine: held-out accuracy, formulas, odd rows."""

import math
import zlib

import numpy as np
import pytest

from corpusbench.llm import language, toxicity

SF = "/root/testdata/sf0.01"


def test_kneser_ney_sums_to_one():
    counts = {"a": {"\x02\x02\x02\x02x": 3, "\x02\x02\x02xy": 2, "\x02\x02\x02x\x03": 1, "\x02\x02xy\x03": 2}, "b": {"\x02\x02\x02\x02y": 4, "\x02\x02\x02yy": 1, "\x02\x02\x02y\x03": 3, "\x02\x02yy\x03": 1}}
    model = language.kneser_ney(counts)
    # the letters seen and one unknown letter share all probability
    first = model.word_scores(["x", "y", "é"])
    assert model.languages == ["a", "b"] and first[0, 0] > first[1, 0] and first[1, 1] > first[0, 1] and (first[2, :2] < first[:2, :2].max(axis=0)).all()
    assert (first[:, -1] == 2).all()
    for k in range(2):
        rows = {g: p for g, p in zip(model.grams[0].tolist(), np.exp(model.log_p[0][:, k]), strict=True)}
        assert sum(rows.values()) + np.exp(model.floor[k]) == pytest.approx(1, abs=1e-9)


def plain_kneser_ney(counts, letters, discount=0.75):
    """p(letter | context) of one language by the recursive definition; None stands for an unknown letter."""
    order = max(map(len, counts))
    levels = {order: dict(counts)}
    for n in range(order - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1

    def p(context, letter):
        if context is None:
            return 1 / (len(letters) + 1)
        n = len(context) + 1
        here = {g: c for g, c in levels[n].items() if g[:-1] == context}
        lower = p(context[1:] if context else None, letter)
        if not here:
            return lower
        total = sum(here.values())
        return max(here.get(context + (letter or ""), 0) - discount, 0) / total + discount * len(here) / total * lower if letter else discount * len(here) / total * lower

    return p


def test_words_score_as_by_the_recursive_definition():
    words = {"a": {"abba": 3, "bad": 2, "cab": 1}, "b": {"dada": 2, "éa": 4}}
    counts = {}
    for k, ws in words.items():
        counts[k] = {}
        for w, n in ws.items():
            padded = "\x02" * 4 + w + "\x03"
            for i in range(len(w) + 1):
                counts[k][padded[i : i + 5]] = counts[k].get(padded[i : i + 5], 0) + n
    letters = {g[-1] for c in counts.values() for g in c}
    model = language.kneser_ney(counts)
    asked = ["abba", "dab", "é", "zz", "badé"]
    got = model.word_scores(asked)
    for j, k in enumerate(model.languages):
        p = plain_kneser_ney(counts[k], letters)
        for i, w in enumerate(asked):
            padded = "\x02" * 4 + w + "\x03"
            want = sum(math.log(p(padded[x : x + 4], c if (c := padded[x + 4]) in letters else None)) for x in range(len(w) + 1))
            assert got[i, j] == pytest.approx(want, abs=1e-9)
        for context in ("\x02\x02\x02\x02", "\x02\x02\x02a", "abba", "zzzz", "\x02bad"[:4]):
            assert sum(p(context, c) for c in letters) + p(context, None) == pytest.approx(1, abs=1e-9)


def test_words_add_up():
    model = language.kneser_ney({"a": {"\x02\x02\x02\x02x": 3, "\x02\x02\x02x\x03": 3}, "b": {"\x02\x02\x02\x02y": 3, "\x02\x02\x02y\x03": 3}})
    scorer = language.Scorer(model)
    total = scorer.totals([b"x, y!", b"", b"12 --", "X Y".encode()])
    assert (total[1] == 0).all() and (total[2] == 0).all() and np.allclose(total[0], total[3])
    assert np.allclose(total[0], model.word_scores(["x", "y"]).sum(axis=0))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_languages(docs)
    rows = language.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.97 * len(held)
    odd = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "123 !?", None, 1), (5, "\u00bd \u00b2\u2460 \u2167", "en", 1), (None, "the of and", "en", 1), (4, "the of and " * 30_000, "en", 1)],
                                "doc_id long, text string, lang string, entropy int")
    got = {r["doc_id"]: r for r in language.predict_languages(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3, 5)] == ["und"] * 4 and got[4]["lang_pred"] == got[None]["lang_pred"] == "en"
    assert language.predict_languages(odd.limit(0), model).count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language.predict_languages(docs, language.fit_languages(docs)).first()["lang_pred"] == "und"


def test_held_out_rows_do_not_teach(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = {r["doc_id"] for r in language.labelled_sample(docs, 10**6).collect()}
    assert sample and all(zlib.crc32(str(k).encode()) % 4 != 2 for k in sample)
    drawn, _ = toxicity.labelled(docs, spark.read.parquet(f"{SF}/labels.parquet"), 10**6)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in drawn.collect())


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, machine).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["toxic"] == k] for k in (0, 1))
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert wins > 0.75 and sum(x >= 0.3 for x in good) <= 0.05 * len(good)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "x", 1), (2, "", 1)], "doc_id long, text string, score int")
    got = toxicity.score_toxicity(odd, machine).collect()
    assert len(got) == 4 and all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert toxicity.drop_toxic(odd, machine).count() == 4 and toxicity.score_toxicity(odd.limit(0), machine).count() == 0
    none = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(odd, none).first()["score"] < 1e-6


def test_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    rows = [sorted(rng.choice(6, rng.integers(0, 5), replace=False).tolist()) for _ in range(3000)]
    y = np.array([0 in r and 1 in r for r in rows], float)
    m = toxicity.train(rows, y, np.ones(len(rows)), {k: k for k in range(6)})
    assert m.score([0, 1]) > 0.8 > 0.3 > max(m.score([0]), m.score([1]), m.score([0, 3]), m.score([1, 2, 3]))


def test_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = toxicity.Machine({}, 0.2, rng.normal(size=9), rng.normal(size=(9, 4)))
    for places in ([], [3], [0, 4], [1, 2, 5, 8]):
        z = m.bias + sum(m.weights[i] for i in places) + sum(m.factors[i] @ m.factors[j] for i in places for j in places if i < j)
        assert m.score(places) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


def test_pair_counts_equal_counting():
    rng = np.random.default_rng(4)
    y = (np.arange(600) % 3 == 0).astype(float)
    rows = []
    for k in y:  # terms 0 and 1: together in toxic texts, apart in others, equally often
        kind = rng.random() < 0.3
        rows.append(np.array(sorted(set(rng.choice(np.arange(2, 12), 3).tolist()) | (({0, 1} if kind else set()) if k else ({0} if kind else {1} if rng.random() < 0.43 else set())))))
    assert toxicity.telling_pairs(rows, y, 12) == [(0, 1)]
    a, b = (sum(0 in r and 1 in r for r, k in zip(rows, y, strict=True) if k == c) for c in (1, 0))
    cells = [(a, 200, 200 * (a + b) / 600), (b, 400, 400 * (a + b) / 600)]
    plain = 2 * sum(k * math.log(k / e) if k else 0 for n, m, x in cells for k, e in ((n, x), (m - n, m - x)))
    assert toxicity.ratios(np.array([a]), np.array([b]), 200.0, 400.0)[0] == pytest.approx(plain)


def test_pair_without_telling_words_is_learnt(spark):
    """Each word is in a third of the texts of both classes; only in toxic ones are they together."""
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(3000):
        toxic, kind = int(i % 6 == 0), rng.integers(0, 3)
        words = [f"w{k}" for k in rng.integers(0, 60, 12)]
        words += (["zebra", "quartz"] if kind == 0 else []) if toxic else [["zebra"], ["quartz"], []][kind]
        docs.append((i, " ".join(rng.permutation(words).tolist())))
        labels.append((i, toxic))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    machine = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = spark.createDataFrame([(1, "w1 zebra w2 quartz w3"), (2, "w1 zebra w2"), (3, "w1 quartz"), (4, "w1 w2"), (5, "zebra quartz " * 40_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(texts, machine).collect()}
    assert min(got[1], got[5]) > 0.8 and max(got[2], got[3]) < 0.2 and got[4] < 0.3
