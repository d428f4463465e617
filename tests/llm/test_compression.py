"""Quality by compression: held-out ranking, sizes against the library, odd rows."""

import math
import zlib

import numpy as np
import pytest
import zstandard

from corpusbench.llm import compression

SF = "/root/testdata/sf0.1"


def test_held_out_ranking(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = compression.fit_quality(docs, labels)
    rows = compression.score_quality(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"]]
    good, bad = ([r for r in held if r["quality"] == k] for k in (1, 0))
    wins = np.mean([(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in good for b in bad])
    assert wins > 0.98 and np.mean([r["predicted"] for r in good]) > 0.98 and np.mean([r["predicted"] for r in bad]) < 0.35
    # calibrated: scores of held-out rows average to the share of good ones
    assert abs(np.mean([r["score"] for r in held]) - len(good) / len(held)) < 0.04


def test_held_out_rows_do_not_teach(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.1', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    sample, share = compression.labelled(docs, labels, 10**6)
    parts = {zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in sample.collect()}
    assert parts == {1, 2, 3, 4} and share == {0: 1.0, 1: 1.0}
    swapped = labels.selectExpr("doc_id", "case when crc32(cast(string(doc_id) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    assert compression.fit_quality(docs, swapped) == compression.fit_quality(docs, labels)


def test_sizes_of_the_library(spark):
    model = compression.Model(b"good words and sense " * 40, b"### $$$ *** junk " * 40, 0.5, 3.0)
    texts = [None, "", "a", "good words and sense " * 30, "### junk $$$ " * 50, "é😀" * 9000, "good words " * 3 + "### junk"]
    docs = spark.createDataFrame([(k, t, 0.1, 1) for k, t in enumerate(texts)] + [(None, "good words", 0.2, 2), (3, texts[3], 0.1, 1)], "doc_id long, text string, score double, difference int")
    got = compression.score_quality(docs, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        raw = ("good words" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        sizes = [0, 0]
        for k in range(0, len(raw), 4096):
            for i, d in enumerate((model.good, model.bad)):
                pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                sizes[i] += len(pack.compress(raw[k : k + 4096]))
        z = 0.5 + 3.0 * (sizes[1] - sizes[0]) / (len(raw) + 64)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert compression.score_quality(docs.limit(0), model).count() == 0


def test_pieces_are_bounded_and_whole(spark):
    docs = spark.createDataFrame([(k, f"{k} " * 5000, 1) for k in range(1, 9)], "doc_id long, text string, quality int")
    every = compression.sample_pieces(docs, 1, 10**6)
    taught = [k for k in range(1, 9) if zlib.crc32(str(k).encode()) % 5 != compression.CURVE]
    assert sum(map(len, every)) == sum(len(f"{k} " * 5000) for k in taught) and max(map(len, every)) <= compression.PIECE
    some = compression.sample_pieces(docs, 1, 5)
    assert len(some) == 5 and set(some) <= set(every) and compression.sample_pieces(docs, 0, 5) == []


def test_few_labels(spark):
    docs = spark.createDataFrame([(k, f"some text {k} " * 3) for k in range(40)], "doc_id long, text string")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    none = compression.fit_quality(docs, table([]))
    assert {r["score"] for r in compression.score_quality(docs, none).collect()} == {0.5}
    rows = [(k, 1) for k in range(40)] + [(None, 1), (3, None), (4, 7)]
    taught = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(40))
    assert compression.score_quality(docs, compression.fit_quality(docs, table(rows))).first()["score"] == pytest.approx((taught + 1) / (taught + 2))
    both = compression.fit_quality(docs, table([(k, k % 2) for k in range(40)]))
    assert all(0 <= r["score"] <= 1 for r in compression.score_quality(docs, both).collect())


def test_curve_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 0.1, 40_000)
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(0.7 + 9 * x)))).astype(float)
    bias, slope = compression.fit_curve(x, y, np.ones(len(x)))
    assert bias == pytest.approx(0.7, abs=0.06) and slope == pytest.approx(9, abs=0.5)
    assert compression.fit_curve(x, 1 - y, np.ones(len(x)))[1] == 0.0
