"""Draws to intervals through bins, and passages of any length."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusbench.operators import leaks as L
from corpusbench.operators import mixture as X


def drawn(spark, weights, bins, n=20_000):
    shares = spark.createDataFrame([(g, k, f"s{k}", float(w)) for g, ws in weights.items() for k, w in enumerate(ws)], "g string, k int, source string, p double")
    draws = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"))
    u = (F.col("id") * 7919 % n) / F.lit(float(n))
    bounds = X.interval_bounds(shares, ["g"], ["k"], "p")
    joined = X.range_join(draws, bounds, u, ["g"], bins, ["source"])
    steps = X.intervals(shares.withColumnRenamed("p", "class_share"), "g")
    plain = draws.withColumn("_u", u).join(steps, draws["g"].eqNullSafe(steps["g"])).select("id", X.pick_interval(F.col("steps"), F.col("_u")).alias("source"))
    return joined, plain


@pytest.mark.parametrize("bins", [1, 7, 64])
def test_same_as_the_array(spark, bins):
    rng = np.random.default_rng(2)
    flat = rng.random(40)
    steep = 2.0 ** -np.arange(30)
    weights = {"a": flat / flat.sum(), "b": np.concatenate((steep, [0.0, -1.0])) / steep.sum(), None: [0.25, 0.0, 0.25]}
    joined, plain = drawn(spark, weights, bins)
    got, want = ({(r["id"], r["source"]) for r in df.collect()} for df in (joined, plain))
    assert got == want and len(got) == 20_000 and joined.count() == 20_000


def test_many_intervals_by_an_equi_join(spark):
    n = 100_000
    shares = spark.range(n).select(F.lit("a").alias("g"), F.col("id").alias("k"), F.lit(1.0 / n).alias("p"))
    bounds = X.interval_bounds(shares, ["g"], ["k"], "p")
    draws = spark.range(50_000).select("id", F.lit("a").alias("g"))
    joined = X.range_join(draws, bounds, (F.col("id") + 0.5) / F.lit(50_000.0), ["g"], n, ["k"])
    # draw id lies in the middle of two intervals' border, up to rounding of the sums
    assert joined.where(F.abs(F.col("k") - (2 * F.col("id") + 1)) <= 1).count() == 50_000 == joined.count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


ITEMS = ["one", "ne t", "one two", "two three four", " ", "\n\n", "é😀", "x", "", None, "three four five six seven", "zzz", "e t", "one two three four five six", "one"]
TEXTS = ["one two three four five six seven", "none too", "é😀\n\nend", "", None, "x" * 50_000 + " zzz", "one\ttwo", "two three fourth", "atwo three fourteen"]


@pytest.mark.parametrize("size", [4_000_000, 5])
def test_passages_of_any_length(spark, size, monkeypatch):
    monkeypatch.setattr(L.short_passage_leaks, "__defaults__", ("text", size))
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "s", 1), (None, "one", "s", 1)], "doc_id long, text string, _passage string, item_id int")
    items = spark.createDataFrame([(k, t, 5) for k, t in enumerate(ITEMS)] + [(None, "zzz", 5)], "item_id long, text string, doc_id int")
    rows = list(enumerate(TEXTS)) + [(None, "one")]
    want = {(d, i) for d, t in rows for i, p in [*enumerate(ITEMS), (None, "zzz")] if t and p and p in t}
    got = [tuple(r) for r in L.passage_leaks(docs.select("doc_id", "text"), items, "doc_id", "item_id").collect()]
    # long passages match rows by key, so a row without one is found by short passages only
    assert set(got) == want and len(got) == len(set(got))
    assert L.passage_leaks(docs.limit(0), items, "doc_id", "item_id").count() == 0 and L.passage_leaks(docs, items.limit(0), "doc_id", "item_id").count() == 0
