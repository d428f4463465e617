"""Sketches per shard: merged in any order, within their stated errors; the Newton fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusbench.operators import probe as P
from corpusbench.operators import sketches as S


@pytest.fixture(scope="module")
def rows(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(40_000))
    return spark.range(200_000).select((F.col("id") % 7).alias("shard"), x.alias("many"), (F.col("id") % 9).cast("string").alias("few"),
                                       F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("num"))


def test_estimates_are_within_their_bounds(rows):
    got = {r["column"]: r for r in S.sketch_statistics(S.merge_sketches(S.shard_sketches(rows, "shard", ["many", "few", "num"])), ranks=(0.1, 0.5, 0.9)).collect()}
    exact = rows.select("many").distinct().count()
    assert abs(got["many"]["n_unique"] - exact) < 4 * 1.04 / 2 ** (S.LG_DISTINCT / 2) * exact
    assert got["few"]["n_unique"] == 9 and got["few"]["quantiles"] is None
    counts = {r["few"]: r["count"] for r in rows.groupBy("few").count().collect()}
    assert got["few"]["top_values"] == " ".join(f"{k}={n}" for k, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])))
    assert (got["num"]["n"], got["num"]["nan_count"], got["num"]["min"], got["num"]["max"]) == (200_000, 20_000, 1.0, 199_999.0)
    for want, q in zip((0.1, 0.5, 0.9), got["num"]["quantiles"], strict=True):
        assert abs(q / 200_000 - want) < 0.03


def test_arrivals_merge_like_all_at_once(rows):
    columns = ["few", "num"]
    first, later = (S.shard_sketches(rows.where(c), "shard", columns) for c in ("shard < 3", "shard >= 3"))
    merged = S.merge_sketches(S.merge_sketches(first).unionByName(S.merge_sketches(later)))
    exact = ["column", "n", "nan_count", "min", "max", "n_unique", "top_values"]
    read = lambda s: sorted(map(tuple, S.sketch_statistics(s).select(*exact).collect()))
    assert read(merged) == read(S.merge_sketches(S.shard_sketches(rows, "shard", columns)))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, float("nan"), 1), (None, "a", 1.0, 1), (1, None, None, 1)], "shard int, s string, x double, n int")
    got = {(r["shard"], r["column"]): r for r in S.sketch_statistics(S.shard_sketches(df, "shard", ["s", "x"])).collect()}
    assert (got[None, "x"]["n"], got[None, "x"]["nan_count"], got[None, "x"]["n_unique"]) == (2, 1, 1)
    assert (got[1, "s"]["n_unique"], got[1, "s"]["top_values"], got[1, "x"]["quantiles"], got[1, "x"]["min"]) == (0, "", None, None)
    assert S.shard_sketches(df.limit(0), "shard", ["s"]).count() == 0


def test_newton_equals_the_library_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) * [1, 5, 0.2, 1] + [0, 3, -1, 0]
    y = (x[:, 0] + 0.4 * x[:, 1] + rng.normal(size=500) > 1).astype(int)
    df = spark.createDataFrame([(int(a), [float(v) for v in b], 1) for a, b in zip(y, x, strict=True)], "y int, x array<double>, miss int").repartition(5)
    fit = P.newton_probe(df, "x", "y", reg=0.01)
    lr = P.fit_linear_probe(df, "x", "y", reg=0.01, max_iter=500).stages[-1]
    assert np.allclose(fit.weights, lr.coefficients, atol=1e-3) and abs(fit.bias - lr.intercept) < 1e-3
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    p = 1 / (1 + np.exp(-(z @ fit.weights + fit.bias)))
    assert np.abs(z.T @ (p - y) / 500 + 0.01 * fit.weights).max() < 1e-9 and abs((p - y).mean()) < 1e-9
    got = np.array([r["prob"] for r in P.score_newton(df, "x", fit).select("x", "prob").orderBy("x").collect()])
    assert np.allclose(got, p[np.lexsort(x.T[::-1])], atol=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        P.newton_probe(df.limit(0), "x", "y")
