import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusbench.functions import grids as G
from corpusbench.operators import audit as A
from corpusbench.operators import metrics as M
from corpusbench.operators import probe as P


@pytest.fixture(scope="module")
def grids(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.random(64)]) for i in range(12)]
    return spark.createDataFrame(rows, "id long, grid array<double>").cache()


def run(df, name):
    out = G.kernel(name)(F.col("grid"), F.col("id"))
    return {r.id: (np.array(r.grid), np.array(r.out)) for r in df.select("id", "grid", out.alias("out")).collect()}


def test_lowpass_equals_a_dense_transform(grids):
    n = np.arange(8)
    dft = np.exp(-2j * np.pi * np.outer(n, n) / 8)
    freq = np.minimum(n, 8 - n) / 8
    mask = np.exp(-0.5 * (freq[:, None] ** 2 + freq[None, :] ** 2) / 0.32 ** 2)
    for x, y in run(grids, "fftlp").values():
        want = (np.conj(dft) @ ((dft @ x.reshape(8, 8) @ dft) * mask) @ np.conj(dft) / 64).real
        assert np.allclose(y, np.clip(want, 0, 1).ravel(), atol=1e-12)


def test_phase_noise_keeps_low_frequencies_and_ignores_partitions(grids):
    a, b = run(grids, "phase"), run(grids.repartition(5), "phase")
    for i, (x, y) in a.items():
        assert np.array_equal(y, b[i][1]) and not np.allclose(x, y)
        # The mean is a low frequency; only clipping can move it.
        assert abs(x.mean() - y.mean()) < 0.02


def test_array_kernels_equal_numpy(grids):
    blur = np.array(G.gaussian(8, 1.0))
    assert np.allclose(blur.sum(axis=1), 1)
    for x, y in run(grids, "blur1.0").values():
        assert np.allclose(y, (blur @ x.reshape(8, 8) @ blur.T).ravel(), atol=1e-12)
    for x, y in run(grids, "equalize").values():
        assert np.allclose(y, x.argsort().argsort() / 63.0)
    flat = grids.withColumn("grid", F.array_repeat(F.lit(0.25), 64))
    for name in ("equalize", "autocontrast", "unsharp", "median3", "crop60", "resample"):
        assert all(np.allclose(x, y) for x, y in run(flat, name).values()), name


def test_fitted_probe_beats_chance_on_held_out_rows(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 4)) + y[:, None] * np.array([1.0, 0, -1.0, 0])
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, x)], "y int, x array<double>").withColumn(
        "part", F.monotonically_increasing_id() % 2)
    model = P.fit_linear_probe(df.where("part = 0"), "x", "y")
    scored = P.apply_linear_probe(model, df.where("part = 1"), "x")
    assert M.metrics(scored.select(F.col("y").alias("label"), "prob")).first().auroc > 0.75


def test_file_inventory_counts(spark):
    files = spark.createDataFrame([("a", "a/1", 5), ("a", "a/2", 9), ("b", "b/1", 1)], "folder string, path string, length long")
    got = {r.folder: (r.files, r.bytes, r.largest, r.listed) for r in A.file_inventory(files, "folder", top=1).collect()}
    assert got == {"a": (2, 14, 9, 1), "b": (1, 1, 1, 1)}


def test_column_statistics_count_missing_values(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "a"), (None, None), (3.0, "b")], "x double, s string")
    got = {r.column: r for r in A.column_statistics(df, ["x", "s"]).collect()}
    assert (got["x"].n_unique, got["x"].nan_count, got["x"].mean) == (2, 2, 2.0)
    assert (got["s"].n_unique, got["s"].nan_count, got["s"].top_values) == (2, 1, "a=2 b=1")
