"""Grids are worked out once per row, whatever is done with their cells."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusbench.functions import grids as G
from tools.check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["avg_pool", "paste_labels", "k_median_blur", "k_noise", "k_translate", "heat_upsample"])
def test_no_filter_works_out_the_grid(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "size(" not in plan


@pytest.mark.parametrize("name", ["clean", "blur1.0", "crop60", "resample", "fftlp", "grain"])
def test_sum_of_cells_is_that_of_the_kernel(spark, name):
    grids = spark.range(3).select("id", F.transform(G.cells(), lambda i: (i * 37 + F.col("id") * 11) % 64 / 63.0).alias("grid"))
    run = G.kernel(name)
    cells = F.aggregate(run(F.col("grid"), F.col("id")), F.lit(0.0), lambda s, v: s + v)
    for row in grids.select(G.cell_sum(run, F.col("grid"), F.col("id")).alias("a"), cells.alias("b")).collect():
        assert row.a == pytest.approx(row.b, abs=1e-9)


def test_a_sum_over_averages_makes_no_grid(spark):
    plan = spark.range(1).select(G.cell_sum(G.kernel("blur2.0"), F.array_repeat(F.rand(), 64), F.col("id")))
    assert "flatten" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_equal_cells_share_a_rank(spark):
    grid = [0.5, 0.25, 0.25, *(0.5 + i / 128 for i in range(1, 60)), 1.0, 1.0]
    df = spark.createDataFrame([(1, grid)], "id long, grid array<double>")
    got = df.select(G.kernel("equalize")(F.col("grid"), F.col("id")).alias("v")).first().v
    assert np.allclose(got, [2 / 63, 0.0, 0.0, *(i / 63 for i in range(3, 62)), 62 / 63, 62 / 63])


TIED = {
    "no ties": [i * 29 % 64 / 64 for i in range(64)],
    "one pair": [*(i / 64 for i in range(63)), 0.5],
    "least": [-0.25] * 3 + [i / 64 for i in range(61)],
    "greatest": [i / 64 for i in range(60)] + [1.0] * 4,
    "two values": [0.0, 1.0] * 32,
    "flat": [0.25] * 64,
    "nulls": [*(i / 64 for i in range(61)), 0.5, None, None],
    "no numbers": [*(i / 64 for i in range(61)), float("nan"), float("nan"), None],
    "flat with nulls": [0.25] * 60 + [None] * 4,
    "all null": [None] * 64,
    "none": None,
}


def test_contrast_and_ranks_equal_their_sql_on_equal_cells(spark, tmp_path):
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(TIED.values())], "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    message, ok = compare(spark, con, str(tmp_path), "k_contrast_hist", entry.queries()["k_contrast_hist"], entry.oracle_sql()["k_contrast_hist"])
    assert ok, message
