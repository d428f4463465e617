"""Seeded permutations, places in an epoch, and resumed runs."""

import pytest
from pyspark.sql import functions as F

from corpusbench.functions.permute import Permutation, grid
from corpusbench.operators import mixture as X


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 97, 1000, 1009, 4099, 30_011])
def test_every_place_once_and_back(spark, n):
    order = Permutation(n, "k")
    rows = spark.range(n).select("id", order.place(F.col("id")).alias("place"))
    rows = rows.withColumn("back", order.row(F.col("place"))).collect()
    assert sorted(r["place"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)


def test_grids_leave_little_outside():
    for n in (1, 2, 5, 99, 10**4, 10**6 + 3, 10**9 + 7, 10**12 + 39):
        a, b = grid(n)
        assert 0 <= a * b - n <= 64 and a * b >= n
    with pytest.raises(ValueError):
        Permutation(-1, "k")


def test_orders_look_shuffled_and_differ(spark):
    n = 20_000
    places = {}
    for key in (X.epoch_key(7, 0), X.epoch_key(7, 1), X.epoch_key(7, 0, worker=1), X.epoch_key(7, 0, round_=1)):
        order = Permutation(n, key)
        places[key] = [r["p"] for r in spark.range(n).select("id", order.place(F.col("id")).alias("p")).orderBy("id").collect()]
    lists = list(places.values())
    for i, a in enumerate(lists):
        # neighbours land far apart, and the mean place of any tenth of the rows is near the middle
        assert sum(abs(x - y) < 20 for x, y in zip(a, a[1:], strict=False)) < 0.01 * n
        assert all(abs(sum(a[k : k + 2000]) / 2000 - n / 2) < 0.05 * n for k in range(0, n, 2000))
        assert all(sum(x == y for x, y in zip(a, b, strict=True)) < 20 for b in lists[:i])


def test_slices_are_the_rest_of_an_epoch(spark):
    rows = spark.range(5000).select((F.col("id") * 3).alias("k"))
    numbered = X.numbered(rows, "k", F.floor(F.col("k") / 1000)).cache()
    assert [r["row"] for r in numbered.orderBy("k").collect()] == list(range(5000))
    order = Permutation(5000, X.epoch_key(1, 2))
    whole = {r["place"]: r["k"] for r in X.epoch_places(numbered, order).collect()}
    assert sorted(whole) == list(range(5000))
    for start, stop in ((0, 10), (1234, 1300), (4990, 9999), (-5, 3), (50, 50), (6000, 7000)):
        got = {r["place"]: r["k"] for r in X.epoch_slice(numbered, order, start, stop).collect()}
        assert got == {p: whole[p] for p in range(max(0, start), min(stop, 5000))}
    assert X.epoch_slice(numbered.limit(0), Permutation(0, "k"), 0, 5).count() == 0


def test_places_need_no_shuffle(spark):
    plan = X.epoch_places(spark.range(100).withColumnRenamed("id", "row"), Permutation(100, "k"))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_step_never_meets_the_next_epoch():
    """Offsets used to add up, so a resume after SEED_STEP steps had the next epoch's order."""
    assert X.epoch_seed(1, 0, step=X.SEED_STEP) == X.epoch_seed(1, 1) and len({X.epoch_key(1, e, w, r) for e in range(5) for w in range(5) for r in range(5)}) == 125
