import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusbench.operators import audit as A
from corpusbench.operators import metrics as M
from corpusbench.operators import sweep as S


def confusion(spark, tp, fn, fp, tn):
    rows = [(1, 0.9, tp), (1, 0.1, fn), (0, 0.9, fp), (0, 0.1, tn)]
    return spark.createDataFrame([r for r in rows if r[2]], "label int, prob double, times int").select(
        "label", "prob", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("i"))


def test_published_confusion(spark):
    r = M.metrics(confusion(spark, 23788, 2130, 50, 25868)).first()
    assert (r.n, r.n_fake, r.n_real) == (51836, 25918, 25918)
    assert r.accuracy == pytest.approx(0.9579442858, abs=1e-9)
    assert r.precision == pytest.approx(0.997903, abs=1e-6)
    assert r.f1 == pytest.approx(0.9561861886, abs=1e-9)
    assert r.fpr == pytest.approx(0.0019291612, abs=1e-9)


def test_single_class(spark):
    r = M.metrics(confusion(spark, 0, 0, 3, 4997)).first()
    assert r.accuracy == pytest.approx(0.9994) and r.macro_accuracy == pytest.approx(0.4997)
    assert r.precision == 0 and r.recall == 0 and r.f1 == 0 and r.auroc is None and r.ap is None


def numpy_curves(y, p):
    order = np.argsort(p, kind="stable")
    ranks = np.empty(len(p))
    ranks[order] = np.arange(1, len(p) + 1)
    for v in np.unique(p):
        ranks[p == v] = ranks[p == v].mean()
    pos, neg = y.sum(), (1 - y).sum()
    auc = (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    ap = sum(y[p == v].sum() / pos * y[p >= v].sum() / (p >= v).sum() for v in np.unique(p))
    return auc, ap


@pytest.mark.parametrize("bounded", [True, False])
def test_curves_match_numpy_with_ties_and_extremes(spark, bounded):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 3000)
    p = np.where(rng.random(3000) < 0.4, 1.0, np.round(rng.random(3000) * 0.7 + 0.2 * y, 2))
    p[:5], p[5:9] = 0.0, 1e-9
    df = spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, p)], "g string, label int, prob double")
    auc, ap = numpy_curves(y, p)
    for by in ([], ["g"]):
        r = M.metrics(df, by, bounded=bounded).first()
        assert r.auroc == pytest.approx(auc, abs=1e-12) and r.ap == pytest.approx(ap, abs=1e-12)


def test_auroc_is_antisymmetric_and_ap_of_constant_is_prevalence(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("label"),
                                  ((F.col("id") * 7919 % 1000) / 1000.0).alias("prob"))
    a = M.metrics(df).first().auroc
    b = M.metrics(df.withColumn("prob", 1.0 - F.col("prob"))).first().auroc
    assert a + b == pytest.approx(1.0)
    c = M.metrics(df.withColumn("prob", F.lit(0.3))).first()
    assert c.ap == pytest.approx(667 / 2000) and c.auroc == pytest.approx(0.5)


def test_null_group_keys_survive_the_bucketed_path(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (None, 0, 0.2), ("a", 1, 0.1), ("a", 0, 0.8)],
                               "g string, label int, prob double")
    got = {r.g: r.auroc for r in M.metrics(df, ["g"], bounded=False).collect()}
    assert got == {None: 1.0, "a": 0.0}


def test_histograms_of_batches_add_up(spark):
    df = spark.range(500).select((F.col("id") % 2).cast("int").alias("label"), ((F.col("id") % 37) / 37).alias("prob"))
    parts = M.score_histogram(df.where("id < 200"), []).unionByName(M.score_histogram(df.where("id >= 200"), []))
    assert M.metrics_from_histogram(parts, []).first() == M.metrics(df).first()


def test_robust_metrics_are_empty_without_distorted_rows(spark):
    df = spark.createDataFrame([(1, 0.9, False), (0, 0.1, False)], "label int, prob double, is_distorted boolean")
    assert M.robust_metrics(df).count() == 0
    assert M.robust_metrics(df.withColumn("is_distorted", F.col("label") == 1)).count() == 2


def test_best_step_ignores_missing_and_keeps_the_earlier_tie(spark):
    h = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, 0.7), (4, 0.7), (5, None)], "step int, metric double")
    got = [(r.step, r.best_step) for r in S.best_step(h).orderBy("step").collect()]
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)]


def test_degradation_needs_conditions(spark):
    one = spark.createDataFrame([("clean", 0.9, 0.1)], "condition string, macro_accuracy double, fpr double")
    assert S.degradation_summary(one).count() == 0


def test_pooled_reals_without_reals(spark):
    df = spark.createDataFrame([("g", 1, 0.9)], "generator string, label int, prob double")
    assert M.pooled_generator_metrics(df, []).first().auroc is None


def test_wide_forms(spark):
    """The condition map, the pivot and the cube against DuckDB or the rows themselves."""
    rows = [("g", "clean", 5, 0.9, 0.8), ("g", "jpeg50", 5, float("nan"), 0.7), ("h", "clean", 4, 0.5, None), ("h", None, 4, 0.1, 0.2)]
    per = spark.createDataFrame(rows, "generator string, condition string, n long, recall double, auroc double")
    got = {r["generator"]: r["per_condition"] for r in M.difficulty_rank(per, with_map=True).collect()}
    assert got == {"g": {"clean": 0.9, "jpeg50": None}, "h": {"clean": 0.5}}
    assert "per_condition" not in M.difficulty_rank(per).columns
    sweep = spark.createDataFrame([("clean", 10, 0.9, None), ("blur1.0", 10, 0.7, 0.6)], "condition string, n long, recall double, ap double")
    for names in (None, ["clean", "blur1.0", "crop80"]):
        wide = {r["metric"]: r for r in S.sweep_wide(sweep, ["n", "recall", "ap"], names).collect()}
        assert {m: (r["clean"], r["blur1.0"]) for m, r in wide.items()} == {"n": (10, 10), "recall": (0.9, 0.7), "ap": (None, 0.6)}
        assert names is None or all(r["crop80"] is None for r in wide.values())
    samples = [("a", 1), ("a", 1), ("a", 0), ("b", None), (None, 0)]
    cube = A.inventory_cube(spark.createDataFrame(samples, "source string, label int")).collect()
    values = ", ".join(f"({'null' if s is None else repr(s)}, {'null' if y is None else y})" for s, y in samples)
    want = duckdb.sql(f"""select source, label, grouping(source)::int, grouping(label)::int, count(*)
                          from (values {values}) t(source, label) group by cube (source, label)""").fetchall()
    assert sorted(map(tuple, cube), key=str) == sorted(want, key=str)


def test_draws_come_from_the_table_function(spark):
    plan = entry.queries()["draws_udtf"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "overlay_rows" in plan


def counted(df, seen):
    """The same rows, counted in an accumulator whenever they are computed."""

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema)


def test_curves_read_their_rows_once(spark):
    df = spark.range(4000).select((F.col("id") % 3 == 0).cast("int").alias("label"), ((F.col("id") * 7919 % 1000) / 1000.0).alias("prob"),
                                  F.concat(F.lit("g"), F.col("id") % 7).alias("generator"), F.lit("c").alias("condition"))
    for run in (lambda d: M.metrics(d, ["generator"]), lambda d: M.metrics(d), lambda d: M.fpr_operating_point(d, ["generator"], 0.01),
                lambda d: M.pooled_generator_metrics(d, ["condition"]), lambda d: M.difficulty_rank(M.pooled_generator_metrics(d, ["condition"])),
                lambda d: M.robust_metrics(d.withColumn("is_distorted", F.col("label") == 1))):
        seen = spark.sparkContext.accumulator(0)
        assert run(counted(df, seen)).collect() and seen.value == 4000


def test_close_scores_are_spread_over_ranges(spark):
    """Scores that differ in the tenth digit only, nearly all in one group, make ranges of about equal depth."""
    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 20 == 0, "small").otherwise("hot").alias("g"), (F.col("id") % 2).cast("int").alias("label"),
                               (F.lit(0.5) + F.hash("id") % 1000 * 1e-9 + F.col("id") * 1e-14).alias("prob"))
    hist = M.score_histogram(df, ["g"])
    ranges = M.score_ranges(hist, ["g"], parts=16)
    sizes = [r["count"] for r in ranges.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == hist.count() and max(sizes) < 3 * min(sizes)
    rows = {(r["g"], r["score"]): (r["cpos"], r["cneg"]) for r in M.cumulate(ranges, ["g"]).collect()}
    assert rows == {(r["g"], r["score"]): (r["cpos"], r["cneg"]) for r in M.cumulate_in_place(hist, ["g"]).collect()}
    y, p = map(np.array, zip(*[(r["label"], r["prob"]) for r in df.where("g = 'hot'").collect()]))
    got = {r["g"]: r for r in M.metrics(df, ["g"]).collect()}["hot"]
    order = np.argsort(p)
    cpos = np.cumsum(y[order[::-1]])
    assert got["auroc"] == pytest.approx(numpy_auc(y, p), abs=1e-12)
    assert got["ap"] == pytest.approx((cpos / np.arange(1, len(p) + 1))[y[order[::-1]] == 1].mean(), abs=1e-12)


def numpy_auc(y, p):
    ranks = np.empty(len(p))
    ranks[np.argsort(p)] = np.arange(1, len(p) + 1)
    pos = y.sum()
    return (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_null_scores_and_groups_in_ranges(spark):
    rows = [(g, y, p) for g in (None, "a", "b") for y, p in ((1, 0.9), (0, 0.9), (None, 0.4), (1, 0.1), (0, 0.0), (0, None))]
    df = spark.createDataFrame(rows, "g string, label int, prob double")
    ranged, whole = (sorted(map(tuple, M.metrics(df, ["g"], bounded=b).collect()), key=str) for b in (False, True))
    assert ranged == whole and len(ranged) == 3 and all(r[1] == 6 for r in ranged)
    assert M.metrics(df.limit(0), ["g"]).count() == 0 and M.metrics(df.limit(0)).first()["n"] == 0
