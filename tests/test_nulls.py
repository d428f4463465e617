"""Rows with null keys are rows like others; long texts count as a whole."""

import pytest
from pyspark.sql import functions as F

from corpusbench import session
from corpusbench.functions.labels import as_int
from corpusbench.operators import audit as A
from corpusbench.operators import caps, curation
from corpusbench.operators import leaks
from corpusbench.operators import metrics as M
from corpusbench.operators import ranking as R
from corpusbench.sources.files import natural_key
from corpusbench.sources.readers import id_list


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("label"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("g"), F.col("id") % 3)).alias("generator"))


def test_round_robin_and_budget(rows):
    assert caps.stratified_round_robin(rows, 100, "generator", "s", "id").count() == 40
    all_ = caps.class_budget(rows, 100, "label", "generator", "s", "id")
    assert all_.count() == 40
    none = caps.class_budget(rows, 0, "label", "generator", "s", "id")
    assert none.columns == all_.columns and none.count() == 40
    assert sorted(r["place"] for r in none.where("label = 0").collect()) == list(range(1, 21))
    unlabelled = rows.withColumn("label", F.when(F.col("id") < 10, None).otherwise(F.col("label")))
    assert caps.class_budget(unlabelled, 90, "label", "generator", "s", "id").count() == 40


def test_scan_status_and_report(spark):
    rows = spark.range(20).select(F.lit(1).alias("shard"), F.col("id").alias("pos"), F.when(F.col("id") % 5 > 0, "m").alias("model"), F.lit("fake").alias("label"), F.lit(9).alias("bytes"))
    limits = spark.createDataFrame([("m", 3)], "model string, cap int")
    status = caps.scan_status(rows, limits, "shard", "pos", ["fake"], F.lit(True), F.lit(False))
    assert status.count() == 20
    report = caps.cap_report(status, "shard").first()
    assert (report["rows"], report["kept"], report["skip_model"], report["skip_cap"]) == (20, 3, 4, 13)


def test_split_cap_and_id_list(spark):
    rows = spark.range(30).select(F.col("id").alias("image_id"), F.when(F.col("id") % 3 > 0, "train").alias("split"))
    assert caps.split_cap(rows.withColumnRenamed("image_id", "id"), "split", {"train": 5}, "s", "id").count() == 15
    assert id_list(rows, {"train": 5}).count() == 15


def test_holdout_anti_join_keeps_rows_without_source(rows):
    train = rows.select("id", F.col("generator").alias("source"))
    held = train.where("id < 4").select("id")
    assert curation.holdout_anti_join(train, held, "id").count() == 36


def test_groups_meet_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    assert {tuple(r) for r in R.join_groups(a, b, ["k"]).collect()} == {(None, 1, 10), ("x", 2, 20)}


def test_whole_texts_are_compared(spark):
    head = "h" * 5000
    docs = spark.createDataFrame([(1, head + "a" * 500 + head), (2, head + "b" * 500 + head)], "doc_id long, text string").withColumn("c", F.sha2("text", 256))
    assert curation.exact_dedup(docs, "c", "doc_id", []).count() == 2


def test_mean_does_not_depend_on_the_partitions(spark):
    df = spark.range(5000).select((F.col("id") % 9 / 100.0).alias("x"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(1.5).alias("y"), F.lit("s").alias("z"))
    seen = set()
    for n in (1, 2, 5, 8, 31):
        r = {r["column"]: r for r in A.column_statistics(df.repartition(n), ["x", "y", "z"]).collect()}
        seen.add(r["x"]["mean"])
        assert r["y"]["nan_count"] == 715 and r["y"]["n_unique"] == 1 and r["z"]["mean"] is None
    assert len(seen) == 1


def test_no_single_task_sort_of_scores(spark):
    df = spark.range(1000).select(F.rand(1).alias("prob"), (F.col("id") % 2).cast("int").alias("label"), F.lit("g").alias("generator"))
    for frame in (M.metrics(df, []), M.pooled_generator_metrics(df, [])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        # Windows over all rows may only see range totals; no window without a range orders by score
        assert "[score#" not in "".join(x for x in plan.splitlines() if "Window" in x and "_part" not in x and "_all" not in x)


def test_labels_and_natural_order(spark):
    r = spark.range(1).select(as_int(F.lit(" 2147483647 ")).alias("a"), as_int(F.lit("99999999999")).alias("b")).first()
    assert r["a"] == 2147483647 and r["b"] is None
    names = ["f_" + "9" * 25, "f_1" + "0" * 25, "f_007", "f_8"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r["n"] for r in df.orderBy(natural_key(F.col("n"))).collect()] == ["f_007", "f_8", "f_" + "9" * 25, "f_1" + "0" * 25]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())


def test_passages(spark):
    items = ["one two three four five six seven eight", "a b c", "x y", "q w e r t y"]
    docs = ["zzone two three four five six seven eightzz", "one two three four five six seven", "Aa b cc", "q w e r t y q w e r t y", None, ""]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {tuple(r) for r in leaks.passage_leaks(d, i, "doc_id", "item_id").collect()} == {(0, 0), (2, 1), (3, 3)}
    assert leaks.passage_leaks(d, i.limit(0), "doc_id", "item_id").count() == 0
