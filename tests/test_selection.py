import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusbench.operators import audit as A
from corpusbench.operators import caps as K
from corpusbench.operators import curation as C
from corpusbench.operators import mixture as X
from corpusbench.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of all rows; some keys are tiny."""
    key = F.when(F.col("id") % 5 < 2, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 17))
    return spark.range(4000).select("id", key.alias("key"), (F.col("id") % 13).alias("shard")).cache()


def test_bucketed_numbers_equal_a_plain_sort(spark, skewed):
    rows = skewed.collect()
    want = {}
    for k in {r.key for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r.key == k), key=lambda r: (r.shard, r.id)), 1):
            want[r.id] = i
    got = R.grouped_row_number(skewed, ["key"], ["shard", "id"], F.col("shard"))
    assert {r.id: r.rn for r in got.collect()} == want
    first = R.grouped_row_number(skewed, ["key"], ["shard", "id"], F.col("shard"), first=50)
    assert {r.id for r in first.collect()} == {i for i, n in want.items() if n <= 50}


def test_bucket_count_does_not_change_seeded_numbers(spark, skewed):
    a = R.seeded_row_number(skewed, ["key"], "s", "id").select("id", "rn")
    base = {r.id: r.rn for r in a.collect()}
    spark.conf.set(R.BUCKETS_CONF, "3")
    try:
        assert {r.id: r.rn for r in R.seeded_row_number(skewed, ["key"], "s", "id").collect()} == base
    finally:
        spark.conf.unset(R.BUCKETS_CONF)


def test_bucketed_top_equals_plain_top(spark, skewed):
    a = R.top_per_group(skewed, ["key"], [F.desc("id")], 1200, bucket=F.floor(-F.col("id") / 100))
    b = R.top_per_group(skewed, ["key"], [F.desc("id")], 1200)
    assert {(r.id, r["rank"]) for r in a.collect()} == {(r.id, r["rank"]) for r in b.collect()}


def test_capped_scan_equals_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(8), f"{i:05d}", rng.choice(["hot", "hot", "a", "b", "c"]), rng.choice(["fake", "fake", "real"]),
             rng.choice([0, 5, 9]), rng.choice([10, 300])) for i in range(1500)]
    caps = {"hot": 60, "a": 25, "b": 0}
    df = spark.createDataFrame(rows, "shard int, pos string, model string, label string, bytes long, side int")
    capdf = spark.createDataFrame(list(caps.items()), "model string, cap int")
    got = K.scan_status(df, capdf, "shard", "pos", ["fake"], F.col("bytes") > 0, F.col("side") < 100)
    used, want = Counter(), {}
    for shard, pos, model, label, size, side in sorted(rows, key=lambda r: (r[0], r[1])):
        if label != "fake":
            want[pos] = "skip_label"
        elif model not in caps:
            want[pos] = "skip_model"
        elif caps[model] and used[model] >= caps[model]:
            want[pos] = "skip_cap"
        elif size == 0:
            want[pos] = "skip_bad"
        elif side < 100:
            want[pos] = "skip_small"
        else:
            used[model] += 1
            want[pos] = "kept"
    assert {r.pos: r.status for r in got.collect()} == want


def test_tiers(spark):
    rank = spark.createDataFrame(
        [("a", 0.5), ("b", 0.70), ("c", 0.97), ("d", 0.98), ("e", None), ("tiny-random-sana", 0.1)], "model string, recall_mean double")
    assert {r.model: r.cap for r in K.tier_caps(rank).collect()} == {"a": 25000, "b": 15000, "c": 10000}


def test_caps_satisfied(spark):
    def ask(caps, counts, wanted):
        return K.caps_satisfied(
            spark.createDataFrame(caps, "model string, cap int"), spark.createDataFrame(counts, "model string, n long"),
            spark.createDataFrame([(w,) for w in wanted], "model string")).first().satisfied

    assert ask([("a", 2)], [("a", 2)], ["a"]) is True
    assert ask([("a", 2)], [("a", 1)], ["a"]) is False
    assert ask([("a", 2)], [("a", 2)], ["a", "b"]) is False
    assert ask([("*", 2)], [("a", 9)], []) is False
    assert ask([], [("a", 9)], []) is False


def test_round_robin_counts_are_water_filling(spark, skewed):
    got = Counter(r.key for r in K.stratified_round_robin(skewed, 300, "key", "s", "id").collect())
    sizes = Counter(r.key for r in skewed.collect())
    want, left = Counter(), 300
    while left:
        for k in sorted(sizes):
            if left and want[k] < sizes[k]:
                want[k] += 1
                left -= 1
    assert got == want
    assert K.stratified_round_robin(skewed, 10**6, "key", "s", "id").count() == 4000


def test_shard_selection(spark):
    df = spark.range(186)
    got = sorted(r.id for r in K.coverage_shards(df, "id", 3).collect())
    assert got == sorted({*range(0, 70, 3), *range(70, 94), *range(94, 186, 3)})
    assert [r.id for r in K.shard_stride(df, "id", 40, 5, 3).orderBy("id").collect()] == [5, 45, 85]


def test_budget_keeps_the_crossing_row(spark):
    df = spark.createDataFrame([(0, "a", 5), (0, "b", 6), (1, "c", 1), (1, "d", 1)], "shard int, pos string, bytes long")
    assert sorted(r.pos for r in K.budget_cap(df, "shard", "pos", "bytes", max_bytes=10).collect()) == ["a", "b"]
    assert sorted(r.pos for r in K.budget_cap(df, "shard", "pos", "bytes", max_items=3).collect()) == ["a", "b", "c"]


def test_largest_remainder_sums_and_prefers_fractions(spark):
    df = spark.createDataFrame([("g", i, float(w), 10.0) for i, w in enumerate([1, 1, 1, 0, -2])], "g string, pos int, w double, n double")
    got = [r.out for r in X.largest_remainder(df, ["g"], "w", "n", "pos", "out").orderBy("pos").collect()]
    assert got == [4, 3, 3, 0, 0]


def test_documented_class_shares(spark):
    weights = [("comfor", 0.176, [0, 1]), ("ntire", 0.224, [0, 1]), ("openfake", 0.128, [0, 1]), ("flux-reason", 0.04, [1]),
               ("frontier-fakes", 0.04, [1]), ("sid-set", 0.04, [1]), ("gs-images-v3", 0.072, [1]), ("gs-images-v4", 0.08, [1]),
               ("laion400m-1", 0.128, [0]), ("open-images-v7", 0.072, [0])]
    df = spark.createDataFrame([(n, i, w, c) for i, (n, w, c) in enumerate(weights)],
                               "source string, k int, weight double, classes array<int>")
    got = {(r.source, r.label): round(100 * r.class_share) for r in X.class_shares(df).collect()}
    assert [got[n, 1] for n in ("ntire", "comfor", "openfake", "gs-images-v4", "gs-images-v3", "flux-reason")] == [28, 22, 16, 10, 9, 5]
    assert [got[n, 0] for n in ("ntire", "comfor", "laion400m-1", "openfake", "open-images-v7")] == [31, 24, 18, 18, 10]


def test_mixture_is_balanced_and_cycles_evenly(spark):
    pool = spark.range(40).select("id", F.lit("s").alias("source"), (F.col("id") % 2).cast("int").alias("label"))
    specs = spark.createDataFrame([("s", 0, 1.0, [0, 1])], "source string, k int, weight double, classes array<int>")
    got = X.mixture_draw(spark.range(4000).withColumnRenamed("id", "draw"), pool, X.class_shares(specs), "t", block=97).collect()
    assert len(got) == 4000
    share = sum(r.label for r in got) / 4000
    assert abs(share - 0.5) < 4 * 0.5 / 4000 ** 0.5
    times = defaultdict(Counter)
    for r in got:
        times[r.label][r.id] += 1
    for c in times.values():
        assert max(c.values()) - min(c.values()) <= 1


def test_holdout_reuse(spark):
    train = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, source string")
    held = spark.createDataFrame([(2,), (3,)], "id int")
    got = {(r.id, r.reused) for r in C.holdout_anti_join(train, held, "id").collect()}
    assert got == {(1, False), (3, True)}


def test_composites(spark):
    df = spark.range(640).select("id", (F.col("id") % 3 == 0).cast("int").alias("label"), F.floor(F.col("id") / 64).alias("batch"))
    label = {r.id: r.label for r in df.collect()}
    plan = X.composite_plan(df, "c", "id", "batch").cache()
    by = defaultdict(Counter)
    for r in plan.collect():
        by[r.batch][r.combo] += 1
        assert r.partner != r.id or r.combo == "fake_on_fake"
        assert label[r.partner] == (1 if r.combo == "fake_on_fake" else 0)
        assert 1 <= r.overlays <= 3 and label[r.id] == (r.combo != "real_on_real")
    for c in by.values():
        fakes = [c["fake_on_real"], c["real_on_fake"], c["fake_on_fake"]]
        assert max(fakes) - min(fakes) <= 1 and c["real_on_real"] == round(sum(fakes) / 3)
    only = X.composite_plan(df.where("label = 1"), "c", "id", "batch")
    assert {r.combo for r in only.select("combo").distinct().collect()} == {"fake_on_fake"}
    spark.udtf.register("overlay_rows", X.overlay_table_function("o"))
    plan.createOrReplaceTempView("plan_rows")
    a = spark.sql("select p.id, o.overlay, o.top_class from plan_rows p, lateral overlay_rows(p.id, p.combo, p.overlays) o")
    b = X.overlay_draws(plan, "o").select("id", "overlay", "top_class")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_augment_rates(spark):
    df = X.augment_plan(spark.range(4000), "a", "id")
    n = {r.slot: r["count"] for r in df.groupBy("slot").count().collect()}
    for name, (prob, _) in X.AUGMENT.items():
        assert abs(n[name] / 4000 - prob) < 4 * (prob * (1 - prob) / 4000) ** 0.5
    aligned = X.augment_plan(spark.range(2000), "a", "id", aligned=True)
    assert aligned.where(F.col("kind").isin(["hflip", "random_crop", "center_crop", *X.UNALIGNED_KINDS])).count() == 0
    assert len(X.EXTRA_KINDS) == 34 and len(X.EXTRA_KINDS) - len(X.UNALIGNED_KINDS) == 30


def test_dedup_and_overlap_of_a_hot_copy(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("c"))
    got = C.exact_dedup(df, "c", "id", []).where("c = 'same'").first()
    assert (got.id, got.copies) == (0, 1000)
    both = C.overlap(df.where("id < 1500"), df.where("id >= 1500"), "c").collect()
    assert [(r.c, r.train_rows, r.held_rows) for r in both] == [("same", 500, 500)]


def test_leaderboard_marks(spark):
    from corpusbench.plans.report_queries import LEADERBOARD

    ours = spark.createDataFrame([("ours", 0.9676961538, 0.9228166667, True)], "method string, auroc double, robust double, ours boolean")
    rows = {r.method: r for r in A.leaderboard(spark.createDataFrame(LEADERBOARD, "method string, auroc double, robust double"), ours).collect()}
    assert rows["ours"]["rank"] == 3 and rows["MICV"].robust_mark == "best" and rows["Ant International"].robust_mark == "second"
    assert rows["Ant International"].auroc_mark == "second"
