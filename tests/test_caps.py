"""Capped scans order only the shard in which a model reaches its cap."""

import random
from collections import Counter

from pyspark.sql import functions as F

from corpusbench.operators import caps as K

SCHEMA = "shard int, pos int, model string, label string, bytes int, side int"


def scan(spark, rows, caps):
    return K.scan_status(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(caps, "model string, cap int"),
                         "shard", "pos", ["fake"], F.col("bytes") > 0, F.col("side") < 100, default_cap=4)


def test_status_with_nulls_equals_a_loop(spark):
    draw = random.Random(5)
    rows = [(draw.choice([None, 1, 2, 3]), p, draw.choice(["a", "b", "c", "d", None]), draw.choice(["fake", "real"]),
             draw.choice([None, 0, 7, 8, 9]), draw.choice([50, 200, 300])) for p in range(300)]
    caps, used, want = {"a": 9, "b": None, "c": 0}, Counter(), {}
    for shard, pos, model, label, size, side in sorted(rows, key=lambda r: (r[0] or 0, r[1])):
        cap = 4 if model in caps and caps[model] is None else caps.get(model)
        if label != "fake":
            want[pos] = "skip_label"
        elif model not in caps:
            want[pos] = "skip_model"
        elif cap and used[model] >= cap:
            want[pos] = "skip_cap"
        elif size == 0:
            want[pos] = "skip_bad"
        elif side < 100:
            want[pos] = "skip_small"
        else:
            used[model] += size is not None  # unknown is kept, but does not count
            want[pos] = "kept"
    assert {r.pos: r.status for r in scan(spark, rows, list(caps.items())).collect()} == want


def test_rows_are_not_sent_to_their_caps_and_counts(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scan(spark, [(1, 1, "a", "fake", 5, 200)], [("a", 1)])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # rows meet the caps for the counts and for their status, in two branches; only caps and the shards that reach them are shuffled
    assert plan.count("BroadcastHashJoin") == 4 and plan.count("SortMergeJoin") == 2
