"""Capped streams: where they stop, what they read, and the state they leave."""

import pytest
from pyspark.sql import functions as F

from corpusbench.operators.caps import per_model_cap
from corpusbench.session import scratch
from corpusbench.streaming import caps as P
from corpusbench.streaming import scoring as T


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(2000).select(F.concat(F.lit("m"), F.col("id") % 7).alias("key"), F.floor(F.col("id") / 100).alias("shard"),
                                    F.format_string("%05d", "id").alias("pos"), F.lit("r").alias("row"))


@pytest.fixture(scope="module")
def arrivals(spark, rows):
    """Ten files of two shards each, in scan order."""
    path = scratch(spark, "test-arrivals")
    for k in range(10):
        rows.where(f"shard between {2 * k} and {2 * k + 1}").coalesce(1).write.mode("append").parquet(path)
    return path


def batch_form(spark, rows, caps):
    limits = spark.createDataFrame(list(caps.items()), "model string, cap long")
    return {(r["model"], r["pos"]) for r in per_model_cap(rows.withColumnRenamed("key", "model"), limits, "shard", "pos").collect()}


def counted(stream, seen):
    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    return stream.mapInPandas(count, stream.schema)


def test_stops_and_goes_on(spark, rows, arrivals):
    out, checkpoint = scratch(spark, "test-out"), scratch(spark, "test-checkpoint")
    seen = spark.sparkContext.accumulator(0)
    stream = lambda: T.shard_stream(spark, arrivals, rows.schema, per_trigger=1)
    first = {"m1": 50, "m2": 60, "m3": 1}
    assert P.run_until_capped(counted(stream(), seen), first, out, checkpoint)
    got = {(r["model"], r["pos"]) for r in P.read_capped(spark, out).collect()}
    assert got == batch_form(spark, rows, first)
    # m2 is full in the third arrival: seven of ten files, 1,400 rows, were never read (bucket sizes and rows of a batch are two passes)
    assert P.written_batches(spark, f"{out}/ledger") == [0, 1, 2] and seen.value <= 2 * 600
    # the same checkpoint with a higher cap goes on with the fourth arrival
    more = {"m1": 50, "m2": 60, "m3": 100}
    assert P.run_until_capped(stream(), more, out, checkpoint)
    full = {(r["model"], r["pos"]) for r in P.read_capped(spark, out).collect()}
    want = batch_form(spark, rows, more)
    assert got <= full and {k for k in full if k[0] != "m3"} == {k for k in want if k[0] != "m3"}
    assert len([k for k in full if k[0] == "m3"]) == 100 and min(k[1] for k in full - got) >= "00600"


def test_never_stops_without_room_to_reach(spark, rows, arrivals):
    for caps in ({"m1": 50, "m2": 0}, {"m1": 10**6}, {"*": 1, "m1": 5}):
        out = scratch(spark, "test-open")
        assert not P.run_until_capped(T.shard_stream(spark, arrivals, rows.schema, per_trigger=None), caps, out)
        got = {(r["model"], r["pos"]) for r in P.read_capped(spark, out).collect()}
        assert got == batch_form(spark, rows, caps)


def test_other_errors_are_not_taken_for_a_stop(spark, rows, arrivals):
    broken = T.shard_stream(spark, arrivals, rows.schema).withColumn("shard", F.assert_true(F.lit(False)).cast("long"))
    with pytest.raises(Exception, match="is not true"):
        P.run_until_capped(broken, {"m1": 1}, scratch(spark, "test-broken"))


@pytest.mark.parametrize("ttl_ms", [None, 3_600_000])
def test_typed_state_survives_a_restart(spark, rows, arrivals, ttl_ms):
    caps = {"m1": 50, "m2": 0, "m3": None, "m4": 1}
    out, checkpoint, part = scratch(spark, "test-state-out"), scratch(spark, "test-state"), scratch(spark, "test-part")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for cut in ("shard < 9", "shard >= 9"):
        rows.where(cut).write.mode("append").parquet(part)
        with P.state_settings(spark):
            T.run_to_files(P.capped_with_state(T.shard_stream(spark, part, rows.schema, None), caps, default=20, ttl_ms=ttl_ms), "test", checkpoint, out)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    taken = spark.read.schema(T.CAP_FIELDS).parquet(out).withColumnRenamed("key", "model")
    want = batch_form(spark, rows, {"m1": 50, "m2": 0, "m3": 20, "m4": 1})
    assert {(r["model"], r["pos"]) for r in taken.collect()} == want
    with P.state_settings(spark):
        used = {r["key"]: r["taken"] for r in P.read_used(spark, checkpoint).collect()}
        shards = {(r["key"], r["shard"]): r["taken"] for r in P.read_shards(spark, checkpoint).collect()}
    assert used == {r["model"]: r["count"] for r in taken.groupBy("model").count().collect()}
    assert shards == {(r["model"], r["shard"]): r["count"] for r in taken.groupBy("model", "shard").count().collect()}
