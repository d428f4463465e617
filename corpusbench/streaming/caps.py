"""Capped pulls over arriving shards: one that ends when its caps are reached, one with a readable state table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusbench.operators.caps import caps_satisfied, per_model_cap
from corpusbench.session import scratch
from corpusbench.streaming.scoring import CAP_FIELDS, earliest_per_key, first_rows, row_limit

LEDGER = "model string, cap long, taken long, batch long"


class CapsReached(Exception):
    """Raised before a batch that no cap has room for; the batch stays unread and uncommitted."""


def written_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches below a folder, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    done = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for n in done)


def read_ledger(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The newest ledger, or the newest before a batch: one row per wanted model; none before the first batch."""
    done = [b for b in written_batches(spark, f"{out}/ledger") if before is None or b < before]
    return spark.read.schema(LEDGER).parquet(f"{out}/ledger/batch={done[-1]:06d}") if done else None


def run_until_capped(stream: DataFrame, caps: dict[str, int], out: str, checkpoint: str | None = None) -> bool:
    """Take the first rows per wanted model and end the query once every cap is reached; returns whether it was.

    ``stream`` has ``key, shard, pos, row``; shards arrive in scan order, and
    rows of one trigger are taken in (shard, pos) order. Caps that include
    ``*`` or 0 (uncapped) never end a query; a model without a cap is not
    wanted. The rows taken from batch n are in ``out``/rows/batch=n and the
    counts up to it, one row per model, in ``out``/ledger/batch=n, so a batch
    that is run again replaces its own files.

    The rule is checked before a batch is read. A batch that it stops is not
    committed: with the same checkpoint and higher caps a later run goes on
    with exactly the shards that were not read.
    """
    spark = stream.sparkSession
    wanted = spark.createDataFrame(sorted(caps), "string").toDF("model")
    limits = spark.createDataFrame(sorted(caps.items()), "model string, cap long")
    never = any(n <= 0 for n in caps.values())

    def room(batch_id: int) -> DataFrame:
        ledger = read_ledger(spark, out, batch_id)
        taken = ledger.select("model", "taken") if ledger is not None else wanted.select("model", F.lit(0).cast("long").alias("taken"))
        return limits.join(taken, "model", "left").select("model", "cap", F.coalesce("taken", F.lit(0)).alias("taken"))

    def pull(batch: DataFrame, batch_id: int) -> None:
        state = room(batch_id)
        counts = state.select("model", F.col("taken").alias("n"))
        if not never and caps_satisfied(limits, counts, wanted).first()["satisfied"]:
            raise CapsReached(f"every cap was reached before batch {batch_id}")
        left = F.when(F.col("cap") > 0, F.col("cap") - F.col("taken")).otherwise(F.lit(0))
        open_ = state.where((F.col("cap") <= 0) | (F.col("taken") < F.col("cap"))).select("model", left.alias("cap"))
        rows = batch.select(F.col("key").alias("model"), "shard", "pos", "row")
        path = f"{out}/rows/batch={batch_id:06d}"
        per_model_cap(rows, open_, "shard", "pos").select("model", "shard", "pos", "row").write.mode("overwrite").parquet(path)
        new = spark.read.schema("model string").parquet(path).groupBy("model").agg(F.count("*").alias("new"))
        total = (F.col("taken") + F.coalesce("new", F.lit(0))).alias("taken")
        after = state.join(new, "model", "left").select("model", "cap", total, F.lit(batch_id).cast("long").alias("batch"))
        after.coalesce(1).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch_id:06d}")  # one row per wanted model

    query = (stream.writeStream.foreachBatch(pull).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint or scratch(spark, "capped-checkpoint")).start())
    try:
        query.awaitTermination()
    except StreamingQueryException as error:
        if CapsReached.__name__ not in str(error):
            raise
        return True
    ledger = read_ledger(spark, out)
    return ledger is not None and not never and caps_satisfied(limits, ledger.select("model", F.col("taken").alias("n")), wanted).first()["satisfied"]


def read_capped(spark: SparkSession, out: str) -> DataFrame:
    """model, shard, pos, row of everything taken."""
    return spark.read.schema("model string, shard long, pos string, row string").option("recursiveFileLookup", True).parquet(f"{out}/rows")


class CapCounter(StatefulProcessor):
    """Per key: the rows taken so far, and per shard, for ``ttl_ms``, how many came from it."""

    def __init__(self, cap: int | dict[str, int | None], default: int, ttl_ms: int | None) -> None:
        self.cap, self.default, self.ttl_ms = cap, default, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "taken long")
        self.shards = handle.getMapState("shards", "shard long", "taken long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        used = self.used.get()[0] if self.used.exists() else 0
        best = first_rows(rows, row_limit(self.cap, self.default)(key[0]) - used)
        if best is None or not len(best):
            return
        self.used.update((used + len(best),))
        for shard, n in best.groupby("shard").size().items():
            place = (int(shard),)
            before = self.shards.getValue(place)[0] if self.shards.containsKey(place) else 0
            self.shards.updateValue(place, (before + int(n),))
        yield best[["key", "shard", "pos", "row"]]

    def close(self) -> None:
        pass


#: The state store of typed state; and no batches without data, which a state with expiry would ask for without end.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """Settings that a stream with typed state must start under; a running stream keeps them."""
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def capped_with_state(stream: DataFrame, cap: int | dict[str, int | None], default: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """First rows per key like ``capped_by_key``, with typed state that can be read as a table.

    ``used`` is kept per key as long as the stream. ``shards`` says what came
    from which shard and, with ``ttl_ms``, forgets a shard that long after it
    last gave a row, so its size does not follow the number of shards. Start
    the stream under ``state_settings``.
    """
    return earliest_per_key(stream, cap, default).groupBy("key").transformWithStateInPandas(
        CapCounter(cap, default, ttl_ms), outputStructType=CAP_FIELDS, outputMode="append", timeMode="ProcessingTime" if ttl_ms else "None")


def read_used(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key and taken, from the state of the last committed batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "used").load()
    return state.select(F.col("key.key").alias("key"), F.col("value.taken").alias("taken"))


def read_shards(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key, shard and taken, from the state of the last committed batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "shards").load()
    value = state.schema["user_map_value"].dataType
    taken = "user_map_value.value.taken" if "value" in value.fieldNames() else "user_map_value.taken"  # an expiry wraps the value
    return state.select(F.col("key.key").alias("key"), F.col("user_map_key.shard").alias("shard"), F.col(taken).alias("taken"))
