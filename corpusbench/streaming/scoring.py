"""Shards scored, counted and capped as they arrive.

Streams read shard files and write to files under a checkpoint, so a
restart continues where the last finished batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusbench.session import scratch


def shard_stream(spark: SparkSession, path: str, schema, per_trigger: int | None = 1) -> DataFrame:
    """New parquet shards below ``path``, a few files per trigger (all of them with None)."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def run_to_files(stream: DataFrame, name: str, checkpoint: str | None = None, out: str | None = None) -> str:
    """Append everything available now to parquet files; returns their folder."""
    spark = stream.sparkSession
    out = out or scratch(spark, f"{name}-out")
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch(spark, f"{name}-checkpoint"))
         .option("path", out).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], name: str,
                mode: str = "append", checkpoint: str | None = None) -> None:
    """Hand every micro-batch to ``handle(batch, batch_id)``."""
    q = (stream.writeStream.outputMode(mode).foreachBatch(handle)
         .option("checkpointLocation", checkpoint or scratch(stream.sparkSession, f"{name}-checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def first_seen(stream: DataFrame, key: str, watermark: tuple[str, str] | None = None) -> DataFrame:
    """First row per key. State grows with the keys unless a time column bounds it."""
    if watermark:
        column, delay = watermark
        return stream.withWatermark(column, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def running_counts(stream: DataFrame, seq: str, every: int, threshold: float = 0.5) -> DataFrame:
    """Counts, accuracy and mean score per block of ``every`` items."""
    hit = (F.col("prob") >= threshold).cast("int") == F.col("label")
    return stream.groupBy(F.floor(F.col(seq) / every).alias("block")).agg(
        F.count("*").alias("n"), F.count_if(hit).alias("correct"), F.sum("prob").alias("prob_sum"))


CAP_FIELDS = "key string, shard long, pos string, row string"


def row_limit(cap: int | dict[str, int | None], default: int = 0) -> Callable[[str], int]:
    """Rows allowed per key: one number for all, or one per wanted key; null takes ``default``, 0 means uncapped."""

    def limit(key: str) -> int:
        n = cap if isinstance(cap, int) else (default if cap[key] is None else cap[key])
        return n or 2**62

    return limit


def earliest_per_key(rows: DataFrame, cap: int | dict[str, int | None], default: int = 0) -> DataFrame:
    """Of ``key, shard, pos, row`` each task's first rows per wanted key, as many as the cap allows.

    So a key that fills a third of the stream sends its cap of rows per task
    on, not its rows.
    """
    limit = row_limit(cap, default)
    if isinstance(cap, dict):
        rows = rows.where(F.col("key").isin(list(cap)))

    def earliest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for pdf in batches:
            both = (pdf if best is None else pd.concat([best, pdf])).sort_values(["shard", "pos"], kind="stable")
            best = both[both.groupby("key", sort=False).cumcount() < both["key"].map(limit)]
        if best is not None:
            yield best

    return rows.select("key", "shard", "pos", "row").mapInPandas(earliest, CAP_FIELDS)


def first_rows(batches: Iterator[pd.DataFrame], room: int) -> pd.DataFrame | None:
    """The first ``room`` rows in (shard, pos) order."""
    best: pd.DataFrame | None = None
    if room > 0:
        for pdf in batches:
            both = pdf if best is None else pd.concat([best, pdf])
            best = both.sort_values(["shard", "pos"], kind="stable").head(room)
    return best


def capped_by_key(stream: DataFrame, cap: int | dict[str, int | None], default: int = 0) -> DataFrame:
    """First rows per key over the whole stream, by a carried count.

    ``cap`` is one number for all keys, or a number per wanted key; other
    keys are then dropped. A null cap takes ``default``, and 0 means
    uncapped. ``stream`` has ``key, shard, pos, row``. Only a count is kept
    per key. Rows of one trigger are taken in (shard, pos) order.
    """
    limit = row_limit(cap, default)

    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        best = first_rows(batches, limit(key[0]) - used)
        if best is not None and len(best):
            state.update((used + len(best),))
            yield best[["key", "shard", "pos", "row"]]

    return earliest_per_key(stream, cap, default).groupBy("key").applyInPandasWithState(
        take, outputStructType=CAP_FIELDS, stateStructType="used long", outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)


def cap_ledger(taken: DataFrame, cap: dict[str, int | None], default: int = 0) -> DataFrame:
    """One row per wanted key: its cap, the rows taken, and whether the cap is reached.

    A run may stop when all are ``reached``; an uncapped key never is.
    """
    rows = [(k, default if v is None else v) for k, v in cap.items()]
    wanted = taken.sparkSession.createDataFrame(rows, "model string, cap long")
    counts = taken.groupBy("model").agg(F.count("*").alias("taken"))
    n = F.coalesce("taken", F.lit(0))
    return wanted.join(counts, "model", "left").select(
        "model", "cap", n.alias("taken"), ((F.col("cap") > 0) & (n >= F.col("cap"))).alias("reached"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records of an interrupted run; a torn last line is skipped."""
    raw = spark.read.schema("image_path string, pred double, _torn string").option(
        "columnNameOfCorruptRecord", "_torn").json(path)
    done = raw.where(F.col("_torn").isNull() & F.col("image_path").isNotNull())
    return done.groupBy("image_path").agg(F.max("pred").alias("pred"))
