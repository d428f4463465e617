"""Prompt harvest, de-duplication, leak audit, resume and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.functions.rng import uniform
from corpusbench.operators.ranking import join_groups


def harvest_prompts(df: DataFrame, n: int, seed: str, key: str = "id", prompt: str = "prompt",
                    min_chars: int = 8) -> DataFrame:
    """The first ``n`` distinct prompts of safe fakes in seeded order.

    Copies collapse in a combining aggregate, so one prompt repeated in a
    third of all rows leaves each task as one row.
    """
    text = F.trim(F.col(prompt))
    kept = df.where((F.col("label") == 1) & ~F.col("nsfw_flag") & (F.length(text) >= min_chars)).select(
        F.md5(F.lower(text)).alias("_key"), F.struct(
            uniform(seed, F.col(key)).alias("u"), F.col(key).alias("key"), text.alias("prompt")).alias("_row"))
    first = kept.groupBy("_key").agg(F.min("_row").alias("r"))
    return first.select("r.key", "r.u", "r.prompt").orderBy("u", "key").limit(n)


def harvest_bases(df: DataFrame, n: int, seed: str, key: str, side: Column, min_side: int) -> DataFrame:
    """The first ``n`` real items of at least ``min_side`` in seeded order, numbered."""
    kept = df.where((F.col("label") == 0) & (side >= min_side)).select(
        F.col(key).alias("key"), uniform(seed, F.col(key)).alias("u"))
    first = kept.orderBy("u", "key").limit(n)
    pos = (F.row_number().over(Window.orderBy("u", "key")) - 1).cast("int")
    return first.withColumn("pos", pos).withColumn("name", F.format_string("real_%06d", "pos"))


def exact_dedup(df: DataFrame, content: str, key: str, keep: list[str]) -> DataFrame:
    """One row per content id, the smallest key wins; ``copies`` counts all."""
    return df.groupBy(content).agg(
        F.min(F.struct(key, *keep)).alias("_row"), F.count("*").alias("copies"),
    ).select(content, "_row.*", "copies")


def skip_present(jobs: DataFrame, existing: DataFrame, on: str, size: str, floor: int) -> DataFrame:
    """Jobs without an output larger than ``floor``."""
    return jobs.join(existing.where(F.col(size) > floor).select(on), on, "left_anti")


def overlap(train: DataFrame, held: DataFrame, on: str) -> DataFrame:
    """Identities present on both sides with their row counts.

    Both sides are counted before they meet, so the join handles one row per
    identity and cannot multiply copies.
    """
    a = train.groupBy(on).agg(F.count("*").alias("train_rows"))
    b = held.groupBy(on).agg(F.count("*").alias("held_rows"))
    return a.join(b, on)


def holdout_anti_join(train: DataFrame, held: DataFrame, on: str, source: str = "source") -> DataFrame:
    """Drop held-out rows, but let a source that is wholly held out be reused.

    ``held`` ids are distinct by construction of the hold-out; coverage is
    one count pair per source, bounded by the number of sources.
    """
    marked = train.join(held.select(on).distinct().withColumn("_held", F.lit(True)), on, "left")
    survivors = marked.groupBy(source).agg(F.count_if(F.col("_held").isNull()).alias("_left"))
    return join_groups(marked, survivors, [source]).where(F.col("_held").isNull() | (F.col("_left") == 0)).withColumn(
        "reused", F.col("_held").isNotNull()).drop("_held", "_left")


def resume_anti_join(todo: DataFrame, prior: DataFrame, on: str, pred: str = "pred") -> DataFrame:
    """Rows without a finished prediction; null predictions are tried again."""
    return todo.join(prior.where(F.col(pred).isNotNull()).select(on), on, "left_anti")


def first_by_key(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """First row per key in ``order`` as a combining aggregate."""
    fields = list(dict.fromkeys([*order, *keep]))
    return df.groupBy(key).agg(F.min(F.struct(*fields)).alias("_row")).select(
        key, *[F.col(f"_row.{c}").alias(c) for c in keep])


def union_distinct_ordered(first: DataFrame, second: DataFrame, name: str, pos: str) -> DataFrame:
    """Ordered set union: names of ``first`` in order, then new names of ``second``."""
    both = first.select(name, F.lit(0).alias("part"), pos).unionByName(
        second.select(name, F.lit(1).alias("part"), pos))
    return both.groupBy(name).agg(F.min(F.struct("part", pos)).alias("_first")).select(
        name, F.col("_first.part").alias("part"), F.col(f"_first.{pos}").alias(pos)).orderBy("part", pos)


def prompt_assignment(jobs: DataFrame, job: str, prompts: DataFrame, seed: str) -> DataFrame:
    """Job ``i`` takes prompt ``i mod k`` and its own 31-bit seed.

    ``prompts`` are numbered once; whether they are small enough to be
    broadcast is left to adaptive execution.
    """
    numbered = prompts.select(
        (F.row_number().over(Window.orderBy("u", "key")) - 1).alias("slot"), F.col("key").alias("prompt_key"))
    k = numbered.agg(F.count("*").alias("k")).scalar()
    slot = (F.col(job) % k).cast("int")
    return jobs.withColumn("slot", slot).join(
        numbered, "slot").withColumn(
        "seed", F.floor(uniform(seed, F.col(job)) * F.lit(2147483648.0)).cast("long"))
