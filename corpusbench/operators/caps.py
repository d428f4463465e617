"""Per-model caps, budgets and class-balanced selections.

All selections number rows inside (group, bucket) and add the counts of
earlier buckets, so a model or class holding most of the rows is cut over
many tasks. See ``ranking``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.functions.rng import uniform
from corpusbench.operators.ranking import (
    grouped_row_number, grouped_sum_before, join_groups, seeded_row_number,
)

UNCAPPED = 2**62
# Recall bound -> per-model cap, and generators never taken.
DEFAULT_TIERS = [(0.70, 25000), (0.95, 15000), (0.98, 10000)]
DEFAULT_EXCLUDE = ["tiny-random-sana"]


def scan_status(rows: DataFrame, caps: DataFrame, shard: str, pos: str, labels: list[str],
                ok: Column, small: Column, default_cap: int = 0) -> DataFrame:
    """What a capped scan does with every row, as ``status``.

    ``caps`` (model, cap) names the wanted models; a null cap takes
    ``default_cap`` and 0 means uncapped. A row that turns out unusable
    gives its slot back, so only usable rows count against the cap.

    Counts of usable rows per (model, shard) tell in which shard a model
    reaches its cap. Rows before and after that shard stay where they are;
    only the model's rows inside it are put in order. ``caps``, one row per
    wanted model, is broadcast.
    """
    in_label = F.col("label").isin(labels)
    counted = in_label & ok & ~small
    wanted = caps.select("model", F.coalesce(F.col("cap"), F.lit(default_cap)).alias("_cap"))
    per = rows.where(counted).join(F.broadcast(wanted.where("_cap > 0")), "model").groupBy("model", "_cap", F.col(shard).alias("at")).agg(
        F.count("*").alias("_n"))
    upto = Window.partitionBy("model").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = per.withColumn("_upto", F.sum("_n").over(upto)).where("_upto >= _cap")
    ends = full.groupBy("model").agg(F.min(F.struct("at", (F.col("_upto") - F.col("_n")).alias("before"))).alias("_end"))
    limits = wanted.join(ends, "model", "left").withColumn("_wanted", F.lit(True))
    joined = rows.join(F.broadcast(limits), "model", "left")

    inside = F.col("_end").isNotNull() & F.col(shard).eqNullSafe(F.col("_end.at"))
    # a null shard comes first, as nulls do in an ascending order
    past = F.col("_end").isNotNull() & F.coalesce(F.col(shard) > F.col("_end.at"), F.col(shard).isNotNull())
    used = Window.partitionBy("model").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_end.before") + F.coalesce(F.sum(counted.cast("long")).over(used), F.lit(0))
    run = joined.where(~inside).withColumn("_capped", past).unionByName(
        joined.where(inside).withColumn("_capped", before >= F.col("_cap")))
    return run.withColumn(
        "status",
        F.when(~in_label, "skip_label")
        .when(F.col("_wanted").isNull(), "skip_model")
        .when(F.col("_capped"), "skip_cap")
        .when(~ok, "skip_bad")
        .when(small, "skip_small")
        .otherwise("kept"),
    ).drop("_wanted", "_cap", "_end", "_capped")


def per_model_cap(rows: DataFrame, caps: DataFrame, shard: str, pos: str, default_cap: int = 0) -> DataFrame:
    """First ``cap`` rows of each wanted model in scan order; rows must be usable already. ``caps`` is broadcast."""
    cap = F.coalesce(F.col("cap"), F.lit(default_cap))
    joined = rows.join(F.broadcast(caps), "model").withColumn(
        "cap", F.when(cap > 0, cap).otherwise(F.lit(UNCAPPED)).cast("long"))
    return grouped_row_number(joined, ["model"], [shard, pos], F.col(shard), out="taken", first="cap")


def cap_report(status: DataFrame, shard: str) -> DataFrame:
    """Counts per shard plus running totals; the running window sees one row per shard."""
    per = status.groupBy(shard).agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col("status") == s).alias(s)
          for s in ("kept", "skip_model", "skip_cap", "skip_small", "skip_bad")],
        F.coalesce(F.sum(F.when(F.col("status") == "kept", F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.count_distinct(F.when(F.col("status") == "kept", F.col("model"))).alias("models"),
    )
    upto = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("kept_so_far", F.sum("kept").over(upto)).withColumn(
        "bytes_so_far", F.sum("bytes").over(upto))


def caps_satisfied(caps: DataFrame, counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: every cap reached, and every wanted model capped. False without caps or with ``*``."""
    joined = caps.join(counts, "model", "left")
    reached = joined.agg(
        F.count("*").alias("caps"),
        F.coalesce(F.bool_or(F.col("model") == "*"), F.lit(False)).alias("catch_all"),
        F.coalesce(F.bool_and(F.coalesce("n", F.lit(0)) >= F.col("cap")), F.lit(False)).alias("reached"),
    )
    missing = wanted.join(caps, "model", "left_anti").agg(F.count("*").alias("m")).scalar()
    return reached.select(
        "caps", missing.alias("uncapped_wanted"),
        ((F.col("caps") > 0) & ~F.col("catch_all") & F.col("reached") & (missing == 0)).alias("satisfied"))


def tier_caps(rank: DataFrame, tiers: list[tuple[float, int]] | None = None,
              exclude: list[str] | None = None, model: str = "model", recall: str = "recall_mean") -> DataFrame:
    """Cap by the first tier whose bound exceeds the recall; none above the last."""
    tiers = sorted(tiers or DEFAULT_TIERS)
    cap = F.lit(None).cast("int")
    for bound, value in reversed(tiers):
        cap = F.when(F.col(recall) < bound, F.lit(value)).otherwise(cap)
    out = rank.where(~F.col(model).isin(exclude or DEFAULT_EXCLUDE) & F.col(recall).isNotNull())
    return out.select(F.col(model).alias("model"), cap.alias("cap")).where(F.col("cap").isNotNull())


def cap_merge(caps: DataFrame, floor: int, overrides: DataFrame) -> DataFrame:
    """Raise caps to ``floor``; an override (model, override) wins and may add a model."""
    return caps.join(overrides, "model", "full").select("model", F.coalesce(
        "override", F.greatest(F.col("cap"), F.lit(floor))).alias("cap"))


# ---------------------------------------------------------------- selections


def stratified_round_robin(df: DataFrame, n: int, group: str, seed: str, key: str) -> DataFrame:
    """``n`` rows taken one per group in turn, groups in name order."""
    ranked = seeded_row_number(df, [group], seed, key, out="turn", first=n)
    return ranked.orderBy("turn", group).limit(n)


def class_budget(df: DataFrame, n: int, label: str, group: str, seed: str, key: str) -> DataFrame:
    """Budget ``n`` split over classes, leftover to the lowest, round-robin inside each class."""
    ranked = seeded_row_number(df, [label, group], seed, key, out="turn", first=n if n > 0 else None)
    if n <= 0:  # no budget: all rows, numbered in the same order
        unlimited = ranked.withColumn("budget", F.lit(None).cast("long"))
        return grouped_row_number(unlimited, [label], ["turn", group], F.col("turn"), out="place")
    classes = df.select(label).distinct()
    order = Window.orderBy(label)
    k = F.count("*").over(Window.partitionBy())
    budgets = classes.select(
        label, (F.floor(F.lit(n) / k) + F.when(
            F.row_number().over(order) <= F.lit(n) - F.floor(F.lit(n) / k) * k, 1).otherwise(0)).cast("long").alias("budget"))
    return grouped_row_number(join_groups(ranked, budgets, [label]), [label], ["turn", group], F.col("turn"),
                              out="place", first="budget")


def balanced_subset(df: DataFrame, n: int, label: str, seed: str, key: str) -> DataFrame:
    """The same number of reals and fakes, at most ``n // 2`` each."""
    sizes = df.agg(F.least(
        F.lit(n // 2).cast("long"), F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("k"))
    two = df.where(F.col(label).isin(0, 1)).withColumn("_k", sizes.scalar())
    return seeded_row_number(two, [label], seed, key, out="rn", first="_k").drop("_k")


def source_val_slice(df: DataFrame, quotas: DataFrame, seed: str, key: str) -> DataFrame:
    """Rows up to the quota of their (source, label) in seeded order.

    ``quotas`` has ``source, label, want``; see ``val_quotas``.
    """
    return seeded_row_number(df.join(quotas, ["source", "label"]), ["source", "label"], seed, key,
                             out="rn", first="want")


def val_quotas(specs: DataFrame, n: int, classes: str = "classes", order: str = "k") -> DataFrame:
    """``n`` split over sources in spec order; two-class sources halve theirs, reals first."""
    pos = F.row_number().over(Window.orderBy(order))
    k = F.count("*").over(Window.partitionBy())
    each = F.greatest(F.lit(1), F.floor(F.lit(n) / k))
    want = specs.withColumn("_want", (each + F.when(
        pos <= F.greatest(F.lit(0), F.lit(n) - each * k), 1).otherwise(0)).cast("long"))
    both = F.size(classes) >= 2
    return want.select("source", classes, "_want", F.explode(classes).alias("label")).select(
        "source", "label",
        F.when(~both, F.col("_want")).when(F.col("label") == 0, F.floor((F.col("_want") + 1) / 2))
        .otherwise(F.floor(F.col("_want") / 2)).cast("long").alias("want"))


def interleave(df: DataFrame, label: str, seed: str, key: str) -> DataFrame:
    """Real, fake, real, fake, ...; the longer side's rest follows.

    The position is computed from the row's number in its class, so no
    global sort is needed.
    """
    ranked = seeded_row_number(df, [label], seed, key, out="rn")
    short = df.agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("m")).scalar()
    return ranked.withColumn("_m", short).withColumn(
        "position",
        F.when(F.col("rn") <= F.col("_m"), (F.col("rn") - 1) * 2 + F.col(label))
        .otherwise(F.col("_m") + F.col("rn") - 1)).drop("_m")


def class_mix_pick(df: DataFrame, n: int, label: str, key: str, bucket: Column) -> DataFrame:
    """``n`` rows preferring half of each class, filled up in key order."""
    each = max(1, n // 2)
    real = (F.col(label) < 0.5).cast("int")
    ranked = grouped_row_number(df.withColumn("_real", real), ["_real"], [key], bucket, out="rn", first=n)
    tier = F.when(F.col("rn") <= each, F.when(F.col("_real") == 1, 0).otherwise(1)).otherwise(2)
    return ranked.withColumn("tier", tier).orderBy("tier", key).limit(n).drop("_real")


def shard_stride(df: DataFrame, index: str, stride: int, start: int = 0, limit: int | None = None) -> DataFrame:
    """``names[start::stride][:limit]`` as a filter on the index."""
    i = F.col(index)
    out = df.where((i >= start) & ((i - start) % max(1, stride) == 0))
    return out.where(F.floor((i - start) / max(1, stride)) < limit) if limit else out


def coverage_shards(df: DataFrame, index: str, stride: int, keep: tuple[int, int] = (70, 93)) -> DataFrame:
    """A stride before and after a range of shards that is always kept whole."""
    i, (lo, hi) = F.col(index), keep
    return df.where(
        i.between(lo, hi) | ((i < lo) & (i % stride == 0)) | ((i > hi) & ((i - hi - 1) % stride == 0)))


def mod_shard(df: DataFrame, key: str, bucket: Column, workers: int) -> DataFrame:
    """Worker ``i`` takes the rows whose index is ``i`` modulo the worker count."""
    ranked = grouped_row_number(df, [], [key], bucket, out="_rn")
    return ranked.withColumn("worker", ((F.col("_rn") - 1) % workers).cast("int")).drop("_rn")


def budget_cap(df: DataFrame, shard: str, pos: str, size: str, max_items: int | None = None,
               max_bytes: int | None = None) -> DataFrame:
    """Rows until a budget is used up; the row that crosses it is still kept."""
    total = grouped_sum_before(df, [], [pos], F.col(shard), F.lit(1).cast("long"), "_n_before")
    total = grouped_sum_before(total, [], [pos], F.col(shard), F.col(size), "_b_before")
    cond = F.lit(True)
    if max_items:
        cond = cond & (F.col("_n_before") < max_items)
    if max_bytes:
        cond = cond & (F.col("_b_before") < max_bytes)
    return total.where(cond)


def bernoulli_subsample(df: DataFrame, share: float, seed: str, key: str, limit: int | None = None) -> DataFrame:
    """Keep a seeded share, then the first ``limit`` in a second seeded order."""
    kept = df.where(uniform(seed, F.col(key)) <= share)
    if not limit:
        return kept
    order = uniform(f"{seed}.order", F.col(key))
    return kept.withColumn("_u", order).orderBy("_u", key).limit(limit).drop("_u")


def split_cap(df: DataFrame, split: str, caps: dict[str, int], seed: str, key: str) -> DataFrame:
    """Cap only the splits named in ``caps``; the others pass whole."""
    capped = [x for k, v in caps.items() for x in (F.lit(k), F.lit(v).cast("long"))]
    cap = F.coalesce(F.try_element_at(F.create_map(*capped), F.col(split)), F.lit(UNCAPPED))
    return seeded_row_number(df.withColumn("_cap", cap), [split], seed, key, out="rn", first="_cap").drop("_cap")
