"""Column statistics, class balance, confounds and shard indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.operators.ranking import join_groups, top_per_group


def class_balance(df: DataFrame, split: str, label: str = "label", distorted: str = "is_distorted") -> DataFrame:
    """Rows, reals, fakes, fake share and distorted rows per split; labels may be text."""
    y = F.trim(F.col(label).cast("string"))
    return df.groupBy(split).agg(
        F.count("*").alias("total"), F.count_if(y == "0").alias("real"), F.count_if(y == "1").alias("fake"),
        F.round(F.lit(100.0) * F.count_if(y == "1") / F.greatest(F.lit(1), F.count("*")), 1).alias("fake_pct"),
        F.count_if(F.col(distorted)).alias("distorted"))


def inventory_cube(df: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    """Rows per source and label with all totals; the grouping columns tell a total from a null key."""
    return df.cube(source, label).agg(
        F.grouping(source).cast("int").alias("all_sources"), F.grouping(label).cast("int").alias("all_labels"), F.count("*").alias("n"))


def column_statistics(df: DataFrame, columns: list[str], top: int = 12) -> DataFrame:
    """Type, distinct values, range, mean, missing values and the most frequent values per column.

    Range, mean and missing values come from a plain aggregate, one row per
    task. Distinct and frequent values go through one scan as (column, value)
    counts, combined on the map side, and only the ``top`` values of a column
    are ever sorted together. Sums are decimal with ten digits after the
    point, so the mean does not depend on the order of the rows; beyond
    20 digits before the point it falls back to a sum of doubles.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    number = {c: F.col(c).cast("double") if kinds[c] not in ("string", "boolean", "timestamp") else F.lit(None).cast("double") for c in columns}

    def summary(c: str):
        x = F.when(~F.isnan(number[c]), number[c])
        exact = F.col(c).try_cast("decimal(30,10)") if kinds[c] not in ("string", "boolean", "timestamp") else F.lit(None).cast("decimal(30,10)")
        exact = F.when(x.isNotNull(), exact)
        mean = F.when(F.count(exact) == F.count(x), F.sum(exact).cast("double") / F.count(x)).otherwise(F.avg(x))
        missing = F.count_if(F.col(c).isNull() | F.coalesce(F.isnan(number[c]), F.lit(False)))
        return F.struct(F.lit(c).alias("column"), F.min(x).alias("min"), F.max(x).alias("max"), mean.alias("mean"), missing.alias("nan_count")).alias(f"_{c}")

    ranges = df.agg(*[summary(c) for c in columns]).select(F.inline(F.array(*[F.col(f"_{c}") for c in columns])))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~F.coalesce(F.isnan(number[c]), F.lit(False)), F.col(c).cast("string")).alias("value"))
                      for c in columns])
    ok = df.select(F.inline(pairs)).where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    unique = ok.groupBy("column").agg(F.count("*").alias("n_unique"))
    stats = ranges.join(F.broadcast(unique), "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    best = top_per_group(ok, ["column"], [F.desc("n"), "value"], top)
    lists = best.groupBy("column").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value", "n"))),
        lambda s: F.concat(s["value"], F.lit("="), s["n"])), " ").alias("top_values"))
    type_of = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(kinds[c]))])
    return stats.join(F.broadcast(lists), "column", "left").withColumn("type", F.try_element_at(type_of, F.col("column")))


def confound_audit(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """How well one metadata value alone tells the classes apart.

    Balanced accuracy of the rule "this value means fake" (or real, when
    that is the better direction), over counts per (feature, value).
    """
    long = df.select(label, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])))
    counts = long.groupBy("feature", "value").agg(
        F.count_if(F.col(label) == 1).alias("fake"), F.count_if(F.col(label) == 0).alias("real"))
    totals = counts.groupBy("feature").agg(F.sum("fake").alias("_f"), F.sum("real").alias("_r"))
    joined = counts.join(F.broadcast(totals), "feature")
    b = F.lit(0.5) * (F.col("fake") / F.greatest(F.lit(1), F.col("_f"))
                      + F.lit(1.0) - F.col("real") / F.greatest(F.lit(1), F.col("_r")))
    return joined.select(
        "feature", "value", "fake", "real", F.greatest(b, F.lit(1.0) - b).alias("balanced_accuracy"),
        F.when(b >= 0.5, "fake").otherwise("real").alias("means"),
        ((F.col("_f") == 0) | (F.col("_r") == 0)).alias("single_class"))


def meta_index(shards: DataFrame, sampled: DataFrame, all_shards: DataFrame, shard: str = "shard") -> DataFrame:
    """(label, model) counts on sampled shards, scaled to all shards (half-even)."""
    scale = all_shards.agg(F.count("*").alias("n")).scalar() / F.greatest(
        F.lit(1), sampled.agg(F.count("*").alias("n")).scalar())
    counts = shards.join(sampled.select(shard), shard, "left_semi").groupBy("label", "model").agg(
        F.count("*").alias("n_sampled"))
    return counts.withColumn("n_estimated_total", F.bround(F.col("n_sampled") * scale).cast("long"))


def file_inventory(files: DataFrame, by: str, top: int = 12) -> DataFrame:
    """Files and bytes per folder, the largest length, and the ``top`` largest files (length, path) in ``top_files``, largest first."""
    totals = files.groupBy(by).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    big = top_per_group(files, [by], [F.desc("length"), "path"], top)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("order"), "path", "length")))
    lists = big.groupBy(by).agg(
        F.max("length").alias("largest"), F.count("*").alias("listed"),
        F.transform(listed, lambda x: F.struct(x["length"].alias("length"), x["path"].alias("path"))).alias("top_files"))
    return join_groups(totals, lists, [by])


def column_best(df: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """Mark the best value per column; ``False`` means lower is better."""
    best = df.agg(F.struct(*[(F.max(c) if high else F.min(c)).alias(c) for c, high in columns.items()]).alias("b"))
    rows = df.withColumn("_best", best.scalar())
    return rows.select("*", *[(F.col(c) == F.col(f"_best.{c}")).alias(f"{c}_best") for c in columns]).drop("_best")


def leaderboard(published: DataFrame, ours: DataFrame) -> DataFrame:
    """Published and own rows ranked by robust AUROC; best and second value per column marked.

    A leaderboard has tens of rows, so one window over all of them is small.
    """
    rows = published.unionByName(ours, allowMissingColumns=True)
    place = Window.orderBy(F.desc("robust"), F.desc("auroc"), "method")

    def mark(c: str):
        d = F.dense_rank().over(Window.orderBy(F.desc(c)))
        return F.when(d == 1, "best").when(d == 2, "second").otherwise("").alias(f"{c}_mark")

    return rows.select(F.row_number().over(place).alias("rank"), "method", "auroc", "robust", mark("auroc"), mark("robust"),
                       F.coalesce("ours", F.lit(False)).alias("ours"))
