"""Row numbers and top-k per group that stay spread when one group is huge.

A window partitioned by the group alone sends the whole group to one task.
Here every group is cut into buckets that follow the sort order: rows are
numbered inside (group, bucket) and the count of all earlier buckets is
added. Only the per-bucket counts, pre-aggregated on the map side, meet in
one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.functions.rng import uniform

BUCKETS_CONF = "corpusbench.rank.buckets"
BUCKETS = 1024


def bucket_count(df: DataFrame) -> int:
    """Buckets per group for seeded orders; raise the setting with the largest group."""
    return int(df.sparkSession.conf.get(BUCKETS_CONF, str(BUCKETS)))


def join_groups(df: DataFrame, groups: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join per-group values to rows; null keys meet null keys, so no group is lost."""
    right = groups.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`_of_{c}`")) for c in on]
    return df.join(right, same, how).drop(*[f"_of_{c}" for c in on])


def grouped_row_number(df: DataFrame, by: list[str], order: list, bucket: Column,
                       out: str = "rn", first: int | str | None = None) -> DataFrame:
    """Exact 1-based row number per group.

    ``bucket`` must not decrease along ``order``. A null in ``by`` or
    ``bucket`` is a value like others; a null bucket comes first, as nulls do
    in an ascending order.
    With ``first`` (a number or a column of the rows) only rows numbered up
    to it are returned, and buckets that start past it are dropped before
    anything is sorted.
    """
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(*by, "_bucket", (F.sum("_n").over(before) - F.col("_n")).alias("_start"))
    joined = join_groups(keyed, starts, [*by, "_bucket"])
    limit = F.col(first) if isinstance(first, str) else F.lit(first)
    if first is not None:
        joined = joined.where(F.col("_start") < limit)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order)
    ranked = joined.withColumn(out, (F.col("_start") + F.row_number().over(inside)).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col(out) <= limit)
    return ranked.drop("_bucket", "_start")


def grouped_sum_before(df: DataFrame, by: list[str], order: list, bucket: Column, value: Column,
                       out: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group (0 for the first).

    Same bucketing rule as ``grouped_row_number``; with an empty ``by`` the
    whole table is one group and only its bucket totals share a task.
    """
    keyed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select(*by, "_bucket", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return join_groups(keyed, starts, [*by, "_bucket"]).withColumn(
        out, F.col("_start") + F.sum("_value").over(inside) - F.col("_value"),
    ).drop("_bucket", "_value", "_start")


def seeded_row_number(df: DataFrame, by: list[str], seed: str, key: str, out: str = "rn",
                      first: int | str | None = None) -> DataFrame:
    """Row number per group in a seeded random order; ties break by ``key``."""
    buckets = bucket_count(df)
    drawn = df.withColumn("_u", uniform(seed, F.col(key)))
    bucket = F.floor(F.col("_u") * buckets).cast("int")
    return grouped_row_number(drawn, by, ["_u", key], bucket, out, first).drop("_u")


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, out: str = "rank",
                  bucket: Column | None = None) -> DataFrame:
    """The first ``k`` rows of every group.

    With a ``bucket`` that follows the order, buckets past the first ``k``
    rows are dropped and the others sorted by themselves, whatever ``k`` is.
    Without one the groups must be small enough for a task each.
    """
    if bucket is not None:
        return grouped_row_number(df, by, order, bucket, out, first=k)
    final = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(final)).where(F.col(out) <= k)
