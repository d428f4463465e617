"""Confident mistakes: selection, caps, counts and manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.functions.identity import file_part, provenance
from corpusbench.operators.ranking import top_per_group


def errors(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """False positives scored by the probability, false negatives by its complement."""
    fp = (F.col("label") == 0) & (F.col("prob") >= threshold)
    fn = (F.col("label") == 1) & (F.col("prob") < threshold)
    return df.where(fp | fn).withColumn("kind", F.when(fp, "fp").otherwise("fn")).withColumn(
        "score", F.when(fp, F.col("prob")).otherwise(F.lit(1.0) - F.col("prob")))


def score_bucket(score: Column, buckets: int = 1024) -> Column:
    """Buckets that follow falling scores of 0 to 1; scores outside get the end buckets."""
    return F.least(F.greatest(F.floor((F.lit(1.0) - score) * buckets), F.lit(-1)), F.lit(buckets)).cast("int")


def error_topk(df: DataFrame, k: int, key: str = "id", threshold: float = 0.5) -> DataFrame:
    """The ``k`` most confident errors of each kind; ties break by key."""
    return top_per_group(errors(df, threshold), ["kind"], [F.desc("score"), key], k, bucket=score_bucket(F.col("score")))


def error_cap(df: DataFrame, per_kind: int, key: str = "id", threshold: float = 0.5) -> DataFrame:
    """First ``per_kind`` errors with a zero-based index, plus total and saved counts.

    Totals are one row per kind from a combining aggregate.
    """
    found = errors(df, threshold)
    totals = found.groupBy("kind").agg(F.count("*").alias("total"))
    kept = top_per_group(found, ["kind"], [F.desc("score"), key], per_kind, bucket=score_bucket(F.col("score")))
    return kept.withColumn("index", F.col("rank") - 1).join(F.broadcast(totals), "kind").withColumn(
        "saved", F.least(F.col("total"), F.lit(per_kind).cast("long")))


def manifest(df: DataFrame, source: str, stem: Column, step: int, split: str, key: str = "id", saved: Column | None = None) -> DataFrame:
    """Manifest rows of capped errors: the file name of each copy, whether it was saved, and the provenance.

    ``saved`` tells whether a row's copy could be written; by default all are.
    """
    name = F.format_string("%s/%03d_%s_%s_p%s.jpg", F.col("kind"), F.col("index"), file_part(F.col(source), 24),
                           file_part(stem), F.format_number("prob", 3))
    origin = provenance(dict(df.drop("saved").dtypes), F.col(key))
    copied = F.coalesce(saved, F.lit(False)) if saved is not None else F.lit(True)
    return df.select("kind", F.lit(step).alias("step"), F.lit(split).alias("split"), "label", "prob", name.alias("file"),
                     F.col(source).alias("by"), copied.alias("saved"), origin.alias("_origin")).select(
        "kind", "step", "split", "label", "prob", "file", "saved", F.coalesce("by", F.lit("?")).alias("by"), "_origin.*")


def manifest_summary(found: DataFrame, rows: DataFrame, step: int, split: str, per_kind: int) -> DataFrame:
    """One row: errors of either kind, saved copies of either kind, the cap, and manifest rows per source and kind.

    ``found`` are all errors, ``rows`` the manifest. ``by_source`` has one
    entry per source and kind.
    """
    totals = found.agg(F.count_if(F.col("kind") == "fp").alias("n_fp"), F.count_if(F.col("kind") == "fn").alias("n_fn"))
    per = rows.groupBy(F.concat_ws("|", "by", "kind").alias("name")).agg(
        F.count("*").alias("n"), F.count_if((F.col("kind") == "fp") & F.col("saved")).alias("fp"),
        F.count_if((F.col("kind") == "fn") & F.col("saved")).alias("fn"))
    counts = per.agg(F.struct(F.coalesce(F.sum("fp"), F.lit(0)).alias("saved_fp"), F.coalesce(F.sum("fn"), F.lit(0)).alias("saved_fn"),
                              F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("by_source")).alias("c"))
    return totals.withColumn("c", counts.scalar()).select(
        F.lit(step).alias("step"), F.lit(split).alias("split"), "n_fp", "n_fn", "c.saved_fp", "c.saved_fn",
        F.lit(per_kind).alias("max_per_kind"), "c.by_source")


def flag_rate(df: DataFrame, pred: str = "pred", error: str = "error", key: str = "id",
              threshold: float = 0.5) -> DataFrame:
    """How many rows were scored, flagged and failed; the first error by key."""
    p = F.col(pred)
    return df.agg(
        F.count(p).alias("scored"), F.count_if(p >= threshold).alias("flagged"),
        F.count_if(p < threshold).alias("below"), F.count_if(p.isNull()).alias("failed"),
        F.min(F.when(p.isNull(), F.struct(key, error))).getField(error).alias("first_error"),
    ).withColumn("share", F.col("flagged") / F.greatest(F.lit(1), F.col("scored")))
