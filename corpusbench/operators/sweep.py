"""Named conditions over samples, and the tables built from a sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.functions.literals import array_literal, map_literal

# The reported sweep names and their display families, in order.
ALL_CONDITIONS = [
    "clean", "jpeg90", "jpeg70", "jpeg50", "jpeg30", "blur0.5", "blur1.0", "blur2.0",
    "resize0.5", "resize0.25", "noise0.02", "noise0.05", "noise0.10", "jitter20", "crop80",
]
FAMILIES = {
    "Compression": ["jpeg90", "jpeg70", "jpeg50", "jpeg30"],
    "Blur": ["blur0.5", "blur1.0", "blur2.0"],
    "Rescale": ["resize0.5", "resize0.25"],
    "Noise": ["noise0.02", "noise0.05", "noise0.10"],
    "Color": ["jitter20"],
    "Geometry": ["crop80"],
    "Protocol": ["pangram"],
}
OTHER = "Other"


def with_conditions(df: DataFrame, conditions: list[str], out: str = "condition", partitions: int | None = None,
                    **values: dict[str, float | str]) -> DataFrame:
    """Every sample under every named condition.

    A generator over a literal list keeps the plan a map: no join, no
    shuffle, and the factor is the length of the list. Where the scan has
    fewer splits than there are cores, the caller may name a number of
    ``partitions`` over which samples are dealt before they are multiplied.
    ``values`` adds columns that map a condition to a constant; they come out
    of the list too, so nothing is looked up per row.
    """
    if partitions:
        df = df.repartition(partitions)
    if not values:
        return df.withColumn(out, F.explode(array_literal(conditions)))
    listed = [F.struct(F.lit(c).alias(out), *[F.lit(m[c]).alias(n) for n, m in values.items()]) for c in conditions]
    return df.select("*", F.inline(F.array(*listed)))


def lookup(key: Column, mapping: dict[str, str], default: Column) -> Column:
    """Small fixed mapping as a literal map, with a fallback."""
    return F.coalesce(F.try_element_at(map_literal(mapping), key), default)


def family_of(key: Column) -> Column:
    return lookup(key, {k: fam for fam, ks in FAMILIES.items() for k in ks}, F.lit(OTHER))


def family_rank(family: Column) -> Column:
    names = list(FAMILIES)
    pos = F.array_position(array_literal(names), family)
    return F.when(pos == 0, F.lit(len(names) + 1)).otherwise(pos).cast("int")


def sweep_table(per_condition: DataFrame, clean: str = "clean") -> DataFrame:
    """Macro accuracy and its change against clean, in family order."""
    base = per_condition.where(F.col("condition") == clean).agg(
        F.max("macro_accuracy").alias("m")).scalar()
    fam = family_of(F.col("condition"))
    return per_condition.where(F.col("condition") != clean).select(
        family_rank(fam).alias("family_rank"), fam.alias("family"), "condition",
        "macro_accuracy", (F.col("macro_accuracy") - base).alias("delta"), "fpr", "fnr",
    ).orderBy("family_rank", "condition")


def sweep_wide(per_condition: DataFrame, metrics: list[str], conditions: list[str] | None = None) -> DataFrame:
    """One row per metric, one column per condition; without ``conditions`` Spark looks them up first."""
    long = per_condition.select("condition", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot("condition", metrics, "metric", "value")
    return long.groupBy("metric").pivot("condition", conditions).agg(F.first("value"))


def degradation_summary(per_condition: DataFrame, clean: str = "clean") -> DataFrame:
    """Clean accuracy, worst condition, mean change and worst FPR; no row without conditions."""
    is_clean = F.col("condition") == clean
    ours = ~F.col("condition").isin(clean, "none")
    agg = per_condition.agg(
        F.max(F.when(is_clean, F.col("macro_accuracy"))).alias("clean_macro"),
        F.min_by("condition", F.when(ours, F.struct("macro_accuracy", "condition"))).alias("worst_condition"),
        F.min(F.when(ours, F.col("macro_accuracy"))).alias("worst_macro"),
        F.avg(F.when(ours, F.col("macro_accuracy"))).alias("_mean"),
        F.max(F.when(ours, F.col("fpr"))).alias("worst_fpr"),
        F.count_if(ours).alias("conditions"),
    )
    return agg.where(F.col("conditions") > 0).select(
        "conditions", "clean_macro", "worst_condition", "worst_macro",
        (F.col("_mean") - F.col("clean_macro")).alias("mean_delta"), "worst_fpr")


def real_rates(df: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Share of reals flagged and their mean score."""
    return df.where(F.col("label") == 0).groupBy(*by).agg(
        F.count("*").alias("n_real"),
        F.avg((F.col("prob") >= threshold).cast("double")).alias("fpr"),
        F.avg("prob").alias("mean_p"),
    )


def best_step(history: DataFrame, step: str = "step", metric: str = "metric") -> DataFrame:
    """Running best over steps; ties keep the earlier step and missing values never win."""
    seen = Window.orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = F.when(~F.isnan(metric), F.col(metric))
    rank = F.when(ok.isNotNull(), F.struct(ok.alias("m"), (-F.col(step)).alias("s")))
    return history.select(
        step, metric,
        F.max(ok).over(seen).alias("best_metric"),
        (-F.max(rank).over(seen).getField("s")).alias("best_step"),
    )
