"""Detector metrics from scores and labels.

Rows are first reduced to one count pair per distinct score; the curve
metrics then run over that histogram, cut into equally deep score ranges. Raw
rows are read and shuffled once, already combined on the map side, so a group
holding most of the data costs no more than its number of distinct scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.operators.ranking import join_groups
from corpusbench.session import materialize


def score_histogram(df: DataFrame, by: list[str], prob: str = "prob", label: str = "label") -> DataFrame:
    return df.groupBy(*by, F.col(prob).alias("score")).agg(
        F.expr("count(1) as n"),
        F.expr(f"count_if(`{label}` = 1) as pos"),
        F.expr(f"count_if(`{label}` = 0) as neg"),
    )


def score_ranges(hist: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """The histogram dealt by ranges of (group, score), written, with the range of each row as ``_part``.

    Range bounds come from a sample of the histogram, so ranges hold about
    equally many distinct scores however close together they lie. The rows
    before the histogram are read once, when this is called: the ranges are
    written to the shared folder, so that sums over ranges and the rows of a
    range come from the same cut, also after an executor is lost.
    """
    keys = [F.col(f"`{c}`") for c in (*by, "score")]
    dealt = hist.repartitionByRange(*([parts] if parts else []), *keys)
    return materialize(dealt.withColumn("_part", F.spark_partition_id()), "score-ranges")


def cumulate(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Add positives and negatives at or above each score: ``cpos``, ``cneg``.

    Each range of ``score_ranges`` is summed up by itself; of a group only one
    total per range meets in one task.
    """
    by, columns = by or ["_all"], [c for c in ranges.columns if c != "_part"]
    ranges = ranges.withColumn("_all", F.lit(1)) if by == ["_all"] else ranges
    totals = ranges.groupBy(*by, "_part").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = Window.partitionBy(*by).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = totals.select(*by, "_part", (F.sum("_p").over(above) - F.col("_p")).alias("_p0"), (F.sum("_n").over(above) - F.col("_n")).alias("_n0"))
    w = Window.partitionBy(*by, "_part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return join_groups(ranges, totals, [*by, "_part"]).select(
        *columns, (F.col("_p0") + F.sum("pos").over(w)).alias("cpos"), (F.col("_n0") + F.sum("neg").over(w)).alias("cneg"))


def cumulate_in_place(hist: DataFrame, by: list[str]) -> DataFrame:
    """``cpos`` and ``cneg`` with a group's distinct scores sorted in one task, for scores known to be few."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumns({"cpos": F.sum("pos").over(w), "cneg": F.sum("neg").over(w)})


# Denominators are at least 1, so an absent class gives 0, not null.
CONFUSION = [
    "_n as n", "_pos as n_fake", "_neg as n_real",
    "(_tp + _neg - _fp) / greatest(1D, _n) as accuracy",
    "0.5D * (_tp / greatest(1D, _pos) + (_neg - _fp) / greatest(1D, _neg)) as macro_accuracy",
    "_tp / greatest(1D, _tp + _fp) as precision",
    "_tp / greatest(1D, _pos) as recall",
    # Harmonic mean of precision and recall, 0 when both are 0.
    "if(_tp > 0, 2D * _tp / (_tp + _fp + _pos), 0D) as f1",
    "_fp / greatest(1D, _neg) as fpr",
    "(_pos - _tp) / greatest(1D, _pos) as fnr",
]
CURVES = [
    "if(_pos > 0 and _neg > 0, _area / (cast(_pos as double) * _neg), null) as auroc",
    "if(_pos > 0 and _neg > 0, _steps / _pos, null) as ap",
]


def _from_hist(hist: DataFrame, by: list[str], threshold: float, curves: bool, bounded: bool = False) -> DataFrame:
    """Totals and curve areas of the cumulated histogram in one aggregate per group."""
    aggs = [
        "coalesce(sum(n), 0L) as _n", "coalesce(sum(pos), 0L) as _pos", "coalesce(sum(neg), 0L) as _neg",
        f"coalesce(sum(if(score >= {float(threshold)}D, pos, 0)), 0L) as _tp",
        f"coalesce(sum(if(score >= {float(threshold)}D, neg, 0)), 0L) as _fp",
    ]
    if curves:
        hist = cumulate_in_place(hist, by) if bounded else cumulate(score_ranges(hist, by), by)
        aggs += [
            "sum(neg * (cpos - pos / 2D)) as _area",
            "sum(if(pos > 0, cast(pos as double) * cpos / (cpos + cneg), 0D)) as _steps",
        ]
    agg = hist.groupBy(*by).agg(*[F.expr(a) for a in aggs])
    return agg.selectExpr(*[f"`{c}`" for c in by], *CONFUSION, *(CURVES if curves else []))


def metrics(df: DataFrame, by: list[str] | None = None, prob: str = "prob", label: str = "label",
            threshold: float = 0.5, curves: bool = True, bounded: bool = False) -> DataFrame:
    """Confusion metrics, tie-aware AUROC and average precision per group.

    AUROC and AP are null for a single-class group. Curves write the score
    histogram when this is called. A caller who knows that scores carry few
    decimals may say ``bounded``: then nothing is written, and a group's
    scores, a million of them for six decimals, are sorted in one task.
    """
    by = by or []
    return _from_hist(score_histogram(df, by, prob, label), by, threshold, curves, bounded)


def metrics_from_histogram(parts: DataFrame, by: list[str], threshold: float = 0.5,
                           bounded: bool = False) -> DataFrame:
    """Metrics from histograms written at different times; counts of a score add up."""
    hist = parts.groupBy(*by, "score").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "neg")])
    return _from_hist(hist, by, threshold, True, bounded)


def fpr_operating_point(df: DataFrame, by: list[str], target: float, prob: str = "prob", label: str = "label") -> DataFrame:
    """The least threshold whose false positive rate is at most ``target``, with that rate and the recall there.

    A threshold flags the scores at or above it. Where even the highest score
    flags too many reals, threshold and rate are null and the recall is 0.
    """
    ranges = score_ranges(score_histogram(df, by, prob, label), by)
    hist, totals = cumulate(ranges, by), ranges.groupBy(*by).agg(F.sum("pos").alias("n_fake"), F.sum("neg").alias("n_real"))
    joined = join_groups(hist, totals, by) if by else hist.withColumn("_t", totals.select(F.struct("n_fake", "n_real")).scalar()).select("*", "_t.*")
    ok = F.when(F.col("cneg") <= F.lit(target) * F.col("n_real"), F.struct((-F.col("score")).alias("order"), "score", "cpos", "cneg"))
    best = joined.groupBy(*by).agg(F.max(ok).alias("b"), F.first("n_fake").alias("n_fake"), F.first("n_real").alias("n_real"))
    return best.select(*by, "n_fake", "n_real", F.col("b.score").alias("threshold"),
                       (F.col("b.cneg") / F.greatest(F.lit(1), F.col("n_real"))).alias("fpr"),
                       (F.coalesce(F.col("b.cpos"), F.lit(0)) / F.greatest(F.lit(1), F.col("n_fake"))).alias("recall"))


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Round double columns, because sums run in another order on every plan."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name)
        if f.dataType.simpleString() == "double" and f.name not in skip else F.col(f.name)
        for f in df.schema
    ])


def architecture_key(architecture: str = "architecture", generator: str = "generator") -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(F.col(architecture), blank), F.nullif(F.col(generator), blank), blank)


def per_distortion(df: DataFrame, key: str, min_rows: int = 20) -> DataFrame:
    return metrics(df, [key]).where(F.col("n") >= min_rows)


def robust_metrics(df: DataFrame, flag: str = "is_distorted") -> DataFrame:
    """Metrics of the clean and the distorted part; empty when nothing is distorted."""
    part = F.when(F.col(flag), "distorted").otherwise("clean")
    both = metrics(df.withColumn("part", part), ["part"])
    # two rows at most
    seen = F.max(F.col("part") == "distorted").over(Window.partitionBy())
    return both.withColumn("_distorted", seen).where("_distorted").drop("_distorted")


def pooled_generator_metrics(df: DataFrame, by: list[str], generator: str = "generator",
                             threshold: float = 0.5) -> DataFrame:
    """Every generator's fakes against the same pooled reals, per ``by``.

    Rows become counts per (by, generator, score), read once and written when
    this is called. Reals are pooled and cumulated over the score ranges of a
    ``by`` (see ``cumulate``); each generator's scores then meet them on
    (by, score), never row against row.
    """
    hist = materialize(df.groupBy(*by, generator, F.col("prob").alias("score")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")), "pooled-histogram")
    fakes = hist.where(F.col("pos") > 0).select(*by, generator, "score", "pos")
    ranges = score_ranges(hist.groupBy(*by, "score").agg(F.lit(0).alias("pos"), F.sum("neg").alias("neg")), by)
    grid, reals = cumulate(ranges, by), ranges.groupBy(*by).agg(F.sum("neg").alias("n_real"))
    above = join_groups(grid.drop("pos", "cpos"), reals, by) if by else grid.drop("pos", "cpos").withColumn("n_real", reals.scalar())
    grid = above.withColumn("upto", F.col("n_real") - F.col("cneg") + F.col("neg")).drop("n_real", "cneg")
    joined = join_groups(fakes, grid, [*by, "score"])
    per = joined.groupBy(*by, generator).agg(
        F.sum("pos").alias("n"),
        F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / F.lit(2.0))).alias("_wins"),
        F.coalesce(F.sum(F.when(F.col("score") >= threshold, F.col("pos"))), F.lit(0)).alias("_tp"),
        F.sum(F.col("pos") * F.col("score")).alias("_psum"),
    )
    joined = join_groups(per, reals, by, "left") if by else per.withColumn("n_real", reals.scalar())
    return joined.select(
        *by, generator, "n",
        (F.col("_tp") / F.col("n")).alias("recall"),
        (F.col("_psum") / F.col("n")).alias("mean_p"),
        F.when(F.col("n_real") > 0, F.col("_wins") / (F.col("n").cast("double") * F.col("n_real"))).alias("auroc"),
    )


def difficulty_rank(per_condition: DataFrame, generator: str = "generator", condition: str = "condition",
                    clean: str = "clean", with_map: bool = False) -> DataFrame:
    """Generators from hardest to easiest by mean recall over conditions.

    ``with_map`` adds per_condition, a map from each condition to its recall;
    a null condition has no entry there.
    """
    ok = F.nanvl(F.col("recall"), F.lit(None).cast("double"))
    entry = F.when(F.col(condition).isNotNull(), F.struct(F.col(condition).alias("condition"), ok.alias("recall")))
    return per_condition.groupBy(generator).agg(
        F.max("n").alias("n"),
        F.avg(ok).alias("recall_mean"),
        F.max(F.when(F.col(condition) == clean, ok)).alias("recall_clean"),
        F.min(ok).alias("recall_min"),
        F.avg(F.nanvl(F.col("auroc"), F.lit(None).cast("double"))).alias("auroc_mean"),
        *[F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("per_condition")] * with_map,
    )


def detection_log_loss(df: DataFrame, logit: str, label: str, patch_logits: str, patch_labels: str,
                       pos_weight: Column, patch_weight: float) -> DataFrame:
    """Mean item BCE plus weighted patch BCE, both in the stable logit form."""

    def softplus(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))

    x, y = F.col(logit), F.col(label).cast("double")
    item = softplus(x) - x * y
    df = df.withColumn("_pw", F.coalesce(pos_weight, F.lit(1.0)))
    pw = F.col("_pw")
    patch = F.aggregate(
        F.zip_with(patch_logits, patch_labels,
                   lambda a, b: pw * b * softplus(-a) + (F.lit(1.0) - b) * softplus(a)),
        F.lit(0.0), lambda s, v: s + v)
    return df.agg(
        F.avg(item).alias("item_loss"),
        (F.sum(patch) / F.sum(F.size(patch_logits))).alias("patch_loss"),
    ).select("item_loss", "patch_loss",
             (F.col("item_loss") + F.lit(patch_weight) * F.col("patch_loss")).alias("loss"))


def patch_pos_weight(df: DataFrame, patch_labels: str, cap: float = 50.0) -> DataFrame:
    """Real patches over fake patches, clamped; null if a class has less than one patch."""
    fake = F.aggregate(F.col(patch_labels), F.lit(0.0), lambda s, v: s + v)
    agg = df.agg(F.sum(fake).alias("n_fake"), F.sum(F.size(patch_labels)).alias("n_all"))
    real = F.col("n_all") - F.col("n_fake")
    return agg.select(F.when(
        (F.col("n_fake") >= 1) & (real >= 1),
        F.least(F.lit(cap), F.greatest(F.lit(1.0 / cap), real / F.col("n_fake"))),
    ).alias("pos_weight"))
