"""Metrics JSON of evaluation runs: scan, normalize, explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


COUNTS = ["n", "n_fake", "n_real"]
RATES = ["accuracy", "macro_accuracy", "precision", "recall", "f1", "fpr", "fnr", "auroc", "mAP"]
METRIC = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in RATES])
ERROR = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("rank", T.LongType()), T.StructField("file", T.StringType()),
    T.StructField("prob_ai", T.DoubleType()), T.StructField("label", T.LongType()),
    T.StructField("explained", T.BooleanType()), T.StructField("generator", T.StringType()),
    T.StructField("distortions", T.ArrayType(T.StringType())),
])
TABLES = ["perturbation_sweep", "per_architecture", "per_distorted", "per_distortion"]
BODY = T.StructType(
    METRIC.fields
    + [T.StructField(c, T.StringType()) for c in ("suite_name", "dataset", "checkpoint", "perturbation")]
    + [T.StructField("step", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("robust_auroc", "robust_mAP")]
    + [T.StructField("robust_n", T.LongType())]
    + [T.StructField(c, T.MapType(T.StringType(), METRIC)) for c in TABLES]
    + [T.StructField("error_analysis", T.ArrayType(ERROR))]
)
HASH_NAME = "DALL·E 3 Advanced"


def files_below(spark: SparkSession, root: str, only_summary: bool) -> DataFrame:
    """Path, time, size and text of the metrics files below ``root``; a text is read only where it is used."""
    path = F.col("_metadata.file_path")
    summary = F.endswith(path, F.lit("/summary.json"))
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True).where(summary if only_summary else ~summary)
    return raw.select(path.alias("file"), F.col("_metadata.file_modification_time").alias("modified"),
                      F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("json"))


def scan(spark: SparkSession, root: str, limit: int | None = None, only_summary: bool = False,
         max_bytes: int | None = None) -> DataFrame:
    """Readable metrics files below ``root``, newest first, each path once, as parsed bodies.

    ``NaN`` is accepted. All files are read unless ``max_bytes`` or ``limit``
    is given; ``skipped`` names those that are left out.
    """
    raw = files_below(spark, root, only_summary)
    kept = raw.where(F.col("bytes") <= max_bytes) if max_bytes else raw
    rows = parse(kept.drop("bytes")).drop("json").dropDuplicates(["file"]).orderBy(F.desc("modified"), "file")
    return rows.limit(limit) if limit else rows


def skipped(spark: SparkSession, root: str, only_summary: bool = False, max_bytes: int | None = None) -> DataFrame:
    """Files that ``scan`` leaves out, with the reason: too large, or no valid body."""
    raw = files_below(spark, root, only_summary)
    large = F.lit(False) if max_bytes is None else F.col("bytes") > max_bytes
    good = parse(raw.where(~large).drop("bytes")).select("file").distinct()
    return raw.select("file", F.when(large, "too large").otherwise("not readable").alias("reason")).join(good, "file", "left_anti")


def parse(df: DataFrame, text: str = "json") -> DataFrame:
    """Bodies from a JSON string column; ``NaN`` is accepted, broken texts are dropped.

    The generator keeps later filters above the parse, so every text is
    parsed once however many fields are read.
    """
    schema = T.StructType(BODY.fields + [T.StructField("_broken", T.StringType())])
    body = F.from_json(text, schema, {"allowNonNumericNumbers": "true", "columnNameOfCorruptRecord": "_broken"})
    return df.select("*", F.explode(F.array(body)).alias("body")).where("body is not null and body._broken is null")


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.json$", "")


def suite_name(body: Column, file: Column) -> Column:
    base = base_name(file)
    return (
        F.when(body["suite_name"] != "", body["suite_name"])
        .when((base != "") & ~base.isin("folders", "summary"), base)
        .when(body["dataset"] != "folders", body["dataset"])
        .otherwise(base)
    )


def display_generator(name: Column) -> Column:
    """Hash-like generator ids get the display name of their set."""
    return F.when(name.rlike("(?i)^[0-9a-f]{20,}$"), HASH_NAME).otherwise(name)


def _finite(expr: str, name: str) -> str:
    return f"if(isnan({expr}) or abs({expr}) = double('infinity'), null, {expr}) as {name}"


def normalize(df: DataFrame) -> DataFrame:
    """One evaluation record per body that has any metric content."""
    content = ["macro_accuracy", "n", "error_analysis", *TABLES[:3]]
    kept = df.where(" or ".join(f"body.{c} is not null" for c in content))
    root = ", ".join(f"'{f.name}', body.{f.name}" for f in METRIC.fields)
    base = F.expr(f"coalesce(try_element_at(body.perturbation_sweep, 'clean'), named_struct({root}))")
    errors = F.transform("body.error_analysis", lambda e: F.struct(
        F.when(e["kind"] == "fp", "fp").otherwise("fn").alias("kind"), F.coalesce(e["rank"], F.lit(0)).alias("rank"),
        F.coalesce(e["prob_ai"], F.lit(0.0)).alias("prob_ai"), (e["label"] == 1).cast("int").alias("label"),
        display_generator(e["generator"]).alias("generator")))
    named = kept.select(suite_name(F.col("body"), F.col("file")).alias("name"), "file", "body", base.alias("m"),
                        F.when(F.size(errors) > 0, errors).alias("errors"))
    return named.selectExpr(
        "name", "file", "body.checkpoint", "body.step", "coalesce(body.perturbation, 'clean') as perturbation",
        *[f"m.{c}" for c in COUNTS], *[_finite(f"m.{c}", c) for c in RATES],
        *[_finite(f"body.{c}", c) for c in ("robust_auroc", "robust_mAP")], "body.robust_n",
        *[f"body.{t}" for t in TABLES], "errors")


def breakdown(records: DataFrame) -> DataFrame:
    """The nested tables of evaluation records as long rows, in one pass."""
    entries = ", ".join(
        f"transform(coalesce(map_entries({t}), array()), e -> named_struct('table', '{t}', 'key', e.key, 'm', e.value))"
        for t in TABLES)
    return records.selectExpr("name", f"inline(concat({entries}))").selectExpr(
        "name", "`table`", "key", *[f"m.{c}" for c in COUNTS], *[_finite(f"m.{c}", c) for c in RATES])
