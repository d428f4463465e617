"""Outputs of a scoring run."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, out: str, path: str = "image_path", pred: str = "pred") -> None:
    """Predictions in path order as JSON lines.

    Range-partitioned, so file after file is the sorted whole and no single
    task writes it all.
    """
    df.select(path, pred).orderBy(path).write.option("ignoreNullFields", False).json(out)


def run_header(df: DataFrame, pred: str = "pred", threshold: float = 0.5, **meta: str) -> DataFrame:
    """One row of run metadata and counts."""
    return df.agg(
        *[F.lit(v).alias(k) for k, v in meta.items()], F.lit(threshold).alias("threshold"),
        F.count("*").alias("n_images"), F.count(pred).alias("n_scored"),
        (F.count("*") - F.count(pred)).alias("n_failed"))


def write_document(df: DataFrame, out: str, head: DataFrame, *order: str, rows: str = "predictions") -> None:
    """One JSON document: the fields of the one-row ``head``, then all rows of ``df`` in order, one to a line.

    Tasks write sorted part files of lines; nested columns become nested
    JSON. A commit step puts head, parts and end together with a buffer of
    fixed size and renames the file into place, so a reader sees the whole
    document or none. The parts stay beside it under ``.parts``.
    """
    spark = df.sparkSession
    lines = df.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"), F.monotonically_increasing_id().alias("i"))
    first = F.col("i").bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its part
    parts = f"{out}.parts-{uuid.uuid4().hex}"
    lines.select(F.concat(F.when(first, "").otherwise(","), "line").alias("value")).write.text(parts)
    fields = head.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).first()["j"]
    _join_parts(spark, parts, out, (fields[:-1] + (", " if fields != "{}" else "") + json.dumps(rows) + ": [\n").encode(), b"]}\n")


def _join_parts(spark: SparkSession, parts: str, out: str, head: bytes, end: bytes) -> None:
    hadoop = spark._jvm.org.apache.hadoop
    target, part_dir = hadoop.fs.Path(out), hadoop.fs.Path(parts)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    written = hadoop.fs.Path(f"{parts}/.document")
    sink = fs.create(written, True)
    try:
        sink.write(bytearray(head))
        found = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(part_dir))
        for k, name in enumerate(n for n, size in found if n.startswith("part-") and size):
            if k:
                sink.write(bytearray(b","))
            source = fs.open(hadoop.fs.Path(f"{parts}/{name}"))
            try:
                hadoop.io.IOUtils.copyBytes(source, sink, 1 << 20, False)
            finally:
                source.close()
        sink.write(bytearray(end))
    finally:
        sink.close()
    fs.delete(target, False)
    if not fs.rename(written, target):
        raise OSError(f"could not put {out} into place")


def read_document(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict]:
    """Rows and head fields of a document of ``write_document``; its lines are split over tasks."""
    lines = spark.read.text(path)
    head = lines.limit(1).first()["value"]
    fields = json.loads(head + "]}")
    row = F.from_json(F.regexp_replace("value", "^,", ""), schema)
    rows = lines.where(F.col("value").rlike(r"^,?\{") & ~F.col("value").endswith("[")).select(row.alias("r")).select("r.*")
    return rows, {k: v for k, v in fields.items() if not isinstance(v, list)}


def slice_files(spark: SparkSession, path: str, levels: tuple[str, ...], shards: list) -> dict[str, frozenset[str]]:
    """The existing slices of some shards: each folder and the names of its files."""
    hadoop = spark._jvm.org.apache.hadoop
    fs = hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = "{" + ",".join(sorted({f"{levels[-1]}={s}" for s in shards})) + "}"
    found = fs.globStatus(hadoop.fs.Path("/".join([path, *[f"{c}=*" for c in levels[:-1]], names]))) or []
    return {f.getPath().toString(): frozenset(x.getPath().getName() for x in fs.listStatus(f.getPath())) for f in found}


def write_slices(df: DataFrame, path: str, shards: list, *, levels: tuple[str, ...] = ("label", "generator", "shard"), rows_per_file: int = 100_000) -> None:
    """Rows laid out by label, generator and shard; the named shards are replaced, all others stay as they are.

    The last level is the shard. Files hold at most ``rows_per_file`` rows,
    and the rebalancing of adaptive execution cuts a large slice over tasks.
    Running a shard again replaces its slices, and those that it no longer
    has rows for, whose files the write left as they were, are deleted; so a
    repeated run leaves the same rows. A row of a shard that is not named
    raises before anything is replaced.
    """
    spark, shard = df.sparkSession, levels[-1]
    unnamed = F.raise_error(F.concat(F.lit("row of a shard that is not named: "), F.coalesce(F.col(shard).cast("string"), F.lit("null"))))
    checked = df.withColumn(shard, F.when(F.col(shard).isin(shards), F.col(shard)).otherwise(unnamed.cast(df.schema[shard].dataType)))
    before = slice_files(spark, path, levels, shards)
    (checked.hint("rebalance", *levels).write.mode("overwrite").partitionBy(*levels).option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", rows_per_file).parquet(path))
    for folder, names in slice_files(spark, path, levels, shards).items():
        if before.get(folder) == names:
            stale = spark._jvm.org.apache.hadoop.fs.Path(folder)
            stale.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(stale, True)
