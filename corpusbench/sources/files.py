"""Shards, folder trees and path lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.functions.holdout import is_held_out

# Image file extensions.
IMAGE_EXTS = ["jpg", "jpeg", "png", "webp", "bmp"]


def natural_key(text: Column) -> Column:
    """Sort key in which ``shard_2`` comes before ``shard_10``.

    A number of any length is written as its digits without leading zeros,
    behind their count in five digits.
    """
    parts = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), 1)

    def key(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(p)

    return F.array_join(F.transform(parts, key), "")


def shard_scan(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """All parquet shards under folders or files, each path once."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*dict.fromkeys(paths))


def rows_per_shard(df: DataFrame) -> DataFrame:
    """Rows per file of a file-backed scan, with the key of its natural order."""
    return df.select(F.col("_metadata.file_path").alias("shard")).groupBy("shard").agg(
        F.count("*").alias("rows")).withColumn("order_key", natural_key(F.col("shard")))


def row_count(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Exact rows of a shard set; unreadable files count as empty."""
    return (spark.read.schema(schema).option("ignoreCorruptFiles", True)
            .option("recursiveFileLookup", True).parquet(*dict.fromkeys(paths))
            .agg(F.count("*").alias("rows")))


def has_ext(path: Column, exts: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(exts)


def list_files(spark: SparkSession, root: str, exts: list[str] | None = None) -> DataFrame:
    """Paths and sizes below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select("path", "length", "modificationTime")
    return out.where(has_ext(F.col("path"), exts)) if exts else out


def folder_index(listing: DataFrame, label: Column, exts: list[str] | None = None,
                 allow_held_out: bool = False) -> DataFrame:
    """Samples from a path listing: the parent folder names the generator."""
    path = F.col("path")
    out = listing.where(has_ext(path, exts or IMAGE_EXTS))
    if not allow_held_out:
        out = out.where(~is_held_out(path))
    return out.select(
        "path", label.alias("label"), F.try_element_at(F.split(path, "/"), F.lit(-2)).alias("generator"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """A text file with one path per line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where(F.length("path") > 0)


def folder_pair(real: DataFrame, fake: DataFrame, exts: list[str] | None = None) -> DataFrame:
    """Real and fake listings as one labelled source; an error when both are empty."""
    a = folder_index(real, F.lit(0), exts)
    b = folder_index(fake, F.lit(1), exts)
    both = a.unionByName(b)
    if both.limit(1).count() == 0:
        raise FileNotFoundError("no usable files in the real or the fake folders")
    return both


def write_listing(df: DataFrame, column: str, out: str) -> None:
    """Sorted distinct values as text, one per line over range-partitioned files."""
    df.select(F.col(column).alias("value")).distinct().orderBy("value").write.text(out)
