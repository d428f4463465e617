"""Stable identities and safe names for samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 4096
# Name columns in order of preference.
NAME_COLUMNS = ["image_name", "filename", "file_name", "id", "image_id", "path"]
# What is told of a sample's origin.
PROVENANCE_KEYS = [
    "source", "dataset", "source_type", "image_name", "image_path", "generator", "architecture", "prompt",
    "nsfw_flag", "subset", "real_source", "format", "distortions", "distortion_scales", "is_distorted", "content_id",
]


def blank_to_null(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text != "", text)


def first_name(columns: list[str], skip: str = "image") -> Column:
    """First non-empty name column, or the empty string."""
    present = [c for c in NAME_COLUMNS if c in columns and c != skip]
    return F.coalesce(*[blank_to_null(F.col(c)) for c in present], F.lit(""))


def provenance(types: dict[str, str], sample: Column) -> Column:
    """``id`` and those provenance keys that the rows have, as a struct; empty strings become null.

    ``types`` are the column types of the rows (``dict(df.dtypes)``). Written
    as JSON, null fields are left out.
    """
    fields = [blank_to_null(F.col(k)) if types[k] == "string" else F.col(k) for k in PROVENANCE_KEYS if k in types]
    names = [k for k in PROVENANCE_KEYS if k in types]
    return F.struct(sample.cast("string").alias("id"), *[f.alias(k) for f, k in zip(fields, names, strict=True)])


def content_id(content: Column) -> Column:
    """Hash of the head, plus tail and length for long content."""
    head = F.substring(content, 1, BLOCK)
    tail = F.substring(content, -BLOCK, BLOCK)
    size = F.length(content).cast("string")
    return F.substring(
        F.sha1(F.when(F.length(content) > BLOCK, F.concat(head, tail, size)).otherwise(head)), 1, 16)


def tiny_hash(grid: Column, levels: int = 255) -> Column:
    """Hash of a coarse grid quantized to integers."""
    quantized = F.transform(grid, lambda x: F.floor(x * F.lit(float(levels))).cast("string"))
    return F.substring(F.sha1(F.array_join(quantized, ",")), 1, 16)


def normpath(path: Column) -> Column:
    """Drop empty and ``.`` segments and resolve ``..``."""
    absolute = F.startswith(path, F.lit("/"))
    root = (F.when(path.rlike("^//([^/]|$)"), F.lit("//")).when(absolute, F.lit("/"))
            .otherwise(F.lit("")))

    def step(acc: Column, seg: Column) -> Column:
        poppable = (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        return (
            F.when(seg.isin("", "."), acc)
            .when((seg == "..") & poppable, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when((seg == "..") & absolute, acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    whole = F.concat(root, F.array_join(parts, "/"))
    return F.when(whole == "", ".").otherwise(whole)


def sample_id(source: Column, path: Column, name: Column, content: Column,
              generator: Column, label: Column) -> Column:
    """Identity from the path, else the name, else the content, else the class."""
    src = F.coalesce(source.cast("string"), F.lit(""))

    def tag(kind: str, value: Column) -> Column:
        return F.concat(src, F.lit(f"|{kind}|"), value)

    return F.coalesce(
        tag("path", normpath(blank_to_null(path))),
        tag("name", blank_to_null(name)),
        tag("hash", blank_to_null(content)),
        F.concat(src, F.lit("|meta|"), F.coalesce(generator.cast("string"), F.lit("")), F.lit("|"),
                 F.coalesce(label.cast("string"), F.lit("None"))),
    )


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.trim(F.coalesce(blank_to_null(text), F.lit("unknown"))), r"[^A-Za-z0-9._-]+", "_")
    return F.when(s == "", "unknown").otherwise(s)


def shard_tag(name: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), r"(?<=.)\.[^.]*$", "")
    return slug(F.replace(stem, F.lit("-of-"), F.lit("_")))


def folder_name(text: Column, cap: int = 120) -> Column:
    """Letters and digits of any script kept, at most ``cap`` characters."""
    s = F.regexp_replace(F.trim(F.coalesce(blank_to_null(text), F.lit("unknown"))), r"[^\p{L}\p{N}_.\-+]+", "_")
    return F.substring(F.when(s == "", "unknown").otherwise(s), 1, cap)


def file_part(text: Column, cap: int = 72) -> Column:
    """Safe file-name part without leading or trailing dots and underscores."""
    s = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^A-Za-z0-9._-]+", "_")
    s = F.regexp_replace(s, r"^[._]+|[._]+$", "")
    return F.substring(F.when(s == "", "sample").otherwise(s), 1, cap)


def url_stem(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 20)
