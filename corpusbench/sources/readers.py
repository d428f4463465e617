"""Rows of differently shaped sources mapped onto one sample schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.functions.identity import first_name
from corpusbench.functions.labels import normalize_label, to_bool
from corpusbench.operators.curation import first_by_key
from corpusbench.operators.ranking import seeded_row_number

PROMPT_CHARS = 512
# Accepted spellings of the URL metadata columns.
URL_COLUMNS = {
    "url": ["URL", "url", "IMAGE_URL", "image_url", "link"],
    "width": ["WIDTH", "width"],
    "height": ["HEIGHT", "height"],
    "unsafe": ["punsafe", "PUNSAFE", "nsfw"],
    "watermark": ["pwatermark", "PWATERMARK"],
}


def optional(df: DataFrame, name: str, default: str | None = "") -> Column:
    """A string column that may be missing or empty."""
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def forensics_rows(df: DataFrame, content: str = "image_data") -> DataFrame:
    """Fixed-layout rows; a label that is no integer drops the row, a missing one is 0."""
    raw = F.col("label").cast("string") if "label" in df.columns else F.lit(None).cast("string")
    out = df.select(
        F.col(content).alias("image_bytes"),
        F.when(raw.isNull(), F.lit(0)).otherwise(F.trim(raw).try_cast("int")).alias("label"),
        optional(df, "model_name").alias("generator"),
        *[optional(df, c).alias(c) for c in ("architecture", "image_name")],
        F.substring(optional(df, "prompt"), 1, PROMPT_CHARS).alias("prompt"),
        to_bool(optional(df, "nsfw_flag")).alias("nsfw_flag"),
        *[optional(df, c).alias(c) for c in ("subset", "real_source", "format")],
    )
    return out.where(F.col("label").isNotNull() & F.col("image_bytes").isNotNull())


def generic_rows(df: DataFrame, name: str, image_col: str, label_col: str | None = None, label: int | None = None,
                 generator_col: str | None = None, label_map: dict | None = None,
                 keep_label: int | None = None) -> DataFrame:
    """Any table: a label column or a fixed label, optional map, optional class filter."""
    y = (normalize_label(F.col(label_col), label_map) if label_col
         else F.lit(0 if label is None else int(label)))
    out = df.select(
        F.col(image_col).alias("image_bytes"), y.alias("label"),
        (F.coalesce(F.nullif(optional(df, generator_col), F.lit("")), F.lit(name)) if generator_col
         else F.lit(name)).alias("generator"),
        first_name(df.columns, image_col).alias("image_name"),
    ).where(F.col("label").isNotNull())
    return out if keep_label is None else out.where(F.col("label") == keep_label)


def labelled_csv_join(labels: DataFrame, listing: DataFrame, name: str = "image_name") -> DataFrame:
    """Labels joined with files by name; the shallowest, then first, path wins.

    The listing collapses to one path per name before the join.
    """
    files = listing.select(
        F.element_at(F.split("path", "/"), -1).alias(name), F.size(F.split("path", "/")).alias("depth"), "path")
    return labels.join(first_by_key(files, name, ["depth", "path"], ["path"]), name)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.limit(1).count() == 0:
        raise FileNotFoundError(message)
    return df


def split_select(df: DataFrame, split: str, shard: int = -1, hard: bool = False,
                 clean_only: bool = False) -> DataFrame:
    """Rows of a named split; a negative shard takes all shards of the train split."""
    key = split.replace("-", "_")
    if key in ("val_hard",) or (key == "val" and hard):
        out = df.where(F.col("split") == "val_hard")
    elif key in ("train", "train_all"):
        out = df.where(F.col("split") == "train")
        if key == "train" and shard >= 0:
            out = out.where(F.col("shard") == shard)
    elif key in ("val", "test"):
        out = df.where(F.col("split") == key)
    else:
        raise ValueError(f"unknown split {split!r}; known: train, train_all, val, val_hard, test")
    return out.where(~F.col("is_distorted")) if clean_only else out


def archive_member_join(members: DataFrame, index: DataFrame) -> DataFrame:
    """Model of every archive member: full path, else base name, else ``unknown``.

    The index collapses to one model per (archive, member) first, so a
    member cannot be multiplied.
    """
    one = index.groupBy("archive", "member").agg(F.max(F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))).alias("model"))
    full = one.withColumnRenamed("model", "m_full")
    base = one.select("archive", F.col("member").alias("base"), F.col("model").alias("m_base"))
    rows = members.withColumn("base", F.element_at(F.split("member", "/"), -1))
    joined = rows.join(full, ["archive", "member"], "left").join(base, ["archive", "base"], "left")
    model = F.coalesce("m_full", "m_base")
    return joined.select(
        *members.columns, F.coalesce(model, F.lit("unknown")).alias("model"), model.isNull().alias("unlabeled"))


def resolve(df: DataFrame, kind: str) -> Column | None:
    for c in URL_COLUMNS[kind]:
        if c in df.columns:
            return F.col(c).cast("string")
    return None


def url_metadata(df: DataFrame, min_side: int, max_unsafe: float, max_watermark: float) -> DataFrame:
    """Web URLs that pass the size and score limits; values that do not parse pass."""
    url = resolve(df, "url")
    if url is None:
        raise ValueError(f"no URL column among {df.columns}")
    out = df.where(F.startswith(url, F.lit("http")))
    w, h = resolve(df, "width"), resolve(df, "height")
    if w is not None and h is not None:
        wi, hi = F.trim(w).try_cast("int"), F.trim(h).try_cast("int")
        # A width below the limit rejects before the height is looked at.
        small = F.when(w.isNull() | h.isNull() | wi.isNull(), False).when(wi < min_side, True).when(
            hi.isNull(), False).otherwise(hi < min_side)
        out = out.where(~small)
    for kind, limit in (("unsafe", max_unsafe), ("watermark", max_watermark)):
        score = resolve(df, kind)
        if score is not None:
            out = out.where(F.coalesce(F.trim(score).try_cast("double") < limit, F.lit(True)))
    return out.withColumn("resolved_url", url)


def id_list(df: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Trimmed non-empty ids from either spelling of the id column."""
    cols = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("ImageID", "image_id") if c in df.columns]
    out = df.select("split", F.coalesce(*cols).alias("image_id")).where(F.col("image_id").isNotNull())
    if not caps:
        return out
    limit = F.try_element_at(F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))]), F.col("split"))
    ranked = seeded_row_number(out, ["split"], "ids", "image_id", out="rn")
    return ranked.where(limit.isNull() | (F.col("rn") <= limit)).drop("rn")
