"""Which paths and datasets must never be trained on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Substrings of normalized references, per held-out family,
# in the order in which a reason is reported.
HELD_OUT = {
    "forensics-eval": ["communityforensics-eval", "comfor-eval", "comfor_eval"],
    "openfake": [
        "openfake/holdout", "openfake-holdout", "openfake/core/test", "openfake/reddit/test",
    ],
    "demo-val": [
        "coco-val2017", "/val2017/", "wildfake-dalle", "wildfake/dalle", "hy2628982280/wildfake",
        "dall-e advanced", "dalle advanced", "dalle_advanced", "dalle-advanced", "dalle/advanced",
        "diffusion_based/dalle",
    ],
}


def reference_blob(*parts: Column) -> Column:
    """Non-empty parts joined by spaces, lower case, forward slashes."""
    kept = [F.when(p.cast("string") != "", p.cast("string")) for p in parts]
    return F.translate(F.lower(F.concat_ws(" ", *kept)), "\\", "/")


def _any(blob: Column, markers: list[str]) -> Column:
    """One pattern for all markers, so the text expression appears once in the plan."""
    return blob.rlike("|".join(f"\\Q{m}\\E" for m in markers))


def is_held_out(*parts: Column) -> Column:
    return _any(reference_blob(*parts), [m for ms in HELD_OUT.values() for m in ms])


def held_out_reason(*parts: Column) -> Column:
    blob = reference_blob(*parts)
    out = F.lit(None).cast("string")
    for family in reversed(HELD_OUT):
        out = F.when(_any(blob, HELD_OUT[family]), family).otherwise(out)
    return out


def violations(df: DataFrame, by: str, *parts: Column) -> DataFrame:
    """Held-out rows per ``by`` and reason; empty for a clean corpus."""
    return df.where(is_held_out(*parts)).groupBy(by, held_out_reason(*parts).alias("reason")).agg(
        F.count("*").alias("rows"))


def assert_no_held_out(df: DataFrame, by: str, *parts: Column) -> DataFrame:
    """Return ``df``, or raise with the number of offending groups and rows, naming the first 20."""
    bad = violations(df, by, *parts)
    found = bad.orderBy(by).limit(20).collect()
    if found:
        total = bad.agg(F.count("*").alias("groups"), F.sum("rows").alias("rows")).first()
        raise ValueError(f"held-out data in the training corpus ({total['groups']} groups, {total['rows']} rows): " + ", ".join(
            f"{r[by]} ({r['reason']}: {r['rows']})" for r in found))
    return df
