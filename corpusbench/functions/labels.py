"""Loosely typed labels, flags, lists and verdicts made regular."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbench.functions.literals import map_literal

# Words accepted for either class.
FAKE_WORDS = ["fake", "ai", "generated", "synthetic", "ai-generated", "ai_generated"]
REAL_WORDS = ["real", "authentic", "human", "photo"]
TRUE_WORDS = ["1", "true", "yes"]
FALSE_WORDS = ["0", "false", "no"]

# Directory-name hints of the two folder layouts.
FAKE_DIR_HINTS = ["fake", "syn", "dda", "gen", "ai", "sd", "flux"]
REAL_DIR_HINTS = ["real", "coco", "nature", "auth", "photo", "human"]
RAW_PHOTO_HINTS = ["raise", "real", "flickr", "coco"]


def as_int(text: Column) -> Column:
    """Integer value of a trimmed string, null when it is not one."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))


def label_map_lookup(raw: Column, label_map: dict) -> Column:
    """Mapped label by the raw text, the trimmed text or its integer form."""
    if not label_map:
        return F.lit(None).cast("int")
    table = map_literal({str(k): int(v) for k, v in label_map.items()})
    text = raw.cast("string")
    return F.coalesce(
        F.try_element_at(table, text),
        F.try_element_at(table, F.trim(text)),
        F.try_element_at(table, as_int(text).cast("string")),
    )


def normalize_label(raw: Column, label_map: dict | None = None, default: int | None = None) -> Column:
    """0 (real), 1 (fake), another integer as given, or ``default``.

    Empty values give ``default``; so does text that is no label.
    """
    fallback = F.lit(default).cast("int")
    text = raw.cast("string")
    word = F.lower(F.trim(text))
    plain = (
        F.when(word.isin(FAKE_WORDS + TRUE_WORDS), F.lit(1))
        .when(word.isin(REAL_WORDS + FALSE_WORDS), F.lit(0))
        .otherwise(F.coalesce(as_int(text), fallback))
    )
    found = F.coalesce(label_map_lookup(raw, label_map), plain) if label_map else plain
    return F.when(text.isNull() | (text == ""), fallback).otherwise(found)


def to_bool(raw: Column) -> Column:
    """True only for the affirmative words, so ``'False'`` is false."""
    return F.coalesce(F.lower(F.trim(raw.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def parse_list(raw: Column) -> Column:
    """``"['a', 'b']"`` to an array; anything that is not such a list is empty."""
    text = F.trim(raw)
    items = F.transform(
        F.split(F.regexp_replace(text, r"^\[|\]$|['\"]", ""), ","), lambda x: F.trim(x))
    return F.when(text.rlike(r"^\[.*\]$"), F.filter(items, lambda x: x != "")).otherwise(
        F.array().cast("array<string>"))


def distortion_key(distortions: Column) -> Column:
    return F.coalesce(F.get(distortions, 0), F.lit("none"))


def verdict(prob: Column, threshold: float = 0.5) -> Column:
    return F.when(prob >= threshold, "AI").when(prob.isNotNull(), "REAL")


def has_hint(name: Column, hints: list[str]) -> Column:
    return F.lower(name).rlike("|".join(f"\\Q{h}\\E" for h in hints))


def class_from_dir(name: Column) -> Column:
    """Real needs a real hint and no fake hint; then any fake hint; else skipped."""
    fake = has_hint(name, FAKE_DIR_HINTS)
    return (F.when(has_hint(name, REAL_DIR_HINTS) & ~fake, "real")
            .when(fake, "fake").otherwise("skip"))


def class_or_generator(name: Column, at_root: Column) -> Column:
    """``real`` for photo folders, otherwise the folder's own name as generator."""
    return (F.when(has_hint(name, RAW_PHOTO_HINTS), "real")
            .when(at_root, "fake/unknown").otherwise(F.concat(F.lit("fake/"), name)))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
