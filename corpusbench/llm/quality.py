"""Quality rules whose cutoffs keep the share of good documents they reject under control.

Every rule is a ratio with a fixed list of cutoffs, from lax to strict. One
fixed sequence tightens the rules in turn, one cutoff at a step. In each
stratum (language) the documents labelled good are the holdout. A step is
allowed if the exact binomial (Clopper-Pearson) upper bound on the share of
good documents that any rule rejects by then is at most the risk. Steps are
tested in order and testing stops at the first failure, so one level serves
the whole sequence; only the strata divide it (Bonferroni). With the stated
confidence, all rules together then reject at most the stated share of the
good documents of every stratum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import SPACE, narrow
from corpusbench.session import materialize

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
#: The base rule: least words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 10, 20
RISK, CONFIDENCE = 0.02, 0.95
DEVIATIONS = 40.0


@dataclass(frozen=True)
class Rule:
    """A ratio of two count columns and its cutoffs, lax first; a document above the cutoff fails."""

    name: str
    part: str
    whole: str
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "word_chars", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05)),
    Rule("capitals", "n_capitals", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    Rule("lines", "n_dup_lines", "n_lines", (0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
)


def steps(rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float]]:
    """The sequence of all strata: the first cutoff of every rule, the second of every rule and so on."""
    return [(r, r.cutoffs[k]) for k in range(max(len(r.cutoffs) for r in rules)) for r in rules if k < len(r.cutoffs)]


def without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(hashes: Column) -> Column:
    """Words in windows found twice or more, from the hashes of all windows in order."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        F.sort_array(F.transform(F.filter(F.transform(
            F.arrays_zip(pairs.alias("p"), F.concat(F.array(F.lit(None).cast("bigint")), F.slice(pairs["h"], 1, F.size(pairs) - 1)).alias("a"),
                         F.concat(F.slice(pairs["h"], 2, F.size(pairs)), F.array(F.lit(None).cast("bigint"))).alias("b")),
            lambda z: F.struct(z["p"]["i"].alias("i"), (z["p"]["h"].eqNullSafe(z["a"]) | z["p"]["h"].eqNullSafe(z["b"])).alias("twice"))),
            lambda z: z["twice"]), lambda z: z["i"])),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).cast("int").alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = narrow(docs, "doc_id", "lang", "text").select("doc_id", "lang", text.alias("t"))
    bare = F.trim(F.col("t"), F.lit(BLANKS))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    counted = base.select(
        "doc_id", "lang", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)).alias("words"),
        without(F.col("t"), BLANKS).alias("word_chars"), (F.length("t") - without(F.col("t"), SYMBOLS)).alias("n_symbols"),
        (F.length("t") - without(F.col("t"), CAPITALS)).alias("n_capitals"), lines.alias("lines"))
    hashed = counted.select(
        "doc_id", "lang", "word_chars", "n_symbols", "n_capitals", F.size("words").alias("n_words"), F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
        .otherwise(F.array().cast("array<bigint>")).alias("hashes"))
    same = F.size(F.array_distinct("hashes")) == F.size("hashes")
    long = [F.col(c).cast("bigint").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_capitals", "n_lines")]
    return hashed.select("doc_id", "lang", *long, F.when(same, F.lit(0).cast("bigint")).otherwise(repeated_words(F.col("hashes"))).alias("n_repeat_words"))


def most_failures(n: Column, risk: float, level: Column) -> Column:
    """The largest k for which the exact upper bound at this level on a share, k of n seen, is at most ``risk``; -1 if none.

    The bound is at most ``risk`` exactly if P(X <= k) <= level for X binomial
    with n and ``risk``. The terms are summed up from logarithms, from
    ``DEVIATIONS`` standard deviations below the mean on; what lies below
    that is far under the smallest double. So the steps grow with the square
    root of n. The first logarithm is by the series of log n!, exact to
    1e-10 where the sum does not begin at 0.
    """
    n = n.cast("double")
    step = F.log(F.lit(risk / (1 - risk)))
    begin = F.greatest(F.lit(0.0), F.floor(n * risk - DEVIATIONS * F.sqrt(n * (risk * (1 - risk)))))
    series = lambda m: (m + 0.5) * F.log(m) - m + 0.5 * math.log(2 * math.pi) + 1 / (12 * m) - 1 / (360 * m * m * m)
    choose = F.when(begin == 0, F.lit(0.0)).otherwise(series(n) - series(F.greatest(begin, F.lit(1.0))) - series(n - begin))
    at_begin = choose + begin * F.log(F.lit(risk)) + (n - begin) * F.log(F.lit(1 - risk))
    first = F.struct(at_begin.alias("log"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("most"))

    def add(s: Column, k: Column) -> Column:
        here = F.when(k == begin, s["log"]).otherwise(s["log"] + F.log((n - k + 1) / k) + step)
        total = s["sum"] + F.exp(here)
        return F.struct(here.alias("log"), total.alias("sum"), F.when(total <= level, k).otherwise(s["most"]).alias("most"))

    return F.aggregate(F.sequence(begin.cast("bigint"), F.ceil(n * risk).cast("bigint")), first, add, lambda s: s["most"])


def fails(rule: Rule, cutoff: Column) -> Column:
    """A document without the rule's whole passes it."""
    return F.coalesce(F.col(rule.part) > cutoff * F.col(rule.whole), F.lit(False))


def choose_cutoffs(counts: DataFrame, labels: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """lang, n_good, and per rule its cutoff, null if none is allowed; one row per language with good documents labelled.

    The base rule has no part in it: good documents it fails are not counted.
    A document labelled twice counts twice.
    """
    good = narrow(labels, "doc_id", "quality").where("quality = 1").select("doc_id")
    held = counts.where("not base_failed").join(good, "doc_id")
    path = steps(rules)
    # the step from which on a document is rejected, since cutoffs only get stricter
    first = F.coalesce(*[F.when(fails(r, F.lit(c)), F.lit(k)) for k, (r, c) in enumerate(path)])
    sums = [F.count_if(F.col("first") <= k).alias(f"step_{k}") for k in range(len(path))]
    by = held.select("lang", first.alias("first")).groupBy("lang").agg(F.count("*").alias("n_good"), *sums)
    n_strata = F.count("*").over(_all())
    allowed = by.withColumn("most", most_failures(F.col("n_good"), risk, (1 - confidence) / n_strata))
    cutoff, passing = {r.name: F.lit(None).cast("double") for r in rules}, F.lit(True)
    for k, (r, c) in enumerate(path):
        passing = passing & (F.col(f"step_{k}") <= F.col("most"))
        cutoff[r.name] = F.when(passing, F.lit(c)).otherwise(cutoff[r.name])
    return allowed.select("lang", "n_good", *[cutoff[r.name].alias(f"cut_{r.name}") for r in rules])


def _all():
    """All rows of a table of strata; one row per language."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def quality_rules(docs: DataFrame, labels: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base rule and verdict per document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, failed_rules. Null or empty text: no
    words, base rule failed. Null lang: a stratum of its own. A stratum with
    too few labels for any guarantee has no cutoff, so only the base rule
    rejects there. Repeated rows: judged each. Other columns are not read.

    The counts are written once, since both the cutoffs and the verdicts read
    them. The cutoffs, one row per language, come back as one broadcast.
    """
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counts = materialize(measured(docs).withColumn("base_failed", failed), "quality-counts")
    cutoffs = materialize(choose_cutoffs(counts, labels, risk=risk, confidence=confidence, rules=rules), "quality-cutoffs")
    joined = counts.alias("d").join(cutoffs.alias("c"), F.col("d.lang").eqNullSafe(F.col("c.lang")), "left")
    broken = F.array_compact(F.array(*[F.when(fails(r, F.col(f"cut_{r.name}")), F.lit(r.name)) for r in rules]))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select("doc_id", *base, (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), F.array_join(broken, ",").alias("failed_rules"))


def rejected_shares(verdicts: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the verdicts do to the labelled documents, by language and label.

    Columns: lang, quality, n_labelled, n_base (the base rule fails), n_rules
    (passes it, but a rule rejects), rejected (the share of both). doc_id is
    taken as unique in ``docs``. Null lang: a language of its own.
    """
    told = narrow(labels, "doc_id", "quality").where("quality is not null")
    rows = narrow(verdicts, "doc_id", "base_failed", "kept").join(narrow(docs, "doc_id", "lang"), "doc_id").join(told, "doc_id")
    return rows.groupBy("lang", "quality").agg(
        F.count("*").alias("n_labelled"), F.count_if("base_failed").alias("n_base"), F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("n_rules"),
        F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0)).alias("rejected"))
