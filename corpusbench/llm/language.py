"""Language identification by interpolated Kneser-Ney models over the letters of words.

Spark counts the letter n-grams of a bounded sample of labelled documents.
From these the driver makes, per order, one sorted array of n-gram hashes
with the log probability under every language, and one of context hashes with
the back-off weights. A text gets the language with the least cross-entropy
per letter; temperature and rejection limits are set on a part of the sample
that the counts have not seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import binary_texts, held_out, narrow

ORDER = 5
DISCOUNT = 0.75
#: Begin and end of a word; neither is a letter.
BEGIN, END = "\x02", "\x03"
#: Runs of letters, as the counts take them; fractions, raised digits and numbers in circles are none.
LETTERS = regex.compile(r"\p{L}+")
#: Labelled documents taken per language, in expectation; one in five of them sets temperature and limits.
PER_LANGUAGE = 2_000
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
MEMO = 400_000
UNKNOWN = "und"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def code_hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of n-grams given as rows of code points."""
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out = (out + codes[:, k].astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        out ^= out >> np.uint64(31)
    return out


def gram_hash(grams: list[str]) -> np.ndarray:
    if not grams:
        return np.zeros(0, np.uint64)
    return code_hash(np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(len(grams), -1))


@dataclass
class Model:
    """Sorted hash arrays per order; column k of the values is language k."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | float = 0.0
    temperature: float = 8.0
    limits: dict[str, float] = field(default_factory=dict)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word per language, and its number of letters with the end mark in the last column."""
        out = np.zeros((len(words), len(self.languages) + 1))
        if not words:
            return out
        n_letters = np.array([len(w) + 1 for w in words])
        text = "".join(BEGIN * (ORDER - 1) + w + END for w in words)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)
        first = np.concatenate(([0], np.cumsum(n_letters + ORDER - 1)[:-1]))
        at = np.repeat(first - np.concatenate(([0], np.cumsum(n_letters)[:-1])), n_letters) + np.arange(n_letters.sum())
        rows = windows[at]
        score = np.zeros((len(rows), len(self.languages)))
        left = np.arange(len(rows))
        for n in range(ORDER, 0, -1):
            place, found = locate(self.grams[n - 1], code_hash(rows[left][:, ORDER - n :]))
            score[left[found]] += self.log_p[n - 1][place[found]]
            left = left[~found]
            if n > 1 and len(left):
                place, found = locate(self.contexts[n - 1], code_hash(rows[left][:, ORDER - n : ORDER - 1]))
                score[left[found]] += self.backoff[n - 1][place[found]]
        score[left] += self.floor
        out[:, :-1] = np.add.reduceat(score, np.concatenate(([0], np.cumsum(n_letters)[:-1])))
        out[:, -1] = n_letters
        return out


def locate(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in a sorted array, and whether they are there."""
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return place, (keys[place] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def kneser_ney(counts: dict[str, dict[str, int]]) -> Model:
    """The model from counts of full-order n-grams per language."""
    languages = sorted(counts)
    alphabet = {g[-1] for c in counts.values() for g in c}
    floor = -np.log(len(alphabet) + 1.0)
    # level n-1: language -> n-gram -> count; below the top, the number of different letters to the left
    levels = [{k: defaultdict(int) for k in languages} for _ in range(ORDER)]
    for k in languages:
        levels[-1][k].update(counts[k])
        for n in range(ORDER - 1, 0, -1):
            for g in levels[n][k]:
                levels[n - 1][k][g[1:]] += 1
    model = Model(languages, floor=float(floor))
    lower: dict[str, np.ndarray] = {}
    for n in range(1, ORDER + 1):
        total = {k: defaultdict(int) for k in languages}
        kinds = {k: defaultdict(int) for k in languages}
        for k in languages:
            for g, c in levels[n - 1][k].items():
                total[k][g[:-1]] += c
                kinds[k][g[:-1]] += 1
        contexts = sorted({c for k in languages for c in total[k]})
        weights = np.array([[DISCOUNT * kinds[k][c] / total[k][c] if c in total[k] else 1.0 for k in languages] for c in contexts])
        weight = dict(zip(contexts, weights, strict=True))
        grams = sorted({g for k in languages for g in levels[n - 1][k]})
        here: dict[str, np.ndarray] = {}
        uniform = np.full(len(languages), np.exp(floor))
        for g in grams:
            own = np.array([max(levels[n - 1][k].get(g, 0) - DISCOUNT, 0) / total[k][g[:-1]] if g[:-1] in total[k] else 0.0 for k in languages])
            here[g] = own + weight[g[:-1]] * (lower[g[1:]] if n > 1 else uniform)
        for names, values, keys, out in ((grams, here, model.grams, model.log_p), (contexts, weight, model.contexts, model.backoff)):
            hashes = gram_hash(names) if n > 1 or names is grams else np.zeros(len(names), np.uint64)
            order = np.argsort(hashes, kind="stable")
            keys.append(hashes[order])
            out.append(np.log(np.array([values[x] for x in names]).reshape(len(names), len(languages)))[order])
        lower = here
    # an unknown letter takes each language's own back-off weight of the empty context, so its letters sum to one
    if len(model.backoff[0]):
        model.floor = floor + model.backoff[0][0]
    return model


def labelled_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About so many labelled documents per language, chosen by a hash of the id; those held out are never taken."""
    rows = narrow(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, per_language / r["count"]))]) if sizes else F.lit(None)
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(draw < F.element_at(share, F.col("lang"))) if sizes else rows.limit(0)
    return picked.withColumn("check", F.pmod(F.xxhash64(F.lit("language check"), "doc_id"), F.lit(5)) == 0)


def count_grams(sample: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of full-order n-grams per language, by Spark; the sample bounds what comes to the driver."""
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    by_word = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(BEGIN * (ORDER - 1)), F.col("word"), F.lit(END))
    places = by_word.select("lang", "n", padded.alias("w"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("i"))
    grams = places.groupBy("lang", F.substr("w", "i", F.lit(ORDER)).alias("g")).agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in grams.toLocalIterator():
        out[r["lang"]][r["g"]] = r["n"]
    return dict(out)


class Scorer:
    """Sums of word scores over texts, remembering the parts between white space."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.values = np.zeros((0, len(self.model.languages) + 1))

    def learn(self, raws: set[bytes]) -> None:
        parts = list(raws)
        words = [LETTERS.findall(p.decode("utf-8", "replace").lower()) for p in parts]
        flat = sorted({w for ws in words for w in ws})
        known = dict(zip(flat, self.model.word_scores(flat), strict=True))
        none = np.zeros(self.values.shape[1])
        new = np.array([sum((known[w] for w in ws), none) for ws in words]).reshape(len(parts), -1)
        self.rows.update(zip(parts, range(len(self.values), len(self.values) + len(parts)), strict=True))
        self.values = np.concatenate((self.values, new))

    def totals(self, texts: list[bytes]) -> np.ndarray:
        parts = [t.split() for t in texts]
        new = {p for ps in parts for p in ps if p not in self.rows}
        if len(self.rows) + len(new) > MEMO:
            self.forget()
            new = {p for ps in parts for p in ps}
        if new:
            self.learn(new)
        at = self.rows.__getitem__
        return np.array([self.values[list(map(at, ps))].sum(axis=0) if ps else np.zeros(self.values.shape[1]) for ps in parts])


def entropies(docs: DataFrame, model: Model, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the extra columns, letters (with ends) and the cross-entropy per letter under each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = dict(narrow(docs, *extra).dtypes)
    ddl = ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in extra), "letters long", "entropy array<double>"])

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in parts:
            for k in range(0, part.num_rows, 128):
                piece = part.slice(k, 128)
                total = scorer.totals(binary_texts(piece.column(1)))
                n = total[:, -1:]
                entropy = np.where(n > 0, -total[:, :-1] / np.maximum(n, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), *piece.columns[2:], pa.array(n[:, 0].astype(np.int64)), pa.array(list(entropy), pa.list_(pa.float64()))],
                    names=["doc_id", *extra, "letters", "entropy"])

    return narrow(docs, "doc_id", "text", *extra).mapInArrow(score, ddl)


def fit_languages(docs: DataFrame, *, per_language: int = PER_LANGUAGE, reject: float = 0.999) -> Model:
    """Counts, temperature and rejection limits from a bounded sample of labelled documents that are not held out.

    ``reject``: the share of correctly labelled documents of a language that
    its limit on the cross-entropy must let pass. An empty sample gives a
    model without languages.
    """
    sample = labelled_sample(docs, per_language)
    model = kneser_ney(count_grams(sample.where("not check")))
    if not model.languages:
        return model
    names = F.array(*[F.lit(x) for x in model.languages])
    scored = entropies(sample.where("check"), model, ("lang",)).where("letters > 0")
    place = F.array_position(names, F.col("lang"))
    own = F.element_at("entropy", F.greatest(place, F.lit(1)).cast("int"))
    losses = []
    for t in TEMPERATURES:
        rest = F.aggregate(F.transform("entropy", lambda e, t=t: F.exp(-t * (e - own))), F.lit(0.0), lambda a, b: a + b)
        losses.append(F.avg(F.log(rest)).alias(f"t{TEMPERATURES.index(t)}"))
    known = scored.where(place > 0)
    loss = known.agg(*losses).first()
    values = [loss[k] for k in range(len(TEMPERATURES))]
    if values[0] is not None:
        model.temperature = TEMPERATURES[int(np.argmin(values))]
    limits = known.groupBy("lang").agg(F.percentile_approx(own, reject, 10_000).alias("limit")).collect()  # one row per language
    model.limits = {r["lang"]: float(r["limit"]) for r in limits}
    return model


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected for every document.

    A text that is null, empty or without letters: ``und``, score 0. Rows are
    independent, repeated rows give equal results, equal cross-entropies go
    to the first language in the alphabet. ``rejected``: the cross-entropy is
    above the language's limit; the prediction stays. Empty table: no rows.
    Other columns are not read.
    """
    scored = entropies(docs, model)
    names = F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array(F.lit(UNKNOWN))
    least = F.array_min("entropy")
    best = F.element_at(names, F.greatest(F.array_position("entropy", least), F.lit(1)).cast("int"))
    rest = F.aggregate(F.transform("entropy", lambda e: F.exp(-model.temperature * (e - least))), F.lit(0.0), lambda a, b: a + b)
    some = (F.col("letters") > 0) & F.lit(bool(model.languages))
    limits = [F.lit(x) for k, v in model.limits.items() for x in (k, v)]
    over = F.coalesce(least > F.element_at(F.create_map(*limits), best), F.lit(False)) if limits else F.lit(False)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(some, best).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, 1.0 / rest).otherwise(0.0).alias("score"), F.when(some, least).alias("entropy"), F.when(some, over).otherwise(True).alias("rejected"))
