"""Toxicity scores by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, hashed to 40 bits. Spark
counts in how many labelled texts of either class each term is; the terms
that tell the classes apart best are kept, and with them the terms of the
pairs that tell the classes apart better than either term does alone. The
machine

    z = b + sum of w[i] + sum over pairs i < j of <v[i], v[j]>

over the kept terms of a text, with z through the logistic function, also
learns pairs that a sum of weights misses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import batches, binary_texts, held_out, narrow

WORDS = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)
BITS = 40
#: Labelled documents taken per class, in expectation.
PER_CLASS = 4_000
#: Terms kept, the least texts of either class with one, and the least log-likelihood ratio.
TERMS, LEAST, RATIO = 2_048, 3, 12.0
#: Terms whose pairs are counted, those of most toxic texts first; pairs kept, and the least log-likelihood ratio of one.
PAIR_TERMS, PAIRS, PAIR_RATIO = 2_048, 64, 30.0
FACTORS, EPOCHS, RATE, DECAY = 8, 40, 0.03, 1e-4
MEMO = 400_000


def terms_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    names = ["=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) >> (64 - BITS) for x in names]


def document_terms(raw: bytes) -> set[int]:
    return {t for w in set(WORDS.findall(raw.decode("utf-8", "replace").lower())) for t in terms_of(w)}


@dataclass
class Machine:
    """Kept terms, the place of each, and the weights of the machine."""

    places: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, places: list[int]) -> float:
        z = self.bias
        if places:
            v = self.factors[places]
            z += self.weights[places].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))))


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, toxic of about so many labelled documents per class, and the share taken of each class.

    Never rows held out. Ids are drawn by hash. A document with two labels counts as both.
    The drawn ids, about 2 x per_class at every size of the input, are broadcast, so the texts stay where they are.
    """
    marks = narrow(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = marks.groupBy("toxic").count().collect()  # one row per class
    share = {r["toxic"]: min(1.0, per_class / r["count"]) for r in sizes}
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = marks.where(draw < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    return narrow(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic"), share


def term_lists(sample: DataFrame) -> DataFrame:
    """toxic and the distinct term hashes of each sampled document."""

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = ((y, sorted(document_terms(raw))) for raw, y in zip(binary_texts(part.column(0)), part.column(1).to_pylist(), strict=True))
            yield from batches(rows, pa.schema([("toxic", pa.int32()), ("terms", pa.list_(pa.int64()))]), 256)

    return sample.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(split, "toxic int, terms array<long>")


def telling_terms(lists: DataFrame, n: int, n_pairs: int) -> tuple[list[int], list[int]]:
    """The terms with the highest log-likelihood ratio between the classes, and those in most toxic texts, to be paired.

    ``n`` and ``n_pairs`` bound what comes to the driver.
    """
    total = lists.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, q = float(total["p"] or 0), float((total["n"] or 0) - (total["p"] or 0))
    if not p or not q:
        return [], []
    counts = lists.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("ab"))
    a, b = F.col("a"), F.col("ab") - F.col("a")
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    both, all_ = F.col("ab"), p + q
    ratio = 2 * (part(a, both * p / all_) + part(b, both * q / all_) + part(p - a, (all_ - both) * p / all_) + part(q - b, (all_ - both) * q / all_))
    rated = counts.where(both >= LEAST).select("term", "a", ratio.alias("r")).persist()
    try:
        best = rated.where(F.col("r") >= RATIO).orderBy(F.desc("r"), "term").limit(n).collect()
        paired = rated.where(F.col("a") >= LEAST).orderBy(F.desc("a"), "term").limit(n_pairs).collect()
    finally:
        rated.unpersist()
    return sorted(r["term"] for r in best), sorted(r["term"] for r in paired)


def ratios(a: np.ndarray, b: np.ndarray, p: float, q: float) -> np.ndarray:
    """Log-likelihood ratios of what is in ``a`` of ``p`` toxic and ``b`` of ``q`` other texts."""
    both, all_ = a + b, p + q

    def part(k: np.ndarray, e: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)

    return 2 * (part(a, both * p / all_) + part(b, both * q / all_) + part(p - a, (all_ - both) * p / all_) + part(q - b, (all_ - both) * q / all_))


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, n: int, *, most: int = PAIRS) -> list[tuple[int, int]]:
    """The pairs of places below ``n`` that tell toxic texts better, by ``RATIO``, than either of the two does.

    Counts of all pairs are two n x n matrices, products over the sample's
    rows in blocks. Ties go to the smaller pair.
    """
    counts = [np.zeros((n, n), np.float32) for _ in range(2)]
    for y in (0, 1):
        mine = [r for r, k in zip(rows, labels, strict=True) if k == y]
        for k in range(0, len(mine), 1024):
            x = np.zeros((min(1024, len(mine) - k), n), np.float32)
            for i, r in enumerate(mine[k : k + 1024]):
                x[i, r] = 1
            counts[y] += x.T @ x
    p, q = float((labels == 1).sum()), float((labels == 0).sum())
    alone = ratios(counts[1].diagonal().astype(float), counts[0].diagonal().astype(float), p, q)
    found: list[tuple[float, int, int]] = []
    for k in range(0, n, 128):
        a, b = (c[k : k + 128].astype(float) for c in counts[::-1])
        r = ratios(a, b, p, q)
        good = (a * q > b * p) & (a + b >= LEAST) & (r >= PAIR_RATIO) & (r >= np.maximum(alone[k : k + 128, None], alone) + RATIO)
        i, j = np.nonzero(good)
        found += [(-r[x, y], k + x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if k + x < y]
        found = sorted(found)[:most]
    return [(i, j) for _, i, j in found]


def train(rows: list[list[int]], labels: np.ndarray, weights: np.ndarray, places: dict[int, int], *, seed: int = 7) -> Machine:
    """Adam on the weighted log loss, in fixed order from a fixed seed."""
    n, rng = len(places), np.random.default_rng(seed)
    w, v, b = np.zeros(n), rng.normal(0, 0.05, (n, FACTORS)), 0.0
    params = [np.array([b]), w, v]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for _ in range(EPOCHS if n else 0):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 256):
            pick = order[k : k + 256]
            x = np.zeros((len(pick), n))
            for r, i in enumerate(pick):
                x[r, rows[i]] = 1.0
            s = x @ params[2]
            z = params[0][0] + x @ params[1] + 0.5 * (s**2 - x @ (params[2] ** 2)).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * weights[pick] / len(pick)
            grads = [np.array([g.sum()]), x.T @ g + DECAY * params[1], x.T @ (g[:, None] * s) - (x.T @ g)[:, None] * params[2] + DECAY * params[2]]
            t += 1
            for p, (m1, m2), d in zip(params, moments, grads, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Machine(places, float(params[0][0]), params[1], params[2])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, terms: int = TERMS, pair_terms: int = PAIR_TERMS) -> Machine:
    """The machine from a bounded sample of labelled documents; only their kept and paired terms come to the driver.

    Rows with a null id, label or text teach nothing or no terms; repeated
    rows count repeatedly. Without labels of both classes: a machine that
    scores 0 everywhere.
    """
    sample, share = labelled(docs, labels, per_class)
    lists = term_lists(sample).persist()
    try:
        kept, paired = telling_terms(lists, terms, pair_terms)
        if not kept and not paired:
            return Machine({}, -50.0, np.zeros(0), np.zeros((0, FACTORS)))
        # paired terms first, so that their places are those of the pair counts
        asked = paired + sorted(set(kept) - set(paired))
        shared = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(asked)})

        def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                rows = ((y, np.array(sorted(shared.value[t] for t in ts if t in shared.value), "<i4").tobytes())
                        for y, ts in zip(*[c.to_pylist() for c in part.columns], strict=True))
                yield from batches(rows, pa.schema([("toxic", pa.int32()), ("places", pa.binary())]))

        got = lists.mapInArrow(keep, "toxic int, places binary").collect()  # at most about 2 x per_class rows
    finally:
        lists.unpersist()
    got = sorted((r["toxic"], bytes(r["places"])) for r in got)
    y = np.array([k for k, _ in got], float)
    rows = [np.frombuffer(x, "<i4") for _, x in got]
    alone = set(kept)
    used = {k for k, t in enumerate(asked) if t in alone}
    used |= {k for pair in telling_pairs([r[r < len(paired)] for r in rows], y, len(paired)) for k in pair}
    order = sorted(used, key=lambda k: asked[k])
    if not order:
        return Machine({}, -50.0, np.zeros(0), np.zeros((0, FACTORS)))
    place = np.full(len(asked), -1)
    place[order] = np.arange(len(order))
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    listed = [sorted(k for k in place[r].tolist() if k >= 0) for r in rows]
    return train(listed, y, weight / weight.mean(), {asked[k]: i for i, k in enumerate(order)})


def scores(texts: list[bytes], machine: Machine, memo: dict[bytes, tuple[int, ...]]) -> list[float]:
    """Scores of texts; ``memo`` has the kept terms of the parts between white space."""
    out = []
    places = machine.places
    for raw in texts:
        found: set[int] = set()
        for p in raw.split():
            got = memo.get(p)
            if got is None:
                got = tuple({places[t] for w in WORDS.findall(p.decode("utf-8", "replace").lower()) for t in terms_of(w) if t in places})
                if len(memo) < MEMO:
                    memo[p] = got
            if got:
                found.update(got)
        out.append(machine.score(sorted(found)))
    return out


def score_toxicity(docs: DataFrame, machine: Machine, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null or empty text: the score of a text without terms. Rows are
    independent of each other; repeated rows give equal scores. Empty table:
    no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for part in parts:
            for k in range(0, part.num_rows, 256):
                piece = part.slice(k, 256)
                got = scores(binary_texts(piece.column(1)), shared.value, memo)
                yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(got, pa.float64())], names=["doc_id", "score"])

    scored = narrow(docs, "doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, machine: Machine, *, threshold: float = 0.3) -> DataFrame:
    """The documents below the threshold, all their columns as they were.

    Null or empty text: judged as a text without terms. Repeated rows stay or
    go together. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index("text")

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[int, ...]] = {}
        for part in parts:
            for k in range(0, part.num_rows, 256):
                piece = part.slice(k, 256)
                got = scores(binary_texts(piece.column(place)), shared.value, memo)
                yield piece.filter(pa.array([x < threshold for x in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
