"""Quality scores by compression: which of two dictionaries makes a text smaller.

One zstandard dictionary is trained on pieces of texts labelled good, one on
pieces of texts labelled bad. A text is compressed piece by piece with
either; the difference of the sizes, over the length of the text, says which
class it resembles. A logistic curve fitted on labelled texts that taught
neither dictionary turns the difference into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import batches, binary_texts, narrow

#: Bytes compressed together, of a dictionary, and added to a text's length.
PIECE, DICTIONARY, SMOOTH = 4_096, 112_640, 64
LEVEL = 3
#: Labelled documents drawn per class, in expectation, and pieces of them per class that train a dictionary.
PER_CLASS, PIECES = 4_000, 4_000
#: Labelled documents are dealt into 5 parts by crc32 of the id: 0 is held out, 4 fits the curve, 1 to 3 train.
PARTS, HELD, CURVE = 5, 0, 4
DRAW = 1 << 30


def part_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % PARTS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(part_of(doc_id) == HELD, F.lit(False))


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    for k in range(0, len(text), size):
        yield text[k : k + size]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; where the samples are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """Two dictionaries and the curve 1 / (1 + exp(-(bias + slope * difference)))."""

    good: bytes
    bad: bytes
    bias: float = 0.0
    slope: float = 0.0

    @cached_property
    def compressors(self) -> tuple:
        made = []
        for raw in (self.good, self.bad):
            shared = zstandard.ZstdCompressionDict(raw) if raw else None
            if shared:
                shared.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))
        return tuple(made)

    def __getstate__(self) -> dict:
        return {"good": self.good, "bad": self.bad, "bias": self.bias, "slope": self.slope}

    def difference(self, text: bytes) -> float:
        """How many bytes the good dictionary saves over the bad one, per byte of text."""
        good, bad = self.compressors
        saved = sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces(text))
        return saved / (len(text) + SMOOTH)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, ridge: float = 1e-3, steps: int = 60) -> tuple[float, float]:
    """Bias and slope of a weighted logistic curve by Newton steps; the slope never falls below 0."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([np.ones_like(x), x / scale], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * w
        curve = a.T @ (a * (weight * p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0]), max(0.0, float(w[1]) / scale)


def labelled(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, text, quality of about so many labelled documents per class, and the share taken of each class.

    Never rows held out. A document with two labels counts as both. The drawn
    ids, about 2 x per_class at every size of the input, are broadcast, so
    the texts stay where they are.
    """
    known = F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    marks = narrow(labels, "doc_id", "quality").where(known)
    share = {r["quality"]: min(1.0, per_class / r["count"]) for r in marks.groupBy("quality").count().collect()}  # one row per class
    draw = F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(DRAW)) / float(DRAW)
    drawn = marks.where(draw < F.when(F.col("quality") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    return narrow(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id"), share


def sample_pieces(sample: DataFrame, quality: int, n: int) -> list[bytes]:
    """Pieces of the training texts of one class: the n with the least hash, so at most n x ``PIECE`` bytes."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = ((doc_id, k, p) for doc_id, raw in zip(part.column(0).to_pylist(), binary_texts(part.column(1)), strict=True) for k, p in enumerate(pieces(raw)))
            yield from batches(rows, pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("piece", pa.binary())]), 256)

    rows = sample.where((F.col("quality") == quality) & (part_of(F.col("doc_id")) != CURVE)).select("doc_id", "text")
    made = rows.mapInArrow(cut, "doc_id long, k long, piece binary").withColumn("draw", F.xxhash64("doc_id", "k"))
    return [bytes(r["piece"]) for r in made.orderBy("draw", "doc_id", "k", "piece").limit(n).collect()]


def differences(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The named columns and the size difference of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = narrow(docs, *keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text")

    def compress(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(0, part.num_rows, 256):
                piece = part.slice(k, 256)
                got = [shared.value.difference(raw) for raw in binary_texts(piece.column(len(keep)))]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], pa.array(got, pa.float64())], names=[*keep, "difference"])

    return kept.mapInArrow(compress, f"{schema}, difference double")


def fit_quality(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, n_pieces: int = PIECES) -> Model:
    """Dictionaries and curve from a bounded sample of labelled documents.

    Where one class has no text in the curve's part, the training texts fit
    the curve too. With labels of one class only every text gets the share of
    good labels, smoothed by one of each; without labels that is one half.
    """
    sample, share = labelled(docs, labels, per_class)
    good, bad = sample_pieces(sample, 1, n_pieces), sample_pieces(sample, 0, n_pieces)
    model = Model(build_dictionary(good) if good else b"", build_dictionary(bad) if bad else b"")
    measured = differences(sample, model, "doc_id", "quality").withColumn("curve", part_of(F.col("doc_id")) == CURVE)
    rows = sorted(tuple(r) for r in measured.select("curve", "quality", "difference", "doc_id").collect())  # about 2 x per_class rows
    fit = [r for r in rows if r[0]]
    if len({r[1] for r in fit}) < 2:
        fit = rows
    y = np.array([r[1] for r in fit], float)
    if len(set(y.tolist())) < 2:
        return Model(model.good, model.bad, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0)
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    return Model(model.good, model.bad, *fit_curve(np.array([r[2] for r in fit]), y, weight / weight.mean()))


def score_quality(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Null or empty text: no difference, so the score of the curve at 0. Rows
    are independent of each other; repeated rows give equal scores. Empty
    table: no rows. Other columns are not read.
    """
    z = F.lit(model.bias) + F.lit(model.slope) * F.col("difference")
    scored = differences(docs, model, "doc_id").withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0)))))
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
