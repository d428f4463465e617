"""Importance resampling towards a target: hashed n-gram counts and seeded draws without replacement.

Words come from the tokenizers library: an untrained ``Split`` over the
ASCII-lowered text gives words with their offsets. Neighbouring offset pairs
make the windows; each run of words goes into the bucket of its CRC-32. The
buckets of a document are kept, so that texts are cut once: they feed the
histogram of all documents, and later the sum of the gains. A gain is the
scaled log ratio of target and source share of a bucket. The highest sums of
mean gain and Gumbel noise are a draw in proportion to the importance.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.llm.common import binary_texts, narrow
from corpusbench.session import materialize

#: What separates words: ASCII other than digits and lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Characters of a text that are cut into words at once.
SEGMENT = 1 << 16


def packed_dtype(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def segments(text: str, size: int) -> Iterator[str]:
    """A text cut at separators, into parts of about ``size`` characters; a word longer than that stays whole."""
    gap, at = re.compile(GAPS), 0
    while len(text) - at > size:
        found = gap.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Features:
    """Buckets of all runs of 1 to ``longest`` words of a text."""

    def __init__(self, longest: int, buckets: int, segment: int = SEGMENT) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.cut = pre_tokenizers.Split(Regex(GAPS), "removed").pre_tokenize_str
        self.longest, self.buckets, self.segment = longest, buckets, segment
        self.dtype = packed_dtype(buckets)

    def of(self, raw: bytes) -> tuple[int, np.ndarray]:
        """Words, and the bucket of every run."""
        text = raw.lower().decode("utf-8", "replace")  # bytes are lowered in ASCII only
        n, parts = 0, []
        before: list[bytes] = []  # the last words of the part before, whose runs reach into this one
        for part in segments(text, self.segment):
            pairs = [span for _, span in self.cut(part)]
            words = before + [part[a:b].encode() for a, b in pairs]
            n += len(pairs)
            hashes = [zlib.crc32(w) for w in words]
            parts.append(hashes[len(before) :])
            tails = [b" " + w for w in words]
            for k in range(1, self.longest):
                hashes = [zlib.crc32(t, h) for h, t in zip(hashes, tails[k:], strict=False)]
                # a run that ends inside the words carried over was counted with the part before
                parts.append(hashes[max(0, len(before) - k) :])
            before = words[-(self.longest - 1) :] if self.longest > 1 else []
        found = np.concatenate([np.array(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
        return n, (found % self.buckets).astype(self.dtype)


def features(rows: DataFrame, key: str, *, longest: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """The key, n_words, n_features and the buckets, packed as little-endian integers, of every row of key and text."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(longest, buckets)
        for part in parts:
            for k in range(0, part.num_rows, 64):
                piece = part.slice(k, 64)
                got = [made.of(raw) for raw in binary_texts(piece.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).cast(pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([len(b) for _, b in got], pa.int64()),
                     pa.array([b.tobytes() for _, b in got], pa.binary())], names=[key, "n_words", "n_features", "packed"])

    return narrow(rows, key, "text").mapInArrow(cut, f"`{key}` long, n_words long, n_features long, packed binary")


def histogram(found: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the features in it: counted per task, then added up."""
    dtype = packed_dtype(buckets)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in parts:
            for raw in part.column(0):
                total += np.bincount(np.frombuffer(raw.as_py(), dtype), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return found.select("packed").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, *, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the smoothed share ratio) per bucket; one number per bucket comes to the driver."""
    counts = []
    for found in (source, target):
        dense = np.zeros(buckets, np.int64)
        for r in histogram(found, buckets=buckets).collect():
            dense[r["bucket"]] = r["n"]
        counts.append(dense.astype(float))
    s, t = counts
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(found: DataFrame, key: str, gain: np.ndarray, *, buckets: int = BUCKETS) -> DataFrame:
    """The key, n_words, n_features and weight, the floored mean of the gains (0 without features)."""
    shared, dtype = found.sparkSession.sparkContext.broadcast(gain), packed_dtype(buckets)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sums = [int(shared.value[np.frombuffer(raw.as_py(), dtype)].sum()) for raw in part.column(3)]
            weight = [s // n if n else 0 for s, n in zip(sums, part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(weight, pa.int64())], names=[key, "n_words", "n_features", "weight"])

    return found.select(key, "n_words", "n_features", "packed").mapInArrow(add, f"`{key}` long, n_words long, n_features long, weight long")


def importance_sample(docs: DataFrame, target: DataFrame, *, seed: int = 7, percent: int = 25, least_words: int = 20, longest: int = 2,
                      buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Null and empty texts and texts without words have no features, weight 0
    and are never drawn. A null doc_id is hashed as the empty id and comes
    after equal scores with one. Rows that repeat an id share its noise; each
    is a document of its own, and rows equal in all result columns take
    neighbouring ranks. Without target texts the gains follow from T = 0.
    Empty table: no rows. Other columns are not read.

    Scores are whole numbers of a range that the gains and 32 bits of noise
    bound, about 40,000 values at any size. So the counts per score are a
    small table; they give each score's first rank, and rows are numbered
    within their score.
    """
    found = materialize(features(docs, "doc_id", longest=longest, buckets=buckets), "resample-features")
    aim = features(target.select(F.lit(None).cast("long").alias("id"), F.col("text")), "id", longest=longest, buckets=buckets)
    gain = gains(found, materialize(aim, "resample-target"), buckets=buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weigh(found, "doc_id", gain, buckets=buckets).withColumn("score", F.col("weight") + noise), "resample-scores")
    may = F.col("n_words") >= least_words
    per_score = scored.where(may).groupBy("score").agg(F.count("*").alias("n"))
    falling = Window.orderBy(F.desc("score"))
    everything = F.coalesce(F.sum("n").over(Window.partitionBy()), F.lit(0))
    before = per_score.select(
        "score", (F.sum("n").over(falling.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.floor(percent * everything / 100).alias("wanted"))
    placed = scored.join(before, "score", "left").withColumn("open", may & (F.col("before") < F.col("wanted")))
    inside = Window.partitionBy("score", "open").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight")
    rank = F.col("before") + F.row_number().over(inside)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (rank <= F.col("wanted")), rank).alias("rank"))
