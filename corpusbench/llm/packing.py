"""Packing token ids into sequences of a fixed length without changing their order.

The stream of ids of a part (documents in order of doc_id) is cut into
windows. Allowed cuts are the ends of documents (free), the ends of sentences
(a small penalty) and, where neither comes for long, any place on a coarse
raster (a larger penalty). With f(j) the least cost of the stream up to cut j
and p its penalty,

    f(j) = p(j) + min over i with pos(j) - pos(i) <= length of f(i) + length - (pos(j) - pos(i))

so the minimum is over f(i) + pos(i) in a sliding window, which a monotone
queue gives in constant time per cut.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corpusbench.llm.common import batches, binary_texts
from corpusbench.llm.tokens import MEMO, Encoder, in_order

#: Costs of a cut, in padded ids.
SENTENCE, ANYWHERE = 8, 64
#: Without an allowed cut for so many ids, cuts are allowed on this raster.
RASTER = 256
#: Windows per run of the dynamic program; what follows the last safe cut goes to the next run.
RUN = 64
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cut_places(size: int, document_ends: np.ndarray, sentence_ends: np.ndarray, raster: int = RASTER) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts in (0, size] and their penalties, both ascending by place."""
    soft = np.unique(np.concatenate((sentence_ends, document_ends, [0, size])))
    gaps = np.flatnonzero(np.diff(soft) > raster)
    extra = [np.arange(soft[k] + raster, soft[k + 1], raster) for k in gaps]
    places = np.unique(np.concatenate([soft, *extra]))
    places = places[places > 0]
    penalty = np.full(len(places), ANYWHERE)
    penalty[np.isin(places, sentence_ends)] = SENTENCE
    penalty[np.isin(places, document_ends)] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> list[int]:
    """Cuts of least cost; the last is any place within a window of the end."""
    pos, pen = [0, *places.tolist()], [0, *penalties.tolist()]
    cost, back = [0] * len(pos), [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])
    for j in range(1, len(pos)):
        at = pos[j]
        low = at - length
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        cost[j], back[j] = value + length - at + pen[j], i
        key = cost[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    end = pos[-1] - length
    j = min((k for k in range(1, len(pos)) if pos[k] > end), key=lambda k: (cost[k], -k))
    cuts = []
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def last_windows(start: int, end: int, length: int, least: int = 16) -> list[int]:
    """Ends of the windows of a part's short rest: powers of two need no padding."""
    cuts = []
    while end - start and not (cuts == [] and length - (end - start) <= least):
        start += 1 << (end - start).bit_length() - 1
        cuts.append(start)
    return cuts or [end]


class Packer:
    """Takes documents in order and gives pieces; holds a run of windows and the documents in them."""

    def __init__(self, length: int, enders: np.ndarray, first_id: int) -> None:
        self.length, self.enders, self.sequence = length, enders, first_id
        self.docs: list[tuple] = []  # doc_id, ids, ids already given
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)
        if self.size >= RUN * self.length:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.size:
            return
        stream = np.concatenate([ids[used:] for _, ids, used in self.docs])
        ends = np.cumsum([len(ids) - used for _, ids, used in self.docs])
        sentences = np.flatnonzero(self.enders[stream]) + 1
        places, penalties = cut_places(self.size, ends, sentences, max(1, min(RASTER, self.length // 4)))
        cuts = best_cuts(places, penalties, self.length)
        if last:
            if cuts[-1] < self.size:
                cuts += last_windows(cuts[-1], self.size, self.length)
            elif (short := cuts[-1] - (cuts[-2] if len(cuts) > 1 else 0)) < self.length:
                before = cuts[-1] - short
                cuts = cuts[:-1] + last_windows(before, self.size, self.length)
        done, kept, at, c, begun = cuts[-1], [], 0, 0, 0
        for doc_id, ids, used in self.docs:
            stop = at + len(ids) - used
            here = at
            while here < stop and here < done:
                if here == cuts[c]:
                    begun, c, self.sequence = cuts[c], c + 1, self.sequence + 1
                to = min(stop, cuts[c])
                a, b = used + here - at, used + to - at
                yield doc_id, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), len(ids), self.sequence, here - begun
                here = to
            if here < stop:
                kept.append((doc_id, ids, used + here - at))
            at = stop
        self.sequence += 1
        self.docs, self.size = kept, self.size - done


def sentence_enders(encoder: Encoder) -> np.ndarray:
    """For each id, whether its token ends a sentence: punctuation that closes with one of . ! ?"""
    ends = np.zeros(encoder.tokenizer.get_vocab_size() + 1, bool)
    for token, k in encoder.tokenizer.get_vocab().items():
        bare = token.removesuffix("</w>")
        ends[k] = bool(bare) and bare[-1] in ".!?" and not any(c.isalnum() for c in bare)
    return ends


def pack_documents(docs: DataFrame, tokenizer: str, *, end_id: int, length: int = 4096, memo: int = MEMO) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Null text: the end id alone. Null doc_id: packed first. Repeated
    rows are packed each. Empty table: no rows. A part's last, short sequence
    is cut into powers of two. sequence_id is the part's number times 2**32
    plus a running number. ``memo``: words that a worker remembers.
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, memo)
        end = np.array([end_id], encoder.dtype)
        packer = Packer(length, sentence_enders(encoder), TaskContext.get().partitionId() << 32)

        def rows():
            for part in parts:
                for doc_id, raw in zip(part.column(0).to_pylist(), binary_texts(part.column(1)), strict=True):
                    yield from packer.add(doc_id, np.concatenate((encoder.text(raw), end)))
            yield from packer.flush(True)

        yield from batches(rows(), PIECES)

    return in_order(docs).mapInArrow(pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
