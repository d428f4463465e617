"""Removal of byte strings that occur earlier in the corpus, by merging Burrows-Wheeler transforms.

Every string of ``length`` bytes has an anchor: its byte q-gram with the least
hash, the leftmost of equals. Consecutive starts with the same anchor form a
piece of text, short enough to be sent to the bucket of its anchor, so all
copies of a string meet in one bucket, and no bucket holds more than what
shares an anchor. A task sends equal pieces of its own chunks once, as far as it
remembers them. Equal pieces are one entry in the bucket: the first in document
order is the head, the others are repeats as a whole. Pieces that only share
the anchor are looked at in parts that also share their nearer context, where
a bucket does the following:

1. It cuts its entries into shards and sorts each shard's suffixes once,
   which gives the shard's transform and its step from a suffix to the one a
   symbol longer (LF).
2. It merges the shards by refining their interleave: in round h all suffixes
   are in the order of their first h symbols, from the order of round h - 1
   by one stable pass over the symbols of the transforms. No suffixes are
   compared. Suffixes whose first h symbols occur once leave the interleave.
3. The limits between blocks are the places where the common prefix is
   shorter than h. After ``length`` symbols every block is a repeated interval;
   all its places but the first in document order are removed.

Two symbols are taken per round. Texts travel in compressed chunks of whole
documents, and the places to remove in packed blocks per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusbench.llm.common import binary_texts, narrow, packed_ids
from corpusbench.llm.jaccard import _BYTES, Powers, mixed
from corpusbench.session import materialize

LENGTH, GRAM = 100, 24
#: Bytes of text after which a chunk is full, and bytes of entries in a shard.
CHUNK, SHARD = 1 << 20, 1 << 17
#: Pieces that a task remembers, as a power of two.
MEMORY = 18
_U = np.uint64
PIECE = np.dtype([("f", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("row", "<u2"), ("lo", "<u4"), ("n", "<u2"), ("at", "<u2")])
PLACE = np.dtype([("chunk", "<i8"), ("row", "<u2"), ("lo", "<u4"), ("hi", "<u4")])
WANTED = np.dtype([("f", "<u8"), ("doc", "<i8"), ("chunk", "<i8"), ("row", "<u2"), ("lo", "<u4"), ("n", "<u2"), ("at", "<u2")])
SEEN = np.dtype([("f", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("chunk", "<i8"), ("hits", "u1")])
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("chunk", "<i8"), ("row", "<u2"), ("lo", "<u4"), ("n", "<u2")])
BLOBS = pa.schema([("key", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
DDL = "key long, kind int, blob binary"
TEXT, REMOVE, WANT, EQUAL = 0, 1, 2, 3


def packed(arrays: np.ndarray) -> bytes:
    """A record array column by column, compressed."""
    return len(arrays).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(arrays[k]).tobytes() for k in arrays.dtype.names))


def unpacked(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n = int.from_bytes(blob[:4], "little")
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob[4:]), 0, np.empty(n, dtype)
    for k in dtype.names:
        size = n * dtype[k].itemsize
        out[k] = np.frombuffer(raw, dtype[k], n, at)
        at += size
    return out


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    key, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], schema=BLOBS)


def by_key(keys: np.ndarray, kind: int, records: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed block per key."""
    order = np.argsort(keys, kind="stable")
    keys, records = keys[order], records[order]
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else np.zeros(0, int)
    return [(int(keys[a]), kind, packed(records[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


# Chunks of text


def chunks_of(docs: DataFrame) -> DataFrame:
    """Rows as chunks of whole documents, written once: all later steps read texts from here."""

    text = docs.columns.index("text")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in parts:
            sizes = np.array([len(x) for x in binary_texts(part.column(text))], np.int64)
            begin = 0
            while begin < part.num_rows:
                end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), CHUNK, side="right")))
                end = min(end, begin + 60_000, part.num_rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part.slice(begin, end - begin))
                yield blob_batch([(number, TEXT, zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes()))])
                number, begin = number + 1, end

    return materialize(docs.mapInArrow(cut, DDL), "text-chunks")


def chunk_rows(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()


def chunk_texts(rows: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    names = rows.schema.names
    return packed_ids(rows.column(names.index("doc_id"))), binary_texts(rows.column(names.index("text")))


# Pieces


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    out, n = h, 1
    while 2 * n <= w:
        out, n = np.minimum(out[:-n], out[n:]), 2 * n
    return np.minimum(out[: len(out) - (w - n)], out[w - n :]) if n < w else out


def pieces_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of a chunk of documents that lie one after another.

    ``ends``: where each document ends. Returns, per piece: anchor hash, hash
    of its text, document, first start in the chunk, number of starts, and
    the anchor's distance from the first start.
    """
    none = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    up, down = Powers.of(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=total[1:])
    h = mixed((total[gram:] - total[:-gram]) * down[: len(data) - gram + 1])
    w = length - gram + 1
    m = window_min(h, w)
    doc = np.searchsorted(ends, np.arange(len(m)), side="right")
    valid = np.arange(len(m)) + length <= ends[doc]
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new & valid)
    if not len(lo):
        return none
    # pieces end before the next one begins, or where starts stop being valid
    bounds = np.flatnonzero(new | ~valid)
    after = np.searchsorted(bounds, lo, side="right")
    hi = np.concatenate((bounds, [len(m)]))[after]
    last = hi - 1
    at = last.copy()
    open_ = h[last] != m[last]
    if open_.any():
        for part in np.array_split(np.flatnonzero(open_), max(1, open_.sum() // 65_536)):
            seen = h[last[part][:, None] + np.arange(w)] == m[last[part]][:, None]
            at[part] += seen.argmax(axis=1)
    g = mixed((total[last + length] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
    return m[lo], g, doc[lo], lo, hi - lo, at - lo


class Seen:
    """Pieces of the chunks that a task has read before, each with its least document, in a table of fixed size.

    A piece with an equal one in an earlier document is a repeat wherever the
    first of all lies, so it need not be sent. What the table forgets is sent and told apart in the bucket. Pieces
    that come back stay longest, so a passage of very many documents is sent
    about once a task.
    """

    def __init__(self, bits: int = MEMORY) -> None:
        self.table, self.shift = np.zeros(1 << bits, SEEN), _U(64 - bits)

    def repeats(self, rows: np.ndarray, chunk: int) -> np.ndarray:
        """Which of a chunk's pieces, all different, have an earlier equal in the table; the table then knows these pieces."""
        slot = (rows["g"] >> self.shift).astype(np.int64)
        known = self.table[slot]
        same = (known["hits"] > 0) & (known["f"] == rows["f"]) & (known["g"] == rows["g"])
        later = same & ((known["doc"] < rows["doc"]) | ((known["doc"] == rows["doc"]) & (known["chunk"] < chunk)))
        hits = self.table["hits"]
        hits[slot[same]] = np.minimum(known["hits"][same], 254) + 1
        hits[slot[~same]] -= hits[slot[~same]] > 0
        take = (same & ~later) | (~same & (hits[slot] == 0))
        new = np.empty(int(take.sum()), SEEN)
        for k in ("f", "g", "doc"):
            new[k] = rows[k][take]
        new["chunk"], new["hits"] = chunk, np.maximum(hits[slot[take]], 1)
        self.table[slot[take]] = new
        return later


def later_equals(rows: np.ndarray) -> np.ndarray:
    """Which pieces of one chunk, given in order of row and place, have an equal one that comes first."""
    order = np.lexsort((rows["doc"], rows["f"], rows["g"]))
    f, g = rows["f"][order], rows["g"][order]
    out = np.zeros(len(rows), bool)
    out[order[1:]] = (f[1:] == f[:-1]) & (g[1:] == g[:-1])
    return out


def send_pieces(blob: bytes, chunk: int, n_buckets: int, length: int, seen: Seen) -> tuple[list[tuple[int, int, bytes]], np.ndarray]:
    """The pieces of a chunk by bucket, and places known to be repeats: whole copies of documents, and pieces with an earlier equal in the task."""
    ids, texts = chunk_texts(chunk_rows(blob))
    order = np.argsort(ids, kind="stable")
    first: dict[bytes, int] = {}
    copies = np.zeros(len(texts), bool)
    for k in order.tolist():
        copies[k] = len(texts[k]) >= length and first.setdefault(hashlib.blake2b(texts[k], digest_size=16).digest(), k) != k
    rows = np.flatnonzero(~copies)
    sizes = np.array([len(texts[k]) for k in rows], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts[k] for k in rows), np.uint8)
    f, g, doc, lo, n, at = pieces_of(data, ends, length)
    out = np.empty(len(f), PIECE)
    out["f"], out["g"], out["doc"], out["row"], out["n"], out["at"] = f, g, ids[rows][doc], rows[doc], n, at
    out["lo"] = lo - (ends - sizes)[doc]
    whole = np.zeros(int(copies.sum()), PLACE)
    whole["row"], whole["hi"] = np.flatnonzero(copies), [len(texts[k]) for k in np.flatnonzero(copies)]
    gone = later_equals(out)
    gone[~gone] = seen.repeats(out[~gone], chunk)
    again = np.zeros(int(gone.sum()), PLACE)
    again["row"], again["lo"] = out["row"][gone], out["lo"][gone]
    again["hi"] = again["lo"] + out["n"][gone] + (length - 1)
    out, places = out[~gone], joined_places(np.concatenate([whole, again]))
    places["chunk"] = chunk
    return by_key((out["f"] >> _U(33)).astype(np.int64) % n_buckets, 1, out), places


def headed(rows: np.ndarray, chunk: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket's pieces: places of repeats of whole pieces, and heads that share their anchor with other heads."""
    order = np.lexsort((rows["lo"], rows["row"], chunk, rows["doc"], rows["g"], rows["f"]))
    rows, chunk = rows[order], chunk[order]
    new_f = np.concatenate(([True], rows["f"][1:] != rows["f"][:-1]))
    head = new_f | np.concatenate(([True], rows["g"][1:] != rows["g"][:-1]))
    group = np.cumsum(new_f) - 1
    several = np.bincount(group, weights=head)[group] > 1
    gone = np.empty(int((~head).sum()), PLACE)
    gone["chunk"], gone["row"], gone["lo"] = chunk[~head], rows["row"][~head], rows["lo"][~head]
    gone["hi"] = gone["lo"] + rows["n"][~head] + (length - 1)
    pick = head & several
    want = np.empty(int(pick.sum()), WANTED)
    for k in ("f", "doc", "row", "lo", "n", "at"):
        want[k] = rows[k][pick]
    want["chunk"] = chunk[pick]
    return gone, want


# Entries: the part of a piece whose strings hold the same side of the anchor's context


def entries_of(want: np.ndarray, texts: list[bytes], length: int, gram: int = GRAM) -> tuple[np.ndarray, list[bytes]]:
    """Each wanted piece as up to two entries: its strings with half of the spare bytes left of the anchor or more, and the others.

    All strings of an entry hold that side of the context, which is part of
    its key, so a common anchor is split by what stands around it.
    """
    half = (length - gram) // 2
    rows, strings = [], []
    for f, doc, chunk, row, lo, n, at in want.tolist():
        text, anchor = texts[row], lo + at
        cut = min(lo + n, max(lo, anchor - half))  # starts before it are further left than half
        for side, a, b in ((0, lo, cut), (1, cut, lo + n)):
            if a < b:
                # left: starts up to anchor - half - 1; right: strings reach length - half beyond the anchor or more
                context = text[anchor - half - 1 : anchor + gram] if side == 0 else text[anchor : anchor + length - half]
                key = hash_of(context, f + side)
                rows.append((key, doc, chunk, row, a, b - a))
                strings.append(text[a : b + length - 1])
    return np.array(rows, ENTRY), strings


def hash_of(data: bytes, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=(seed & (2**64 - 1)).to_bytes(8, "little")).digest(), "little")


def packed_entries(keys: np.ndarray, rows: np.ndarray, strings: list[bytes]) -> list[tuple[int, int, bytes]]:
    out = []
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1], [True]))) if len(keys) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        head = packed(rows[order[a:b]])
        body = zstandard.ZstdCompressor(level=1).compress(b"".join(strings[k] for k in order[a:b]))
        out.append((int(keys[order[a]]), WANT, len(head).to_bytes(4, "little") + head + body))
    return out


def unpacked_entries(blob: bytes, length: int) -> tuple[np.ndarray, list[bytes]]:
    size = int.from_bytes(blob[:4], "little")
    rows = unpacked(blob[4 : 4 + size], ENTRY)
    body = zstandard.ZstdDecompressor().decompress(blob[4 + size :])
    ends = np.cumsum(rows["n"].astype(np.int64) + length - 1).tolist()
    return rows, [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


# Transforms of shards and their merge


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffixes of a shard in order. ``text``: strings, each closed by a place of its own; ``ends``: those places."""
    n = len(text)
    symbol = text.astype(np.int64) + len(ends)
    symbol[ends] = np.arange(len(ends))  # closing places differ from each other and are less than any byte
    step = 1
    rank = symbol
    order = None
    width = int(symbol.max()) + 2
    key = rank + 1
    while step < 3 and width**4 < 2**62:  # several symbols in the first key
        more = np.zeros(n, np.int64)
        more[:-step] = key[step:]
        key, step, width = key * width**step + more, step * 2, width
    order = np.argsort(key, kind="stable")
    while True:
        ordered = key[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        first = np.flatnonzero(new)
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(first, np.diff(np.concatenate((first, [n]))))
        if len(first) == n:
            return order
        size = np.diff(np.concatenate((first, [n])))
        tied = order[np.repeat(size > 1, size)]
        far = np.minimum(tied + step, n - 1)
        second = np.where(tied + step < n, rank[far] + 1, 0)
        again = np.argsort(rank[tied] * (n + 1) + second, kind="stable")
        key = rank * (n + 1)
        key[tied] += second
        order = order.copy()
        order[np.flatnonzero(np.repeat(size > 1, size))] = tied[again]
        step *= 2


class Transforms:
    """The shards' transforms side by side: per suffix its place, two symbols before it and the suffix two symbols longer."""

    def __init__(self, strings: list[bytes], shard: int = SHARD) -> None:
        sizes = np.array([len(s) + 1 for s in strings], np.int64)
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        self.ends = np.cumsum(sizes) - 1
        cuts = [0]
        for k, e in enumerate(self.ends.tolist()):
            if e + 1 - (self.ends[cuts[-1] - 1] + 1 if cuts[-1] else 0) >= shard:
                cuts.append(k + 1)
        if cuts[-1] != len(strings):
            cuts.append(len(strings))
        n = len(text)
        self.place = np.empty(n, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi = (self.ends[a - 1] + 1 if a else 0), self.ends[b - 1] + 1
            self.place[lo:hi] = lo + suffix_order(text[lo:hi], self.ends[a:b] - lo)
        number = np.empty(n, np.int64)
        number[self.place] = np.arange(n)
        begin = np.zeros(n, np.int64)
        begin[self.ends[:-1] + 1] = 1
        begin[0] = 1
        starts = np.flatnonzero(begin)
        depth = self.place - starts[np.cumsum(begin)[self.place] - 1]
        self.more = depth >= 2
        before = np.where(self.more, self.place - 2, self.place)
        self.longer = number[before].astype(np.int32)
        near = text[np.maximum(self.place - 1, 0)].astype(np.uint16)
        self.symbols = (text[before].astype(np.uint16) << 8) | near


def merged(t: Transforms, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and block numbers of all suffixes whose first ``length`` symbols (an even number) occur twice or more."""
    live = np.arange(len(t.place), dtype=np.int32)  # the interleave: one shard after another
    block = np.zeros(len(live), np.int32)
    for _ in range(length // 2):
        go = t.more[live]
        live, block = live[go], block[go]
        symbols = t.symbols[live]
        order = np.argsort(symbols, kind="stable")
        symbols, block, live = symbols[order], block[order], t.longer[live[order]]
        if not len(live):
            break
        limit = np.concatenate(([True], (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1]), [True]))
        keep = ~(limit[:-1] & limit[1:])  # blocks of one suffix leave
        block = np.cumsum(limit[:-1], dtype=np.int32)[keep]
        live = live[keep]
    return t.place[live], block


def repeats_in(rows: np.ndarray, strings: list[bytes], length: int) -> np.ndarray:
    """Places that a bucket's entries show to be repeats."""
    text_of = np.array([hash_of(s, 0) for s in strings], np.uint64)
    order = np.lexsort((rows["lo"], rows["row"], rows["chunk"], rows["doc"], text_of, rows["key"]))
    rows, text_of = rows[order], text_of[order]
    new_key = np.concatenate(([True], rows["key"][1:] != rows["key"][:-1]))
    head = new_key | np.concatenate(([True], text_of[1:] != text_of[:-1]))
    gone = [place_array(rows[~head], rows["lo"][~head], rows["lo"][~head] + rows["n"][~head] + (length - 1))]
    group = np.cumsum(new_key) - 1
    pick = np.flatnonzero(head & (np.bincount(group, weights=head)[group] > 1))
    if len(pick):
        t = Transforms([strings[order[k]] for k in pick])
        place, block = merged(t, length)
        of = np.searchsorted(t.ends, place)
        begin = np.concatenate(([0], t.ends[:-1] + 1))
        found = rows[pick[of]]
        start = found["lo"] + (place - begin[of]).astype(np.uint32)
        sort = np.lexsort((start, found["row"], found["chunk"], found["doc"], block))
        found, start, block = found[sort], start[sort], block[sort]
        first = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(block)), 0)) if len(block) else np.zeros(0, int)
        same = (found["chunk"] == found["chunk"][lead]) & (found["row"] == found["row"][lead]) & (start == start[lead])
        gone.append(place_array(found[~same], start[~same], start[~same] + length))
    return joined_places(np.concatenate(gone))


def place_array(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), PLACE)
    out["chunk"], out["row"], out["lo"], out["hi"] = rows["chunk"], rows["row"], lo, hi
    return out


def joined_places(places: np.ndarray) -> np.ndarray:
    """Overlapping and touching places of a document as one."""
    if not len(places):
        return places
    places = places[np.lexsort((places["hi"], places["lo"], places["row"], places["chunk"]))]
    new = np.concatenate(([True], (places["chunk"][1:] != places["chunk"][:-1]) | (places["row"][1:] != places["row"][:-1])))
    part = np.cumsum(new).astype(np.int64) << 32
    reach = np.maximum.accumulate(part + places["hi"])
    new[1:] |= (part + places["lo"])[1:] > reach[:-1]
    first = np.flatnonzero(new)
    out = places[first].copy()
    out["hi"] = (reach & 0xFFFFFFFF)[np.concatenate((first[1:] - 1, [len(places) - 1]))]
    return out


# The whole job


def dealt(blobs: DataFrame, n: int) -> DataFrame:
    return blobs.repartition(n, "key").sortWithinPartitions("key", "kind")


def grouped(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Blocks by key, over batch ends."""
    at, held = None, []
    for part in parts:
        for key, kind, blob in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if key != at and held:
                yield at, held
                held = []
            at = key
            held.append((kind, blob))
    if held:
        yield at, held


def places_by_way(texts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Packed places to remove, by chunk: those of equal pieces, and those that the merge of transforms finds."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = 4 * n

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for part in parts:
            for number, blob in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                rows, gone = send_pieces(blob, number, n_buckets, length, seen)
                head = number.to_bytes(8, "little", signed=True)
                # known repeats go on by a bucket of their own, unchanged
                extra = [(number % n_buckets, 0, packed(gone))] if len(gone) else []
                yield blob_batch([(k, kind, head + b) for k, kind, b in rows] + extra)

    def heads(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(parts):
            gone = [unpacked(b, PLACE) for kind, b in blobs if kind == 0]
            got = [(int.from_bytes(b[:8], "little", signed=True), unpacked(b[8:], PIECE)) for kind, b in blobs if kind == 1]
            want = np.zeros(0, WANTED)
            if got:
                chunk = np.repeat(np.array([c for c, _ in got], np.int64), [len(r) for _, r in got])
                more, want = headed(np.concatenate([r for _, r in got]), chunk, length)
                gone.append(more)
            gone = joined_places(np.concatenate(gone))
            yield blob_batch(by_key(gone["chunk"], REMOVE, gone) + by_key(want["chunk"], WANT, want))

    met = materialize(dealt(texts.mapInArrow(pieces, DDL), n).mapInArrow(heads, DDL), "piece-heads")

    def entries(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(parts):
            asked = [unpacked(b, WANTED) for kind, b in blobs if kind == WANT]
            text = next((b for kind, b in blobs if kind == TEXT), None)
            if asked and text is not None:
                _, own = chunk_texts(chunk_rows(text))
                rows, strings = entries_of(np.concatenate(asked), own, length)
                yield blob_batch(packed_entries((rows["key"] >> _U(33)).astype(np.int64) % n_buckets, rows, strings))

    def repeats(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(parts):
            got = [unpacked_entries(b, length) for _, b in blobs]
            gone = repeats_in(np.concatenate([r for r, _ in got]), [s for _, ss in got for s in ss], length)
            yield blob_batch(by_key(gone["chunk"], REMOVE, gone))

    wanted = texts.union(met.where(F.col("kind") == WANT))
    parts = dealt(dealt(wanted, n).mapInArrow(entries, DDL), n).mapInArrow(repeats, DDL)
    return met.where(F.col("kind") == REMOVE), materialize(parts, "repeated-places")


def places_to_remove(texts: DataFrame, length: int) -> DataFrame:
    """Packed places to remove, by chunk."""
    equal, merging = places_by_way(texts, length)
    return equal.union(merging)


def removed_shares(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """One row of longs: n_bytes of the texts, n_equal bytes covered by equal pieces, n_merged by the merge of transforms, n_removed by either.

    Empty table: null sums.
    """
    texts = chunks_of(narrow(docs, "doc_id", "text"))
    equal, merging = places_by_way(texts, length)
    covered = lambda places: int((places["hi"].astype(np.int64) - places["lo"]).sum())

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(parts):
            ways = [joined_places(np.concatenate([np.zeros(0, PLACE), *(unpacked(b, PLACE) for kind, b in blobs if kind == k)])) for k in (EQUAL, REMOVE)]
            n = sum(len(t) for kind, b in blobs if kind == TEXT for t in chunk_texts(chunk_rows(b))[1])
            values = [n, *map(covered, ways), covered(joined_places(np.concatenate(ways)))]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in values], names=names)

    names = ["n_bytes", "n_equal", "n_merged", "n_removed"]
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = texts.union(equal.select("key", F.lit(EQUAL).alias("kind"), "blob")).union(merging)
    return dealt(marked, n).mapInArrow(count, ", ".join(f"{k} long" for k in names)).agg(*(F.sum(k).alias(k) for k in names))


def kept_bytes(data: bytes, places: np.ndarray) -> bytes:
    ends = [0, *places["hi"].tolist()]
    return b"".join(data[a:b] for a, b in zip(ends, [*places["lo"].tolist(), len(data)], strict=True))


def finished(texts: DataFrame, places: DataFrame, schema: StructType, finish) -> DataFrame:
    """Chunks meet their places; ``finish`` makes a batch from a chunk's rows and the places of each."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in grouped(parts):
            text = next((b for kind, b in blobs if kind == TEXT), None)
            if text is None:
                continue
            rows = chunk_rows(text)
            gone = [unpacked(b, PLACE) for kind, b in blobs if kind == REMOVE]
            gone = joined_places(np.concatenate(gone)) if gone else np.zeros(0, PLACE)
            cuts = np.searchsorted(gone["row"], np.arange(rows.num_rows + 1))
            yield finish(rows, [gone[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        pa.default_memory_pool().release_unused()

    return dealt(texts.union(places), n).mapInArrow(cut, schema)


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeat_report(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document.

    A byte is removed if a string of ``length`` bytes that covers it also
    starts earlier: in a document of smaller doc_id, or earlier in its own.
    Null and empty texts have no bytes. Texts shorter than ``length`` stay.
    A null doc_id comes first. Of rows that repeat an id, the first in the
    table as read comes first. Empty table: no rows. Other columns are not
    read. ``length`` is even and above 2 * GRAM.
    """
    def report(rows: pa.RecordBatch, places: list[np.ndarray]) -> pa.RecordBatch:
        _, texts = chunk_texts(rows)
        names = rows.schema.names
        removed = [int((p["hi"].astype(np.int64) - p["lo"]).sum()) for p in places]
        sha = [hashlib.sha256(kept_bytes(t, p)).hexdigest() for t, p in zip(texts, places, strict=True)]
        return pa.RecordBatch.from_arrays(
            [rows.column(names.index("doc_id")).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
             pa.array([len(p) for p in places], pa.int64()), pa.array(sha, pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = chunks_of(narrow(docs, "doc_id", "text"))
    return finished(texts, places_to_remove(texts, length), REPORT, report)


def without_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut out of their texts, other columns as they were.

    Bytes of a character that is only partly removed go too. ``n_chars`` is
    set anew where there is such a column. Null texts stay null.
    """
    names = docs.columns
    texts = chunks_of(docs)

    def cut(rows: pa.RecordBatch, places: list[np.ndarray]) -> pa.RecordBatch:
        _, own = chunk_texts(rows)
        columns = list(rows.columns)
        k = names.index("text")
        given = columns[k].is_valid().to_pylist()
        new = [kept_bytes(t, p).decode("utf-8", "ignore") if ok else None for t, p, ok in zip(own, places, given, strict=True)]
        columns[k] = pa.array(new, columns[k].type)
        if "n_chars" in names:
            c = names.index("n_chars")
            columns[c] = pa.array([old if x is None else len(x) for x, old in zip(new, columns[c].to_pylist(), strict=True)], columns[c].type)
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return finished(texts, places_to_remove(texts, length), docs.schema, cut)
