"""Near copies by the Jaccard similarity of their sets of word shingles.

Two documents link if 100 * overlap >= percent * union. The join is exact:

1. Shingles are hashed to 64 bits and ordered: common ones last (a list from
   a bounded sample; it only sets the order), else by hash. A linked pair
   shares one of the first n - ceil(percent * n / 100) + 1 shingles of both.
   These prefixes are sent, in packed blocks, to the bucket of their hash;
   equal sets are one class. Of the classes in a shingle that have another one
   of a fitting size there, the least is the hub. Two classes that share a
   shingle share its hub, so a hub and its classes are one group, however many
   shingles they have in common.
2. A group is cut into tiles by size. In each pair of tiles of fitting sizes,
   bit counts of hashed bitmaps bound the overlap from above: a bit that only
   A has stands for a shingle that B lacks. Classes without a partner within
   the bound leave.
3. Texts of the others are read again, and pairs within the bound are verified
   by exact intersection of the sorted sets, those with most partners first,
   until no two of different components are left. So a group gives at most as
   many links as it has classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import NULL_ID, batches, binary_texts, narrow, packed_ids
from corpusbench.llm.graph import connected_components
from corpusbench.session import materialize

WORDS, PERCENT = 5, 80
#: Documents in the sample for the order of shingles, in expectation, and in how many of them a common one is.
SAMPLE, COMMON = 8_192, 8
#: Classes in a tile, and classes of a group that one task takes at a time.
TILE, SLICE = 128, 4_096
#: 64-bit words of bitmaps that are compared at once.
WORDS_AT_ONCE = 1 << 19
_U = np.uint64
_BASE, _STEP, _MIX = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) | _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    h = (h ^ (h >> _U(29))) * _STEP
    return h ^ (h >> _U(32))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as long as the longest text so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            up, down = np.full(size, _BASE), np.full(size, _U(pow(int(_BASE), -1, 2**64)))
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash per word (no blank, tab to carriage return) of a text whose A-Z are lower case."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = np.concatenate(([0] * (not blank[0]), edge, [len(data)] * (not blank[-1]))).astype(np.int64)
    begin, end = edge[::2], edge[1::2]
    up, down = Powers.of(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up, out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle, one without words has none."""
    w = word_hashes(raw.lower())
    if not len(w):
        return w
    n = min(words, len(w))
    h = w[: len(w) - n + 1] + _U(n)
    for k in range(1, n):
        h = h * _BASE + w[k : len(w) - n + 1 + k]
    return np.unique(mixed(h))


def prefix(shingles: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of which a linked document must share one: common ones come last in the order."""
    n = len(shingles)
    size = n - -(-percent * n // 100) + 1
    if not n:
        return shingles
    last = common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] == shingles if len(common) else np.zeros(n, bool)
    return np.concatenate((shingles[~last], shingles[last]))[:size]


def class_of(shingles: np.ndarray) -> tuple[int, bytes]:
    """64 and 128 bits that stand for a set."""
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), digest


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits of the hashes; the width is the power of two from four times the set's size on."""
    width = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingles & _U(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words of one width, wider ones folded."""
    out = np.zeros((len(maps), width // 8), np.uint8)
    for k, m in enumerate(maps):
        out[k] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width // 8), axis=0)
    return out.view(np.uint64)


def possible(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """For each pair of rows, whether the bit counts allow a link; a few rows at a time, so wide bitmaps need little memory."""
    both = np.empty((len(a), len(b)), np.int64)
    step = max(1, WORDS_AT_ONCE // max(1, b.size))
    for i in range(0, len(a), step):
        both[i : i + step] = np.bitwise_count(a[i : i + step, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
    only_a = np.bitwise_count(a).sum(axis=1, dtype=np.int64)[:, None] - both
    only_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)[None, :] - both
    overlap = np.minimum(n_a[:, None] - only_a, n_b[None, :] - only_b)
    return (100 + percent) * overlap >= percent * (n_a[:, None] + n_b[None, :])


def tile_fits(sizes: np.ndarray, maps: list[bytes], own: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a group sizes and bit counts allow; with two slices, only pairs over both.

    ``sizes`` ascend. The result is symmetric, with nothing on the diagonal.
    """
    n = len(sizes)
    fits = np.zeros((n, n), bool)
    over = len(np.unique(own)) > 1
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            if percent * sizes[j] > 100 * sizes[min(i + TILE, n) - 1]:
                break
            p, q = slice(i, i + TILE), slice(j, j + TILE)
            some = percent * sizes[q][None, :] <= 100 * sizes[p][:, None]
            some &= percent * sizes[p][:, None] <= 100 * sizes[q][None, :]
            if over:
                some &= own[p][:, None] != own[q][None, :]
            if i == j:
                np.fill_diagonal(some, False)
            if not some.any():
                continue
            width = min(len(m) for m in maps[p] + maps[q]) * 8
            some &= possible(folded(maps[p], width), sizes[p], folded(maps[q], width), sizes[q], percent)
            fits[p, q] |= some
            fits[q, p] |= some.T
    return fits


def spanning_links(sets: list[np.ndarray], fits: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Exact links that join the same components as all links among the allowed pairs do."""
    part, links = np.arange(len(sets)), []
    for i in np.argsort(-fits.sum(axis=1), kind="stable").tolist():
        for j in np.flatnonzero(fits[i] & (part != part[i])).tolist():
            if part[j] == part[i]:
                continue
            x, y = sets[i], sets[j]
            at = np.minimum(np.searchsorted(x, y), len(x) - 1)
            both = int((x[at] == y).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                links.append((i, j))
                part[part == part[j]] = part[i]
    return links


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles in COMMON or more different sets of the sample; at most SAMPLE * (mean set size) / COMMON of them."""
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.lit("shingle sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)

    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = ((class_of(s)[0], s.view(np.int64)) for s in (shingle_set(raw, words) for raw in binary_texts(part.column(1))))
            yield from batches(rows, pa.schema([("class", pa.int64()), ("shingles", pa.list_(pa.int64()))]), 256)

    sampled = docs.where(draw < SAMPLE / max(1, n)).mapInArrow(sets, "class long, shingles array<long>").dropDuplicates(["class"])
    counts = sampled.select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["h"] for r in counts.select("h").collect()], np.int64).view(np.uint64))


PACKED = "bucket int, kind int, blob binary"
FOUND = pa.schema([("hub", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary())])
FOUND_DDL = "hub long, class long, n long, doc_id long, digest binary, bits binary"
DOCUMENTS = pa.schema([("class", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("bits", pa.binary())])


def packed_prefixes(key: np.ndarray, cls: np.ndarray, n: np.ndarray) -> bytes:
    """Rows of a bucket, sorted by key: the keys' lower 40 bits as differences, classes and sizes, compressed."""
    low = key & _U((1 << 40) - 1)
    step = np.diff(low, prepend=_U(0))
    raw = [step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, k].tobytes() for k in range(5)] + [cls.astype("<i8").tobytes(), n.astype("<u4").tobytes()]
    return len(key).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpacked_prefixes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    step = np.zeros((size, 8), np.uint8)
    step[:, :5] = np.frombuffer(raw, np.uint8, 5 * size).reshape(5, size).T
    key = np.cumsum(step.view("<u8").reshape(-1), dtype=np.uint64)
    return key, np.frombuffer(raw, "<i8", size, 5 * size), np.frombuffer(raw, "<u4", size, 13 * size).astype(np.int64)


def as_blob(rows: list[tuple]) -> bytes:
    """Documents of one batch as an Arrow stream, which passes through the shuffle as it is."""
    part = next(batches(rows, DOCUMENTS, 1 << 20))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, part.schema) as writer:
        writer.write_batch(part)
    return sink.getvalue().to_pybytes()


def groups_and_documents(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One table: per document its set's class, size, digest and bitmap (hub null), and the classes of each hub.

    Of copies that are read together only the first has a bitmap. A hub's
    classes may repeat.
    """
    spark = docs.sparkSession
    n_buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    common = spark.sparkContext.broadcast(common_shingles(docs, words))

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
        for part in parts:
            for k in range(0, part.num_rows, 4_096):
                piece = part.slice(k, 4_096)
                rows, keys, classes, sizes, seen = [], [], [], [], set()
                for doc_id, raw in zip(packed_ids(piece.column(0)).tolist(), binary_texts(piece.column(1)), strict=True):
                    s = shingle_set(raw, words)
                    c, digest = class_of(s)
                    new = len(s) > 0 and digest not in seen and doc_id != NULL_ID
                    rows.append((c, len(s), None if doc_id == NULL_ID else doc_id, digest, bitmap(s) if new else None))
                    if new:
                        seen.add(digest)
                        keys.append(prefix(s, common.value, percent))
                        classes.append(c)
                        sizes.append(len(s))
                out = [(int.from_bytes(rows[0][3][:4], "little") % n_buckets, 0, as_blob(rows))] if rows else []
                if keys:
                    key = np.concatenate(keys)
                    of = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
                    bucket = (key >> _U(40)).astype(np.int64) % n_buckets
                    order = np.lexsort((key & _U((1 << 40) - 1), bucket))
                    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
                    c, n = np.array(classes, np.int64), np.array(sizes, np.int64)
                    for a, b in zip(cut[:-1], cut[1:], strict=True):
                        pick = order[a:b]
                        out.append((int(bucket[pick[0]]), 1, packed_prefixes(key[pick], c[of[pick]], n[of[pick]])))
                yield from batches(out, schema, 1 << 20)

    def receive(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for part in parts:
            for bucket, kind, blob in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if kind == 0:
                    rows = pa.ipc.open_stream(blob).read_next_batch()
                    yield pa.RecordBatch.from_arrays([pa.nulls(rows.num_rows, pa.int64()), *rows.columns], schema=FOUND)
                    continue
                if bucket != at and held:
                    yield meeting(held, percent)
                    held = []
                at = bucket
                held.append(blob)
        if held:
            yield meeting(held, percent)
        pa.default_memory_pool().release_unused()

    packed = docs.mapInArrow(send, PACKED).repartition(n_buckets // 4, "bucket").sortWithinPartitions("bucket")
    return materialize(packed.mapInArrow(receive, FOUND_DDL), "hubs-and-documents")


def meeting(blobs: list[bytes], percent: int) -> pa.RecordBatch:
    """Hub and class of a bucket's members that share a shingle with another class of a fitting size.

    The lower 40 bits of a hash stand for it within its bucket; where two
    shingles agree in them, a group has classes too many, which leave later.
    """
    key, cls, n = (np.concatenate(x) for x in zip(*map(unpacked_prefixes, blobs), strict=True))
    order = np.lexsort((cls, n, key))
    key, cls, n = key[order], cls[order], n[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])))
    key, cls, n = key[fresh], cls[fresh], n[fresh]
    near = (key[1:] == key[:-1]) & (percent * n[1:] <= 100 * n[:-1])
    keep = np.concatenate((near, [False])) | np.concatenate(([False], near))
    key, cls = key[keep], cls[keep]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    hub = np.repeat(np.minimum.reduceat(cls, first), np.diff(np.concatenate((first, [len(key)])))) if len(key) else cls
    pairs = np.unique(np.stack((hub, cls), axis=1), axis=0)
    null = pa.nulls(len(pairs), pa.int64())
    empty = pa.nulls(len(pairs), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), null, null, empty, empty], schema=FOUND)


def grouped(parts: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first ``key`` columns, over batch ends."""
    at, held = None, []
    for part in parts:
        for row in zip(*[c.to_pylist() for c in part.columns], strict=True):
            if row[:key] != at and held:
                yield held
                held = []
            at = row[:key]
            held.append(row)
    if held:
        yield held


def with_partner(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """hub, x, y, own, rep, digest of the classes that have a partner within the bound.

    A group of more than SLICE classes is cut into slices, and a task gets two
    slices of it (x, y); ``own`` is the slice of a class.
    """
    sizes = materialize(groups.groupBy("hub").agg(F.count("*").alias("m")).where("m > 1").select("hub", F.ceil(F.col("m") / SLICE).cast("int").alias("slices")), "group-sizes")
    kept = groups.join(sizes, "hub").withColumn("own", F.pmod(F.xxhash64("class"), F.col("slices")).cast("int"))
    spread = kept.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    tiles = spread.select("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class")
    whole = tiles.join(classes.select("class", "rep", "digest", "n", "bits"), "class").select("hub", "x", "y", "own", "rep", "digest", "n", "bits")

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("hub", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("own", pa.int32()), ("rep", pa.int64()), ("digest", pa.binary())])
        for rows in grouped(parts, 3):
            rows.sort(key=lambda r: r[6])
            fits = tile_fits(np.array([r[6] for r in rows], np.int64), [r[7] for r in rows], np.array([r[3] for r in rows]), percent)
            yield from batches((rows[k][:6] for k in np.flatnonzero(fits.any(axis=1))), schema)

    dealt = whole.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")
    return materialize(dealt.mapInArrow(mark, "hub long, x int, y int, own int, rep long, digest binary"), "possible-partners")


#: Bits of the filter that texts pass before they are shuffled; its size is the same for every input.
FILTER_BITS = 1 << 23


def only_these(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Compressed texts whose id may be among ``ids``: those with the bit of their hash set in a filter of fixed size."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 32).alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("bits")).collect()  # at most FILTER_BITS / 32 rows
    filter_ = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in words:
        filter_[r["w"]] = r["bits"]
    shared = texts.sparkSession.sparkContext.broadcast(filter_)

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            s = part.column(2).to_numpy()
            hit = (shared.value[s // 32] >> (s % 32).astype(np.uint32)) & np.uint32(1)
            some = part.filter(pa.array(hit.astype(bool)))
            pack = zstandard.ZstdCompressor(level=3).compress
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(map(pack, binary_texts(some.column(1))), pa.binary())], names=["doc_id", "packed"])

    return texts.where("doc_id is not null").select("doc_id", "text", slot.alias("slot")).mapInArrow(keep, "doc_id long, packed binary")


def exact_links(texts: DataFrame, marked: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked in each group, and the digests (p, q) of the linked sets, by the sorted sets of the marked classes.

    The sets are made from the texts in the task that needs them: a text
    packs better than its hashes. An id with several texts may stand for
    several classes; the digest tells which text is meant.
    """
    some = only_these(texts, marked.select(F.col("rep").alias("doc_id")).distinct())
    whole = some.join(marked.withColumnRenamed("rep", "doc_id"), "doc_id").select("hub", "x", "y", "own", "doc_id", "digest", "packed")

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, bytes, bytes]]:
            unpack = zstandard.ZstdDecompressor().decompress
            for held in grouped(parts, 3):
                made = ((r[4], r[3], shingle_set(unpack(r[6]), words), r[5]) for r in held)
                found = sorted((r for r in made if class_of(r[2])[1] == r[3]), key=lambda r: len(r[2]))
                sets = [r[2] for r in found]
                fits = tile_fits(np.array([len(s) for s in sets], np.int64), [bitmap(s) for s in sets], np.array([r[1] for r in found]), percent)
                for i, j in spanning_links(sets, fits, percent):
                    (a, p), (b, q) = sorted((found[k][0], found[k][3]) for k in (i, j))
                    yield a, b, p, q
            pa.default_memory_pool().release_unused()

        yield from batches(rows(), pa.schema([("a", pa.int64()), ("b", pa.int64()), ("p", pa.binary()), ("q", pa.binary())]))

    dealt = whole.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y")
    return materialize(dealt.mapInArrow(verify, "a long, b long, p binary, q binary"), "links")


def linked_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with the digest of their set, the classes of equal sets with their least id, and the links between classes."""
    texts = narrow(docs, "doc_id", "text")
    table = groups_and_documents(texts, words, percent)
    documents = table.where("hub is null").select("doc_id", "n", "class", "digest", "bits")
    classes = documents.where("doc_id is not null and n > 0").groupBy("class", "digest").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.max("bits").alias("bits"))
    classes = materialize(classes, "classes")
    groups = materialize(table.where("hub is not null").select("hub", "class").distinct(), "groups")
    return documents, classes, exact_links(texts, with_partner(groups, classes, percent), words, percent)


def near_copies(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document.

    component_id is the smallest doc_id reachable by links, the document
    itself included. Null, empty or blank texts have no shingles and link to
    nothing. A null doc_id gets a null component and links nothing. Repeated
    rows are equal sets, so they link. Empty table: no rows. Other columns are
    not read.
    """
    documents, classes, links = linked_classes(docs, words, percent)
    components = connected_components(links.select("a", "b")).withColumnRenamed("v", "rep")
    named = materialize(classes.join(components, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id")), "components")
    joined = documents.join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def with_digest(docs: DataFrame, words: int) -> DataFrame:
    """The rows with the digest of their shingle set as ``_digest``."""
    place = docs.columns.index("text")

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            made = [class_of(shingle_set(raw, words))[1] for raw in binary_texts(part.column(place))]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*part.schema.names, "_digest"])

    return docs.mapInArrow(add, docs.select("*", F.lit(b"").alias("_digest")).schema)


def keep_one_of_each(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, that with the smallest id, all columns as they were.

    Rows are told apart by id and text: where texts of one id differ, each is
    a document of its own and stays or goes with what it is linked with. Rows
    of one id and one shingle set are one document. Texts without shingles
    are linked with nothing and stay, one for each id. Rows without an id
    stay. Empty table: no rows.
    """
    documents, classes, links = linked_classes(docs, words, percent)
    node = lambda rep, digest: F.struct(F.col(rep).alias("rep"), F.col(digest).alias("digest"))
    components = connected_components(links.select(node("a", "p").alias("a"), node("b", "q").alias("b")))
    beaten = components.where("v <> component").select("v.rep", "v.digest")
    first = classes.select("rep", "digest").join(beaten, ["rep", "digest"], "left_anti").select(F.col("rep").alias("doc_id"), "digest")
    wordless = documents.where("doc_id is not null and n = 0").select("doc_id", "digest").distinct()
    keep = materialize(first.unionByName(wordless), "kept")
    several = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    torn = materialize(several.where("lo <> hi").select("doc_id"), "ids-of-several-texts")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    plain = docs.join(torn, "doc_id", "left_anti").join(keep.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*columns)
    named = with_digest(docs.join(torn, "doc_id", "left_semi").select(*columns), words)
    by_text = named.join(keep.select("doc_id", F.col("digest").alias("_digest")), ["doc_id", "_digest"], "left_semi").dropDuplicates(["doc_id", "_digest"])
    return plain.union(by_text.select(*columns)).union(docs.where("doc_id is null").select(*columns))
