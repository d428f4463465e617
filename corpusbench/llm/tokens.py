"""Token ids of whole texts and a file format of bit or byte planes for them.

A shard file holds the ids of a run of documents, in document order, as one
stream. The stream is cut into blocks of a fixed number of ids. Each block is
transposed: plane k has bit k (or byte k) of every id, and each plane is
compressed by itself with zstandard, so the nearly constant high planes
almost vanish. A footer holds the chunk index (place, ids, plane sizes and
checksum of each block) and the documents with their lengths.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusbench.llm.common import batches, binary_texts, filesystem, narrow, unique_name
from corpusbench.session import materialize, scratch

MAGIC = b"IDPLANE1"
BLOCK = 65_536
#: Words, and parts of words, that a worker process remembers: about 100 MB each.
MEMO = 500_000
#: Lower- and upper-case letters that are their own composed form and whose case pairs are one to one.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-ßà-öø-ÿ]+)([.,;:!?]*)")


#: Normaliser and pre-tokenizer under which a text's ids are those of its lower-cased words.
BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)


class Encoder:
    """Ids of a text by the tokenizers library, remembering words.

    The tokenizer drops white space and never joins across it, so a text's
    ids are those of its words one after another. Words are remembered up to
    a fixed number; later ones are encoded each time. A plain word is encoded
    without its punctuation, which is looked up by itself. All that holds for
    the rules in ``BY_WORDS``; a tokenizer with others gets whole texts.
    """

    made: dict[tuple[str, int], Encoder] = {}

    def __init__(self, path: str, memo: int = MEMO) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = (rules["normalizer"], rules["pre_tokenizer"]) == BY_WORDS
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.memo = memo

    @classmethod
    def of(cls, path: str, memo: int = MEMO) -> Encoder:
        """One per worker process, kept over its tasks."""
        if (path, memo) not in cls.made:
            cls.made[path, memo] = cls(path, memo)
        return cls.made[path, memo]

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def part(self, text: str) -> bytes:
        got = self.parts.get(text)
        if got is None:
            if text.isascii() and text.isalpha():
                ids = [t.id for t in self.tokenizer.model.tokenize(text)]
            else:
                ids = self.ids_of(text)
            got = np.array(ids, self.dtype).tobytes()
            if len(self.parts) < self.memo:
                self.parts[text] = got
        return got

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        plain = SIMPLE.fullmatch(text)
        if plain:
            got = self.part(plain[1].lower()) + (self.part(plain[2]) if plain[2] else b"")
        else:
            got = np.array(self.ids_of(text), self.dtype).tobytes()
        if len(self.words) < self.memo:
            self.words[raw] = got
        return got

    def text(self, raw: bytes) -> np.ndarray:
        """Ids of a text given in UTF-8."""
        if not self.by_words:
            return np.array(self.ids_of(raw.decode("utf-8", "replace")), self.dtype)
        known, word = self.words.get, self.word
        return np.frombuffer(b"".join([known(w) or word(w) for w in raw.split()]), self.dtype)


def split_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The bit or byte planes of little-endian ids."""
    rows = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), -1)
    if planes == "byte":
        return [rows[:, k].tobytes() for k in range(rows.shape[1])]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(bits.shape[1])]


def join_planes(parts: list[bytes], n: int, dtype: np.dtype, planes: str) -> np.ndarray:
    """The reverse of ``split_planes``."""
    columns = [np.frombuffer(p, np.uint8) for p in parts]
    if planes == "byte":
        rows = np.stack(columns, axis=1) if n else np.zeros((0, dtype.itemsize), np.uint8)
    else:
        bits = np.stack([np.unpackbits(c, count=n, bitorder="little") for c in columns], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(dtype).reshape(-1)


class ShardWriter:
    """Writes one shard; holds one block of ids and the document list."""

    def __init__(self, sink, dtype: np.dtype, block: int = BLOCK, planes: str = "bit", level: int = 3) -> None:
        self.sink, self.dtype, self.block, self.planes = sink, dtype, block, planes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.rest: list[np.ndarray] = []
        self.n_rest = self.at = self.n_ids = 0
        self.chunks: list[tuple] = []
        self.documents: list[tuple[int | None, int]] = []
        self.put(MAGIC)

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.documents.append((doc_id, len(ids)))
        self.rest.append(ids)
        self.n_rest += len(ids)
        self.n_ids += len(ids)
        if self.n_rest >= self.block:
            joined = np.concatenate(self.rest)
            whole = len(joined) // self.block * self.block
            for k in range(0, whole, self.block):
                self.chunk(joined[k : k + self.block])
            self.rest, self.n_rest = [joined[whole:].copy()], len(joined) - whole

    def chunk(self, ids: np.ndarray) -> None:
        parts = [self.packer.compress(p) for p in split_planes(ids, self.planes)]
        self.chunks.append((self.at, len(ids), [len(p) for p in parts], zlib.crc32(ids.tobytes())))
        self.put(b"".join(parts))

    def close(self) -> None:
        if self.n_rest:
            self.chunk(np.concatenate(self.rest))
        head = {"dtype": self.dtype.str, "block": self.block, "planes": self.planes, "chunks": self.chunks, "n_ids": self.n_ids,
                "documents": self.documents}
        footer = self.packer.compress(json.dumps(head, separators=(",", ":")).encode())
        self.put(footer + struct.pack("<Q", len(footer)) + MAGIC)


class ShardReader:
    """Reads the footer, then any chunk by the index."""

    def __init__(self, source) -> None:
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard of id planes")
        size = struct.unpack("<Q", tail[:8])[0]
        source.seek(end - 16 - size)
        head = json.loads(zstandard.ZstdDecompressor().decompress(source.read(size)))
        self.dtype, self.planes = np.dtype(head["dtype"]), head["planes"]
        self.chunks, self.documents, self.n_ids = head["chunks"], head["documents"], head["n_ids"]

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes, crc = self.chunks[k]
        self.source.seek(at)
        raw = self.source.read(sum(sizes))
        ends = np.cumsum([0, *sizes])
        unpack = zstandard.ZstdDecompressor().decompress
        ids = join_planes([unpack(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], n, self.dtype, self.planes)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def read(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in order, one chunk in memory besides the document at hand."""
        have, k = np.zeros(0, self.dtype), 0
        for doc_id, n in self.documents:
            parts = []
            while n > len(have):
                parts.append(have)
                n -= len(have)
                have, k = self.chunk(k), k + 1
            parts.append(have[:n])
            have = have[n:]
            yield doc_id, np.concatenate(parts) if len(parts) > 1 else parts[0]


MANIFEST = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text, dealt by ranges of doc_id and sorted inside each part; equal ids by text."""
    return narrow(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int, block: int = BLOCK, planes: str = "bit") -> DataFrame:
    """Encode whole texts and write one shard per part of the id range.

    Null text: the end id alone. Null doc_id: sorted first. Repeated ids:
    one entry per row, in order of their texts. Empty table: no shard.
    Other columns are not read. Returns the manifest (one row per shard),
    which Spark has written; files of lost attempts are not in it.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, fs_path, writer, first = Encoder.of(tokenizer), filesystem(folder), None, None
        end = np.array([end_id], encoder.dtype)
        fs, base = fs_path
        for part in parts:
            for doc_id, raw in zip(part.column(0).to_pylist(), binary_texts(part.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    path, first = f"{base}/{unique_name('ids', '.plane')}", doc_id
                    sink = fs.open_output_stream(path)
                    writer = ShardWriter(sink, encoder.dtype, block, planes)
                writer.add(doc_id, np.concatenate((encoder.text(raw), end)))
        if writer is not None:
            writer.close()
            sink.close()
            yield from batches([(path.rsplit("/", 1)[1], first, len(writer.documents), writer.n_ids, writer.at)], MANIFEST)

    rows = in_order(docs).mapInArrow(write, "path string, first_id long, n_docs long, n_ids long, n_bytes long")
    return materialize(rows, "token-manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The running sum goes over one row per shard, the number of ids before it.
    """
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).select("path", "before")
    spread = placed.repartition(max(1, manifest.count()), "path")  # a task per shard: a manifest row is small, its file is not

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)

        def rows():
            for part in parts:
                for path, start in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    with fs.open_input_file(f"{base}/{path}") as source:
                        for doc_id, ids in ShardReader(source).read():
                            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                            start += len(ids)

        yield from batches(rows(), READ)

    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int, block: int = BLOCK, planes: str = "bit") -> DataFrame:
    """Write token files to the shared folder, then read them back."""
    folder = scratch(spark, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id=end_id, block=block, planes=planes), folder)
