"""Fill-in-the-middle: whole texts cut at two drawn units and put into another order.

A text is a run of units: code points, words or lines. Its UTF-8 bytes are
looked at in blocks of fixed size. A Fenwick tree over the blocks stores how
many units and how many code points begin in each. A cut after k units is
found by binary lifting: the descent ends at the block where unit k begins,
and only that block is searched for the byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import binary_texts, narrow

BLOCK = 1024
#: Blocks looked at together while the tree is built.
STRIDE = 1024
#: Bytes of output held before a record batch is sent.
BATCH = 16 << 20
MARKS = ("<P>", "<S>", "<M>")
OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def point_starts(raw: np.ndarray, a: int, b: int) -> np.ndarray:
    """True where a code point begins."""
    return (raw[a:b] & 0xC0) != 0x80


def word_starts(raw: np.ndarray, a: int, b: int) -> np.ndarray:
    """True where a word begins, and at the first byte of a text; a word takes the white space behind it along."""
    part = raw[max(a - 1, 0) : b]
    word = (part != 0x20) & ((part < 0x09) | (part > 0x0D))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    if a == 0:
        begins[:1] = True
        return begins
    return begins[1:]


def line_starts(raw: np.ndarray, a: int, b: int) -> np.ndarray:
    """True behind a line feed, and at the first byte of a text."""
    begins = np.zeros(b - a, bool)
    if a == 0:
        begins[:1] = True
        begins[1:] = raw[: b - 1] == 0x0A
    else:
        begins[:] = raw[a - 1 : b - 1] == 0x0A
    return begins


UNITS = {"char": point_starts, "word": word_starts, "line": line_starts}


class UnitTree:
    """Fenwick tree over the blocks of one text."""

    def __init__(self, text: bytes, unit: str = "char", block: int = BLOCK) -> None:
        self.raw, self.starts, self.block = np.frombuffer(text, np.uint8), UNITS[unit], block
        self.size = -(-len(text) // block)
        self.tree = np.zeros((self.size + 1, 2), np.int64)
        for first in range(0, self.size, STRIDE):
            a, b = first * block, min((first + STRIDE) * block, len(text))
            edges = np.arange(0, b - a, block)
            places = slice(first + 1, first + 1 + len(edges))
            points = np.add.reduceat(point_starts(self.raw, a, b), edges, dtype=np.int64)
            self.tree[places, 1] = points
            self.tree[places, 0] = points if unit == "char" else np.add.reduceat(self.starts(self.raw, a, b), edges, dtype=np.int64)
        total = self.tree.sum(axis=0)
        self.units, self.points = int(total[0]), int(total[1])
        for i in range(1, self.size + 1):
            parent = i + (i & -i)
            if parent <= self.size:
                self.tree[parent] += self.tree[i]

    def descend(self, k: int) -> tuple[int, int, int]:
        """The most whole blocks in which at most k units begin, and the units and code points that do."""
        at = units = points = 0
        step = 1 << self.size.bit_length()
        while step:
            if at + step <= self.size and units + self.tree[at + step, 0] <= k:
                at += step
                units += int(self.tree[at, 0])
                points += int(self.tree[at, 1])
            step >>= 1
        return at, units, points

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the end of unit k, which is where the next unit begins."""
        at, units, points = self.descend(k)
        if at == self.size:
            return len(self.raw), points
        a, b = at * self.block, min((at + 1) * self.block, len(self.raw))
        inside = int(np.flatnonzero(self.starts(self.raw, a, b))[k - units])
        return a + inside, points + int(point_starts(self.raw, a, a + inside).sum())


def draws(doc_id: int | None, seed: int) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearrange(doc_id: int | None, text: bytes, *, seed: int, rate: int, spm: int, unit: str, marks: tuple[bytes, bytes, bytes], block: int = BLOCK) -> tuple:
    """Units, form, code points of prefix and middle, and the new text."""
    tree = UnitTree(text, unit, block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return tree.units, "plain", None, None, text
    a, b = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
    (first, before), (last, upto) = tree.cut(a), tree.cut(b)
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    p, s, m = marks
    if h4 % 100 < spm:
        return tree.units, "spm", before, upto - before, b"".join((s, suffix, p, prefix, m, middle))
    return tree.units, "psm", before, upto - before, b"".join((p, prefix, s, suffix, m, middle))


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be found again wherever text stands around them: none may hold or run into another or itself."""
    for x in marks:
        for y in marks:
            overlap = any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)) + (x != y)))
            if not x or overlap or (x != y and x in y) or len(set(marks)) < 3:
                raise ValueError(f"marks {marks} could be taken for each other")


def fill_in_middle(docs: DataFrame, *, seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char", marks: tuple[str, str, str] = MARKS, block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every document.

    Of 100 texts about ``rate`` are rearranged, of these ``spm`` in the form
    suffix, prefix, middle and the others as prefix, suffix, middle; the
    draws come from seed and doc_id, so repeated rows give equal results.
    Null text: empty, so plain. A text that holds a mark stays plain. A null
    doc_id draws by the empty id. Empty table: no rows. Other columns are not
    read. A task holds one text and about ``BATCH`` bytes of output.
    """
    check_marks(marks)
    raw_marks = tuple(m.encode() for m in marks)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def send() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(OUT) if f.name != "output"]
            texts = pa.array([r[5] for r in rows], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, texts.view(pa.string())], schema=OUT)

        for part in parts:
            for k in range(0, part.num_rows, 256):
                piece = part.slice(k, 256)
                for doc_id, text in zip(piece.column(0).to_pylist(), binary_texts(piece.column(1)), strict=True):
                    row = rearrange(doc_id, text, seed=seed, rate=rate, spm=spm, unit=unit, marks=raw_marks, block=block)
                    rows.append((doc_id, *row))
                    size += len(row[-1])
                    if size >= BATCH or len(rows) >= 4096:
                        yield send()
                        rows, size = [], 0
        if rows:
            yield send()

    return narrow(docs, "doc_id", "text").mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text before ``fill_in_middle``, from its output and form."""
    parts = F.split(output, "|".join(re.escape(m) for m in marks))
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def middle_digests(docs: DataFrame, **options) -> DataFrame:
    """The rearrangement with digests of output and restored text in place of the texts."""
    made = fill_in_middle(docs, **options)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    marks = options.get("marks", MARKS)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))
