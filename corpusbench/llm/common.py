"""Helpers shared by the training-data operators: columns, files, state of a worker."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the contracts call white space: blank and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: Stands for a null id inside packed arrays.
NULL_ID = -(2**63)


def held_out(doc_id: Column) -> Column:
    """True for documents that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def binary_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column of one batch; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def packed_ids(column: pa.Array):
    """An id column as int64 numpy array, null as ``NULL_ID``."""
    return column.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def unpacked_ids(ids) -> pa.Array:
    """The reverse of ``packed_ids``."""
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder's URI, as seen from a task."""
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def unique_name(prefix: str, suffix: str) -> str:
    """A file name that no other attempt of the same task uses.

    The manifest, which Spark commits, names the files of the successful
    attempts only; those of lost ones are never read.
    """
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) == size:
            yield batch(part, schema)
            part = []
    if part:
        yield batch(part, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that others never clash with its own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
