"""Container type and pixel size from the first bytes of an image."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
MIN_BYTES = 2048
MIN_JPEG_BYTES = 1024


def _hex(content: Column, pos: int, n: int) -> Column:
    return F.hex(F.substring(content, pos, n))


def magic_type(content: Column) -> Column:
    """``jpg``, ``png`` or ``webp`` by magic; null when too short or unknown."""
    return F.when(F.length(content) < MIN_BYTES, F.lit(None)).when(
        _hex(content, 1, 2) == "FFD8", "jpg").when(
        _hex(content, 1, 4) == "89504E47", "png").when(
        (_hex(content, 1, 4) == "52494646") & F.contains(_hex(content, 1, 16), F.lit("57454250")), "webp")


def is_jpeg(content: Column) -> Column:
    return (F.length(content) > MIN_JPEG_BYTES) & (_hex(content, 1, 2) == "FFD8")


def big_endian(content: Column, offset: int, n: int) -> Column:
    """Unsigned integer of ``n`` bytes at a zero-based offset."""
    return F.conv(_hex(content, offset + 1, n), 16, 10).cast("int")


def little_endian(content: Column, offset: int, n: int) -> Column:
    text = F.concat(*[_hex(content, offset + 1 + i, 1) for i in reversed(range(n))])
    return F.conv(text, 16, 10).cast("int")


# Markers of frame headers; the other three of C0 to CF are tables and extensions.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
#: Bytes of a JPEG that are looked at first; most have their frame header there.
HEAD = 4096


def segments(data: bytes) -> Iterator[tuple[int, int]]:
    """Marker and place of the body of each segment that has room for a frame header.

    A body begins with its own length. Fill bytes before a marker and bytes
    between segments are passed over.
    """
    at = data.find(b"\xff", 2)
    while 0 <= at < len(data) - 9:
        marker, body = data[at + 1], at + 2
        if marker == 0xFF:
            at += 1
            continue
        yield marker, body
        at = data.find(b"\xff", body + int.from_bytes(data[body : body + 2], "big"))


def frame_size(data: bytes | None) -> tuple[int | None, int | None]:
    """Width and height from the first frame header."""
    found = next((body for marker, body in segments(data or b"") if marker in FRAMES), None)
    if found is None:
        return None, None
    height, width = struct.unpack_from(">HH", data, found + 3)
    return width, height


@F.pandas_udf(SIZE)
def jpeg_size(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([frame_size(b) for b in data], columns=["width", "height"]).astype("Int32")


def jpeg_size_of(content: Column) -> Column:
    """Size of a JPEG. Only its head leaves the JVM, and the rest where no frame header is in the head."""
    head = jpeg_size(F.substring(content, 1, HEAD))
    rest = F.when(head["width"].isNull() & (F.length(content) > HEAD), content)
    return F.when(head["width"].isNotNull(), head).otherwise(jpeg_size(rest))


def image_size(content: Column, format: Column) -> Column:
    """``struct(width, height)``; only JPEG bytes leave the JVM."""
    chunk = _hex(content, 13, 4)
    # lossless: 14 bits of width, then 14 of height, each less one, in one little-endian integer
    lossless = F.conv(F.concat(*[_hex(content, 25 - i, 1) for i in range(4)]), 16, 10).cast("bigint")

    def size(w: Column, h: Column) -> Column:
        return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))

    return (
        F.when(format == "png", size(big_endian(content, 16, 4), big_endian(content, 20, 4)))
        .when(format == "gif", size(little_endian(content, 6, 2), little_endian(content, 8, 2)))
        .when(chunk == "56503858", size(little_endian(content, 24, 3) + 1, little_endian(content, 27, 3) + 1))
        .when(chunk == "56503820", size(little_endian(content, 26, 2).bitwiseAND(0x3FFF),
                                        little_endian(content, 28, 2).bitwiseAND(0x3FFF)))
        .when(chunk == "5650384C", size(lossless.bitwiseAND(0x3FFF) + 1, F.shiftright(lossless, 14).bitwiseAND(0x3FFF) + 1))
        .when(format == "jpg", jpeg_size_of(F.when(format == "jpg", content)))
    )


def container(content: Column) -> Column:
    """Format for size reading: no length floor, GIF included."""
    return (F.when(_hex(content, 1, 2) == "FFD8", "jpg").when(_hex(content, 1, 4) == "89504E47", "png")
            .when(_hex(content, 1, 3) == "474946", "gif")
            .when((_hex(content, 1, 4) == "52494646") & (_hex(content, 9, 4) == "57454250"), "webp"))


def triage(format: Column, mode: Column, width: Column, height: Column, max_side: int, min_side: int) -> Column:
    """0 bad, -1 too small, 1 pass the JPEG through, 2 must be re-encoded."""
    return (F.when(width.isNull() | height.isNull(), 0)
            .when(F.least(width, height) < min_side, -1)
            .when((format == "jpg") & mode.isin("RGB", "L") & (F.greatest(width, height) <= max_side), 1)
            .otherwise(2))
