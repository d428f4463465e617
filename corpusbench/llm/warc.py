"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader takes gzip archives (members) and plain ones. After a failed check
(broken member, no version line, wrong length, wrong digest) it looks for the
next place where a valid member or version line begins, goes on from there
and reports the bytes in between as a quarantined gap. A broken member still
gives the valid records among the bytes that it decodes to.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.llm.common import batches, binary_texts, filesystem, narrow, unique_name
from corpusbench.session import materialize, scratch

GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: A new file begins when one has reached this size.
ROLL = 64 << 20
STEP = 1 << 16
EARLY = "member ends early"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, uri: str, date: str, payload: bytes | None, n_bytes: int, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes + (payload or b"")
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri),
            "WARC-Date": date, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{payload_digest}",
            "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if refers_to:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers_to}>"}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Damaged(Exception):
    """What a reader found wrong at its place."""


class Window:
    """Part of a seekable source in memory, from ``at`` on."""

    def __init__(self, source) -> None:
        self.source, self.data, self.at = source, b"", 0
        self.size = source.seek(0, io.SEEK_END)
        source.seek(0)

    def fill(self, n: int) -> bytes:
        """The bytes from ``at`` on: n of them, or all up to the end."""
        while len(self.data) < n and (more := self.source.read(max(STEP, n - len(self.data)))):
            self.data += more
        return self.data

    def peek(self, begin: int, n: int) -> bytes:
        """The n bytes at ``begin`` bytes from here, fewer at the end; what lies between is not read."""
        if begin + n <= len(self.data):
            return self.data[begin : begin + n]
        if self.at + begin >= self.size:
            return b""
        self.source.seek(self.at + begin)
        got = self.source.read(n)
        self.source.seek(self.at + len(self.data))
        return got

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n

    def find(self, pattern: re.Pattern, begin: int) -> bool:
        """Go on to the next match at or after ``begin`` bytes from here; False: none, now at the end."""
        self.fill(begin)
        self.skip(min(begin, len(self.data)))
        while True:
            if m := pattern.search(self.data):
                self.skip(m.start())
                return True
            had = len(self.data)
            if len(self.fill(had + 1)) == had:
                self.skip(had)
                return False
            if had > 16:
                self.skip(had - 16)


MEMBER = re.compile(re.escape(GZIP))


def one_record(window: Window) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and size of the record at the window's place."""
    have = window.fill(10)
    if not VERSION.match(have):
        raise Damaged("no version line")
    cut, seen = -1, 0
    while cut < 0:  # the writer takes URIs of any length, so headers have no limit
        cut = have.find(b"\r\n\r\n", max(0, seen - 3))
        if cut < 0:
            seen = len(have)
            if len(have := window.fill(2 * seen)) == seen:
                raise Damaged("no end of headers")
    head = {}
    for line in have[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise Damaged("broken header line")
        head[key.strip().lower()] = value.strip()
    size = head.get("content-length", "")
    if not size.isdecimal():
        raise Damaged("no content length")
    end = cut + 4 + int(size)
    # a damaged length must not make the reader hold what follows, so the end is looked at first
    if window.peek(end, 4) != b"\r\n\r\n":
        raise Damaged("wrong content length")
    have = window.fill(end + 4)
    block = have[cut + 4 : end]
    told = head.get("warc-block-digest", "").removeprefix("sha1:")
    if told and told != digest(block):
        raise Damaged("wrong block digest")
    return head, block, end + 4


def one_member(window: Window) -> tuple[bytes, int, str]:
    """Content and size of the gzip member at the window's place, and what broke it; then the content is what decodes before that."""
    unpack, out, used = zlib.decompressobj(31), [], 0
    while not unpack.eof:
        have = window.fill(used + 1)
        if len(have) == used:
            return b"".join(out), used, EARLY
        chunk = have[used : used + STEP]
        try:
            out.append(unpack.decompress(chunk))
        except zlib.error as e:
            return b"".join(x for _, x in slowly(have, used)), used, f"broken member: {e}"
        used += len(chunk)
    return b"".join(out), used - len(unpack.unused_data), ""


def slowly(data: bytes, begin: int) -> Iterator[tuple[int, bytes]]:
    """What a member decodes to, up to its end or first error: bytes used so far and the next of the content, byte by byte after ``begin``."""
    unpack, used = zlib.decompressobj(31), 0
    while used < len(data) and not unpack.eof:
        chunk = data[used : used + (min(STEP, begin - used) if used < begin else 1)]
        try:
            out = unpack.decompress(chunk)
        except zlib.error:
            return
        used += len(chunk)
        yield used, out


def bytes_for(data: bytes, n: int) -> int:
    """How many bytes of a member its first n bytes of content take."""
    got, begin = 0, 0
    for used, out in slowly(data, len(data)):
        if got + len(out) >= n:
            break
        got, begin = got + len(out), used
    got = 0
    for used, out in slowly(data[: begin + STEP], begin):
        got += len(out)
        if got >= n:
            return used
    return len(data)


def salvage(source) -> Iterator[tuple]:
    """("record", offset, size, headers, block) and ("gap", offset, size, reason) over one archive.

    Offsets and sizes are those in the file, for both kinds. A member with
    several records is taken apart; one whose content is broken gives its
    valid records and a gap for itself. A member that does not decode to its
    end or fails its check gives the valid records before that, with the
    bytes that they take as their place, and a gap for the rest; unless it
    only ends early, records without a digest count as lost there. An empty
    file gives nothing.
    """
    window = Window(source)
    begins = re.compile(MEMBER.pattern + b"|" + VERSION.pattern)
    gap: tuple[int, str] | None = None
    while window.fill(1):
        at, broken = window.at, ""
        try:
            if window.fill(3)[:3] == GZIP:
                data, size, broken = one_member(window)
                inner = list(plain(io.BytesIO(data)))
                valid = [x for x in inner if x[0] == "record" and (broken in ("", EARLY) or x[3].get("warc-block-digest"))]
                bad = next((x[3] for x in inner if x[0] == "gap"), broken)
                if not valid and (bad or inner):
                    raise Damaged(broken or bad)
                if broken:
                    end = valid[-1][1] + valid[-1][2]
                    size, bad = bytes_for(window.data, end), bad if sum(x[2] for x in valid) < end else ""
                found = [("record", at, size, *x[3:]) for x in valid]
                found += [("gap", at, size, bad)] if bad else []
            else:
                head, block, size = one_record(window)
                found = [("record", at, size, head, block)]
        except Damaged as e:
            gap = gap or (at, str(e))
            if not window.find(begins, 1):
                break
            continue
        if gap:
            yield "gap", gap[0], at - gap[0], gap[1]
            gap = None
        yield from found
        if broken:
            gap = (at + size, broken)
            if not window.find(begins, size):
                break
            continue
        window.skip(size)
    if gap:
        yield "gap", gap[0], window.at - gap[0], gap[1]


def plain(source) -> Iterator[tuple]:
    """The same for the content of a member, which holds records only."""
    window = Window(source)
    gap: tuple[int, str] | None = None
    while window.fill(1):
        at = window.at
        try:
            head, block, size = one_record(window)
        except Damaged as e:
            gap = gap or (at, str(e))
            if not window.find(VERSION, 1):
                break
            continue
        if gap:
            yield "gap", gap[0], at - gap[0], gap[1]
            gap = None
        yield "record", at, size, head, block
        window.skip(size)
    if gap:
        yield "gap", gap[0], window.at - gap[0], gap[1]


MANIFEST = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
RECORDS = pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("gap", pa.string()), ("record_type", pa.string()),
                     ("record_id", pa.string()), ("uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string())])
RECORDS_DDL = ("path string, at long, size long, gap string, record_type string, record_id string, uri string, refers_to string, "
               "payload_bytes long, payload_digest string")


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the largest page_id with the same payload where that is another page.

    Null html is an empty payload. A null page_id is a response that nothing
    refers to. Rows that repeat the largest page_id are all responses. The
    groups with copies are written first, so that both sides of the join are
    plain exchanges, whose hot keys adaptive execution splits.
    """
    rows = narrow(pages, "page_id", "url", "html").withColumn("key", F.sha1(F.coalesce("html", F.lit("")).cast("binary")))
    groups = rows.where("page_id is not null").groupBy("key").agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
    copied = materialize(groups.where("last > first").select("key", "last"), "payload-groups")
    joined = rows.join(copied, "key", "left")
    return joined.select("page_id", "url", "html", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, *, date: str = "2000-01-01T00:00:00Z", roll: int = ROLL, level: int = 6) -> DataFrame:
    """One record per page, gzip member by member; returns the manifest of the files, which Spark has written."""

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        sink, path, n, size = None, "", 0, 0
        for part in parts:
            columns = [part.column(0).to_pylist(), part.column(1).to_pylist(), binary_texts(part.column(2)), part.column(3).to_pylist()]
            for page_id, url, payload, refers_to in zip(*columns, strict=True):
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    path, n, size = unique_name("pages", ".warc.gz"), 0, 0
                    sink = fs.open_output_stream(f"{base}/{path}", compression=None)
                name = f"urn:page:{page_id}"
                kind, original = ("response", None) if refers_to is None else ("revisit", f"urn:page:{refers_to}")
                data = member(record(kind, name, url or name, date, None if original else payload, len(payload), digest(payload), original), level)
                sink.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    sink.close()
                    yield from batches([(path, n, size)], MANIFEST)
                    sink = None
        if sink is not None:
            sink.close()
            yield from batches([(path, n, size)], MANIFEST)

    rows = with_originals(pages).mapInArrow(write, "path string, n_records long, n_bytes long")
    return materialize(rows, "warc-manifest")


def fields(head: dict[str, str], block: bytes) -> tuple:
    """Type, id, URI, original, payload size and digest of a record, by what is stored."""
    payload = block.partition(b"\r\n\r\n")[2]
    told = re.search(rb"(?i)\r\ncontent-length: *(\d+)", block.partition(b"\r\n\r\n")[0])
    kind = head.get("warc-type")
    if kind == "revisit":
        n, sha = int(told[1]) if told else None, head.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        n, sha = len(payload), digest(payload)
    strip = lambda x: x and x.strip("<>")
    return kind, strip(head.get("warc-record-id")), head.get("warc-target-uri"), strip(head.get("warc-refers-to")), n, sha


def read_warc(files: DataFrame, folder: str, *, counted: bool = False) -> DataFrame:
    """Records and gaps of the files named in column ``path``.

    One row per record, with gap null; one per quarantined gap, with gap the
    reason and at, size the bytes left out. A file is read in pieces, a record
    or member at a time. With
    ``counted`` a file that has other than ``n_records`` records raises.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)

        def rows():
            for part in parts:
                for path, told in zip(part.column(0).to_pylist(), part.column(1).to_pylist() if counted else [None] * len(part), strict=True):
                    n = 0
                    with fs.open_input_file(f"{base}/{path}") as source:
                        for found in salvage(source):
                            if found[0] == "gap":
                                yield path, found[1], found[2], found[3], *[None] * 6
                            else:
                                n += 1
                                yield path, found[1], found[2], None, *fields(found[3], found[4])
                    if counted and n != told:
                        raise ValueError(f"{path}: {n} records read, the manifest has {told}")

        yield from batches(rows(), RECORDS, 1024)

    # a task per file: a row of the list is small, its file is not
    return narrow(files, "path", *["n_records"] * counted).repartition(max(1, files.count()), "path").mapInArrow(read, RECORDS_DDL)


def page_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back: one row per page, or an error."""
    folder = scratch(spark, "warc")
    records = read_warc(write_warc(pages, folder), folder, counted=True).where("gap is null")
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) as bigint)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
