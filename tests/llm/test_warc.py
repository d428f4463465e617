"""WARC archives: round trip, salvage of damaged files, odd rows."""

import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from corpusbench.llm import warc


def archive(n=6, plain=False):
    records = [warc.record("response", f"urn:page:{k}", f"http://x/{k}", "2000-01-01T00:00:00Z", b"body %d " % k * 50, 0, warc.digest(b"body %d " % k * 50), None)
               for k in range(n)]
    return [r if plain else warc.member(r) for r in records]


def ids(found):
    return [x[3]["warc-record-id"] for x in found if x[0] == "record"]


def gaps(found):
    return [(x[1], x[2]) for x in found if x[0] == "gap"]


def test_intact_archives():
    for plain in (False, True):
        data = b"".join(archive(plain=plain))
        found = list(warc.salvage(io.BytesIO(data)))
        assert ids(found) == [f"<urn:page:{k}>" for k in range(6)] and not gaps(found)
    assert list(warc.salvage(io.BytesIO(b""))) == []


def test_later_records_are_recovered():
    for plain in (False, True):
        parts = archive(plain=plain)
        for broken in range(6):
            for how in ("flip", "cut", "junk"):
                bad = parts[broken]
                bad = {"flip": bad[:60] + bytes([bad[60] ^ 255]) + bad[61:], "cut": bad[: len(bad) // 2], "junk": b"\x1f\x8b\x08 not a member " * 20}[how]
                data = b"".join([*parts[:broken], bad, *parts[broken + 1 :]])
                found = list(warc.salvage(io.BytesIO(data)))
                want = [f"<urn:page:{k}>" for k in range(6) if k != broken]
                if how == "flip":  # a flipped header byte may leave a valid record
                    assert [x for x in ids(found) if x in want] == want
                else:
                    assert ids(found) == want
                    start = sum(map(len, parts[:broken]))
                    assert gaps(found) == [(start, len(bad))]


def test_gaps_and_records_cover_the_file():
    rng = random.Random(4)
    for _ in range(30):
        data = bytearray(b"".join(archive()))
        for _ in range(3):
            data[rng.randrange(len(data))] ^= rng.randrange(1, 256)
        found = sorted((x[1], x[2]) for x in warc.salvage(io.BytesIO(bytes(data))))
        at = 0
        for begin, size in found:
            assert begin == at
            at += size
        assert at == len(data)


def test_member_with_several_records():
    data = warc.member(b"".join(archive(3, plain=True))) + archive(1)[0]
    assert len(ids(warc.salvage(io.BytesIO(data)))) == 4


def noisy(n):
    rng = random.Random(7)
    bodies = [rng.randbytes(rng.randrange(20, 4000)) for _ in range(n)]
    return [warc.record("response", f"urn:page:{k}", f"http://x/{k}", "2000-01-01T00:00:00Z", b, len(b), warc.digest(b), None) for k, b in enumerate(bodies)]


def test_broken_member_gives_its_valid_records():
    records, tail = noisy(100), warc.member(noisy(1)[0])
    name = lambda ks: [f"<urn:page:{k}>" for k in ks]
    whole = warc.member(b"".join(records))
    for share in (0.2, 0.9):  # with and without something after the cut
        cut = whole[: int(share * len(whole))]
        content = zlib.decompressobj(31).decompress(cut)
        n = max(k for k in range(100) if len(b"".join(records[:k])) <= len(content))
        assert n > 15
        for after in (b"", tail):
            found = list(warc.salvage(io.BytesIO(cut + after)))
            assert ids(found) == name(range(n)) + name([0] if after else [])
            (begin, size), kept = gaps(found)[-1], found[0][2]
            assert len(gaps(found)) == 1 and found[0][1] == 0 and begin == kept and begin + size == len(cut)
            assert zlib.decompressobj(31).decompress(cut[:kept]).startswith(b"".join(records[:n]))
    bad = whole[:-8] + bytes(8)
    found = list(warc.salvage(io.BytesIO(bad + tail)))
    assert ids(found) == name([*range(100), 0]) and len(gaps(found)) == 1 and sum(gaps(found)[0]) == len(bad)
    at = len(whole) // 2
    found = list(warc.salvage(io.BytesIO(whole[:at] + bytes(64) + whole[at + 64 :] + tail)))
    assert ids(found)[:40] == name(range(40)) and ids(found)[-1] == name([0])[0] and gaps(found)


def test_bad_first_line_in_a_member_with_a_bad_check():
    records = noisy(5)
    whole = warc.member(b"XARC" + b"".join(records)[4:])
    found = list(warc.salvage(io.BytesIO(whole[:-8] + bytes(8))))
    assert ids(found) == [f"<urn:page:{k}>" for k in range(1, 5)] and len(gaps(found)) == 2


def test_records_without_digest_in_a_broken_member():
    plain = b"".join(b"WARC/1.1\r\nWARC-Record-ID: <%d>\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n" % k for k in range(20))
    whole = warc.member(plain)
    assert len(ids(warc.salvage(io.BytesIO(whole[:-8])))) == 20
    assert ids(warc.salvage(io.BytesIO(whole[:-8] + bytes(8)))) == []


class Counted(io.BytesIO):
    """A file that counts the bytes read."""

    n = 0

    def read(self, size=-1):
        got = super().read(size)
        self.n += len(got)
        return got


def test_damaged_length_does_not_read_ahead():
    """A length beyond the file, or one that ends far off within it: found damaged from the record's own bytes, later records recovered."""
    parts = [warc.record("response", f"urn:page:{k}", f"http://x/{k}", "2000-01-01T00:00:00Z", b"x" * 5_000, 5_000, "", None) for k in range(200)]
    for told in (b"999999999999", b"700000"):
        begin = parts[0].rindex(b"Content-Length: ")
        bad = parts[0][:begin] + b"Content-Length: " + told + parts[0][parts[0].index(b"\r\n", begin):]
        source = Counted(b"".join([bad, *parts[1:]]))
        found = warc.salvage(source)
        first = next(found)
        assert first[0] == "gap" and first[1:3] == (0, len(bad)) and source.n < 4 * warc.STEP
        assert ids(found) == [f"<urn:page:{k}>" for k in range(1, 200)]


def test_long_headers(spark):
    url = "http://x/" + "ä" * 200_000
    pages = spark.createDataFrame([(1, url, "a"), (2, "b", "c")], "page_id long, url string, html string")
    assert {r["page_id"] for r in warc.page_round_trip(spark, pages).collect()} == {1, 2}


def test_missing_records_raise(spark):
    folder = warc.scratch(spark, "warc")
    manifest = warc.write_warc(spark.createDataFrame([(1, "a", "a")], "page_id long, url string, html string"), folder)
    assert warc.read_warc(manifest, folder, counted=True).count() == 1
    with pytest.raises(Exception, match="1 records read, the manifest has 2"):
        warc.read_warc(manifest.withColumn("n_records", F.lit(2).cast("long")), folder, counted=True).collect()


def test_pages(spark):
    rows = [(1, "http://a\r\nb", "same", 1), (5, None, "same", 2), (3, "c", "same", 3), (2, "d", None, 4), (4, "e", "", 5), (9, "f", "é" * 70_000, 6), (None, "g", "same", 7),
            (5, None, "same", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, last long")
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.page_round_trip(spark, pages).collect()}
    d = lambda x: (len(x.encode()), warc.digest(x.encode()))
    assert got == {(1, "revisit", 5, *d("same")), (3, "revisit", 5, *d("same")), (5, "response", None, *d("same")), (2, "revisit", 4, *d("")), (4, "response", None, *d("")),
                   (9, "response", None, *d("é" * 70_000)), (None, "response", None, *d("same"))}
    assert warc.page_round_trip(spark, pages).count() == len(rows)
    assert warc.page_round_trip(spark, pages.limit(0)).count() == 0
