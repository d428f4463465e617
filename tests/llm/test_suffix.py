"""Repeated byte strings against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from corpusbench.llm import suffix


def brute(docs, length=100):
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            key = data[s : s + length]
            if key in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(key)
        spans = sum(1 for k, x in enumerate(gone) if x and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed, n=60):
    rng = np.random.default_rng(seed)
    words = ["alpha", "be", "gamma,", "dé", "ëpsilon", "zeta.", "x", "omega\n"]
    draw = lambda k: " ".join(rng.choice(words, k))
    shared, out = [draw(60) for _ in range(4)], []
    for _ in range(n):
        kind = rng.integers(0, 8)
        if kind == 0:
            out.append(draw(rng.integers(0, 40)))
        elif kind == 1:
            out.append("ab" * int(rng.integers(30, 400)))
        elif kind == 2:
            out.append("a" * int(rng.integers(95, 300)))
        elif kind == 3 and out:
            out.append(out[rng.integers(0, len(out))])
        elif kind == 4 and out:
            old = list(out[rng.integers(0, len(out))])
            for _ in range(3):
                if old:
                    old[rng.integers(0, len(old))] = "#"
            out.append("".join(old))
        else:
            s = shared[rng.integers(0, 4)]
            a = rng.integers(0, len(s) // 2)
            out.append(draw(rng.integers(0, 30)) + s[a : a + rng.integers(90, 260)] + draw(rng.integers(0, 30)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_table_against_brute_force(spark, seed):
    rows = [(2 * k, t, "n", 1) for k, t in enumerate(texts(seed))] + [(1000, None, None, None), (1001, "", "x", 0), (1002, "0" * 99, "x", 0), (1003, "0" * 100, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, kind int").repartition(5)
    got = sorted(tuple(r) for r in suffix.repeat_report(docs).collect())
    assert got == brute(sorted((r[0], r[1]) for r in rows))


def test_pieces_that_a_task_remembers():
    """Over chunks in any order: of equal pieces, the first in (doc, chunk, row, place) is sent, and what is held back has an earlier equal."""
    rng = np.random.default_rng(11)
    for bits in (1, 4, 12):
        seen, first, sent, n_sent, n = suffix.Seen(bits), {}, set(), 0, 0
        for chunk in rng.permutation(60).tolist():
            rows = np.zeros(50, suffix.PIECE)
            rows["f"], rows["row"] = rng.integers(0, 3, 50), np.arange(50)
            rows["g"] = rng.integers(0, 12, 50).astype(np.uint64) << np.uint64(60)
            rows["doc"] = rng.integers(-3, 40, 50)
            gone = suffix.later_equals(rows)
            gone[~gone] = seen.repeats(rows[~gone], chunk)
            places = [((int(r["f"]), int(r["g"])), (int(r["doc"]), chunk, int(r["row"]))) for r in rows]
            for key, place in places:
                first[key] = min(first.get(key, place), place)
            assert all(first[key] < place for (key, place), held in zip(places, gone, strict=True) if held)
            sent |= {p for p, held in zip(places, gone, strict=True) if not held}
            n, n_sent = n + 50, n_sent + int((~gone).sum())
        assert {(k, v) for k, v in first.items()} <= sent and n_sent < n * (0.9 if bits == 1 else 0.5)


def test_passage_of_most_documents_is_sent_once_a_task():
    rng = np.random.default_rng(12)
    passage = bytes(rng.integers(97, 123, 2000, dtype=np.uint8))
    seen, sent = suffix.Seen(), []
    for chunk in range(8):
        texts = [(bytes(rng.integers(97, 123, 300, dtype=np.uint8)) + passage).decode() for _ in range(40)]
        rows = pa.RecordBatch.from_arrays([pa.array(range(chunk * 40, chunk * 40 + 40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as writer:
            writer.write_batch(rows)
        blobs, gone = suffix.send_pieces(zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes()), chunk, 4, 100, seen)
        sent.append(np.concatenate([suffix.unpacked(b, suffix.PIECE) for _, _, b in blobs]))
        assert (gone["chunk"] == chunk).all() and len(gone) >= 39
    inside = [r["g"] for rows in sent for r in rows[rows["lo"] > 300 + 80]]
    assert len(inside) == len(set(inside)) > 0


def test_shares_of_the_two_ways(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts(4))] + [(99, None)], "doc_id long, text string").repartition(3)
    total = suffix.repeat_report(docs).groupBy().sum("n_bytes", "n_removed").first()
    shares = suffix.removed_shares(docs).first()
    assert (shares["n_bytes"], shares["n_removed"]) == tuple(total) and 0 < shares["n_merged"] < shares["n_removed"]
    assert max(shares["n_equal"], shares["n_merged"]) <= shares["n_removed"] <= shares["n_equal"] + shares["n_merged"]


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = "".join(chr(97 + x) for x in np.random.default_rng(9).integers(0, 26, 400))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (0, text[50:300])], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"]) for r in suffix.repeat_report(docs).collect()}
    assert sum(r["n_removed"] == 0 for r in suffix.repeat_report(docs).collect()) == 1 and (None, 0) in got
    assert suffix.repeat_report(docs.limit(0)).count() == 0


def test_columns_and_characters_survive(spark):
    long = "é".join(str(k * k) for k in range(60))
    rows = [(1, long, "en", 5, "a"), (2, "x" + long, "de", 6, "b"), (3, None, None, None, None)]
    out = {r["doc_id"]: r for r in suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, blob string")).collect()}
    assert out[1]["text"] == long and out[2]["text"] == "x" and out[2]["n_chars"] == 1 and out[2]["blob"] == "b" and out[3]["text"] is None


def test_merge_equals_sorting():
    rng = np.random.default_rng(5)
    for shard in (8, 64, 10_000):
        strings = [bytes(rng.integers(97, 99, rng.integers(12, 60), dtype=np.uint8)) for _ in range(30)]
        t = suffix.Transforms(strings, shard)
        place, block = suffix.merged(t, 12)
        joined = b"\0".join(strings) + b"\0"
        found = {}
        for p, b in zip(place.tolist(), block.tolist(), strict=True):
            found.setdefault(b, set()).add(p)
        want = {}
        for k, s in enumerate(strings):
            base = int(t.ends[k]) - len(s)
            for i in range(len(s) - 11):
                want.setdefault(s[i : i + 12], set()).add(base + i)
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
        assert all(len({joined[p : p + 12] for p in v}) == 1 for v in found.values())


def test_suffix_order():
    rng = np.random.default_rng(6)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 100, rng.integers(0, 40), dtype=np.uint8)) for _ in range(7)]
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        key = lambda p: [int(np.searchsorted(ends, q)) - 100 if q in ends else int(text[q]) for q in range(p, int(ends[np.searchsorted(ends, p)]) + 1)]  # noqa: E731, B023
        assert suffix.suffix_order(text, ends).tolist() == sorted(range(len(text)), key=key)
