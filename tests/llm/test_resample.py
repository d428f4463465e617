"""Importance resampling against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

from corpusbench.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, longest=2, buckets=10_000):
    w = WORD.findall((text or "").encode().lower().decode())
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, seed=7, percent=25, least=20, buckets=10_000):
    made = [(i, *buckets_of(t, buckets=buckets)) for i, t in docs]
    s = collections.Counter(b for _, _, f in made for b in f)
    t = collections.Counter(b for x in target for b in buckets_of(x, buckets=buckets)[1])
    ss, tt = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéß中0", k=rng.randint(1, 6))) for _ in range(300)]
    gaps = [" ", "  ", "-", ".\n", ", ", "\x00", "\t", "_", "\x7f", "{"]
    make = lambda n: "".join(rng.choice(vocabulary).upper() + rng.choice(gaps) if rng.random() < 0.2 else rng.choice(vocabulary) + rng.choice(gaps) for _ in range(n))
    rows = [(k, make(rng.choice([3, 19, 20, 21, 60, 200]))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " ...\n"), (1003, "ÀÉ İ ẞ"), (1004, make(40_000)), (None, make(30)), (None, make(25)), (5, make(50)), rows[7], rows[7]]
    rows += [(2000 + k, rows[20][1]) for k in range(40)]
    return rows, [make(40) for _ in range(8)] + [None, "", rows[3][1]]


def test_against_plain_python(spark):
    rows, target = corpus()
    docs = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "doc_id long, text string, score int, rank string, bucket double").repartition(5)
    aim = spark.createDataFrame([(t, 1, 2) for t in target], "text string, doc_id int, id int")
    got = sorted((tuple(r) for r in resample.importance_sample(docs, aim).collect()), key=repr)
    assert got == plain(rows, target)
    got = sorted((tuple(r) for r in resample.importance_sample(docs, aim, seed=11, percent=60, least_words=3, buckets=97).collect()), key=repr)
    assert got == plain(rows, target, 11, 60, 3, 97)


def test_empty_tables(spark):
    rows, target = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resample.importance_sample(docs.limit(0), none).count() == 0
    assert sorted((tuple(r) for r in resample.importance_sample(docs, none).collect()), key=repr) == plain(rows, [])


def test_runs_across_segments():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "é", "c", " ", ". ", "Zz", "1"]) for _ in range(rng.randint(0, 120)))
        for longest in (1, 2, 3, 4):
            n, found = resample.Features(longest, 10_000, segment=rng.choice([1, 3, 8])).of(text.encode())
            want = buckets_of(text, longest)
            assert n == want[0] and sorted(found.tolist()) == sorted(want[1])


def test_more_buckets_than_two_bytes():
    made = resample.Features(2, 1 << 20)
    assert sorted(made.of(b"one two three")[1].tolist()) == sorted(buckets_of("one two three", buckets=1 << 20)[1])
