"""Fill-in-the-middle against plain slicing, cuts of the tree, round trips."""

import hashlib
import random
import re

import pytest

from corpusbench.llm import middle

ODD = [None, "", "a", "é", "😀", "ab", "<", "<P", "a<S>b", "text <M", "P>", "é\n\nü 😀" * 700, "\n", " x", "word " * 5000, "́á", "\x00\x01", "<P>", "S><", "日本語" * 2000]


def plain(doc_id, text, seed=1, rate=90, spm=20):
    t = text or ""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(t), "plain", None, None, t
    if h[3] % 100 < spm:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_against_slicing(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(ODD * 6)] + [(0, "other text of one id", "x", 1), (0, "other text of one id", "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    got = sorted((tuple(r) for r in middle.fill_in_middle(docs, block=16).collect()), key=repr)
    assert got == sorted(((i, *plain(i, t)) for i, t, _, _ in rows), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((tuple(r) for r in middle.middle_digests(docs).collect()), key=repr)
    want = [(i, *plain(i, t)[:4], sha(plain(i, t)[4]), sha(t or "")) for i, t, _, _ in rows]
    assert got == sorted(want, key=repr) and {r[2] for r in got} == {"plain", "psm", "spm"}
    assert middle.middle_digests(docs.limit(0)).count() == 0


def test_other_units_come_back(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(ODD * 4)], "doc_id long, text string")
    for unit, pattern in (("word", r"[^ \t-\r]+[ \t-\r]*|^[ \t-\r]+"), ("line", r"[^\n]*\n|[^\n]+")):
        made = middle.fill_in_middle(docs, unit=unit, rate=100, spm=50, marks=("[one]", "[two]", "[three]"), block=8)
        for r in made.select("*", middle.restored(made["output"], made["form"], ("[one]", "[two]", "[three]")).alias("back")).collect():
            text = ODD[r["doc_id"] % len(ODD)] or ""
            ends = [0, *(m.end() for m in re.finditer(pattern, text))]
            assert r["back"] == text and r["n"] == len(ends) - 1 and ends[-1] == len(text)
            if text:
                assert r["form"] != "plain" and r["prefix_chars"] in ends and r["prefix_chars"] + r["middle_chars"] in ends


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_every_cut(block):
    rng = random.Random(block)
    for _ in range(40):
        text = "".join(rng.choices("aé😀 \n", k=rng.randint(0, 90)))
        tree = middle.UnitTree(text.encode(), block=block)
        assert tree.units == tree.points == len(text)
        assert [tree.cut(k) for k in range(len(text) + 1)] == [(len(text[:k].encode()), k) for k in range(len(text) + 1)]


def test_long_text():
    text = "aé😀 " * 900_000
    tree = middle.UnitTree(text.encode())
    assert tree.units == len(text)
    for k in (0, 1, 17, 1_799_999, 3_000_001, len(text)):
        assert tree.cut(k) == (len(text[:k].encode()), k)


def test_marks_that_run_together(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for marks in (("<P>", "<P>", "<M>"), ("ab", "ba", "x"), ("aa", "b", "c"), ("x", "", "y"), ("<P>", "<<P>>", "z"), ("aba", "c", "d")):
        with pytest.raises(ValueError):
            middle.fill_in_middle(docs, marks=marks)
