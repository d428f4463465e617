"""Token files, packing: round trips against the tokenizer itself, and odd rows."""

import io
import zlib

import numpy as np
import pytest

from corpusbench.llm import packing, tokens
from corpusbench.llm.queries import tokenizer_path
from corpusbench.session import scratch

TEXTS = ["", "a", "Hello, world! It's 42.", "İstanbul ΣΊΣΥΦΟΣ ẞ ﬁ  x　y\x1cz", "a\x0bb\rc\td", "<|endoftext|> <|endof text|>", "é ́x 日本語", "word " * 9000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def odd_rows(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(100, None, None, None), (None, "no id", "x", 1), (3, "same id", "x", 1), (3, "same id", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens long")


@pytest.mark.parametrize("memo", [0, 2, 1000])
def test_encoder_equals_the_library(reference, memo):
    encoder = tokens.Encoder(tokenizer_path(), memo)
    for _ in range(2):
        for text in TEXTS:
            assert encoder.text(text.encode()).tolist() == reference(text)[:-1].tolist()


def test_tokenizer_with_other_rules_gets_whole_texts():
    from pathlib import Path

    from tokenizers import Tokenizer

    path = str(Path(tokenizer_path()).with_name("byte_bpe_50k.json"))
    other, encoder = Tokenizer.from_file(path), tokens.Encoder(path)
    assert tokens.Encoder(tokenizer_path()).by_words and not encoder.by_words
    for text in TEXTS:
        assert encoder.text(text.encode()).tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("sizes", [[], [0], [1], [7, 0, 9, 30], [8, 8, 16]])
def test_shard_round_trip(planes, sizes):
    rng, sink = np.random.default_rng(1), io.BytesIO()
    docs = [(k, rng.integers(0, 49_408, n).astype("<u2")) for k, n in enumerate(sizes)]
    writer = tokens.ShardWriter(sink, np.dtype("<u2"), 8, planes)
    for doc in docs:
        writer.add(*doc)
    writer.close()
    back = list(tokens.ShardReader(io.BytesIO(sink.getvalue())).read())
    assert [(k, ids.tolist()) for k, ids in back] == [(k, ids.tolist()) for k, ids in docs]


def test_damaged_chunk_is_told():
    sink = io.BytesIO()
    writer = tokens.ShardWriter(sink, np.dtype("<u2"), 8)
    writer.add(1, np.arange(8, dtype="<u2"))
    writer.close()
    reader = tokens.ShardReader(io.BytesIO(sink.getvalue()))
    reader.chunks[0][3] += 1
    with pytest.raises(ValueError):
        list(reader.read())


def test_token_files(spark, reference):
    docs = odd_rows(spark)
    got = sorted(tokens.token_round_trip(spark, docs, tokenizer_path(), end_id=2, block=64).collect(), key=lambda r: r["start"])
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1]))
    at = 0
    for r, (doc_id, text) in zip(got, want, strict=True):
        ids = reference(text)
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_empty_table(spark):
    none = odd_rows(spark).limit(0)
    assert tokens.token_round_trip(spark, none, tokenizer_path(), end_id=2).count() == 0
    assert packing.pack_documents(none, tokenizer_path(), end_id=2).count() == 0


def test_packing_places_each_id_once(spark, reference):
    docs = odd_rows(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: reference(r["text"]) for r in docs.collect()}
    rows = packing.pack_documents(docs, tokenizer_path(), end_id=2, length=128).collect()
    seen = {k: 0 for k in texts}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = texts[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] += r["length"]
    assert seen == {k: len(v) for k, v in texts.items()}
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 128
    padding = sum(128 - n for n in sequences.values() if n & (n - 1))
    assert padding < 0.2 * sum(sequences.values())


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(200):
        places = np.unique(rng.integers(1, 60, rng.integers(3, 25)))
        places = np.unique(np.concatenate((places, np.arange(8, 60, 8))))
        penalties, length = rng.choice([0, 8, 64], len(places)), 16
        pos, cost = [0, *places.tolist()], [0.0]
        for j in range(1, len(pos)):
            cost.append(min(cost[i] + length - (pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= length) + penalties[j - 1])
        cuts = packing.best_cuts(places, penalties, length)
        assert cuts[-1] > pos[-1] - length
        paid = sum(length - (b - a) for a, b in zip([0, *cuts[:-1]], cuts, strict=True)) + sum(penalties[pos.index(c) - 1] for c in cuts)
        assert paid == min(c for c, p in zip(cost, pos, strict=True) if p > pos[-1] - length and p)


def test_last_windows_need_no_padding():
    for n in range(1, 300):
        cuts = packing.last_windows(10, 10 + n, 256)
        sizes = np.diff([10, *cuts])
        assert sizes.sum() == n and (len(cuts) == 1 or all(x & (x - 1) == 0 for x in sizes)) and (len(cuts) > 1 or n & (n - 1) == 0 or 0 <= 256 - n <= 16 or n > 256)


def test_files_are_in_the_shared_folder(spark):
    folder = scratch(spark, "tokens")
    manifest = tokens.write_token_files(odd_rows(spark), folder, tokenizer_path(), end_id=2)
    assert manifest.agg({"n_docs": "sum"}).first()[0] == len(TEXTS) + 4
