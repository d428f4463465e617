"""Which documents contain held-out passages, word for word."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.session import materialize

#: Words of a passage that are looked up; a passage of fewer inner words is looked up by all of them.
ANCHOR = 5
BLANKS = " \t\n\x0b\f\r"
#: Characters of passages in one automaton; more of them are dealt over several, each broadcast by itself.
AUTOMATON = 4_000_000


def _words(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _hash(n: int, start: Column) -> Column:
    return F.xxhash64(F.lit(n), *[F.get("words", start + k) for k in range(n)])


def long_passage_leaks(docs: DataFrame, passages: DataFrame, key: str, passage: str, text: str = "text") -> DataFrame:
    """(key, passage) for passages of three words and more, by a join on their first inner words.

    The first and the last word of a passage may be part of longer words in
    a document, the words between cannot. So the hash of the first inner words
    finds the candidates by an equi-join, and ``contains`` on the whole texts
    decides. The looked-up hashes are written first, so that Spark broadcasts
    them if they are small and otherwise splits a frequent hash like any
    skewed join key.
    """
    cut = passages.select(passage, F.col(text).alias("_passage"), _words(F.col(text)).alias("words")).where("size(words) >= 3")
    inner = F.least(F.lit(ANCHOR), F.size("words") - 2)
    picked = F.coalesce(*[F.when(inner == n, _hash(n, F.lit(1))) for n in range(1, ANCHOR + 1)])
    wanted = materialize(cut.select(passage, "_passage", inner.alias("n"), picked.alias("h")), "passages")
    sizes = [r["n"] for r in wanted.select("n").distinct().orderBy("n").collect()]  # at most ANCHOR values
    words = docs.select(key, _words(F.col(text)).alias("words"))
    places = words.select(key, "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)))).alias("i"))
    starts = [F.when(F.col("i") + n <= F.size("words"), _hash(n, F.col("i"))) for n in sizes] or [F.lit(None).cast("bigint")]
    hashed = places.select(key, F.explode(F.array(*starts)).alias("h")) if len(starts) > 1 else places.select(key, starts[0].alias("h"))
    found = hashed.where("h is not null").join(wanted.select("h", passage), "h").select(key, passage).distinct()
    found = materialize(found, "passage-candidates")
    texts = docs.select(key, text).join(found, key).join(wanted.select(passage, "_passage"), passage)
    return texts.where(F.contains(F.col(text), F.col("_passage"))).select(key, passage).distinct()


def short_passage_leaks(docs: DataFrame, passages: DataFrame, key: str, passage: str, text: str = "text", size: int = AUTOMATON) -> DataFrame:
    """(key, passage) for passages of any length, by a multi-pattern automaton that reads each text once.

    The characters of the distinct passages are counted first. Up to ``size``
    of them make one automaton, which is broadcast; more are dealt by hash
    over several, and the texts are read once for each.
    """
    known = passages.select(F.col(passage).alias("_id"), F.col(text).alias("_passage")).where("_passage <> ''")
    patterns = materialize(known.groupBy("_passage").agg(F.collect_set("_id").alias("ids"), F.max(F.col("_id").isNull()).alias("nameless")), "short-passages")
    total = patterns.agg(F.sum(F.length("_passage"))).first()[0] or 0
    groups = -(-total // size)
    found = None
    for g in range(groups):
        part = patterns.where(F.pmod(F.xxhash64("_passage"), F.lit(groups)) == g).select("_passage") if groups > 1 else patterns.select("_passage")
        hits = _automaton_hits(docs.select(key, text), [r["_passage"] for r in part.collect()], key)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.select(key, F.lit(None).cast(known.schema["_id"].dataType).alias(passage)).where(F.lit(False))
    named = patterns.select("_passage", F.explode(F.when(F.col("nameless"), F.concat("ids", F.array(F.lit(None).cast(known.schema["_id"].dataType)))).otherwise(F.col("ids"))).alias(passage))
    return found.join(named, "_passage").select(key, passage).distinct()


def _automaton_hits(docs: DataFrame, patterns: list[str], key: str) -> DataFrame:
    """The key and each pattern found in a text."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    field = docs.schema[key]

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for k, p in enumerate(shared.value):
            finder.add_word(p, k)
        if len(finder):
            finder.make_automaton()
        for part in parts:
            rows, hits = [], []
            for i, value in enumerate(part.column(1)):
                body = value.as_py()
                found = {k for _, k in finder.iter(body)} if body and len(finder) else ()
                rows += [i] * len(found)
                hits += [shared.value[k] for k in found]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=[key, "_passage"])

    return docs.mapInArrow(search, f"`{key}` {field.dataType.simpleString()}, _passage string")


def passage_leaks(docs: DataFrame, passages: DataFrame, key: str, passage: str, text: str = "text") -> DataFrame:
    """(key, passage) of every document whose text contains the passage's text, passages of any length.

    Passages of three words and more go by a join, shorter ones, also of
    white space alone, through an automaton. Null texts and passages contain
    nothing and are nowhere; an empty passage names nothing and is left out.
    """
    n_words = F.size(_words(F.col(text)))
    short = passages.where((n_words < 3) & F.col(text).isNotNull())
    return long_passage_leaks(docs, passages, key, passage, text).unionByName(short_passage_leaks(docs, short, key, passage, text)).distinct()
