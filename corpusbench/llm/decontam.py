"""Benchmark decontamination: which documents hold which test items.

An item of n word shingles is in a document if at least the stated share of
its shingles is. At most floor((1 - share) * n) may be missing, so a document
that holds the item has one of its floor((1 - share) * n) + 1 least hashes,
its MinHash values: a search for these misses nothing. Items are partitioned
by size. Each partition has its greatest MinHash value as a bound and its
least number of shingles as a floor: a shingle of a document meets only the
partitions whose bound it is under, and only those whose floor the document
has shingles for. Items shorter than a shingle are one shingle of their own
length and partitions of their own. Pairs found are verified by the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbench.llm.common import SPACE, narrow
from corpusbench.session import materialize

WORDS, SHARE = 5, 0.8
BLANKS = " \t\n\x0b\f\r"


def words_of(column: str) -> Column:
    """Lower-case words; null text has none."""
    bare = F.trim(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def places(length: Column) -> Column:
    """Starts of the shingles of that length, none for a text that is too short."""
    return F.explode(F.when(F.size("words") >= length, F.sequence(F.lit(0), F.size("words") - length)).otherwise(F.array().cast("array<int>")))


def shingle(n: int) -> list[Column]:
    return [F.get("words", F.col("i") + k) for k in range(n)]


def hashed(n: int) -> Column:
    return F.xxhash64(F.lit(n), *shingle(n))


def per_length(length: str, lengths: list[int], made) -> Column:
    """``made(n)`` for the length n that the column holds."""
    return F.coalesce(*[F.when(F.col(length) == n, made(n)) for n in lengths])


def item_shingles(items: DataFrame, n: int) -> DataFrame:
    """item_id, words (of a shingle), shingle, h, size: the distinct shingles of each item, their hashes and their number."""
    cut = narrow(items, "item_id", "text").where("item_id is not null").select("item_id", words_of("text").alias("words")).where(F.size("words") > 0)
    placed = cut.withColumn("length", F.least(F.size("words"), F.lit(n))).select("item_id", "length", "words", places(F.col("length")).alias("i"))
    lengths = list(range(1, n + 1))
    rows = placed.select("item_id", "length", per_length("length", lengths, lambda k: F.concat_ws(" ", *shingle(k))).alias("shingle"), per_length("length", lengths, hashed).alias("h")).distinct()
    # repeated rows of an item count as one text; differing texts of one id are told apart by their length alone
    sizes = rows.groupBy("item_id", "length").agg(F.count("*").alias("size"))
    return rows.join(sizes, ["item_id", "length"])


def minhash_values(shingles: DataFrame, share: float) -> DataFrame:
    """item_id, length, band, size, h: the least hashes of each item, as many as its size asks for."""
    wanted = F.floor((1 - share) * F.col("size") + 1e-9) + 1
    lists = shingles.groupBy("item_id", "length").agg(F.sort_array(F.collect_set("h")).alias("hs"), F.first("size").alias("size"))
    band = F.floor(F.log2(F.col("size").cast("double"))).cast("int")
    return lists.select("item_id", "length", band.alias("band"), "size", F.explode(F.slice("hs", F.lit(1), wanted.cast("int"))).alias("h"))


def contaminated_pairs(docs: DataFrame, items: DataFrame, *, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at or above the share.

    An item of fewer words than a shingle is one shingle of its own length.
    Null and wordless texts have no shingles and are in no pair, and so are
    null ids, which name no document; ``drop_contaminated`` goes by rows.
    Repeated rows of a document or an item count as one. Empty tables: no
    rows. Other columns are not read.

    The searched values are written first, so that Spark knows their size: it
    broadcasts them if they are small and shuffles otherwise.
    """
    held = materialize(item_shingles(items, words), "item-shingles")
    values = materialize(minhash_values(held, share), "item-minhash")
    partitions = values.groupBy("length", "band").agg(F.max("h").alias("bound"), F.min("size").alias("least")).collect()  # a row per power of two
    texts = narrow(docs, "doc_id", "text").where("doc_id is not null and text is not null").select("doc_id", words_of("text").alias("words"))
    hits = None
    for n in sorted({p["length"] for p in partitions}):
        own = [p for p in partitions if p["length"] == n]
        h = hashed(n)
        rows = texts.select("doc_id", "words", places(F.lit(n)).alias("i")).select("doc_id", (F.size("words") - n + 1).alias("n_places"), h.alias("h"))
        rows = rows.where(F.col("h") <= max(p["bound"] for p in own))
        open_ = F.array(*[F.when((F.col("h") <= p["bound"]) & (F.col("n_places") >= share * p["least"] - 1e-9), F.lit(p["band"])) for p in own])
        met = rows.select("doc_id", F.lit(n).alias("length"), "h", F.explode(F.array_compact(open_)).alias("band"))
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        none = {"item_id": items.schema["item_id"].dataType, "n_shared": "long", "n_item": "long", "containment": "double"}
        return texts.select("doc_id", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).where(F.lit(False))
    found = materialize(hits.join(values.select("length", "band", "h", "item_id"), ["length", "band", "h"]).select("doc_id", "item_id").distinct(), "candidates")
    lengths = sorted({p["length"] for p in partitions})
    some = texts.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    again = some.select("doc_id", "words", F.explode(F.array(*map(F.lit, lengths))).alias("length")).select("doc_id", "words", "length", places(F.col("length")).alias("i"))
    exact = again.select("doc_id", "length", per_length("length", lengths, lambda k: F.concat_ws(" ", *shingle(k))).alias("shingle"), per_length("length", lengths, hashed).alias("h"))
    matched = exact.join(held, ["length", "h", "shingle"]).select("doc_id", "item_id", "length", "size", "shingle").distinct()
    counted = matched.groupBy("doc_id", "item_id", "length").agg(F.count("*").alias("n_shared"), F.first("size").alias("n_item"))
    checked = counted.join(found, ["doc_id", "item_id"], "left_semi").where(F.col("n_shared") >= F.lit(share) * F.col("n_item") - 1e-9)
    return checked.select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, words: int = WORDS, share: float = SHARE) -> DataFrame:
    """The documents that hold no item, all their columns as they were.

    Rows are judged by their texts, so a row without an id, or of an id that
    another text has too, goes only for what it holds itself. Null and
    wordless texts stay; repeated rows stay or go together. Empty tables: all
    documents stay.
    """
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    named = docs.select(key.alias("doc_id"), "text")
    bad = materialize(contaminated_pairs(named, items, words=words, share=share).select(F.col("doc_id").alias("_text")).distinct(), "contaminated")
    return docs.withColumn("_text", key).join(bad, "_text", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
