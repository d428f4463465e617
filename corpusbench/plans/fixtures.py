"""Views over the given tables: once as DataFrames, once as DuckDB SQL.

Each view maps a table onto the shape the operators take (labelled
samples, scored rows, patch grids, shards, URL metadata). The two forms
are written separately, so a mistake in one shows up in the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbench.functions.rng import choice, uniform
from corpusbench.operators.probe import linear_score, mean_difference_weights

DISTORTION_VOCAB = [
    "jpeg", "lensblur", "brighten", "clahe", "colorsat", "impulsenoise", "isonoise", "shotnoise",
]
# Folders the corpus rows are spread over; six of them are held out.
CORPUS_DIRS = [
    "comfor-small/train", "ntire/shard_0", "OpenFake/train", "laion400m-1/real", "open-images-v7",
    "CommunityForensics-Eval/data", "coco-val2017/images", "WildFake\\DALLE-Advanced",
    "openfake/holdout_core", "flux-reason", "comfor_eval", "sid-set//./full",
]
GRID = 8
DIMS = 64


#: Number of partitions over which a fixture deals a table whose file has too few splits for the cores at hand.
SCAN_PARTITIONS = "corpusbench.fixture.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """The rows over as many partitions as the session's setting names; as they are without it."""
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


# ---------------------------------------------------------------- DataFrames


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    kind1 = choice(uniform("kind", F.col("id")), DISTORTION_VOCAB)
    kind2 = choice(uniform("kind2", F.col("id")), DISTORTION_VOCAB)
    return (
        docs.join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("id"),
            "text",
            "source",
            F.col("source").alias("generator"),
            F.col("lang").alias("architecture"),
            F.concat(F.lit("doc_"), F.col("doc_id")).alias("image_name"),
            "n_chars",
            "quality",
            "toxic",
            (F.lit(1) - F.col("quality")).alias("label"),
            (F.coalesce(F.col("toxic"), F.lit(0)) == 1).alias("nsfw_flag"),
        )
        .withColumn("is_distorted", uniform("dist", F.col("id")) < 0.5)
        .withColumn(
            "distortions_raw",
            F.when(~F.col("is_distorted"), F.lit("[]"))
            .when(kind1 == kind2, F.concat(F.lit("['"), kind1, F.lit("']")))
            .otherwise(F.concat(F.lit("['"), kind1, F.lit("', '"), kind2, F.lit("']"))),
        )
        .withColumn(
            "path",
            F.concat(F.lit("/data/"), choice(uniform("dir", F.col("id")), CORPUS_DIRS),
                     F.lit("/"), F.col("source"), F.lit("/doc_"), F.col("id"), F.lit(".jpg")),
        )
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = dealt(table(spark, sf_dir, "embeddings")).withColumn("y", (F.col("label") >= 5).cast("int"))
    weights = mean_difference_weights(emb, "embedding", "y")
    return linear_score(emb, "embedding", weights, DIMS, scale=8.0).select(
        F.col("vec_id").alias("id"),
        F.col("y").alias("label"),
        F.concat(F.lit("gen"), F.col("label")).alias("generator"),
        F.concat(F.lit("arch"), F.col("label") % 5).alias("architecture"),
        "prob",
    )


def line_key() -> Column:
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100.0).cast("long"),
    )


def scored_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = (F.col("l_returnflag") == "R").cast("int")
    return dealt(table(spark, sf_dir, "lineitem")).select(
        line_key().alias("id"),
        label.alias("label"),
        F.round(F.lit(0.35) * label + F.lit(0.65) * uniform("sb", line_key()), 2).alias("prob"),
        F.concat(F.lit("gen"), F.col("l_suppkey") % 20).alias("generator"),
        F.col("l_linestatus").alias("architecture"),
        (F.col("l_tax") > 0.04).alias("is_distorted"),
        F.concat(F.lit("kind"), F.col("l_partkey") % 40).alias("kind"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved shards: ``(shard, pos)`` is the scan order."""
    line = dealt(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return line.join(part, "l_partkey", "left").select(
        F.col("l_suppkey").alias("shard"),
        line_key().alias("pos"),
        F.concat(F.lit("m"), F.col("l_partkey") % 30).alias("model"),
        F.when(F.col("l_returnflag") == "R", "fake").otherwise("real").alias("label"),
        (F.col("l_quantity") * 10000).cast("long").alias("bytes"),
        (F.coalesce(F.col("p_size"), F.lit(0)) * 20).alias("side"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs with drawn width, height and scores; some values do not parse."""
    key = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(uniform("ftp", key) < 0.05, F.regexp_replace("url", "^https?", "ftp"))
        .otherwise(F.col("url")).alias("url"),
        F.when(uniform("wn", key) < 0.1, F.lit(None))
        .when(uniform("wn", key) < 0.2, F.lit("wide"))
        .otherwise(F.floor(uniform("w", key) * 1000).cast("string")).alias("width"),
        F.floor(uniform("h", key) * 1000).cast("string").alias("height"),
        F.when(uniform("pn", key) < 0.1, F.lit("n/a"))
        .otherwise(F.round(uniform("p", key), 4).cast("string")).alias("punsafe"),
        F.round(uniform("wm", key), 4).cast("string").alias("pwatermark"),
    )


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs as file listings: host, first folder, path."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract("url", r"^https?://([^/]+)/", 1).alias("host"),
        F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1).alias("dir"),
        F.regexp_extract("url", r"^https?://([^?#]*)", 1).alias("path"),
    )


def source_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document source: type, weight, label rules and class counts."""
    k = F.substring("source", 4, 10).cast("int")
    counts = samples(spark, sf_dir).groupBy("source").agg(
        F.count_if(F.col("label") == 1).alias("n_fake"),
        F.count_if(F.col("label") == 0).alias("n_real"),
        F.count_if(F.col("label").isNull()).alias("n_unused"),
        F.count("*").alias("n_total"),
    )
    return counts.select(
        "source",
        k.alias("k"),
        F.get(F.array(F.lit("comfor"), F.lit("hf"), F.lit("folders"), F.lit("ntire")), k % 4).alias("type"),
        ((k % 6) - 1).cast("double").alias("weight"),
        F.when(k % 5 == 0, F.lit(1)).when(k % 7 == 0, F.lit(0)).alias("keep_label"),
        F.when(k % 3 == 0, F.lit(1)).alias("fixed_label"),
        F.when(k % 2 == 0, F.lit("label")).alias("label_col"),
        (k % 8 < 6).alias("has_real_dirs"),
        (k % 8 > 2).alias("has_fake_dirs"),
        "n_fake", "n_real", "n_unused", "n_total",
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type",
        F.round(F.col("value") / (F.col("value") + F.lit(50.0)), 6).alias("prob"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


def pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 patches in (0, 1): the sigmoid of the scaled embedding."""
    return dealt(table(spark, sf_dir, "embeddings")).select(
        F.col("vec_id").alias("id"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.transform("embedding", lambda x: F.lit(1.0) / (
            F.lit(1.0) + F.exp(F.lit(-8.0) * x.cast("double")))).alias("grid"),
    )


# ------------------------------------------------------------------- DuckDB


def u(seed: str, key: str) -> str:
    return (f"(('0x' || substr(md5('{seed}|' || ({key})::varchar), 1, 8))::ubigint::double"
            " / 4294967296.0::double)")


def pick(u_sql: str, values: list) -> str:
    items = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{items}])[1 + floor({u_sql} * {len(values)})::int]"


_LINE_KEY = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
             "round(l_extendedprice * 100.0)::bigint)")

VIEWS: dict[str, tuple[list[str], str]] = {
    "samples": ([], f"""
        select doc_id as id, text, source, source as generator, lang as architecture,
               'doc_' || doc_id as image_name, n_chars, quality, toxic, 1 - quality as label,
               coalesce(toxic, 0) = 1 as nsfw_flag,
               {u('dist', 'doc_id')} < 0.5 as is_distorted,
               case when {u('dist', 'doc_id')} >= 0.5 then '[]'
                    when {pick(u('kind', 'doc_id'), DISTORTION_VOCAB)} = {pick(u('kind2', 'doc_id'), DISTORTION_VOCAB)}
                    then '[''' || {pick(u('kind', 'doc_id'), DISTORTION_VOCAB)} || ''']'
                    else '[''' || {pick(u('kind', 'doc_id'), DISTORTION_VOCAB)} || ''', '''
                         || {pick(u('kind2', 'doc_id'), DISTORTION_VOCAB)} || ''']' end as distortions_raw,
               '/data/' || {pick(u('dir', 'doc_id'), CORPUS_DIRS)} || '/' || source || '/doc_' || doc_id || '.jpg' as path
        from documents left join labels using (doc_id)"""),
    "weights": ([], """
        select i, avg(x) filter (where label >= 5) - avg(x) filter (where label < 5) as w
        from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i
              from embeddings) group by i"""),
    "scored": (["weights"], """
        select e.vec_id as id, (e.label >= 5)::int as label, 'gen' || e.label as generator,
               'arch' || (e.label % 5) as architecture,
               round(1.0::double / (1.0::double + exp(-8.0::double * s.dot)), 6) as prob
        from embeddings e join (
            select vec_id, sum(x * w) as dot
            from (select vec_id, unnest(embedding)::double as x,
                         generate_subscripts(embedding, 1) as i from embeddings) join weights using (i)
            group by vec_id) s using (vec_id)"""),
    "scored_big": ([], f"""
        select {_LINE_KEY} as id, (l_returnflag = 'R')::int as label,
               round(0.35::double * (l_returnflag = 'R')::int + 0.65::double * {u('sb', _LINE_KEY)}, 2) as prob,
               'gen' || (l_suppkey % 20) as generator, l_linestatus as architecture,
               l_tax > 0.04 as is_distorted, 'kind' || (l_partkey % 40) as kind
        from lineitem"""),
    "shards": ([], f"""
        select l_suppkey as shard, {_LINE_KEY} as pos, 'm' || (l_partkey % 30) as model,
               case when l_returnflag = 'R' then 'fake' else 'real' end as label,
               (l_quantity * 10000)::bigint as bytes, coalesce(p_size, 0) * 20 as side
        from lineitem left join part on p_partkey = l_partkey"""),
    "urls": ([], f"""
        select page_id,
               case when {u('ftp', 'page_id')} < 0.05 then regexp_replace(url, '^https?', 'ftp') else url end as url,
               case when {u('wn', 'page_id')} < 0.1 then null when {u('wn', 'page_id')} < 0.2 then 'wide'
                    else floor({u('w', 'page_id')} * 1000)::bigint::varchar end as width,
               floor({u('h', 'page_id')} * 1000)::bigint::varchar as height,
               case when {u('pn', 'page_id')} < 0.1 then 'n/a' else round({u('p', 'page_id')}, 4)::varchar end as punsafe,
               round({u('wm', 'page_id')}, 4)::varchar as pwatermark
        from pages"""),
    "url_parts": ([], """
        select page_id, url, regexp_extract(url, '^https?://([^/]+)/', 1) as host,
               regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) as dir,
               regexp_extract(url, '^https?://([^?#]*)', 1) as path
        from pages"""),
    "source_specs": (["samples"], """
        select source, k, (['comfor', 'hf', 'folders', 'ntire'])[1 + k % 4] as type,
               ((k % 6) - 1)::double as weight,
               case when k % 5 = 0 then 1 when k % 7 = 0 then 0 end as keep_label,
               case when k % 3 = 0 then 1 end as fixed_label,
               case when k % 2 = 0 then 'label' end as label_col,
               k % 8 < 6 as has_real_dirs, k % 8 > 2 as has_fake_dirs,
               n_fake, n_real, n_unused, n_total
        from (select source, substr(source, 4)::int as k,
                     count(*) filter (where label = 1) as n_fake,
                     count(*) filter (where label = 0) as n_real,
                     count(*) filter (where label is null) as n_unused, count(*) as n_total
              from samples group by source)"""),
    "feed": ([], """
        select event_id, user_id, event_type, round(value / (value + 50.0::double), 6) as prob,
               (event_type = 'error')::int as label from events"""),
    "cells": ([], """
        select vec_id as id, (label >= 5)::int as label, i - 1 as cell, (i - 1) // 8 as r, (i - 1) % 8 as c,
               1.0::double / (1.0::double + exp(-8.0::double * x)) as x
        from (select vec_id, label, unnest(embedding)::double as x,
                     generate_subscripts(embedding, 1) as i from embeddings)"""),
}


def oracle(body: str, *views: str) -> str:
    """``body`` prefixed with the CTEs it names, dependencies first.

    ``body`` may start with its own CTE list written as ``with a as (...)``.
    """
    order: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    ctes = ", ".join(f"{v} as ({VIEWS[v][1]})" for v in order)
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return f"with {ctes}, {body[5:]}"
    return f"with {ctes} {body}"
