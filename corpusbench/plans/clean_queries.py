"""Projections, filters, identities, de-duplication, joins on ids and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusbench.functions import holdout as H
from corpusbench.functions import identity as I
from corpusbench.functions import labels as L
from corpusbench.functions.rng import choice, uniform
from corpusbench.operators.leaks import passage_leaks
from corpusbench.operators import curation as C
from corpusbench.operators import metrics as M
from corpusbench.operators.probe import mean_difference_weights, sigmoid
from corpusbench.operators.sweep import lookup
from corpusbench.plans import fixtures as fx
from corpusbench.plans.fixtures import oracle, pick, u
from corpusbench.plans.registry import query

RAW_LABELS = ["fake", "AI ", " Real", "photo", "1", "0", "Yes", "no", "2", "-1", "", "maybe", "2.5",
              "synthetic", "AI-Generated", " 07 "]
RAW_MAPPED = ["0", " 1", "01", "7", "7.0", "x", "fake", "+1"]
RAW_FLAGS = ["True", "false ", "1", "yes", "", "False", "0", " YES", "y"]
LABEL_MAP = {0: 1, 1: 0, "7": 1}


def raw_labels(spark, sf):
    return fx.samples(spark, sf).select(
        "id", "source",
        F.when(uniform("rawnull", F.col("id")) < 0.05, F.lit(None)).otherwise(
            choice(uniform("raw", F.col("id")), RAW_LABELS)).alias("raw"),
        choice(uniform("rawm", F.col("id")), RAW_MAPPED).alias("mapped"),
        choice(uniform("flag", F.col("id")), RAW_FLAGS).alias("flag"),
    )


_RAW = f"""raws as (select id, source, case when {u('rawnull', 'id')} < 0.05 then null
    else {pick(u('raw', 'id'), RAW_LABELS)} end as raw, {pick(u('rawm', 'id'), RAW_MAPPED)} as mapped,
    {pick(u('flag', 'id'), RAW_FLAGS)} as flag from samples)"""
_NORM = """case raw when 'fake' then 1 when 'AI ' then 1 when ' Real' then 0 when 'photo' then 0 when '1' then 1
    when '0' then 0 when 'Yes' then 1 when 'no' then 0 when '2' then 2 when '-1' then -1 when 'synthetic' then 1
    when 'AI-Generated' then 1 when ' 07 ' then 7 end"""


@query("normalize_label", oracle(f"""with {_RAW}
    select raw, count(*) as n, max({_NORM}) as label, max(coalesce({_NORM}, 0)) as label_or_real
    from raws group by raw""", "samples"))
def normalize_label(spark, sf):
    return raw_labels(spark, sf).groupBy("raw").agg(
        F.count("*").alias("n"),
        F.max(L.normalize_label(F.col("raw"))).alias("label"),
        F.max(L.normalize_label(F.col("raw"), default=0)).alias("label_or_real"))


@query("label_map_lookup", oracle(f"""with {_RAW}
    select mapped as raw, count(*) as n,
           max(case mapped when '0' then 1 when ' 1' then 0 when '01' then 0 when '7' then 1 when '+1' then 0 end) as mapped_label,
           max(case mapped when '0' then 1 when ' 1' then 0 when '01' then 0 when '7' then 1 when '+1' then 0
                           when 'fake' then 1 end) as label
    from raws group by mapped""", "samples"))
def label_map_lookup(spark, sf):
    raw = F.col("mapped")
    return raw_labels(spark, sf).groupBy(raw.alias("raw")).agg(
        F.count("*").alias("n"), F.max(L.label_map_lookup(raw, LABEL_MAP)).alias("mapped_label"),
        F.max(L.normalize_label(raw, LABEL_MAP)).alias("label"))


@query("keep_label", oracle(f"with {_RAW} select id, {_NORM} as label from raws where {_NORM} = 1", "samples"))
def keep_label(spark, sf):
    df = raw_labels(spark, sf).withColumn("label", L.normalize_label(F.col("raw")))
    return df.where(F.col("label").isNotNull() & (F.col("label") == 1)).select("id", "label")


@query("fixed_label", oracle("""
    select s.source, coalesce(fixed_label, 0) as label, count(*) as n from samples s join source_specs using (source)
    where label_col is null group by all""", "samples", "source_specs"))
def fixed_label(spark, sf):
    """Sources without a label column take the constant of their spec, 0 if none."""
    specs = fx.source_specs(spark, sf).where("label_col is null").select(
        "source", F.coalesce("fixed_label", F.lit(0)).alias("label"))
    rows = fx.samples(spark, sf).groupBy("source").agg(F.count("*").alias("n"))
    return rows.join(specs, "source").select("source", "label", "n")


@query("to_bool", oracle(f"""with {_RAW}
    select flag, flag in ('True', '1', 'yes', ' YES') as value, count(*) as n from raws group by flag""", "samples"))
def to_bool(spark, sf):
    return raw_labels(spark, sf).groupBy("flag", L.to_bool(F.col("flag")).alias("value")).agg(F.count("*").alias("n"))


@query("row_name", """
    select doc_id, case when doc_id % 3 = 0 then 'doc_' || doc_id when doc_id % 5 = 0 then 'file' || doc_id || '.jpg'
                        when doc_id % 7 = 0 then source else '' end as name from documents""")
def row_name(spark, sf):
    d = F.col("doc_id")
    df = fx.table(spark, sf, "documents").select(
        d, F.when(d % 3 == 0, F.concat(F.lit("doc_"), d)).otherwise("").alias("image_name"),
        F.when(d % 5 == 0, F.concat(F.lit("file"), d, F.lit(".jpg"))).alias("file_name"),
        F.when(d % 7 == 0, F.col("source")).otherwise("").alias("path"))
    return df.select("doc_id", I.first_name(df.columns).alias("name"))


_DATASET = """case when k % 3 = 0 then 'corpus/' || source when type = 'ntire' then
    'ntire-' || case when k % 2 = 1 then 'val' else 'train' end else source end"""


@query("attach_source", oracle(f"""
    select source, type as source_type, {_DATASET} as dataset, n_total from source_specs""", "source_specs"))
def attach_source(spark, sf):
    k = F.col("k")
    dataset = (F.when(k % 3 == 0, F.concat(F.lit("corpus/"), F.col("source"))))
    split = F.when(k % 2 == 1, "val")
    return fx.source_specs(spark, sf).select(
        "source", F.col("type").alias("source_type"),
        F.coalesce(
            I.blank_to_null(dataset),
            F.when(F.col("type") == "ntire", F.concat(F.lit("ntire-"), F.coalesce(split, F.lit("train")))),
            I.blank_to_null(F.col("source")), F.lit("src")).alias("dataset"),
        "n_total")


# Evaluation set names per source type.
EVAL_TYPES = {
    "ntire_train": "ntire", "ntire_val": "ntire", "ntire_test": "ntire", "mirage": "mirage",
    "folders": "folders", "openfake_test": "folders", "openfake_reddit": "folders",
}
EVAL_SETS = ["ntire_val", "comfor_eval", "mirage", "folders", "openfake_test", "other_set"]


def eval_tags(dataset, source, source_type):
    """Set source and type only where absent, from the evaluation set's name."""
    by_name = lookup(dataset, EVAL_TYPES, F.when(F.startswith(dataset, F.lit("comfor")), "comfor"))
    return F.coalesce(source, dataset), F.coalesce(source_type, by_name)


@query("tag_defaults", oracle(f"""
    select eval_set, source, source_type, count(*) as n from (
        select {pick(u('set', 'id'), EVAL_SETS)} as eval_set,
               case when id % 2 = 0 then s.source else {pick(u('set', 'id'), EVAL_SETS)} end as source,
               case when id % 9 = 0 then 'given' else
                 case {pick(u('set', 'id'), EVAL_SETS)} when 'ntire_val' then 'ntire' when 'comfor_eval' then 'comfor'
                      when 'mirage' then 'mirage' when 'folders' then 'folders' when 'openfake_test' then 'folders' end
               end as source_type from samples s) group by all""", "samples"))
def tag_defaults(spark, sf):
    df = fx.samples(spark, sf).select(
        choice(uniform("set", F.col("id")), EVAL_SETS).alias("eval_set"),
        F.when(F.col("id") % 2 == 0, F.col("source")).alias("source"),
        F.when(F.col("id") % 9 == 0, "given").alias("source_type"))
    source, kind = eval_tags(F.col("eval_set"), F.col("source"), F.col("source_type"))
    return df.groupBy("eval_set", source.alias("source"), kind.alias("source_type")).agg(F.count("*").alias("n"))


CONTENT_SQL = """substr(sha1(case when length(text) > 4096
    then substr(text, 1, 4096) || right(text, 4096) || length(text) else text end), 1, 16)"""


@query("sample_id", oracle(f"""
    select id, source || case when id % 4 = 0 then '|path|' || replace(path, '//./', '/')
                   when id % 4 = 1 then '|name|doc_' || id when id % 4 = 2 then '|hash|' || {CONTENT_SQL}
                   else '|meta|' || generator || '|' || coalesce(label::varchar, 'None') end as sample_id
    from samples""", "samples"))
def sample_id(spark, sf):
    k = F.col("id") % 4
    return fx.samples(spark, sf).select("id", I.sample_id(
        F.col("source"), F.when(k == 0, F.col("path")).otherwise(""), F.when(k == 1, F.col("image_name")),
        F.when(k == 2, I.content_id(F.col("text"))), F.col("generator"), F.col("label")).alias("sample_id"))


@query("content_id", f"select doc_id, {CONTENT_SQL} as content_id from documents")
def content_id(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", I.content_id(F.col("text")).alias("content_id"))


@query("tiny_hash", oracle("""
    select id, substr(sha1(string_agg(floor(x * 255.0::double)::bigint::varchar, ',' order by cell)), 1, 16) as tiny_hash
    from cells group by id""", "cells"))
def tiny_hash(spark, sf):
    return fx.pixel_grid(spark, sf).select("id", I.tiny_hash(F.col("grid")).alias("tiny_hash"))


_BLOB = "replace(lower(path), chr(92), '/')"
_REASON = f"""case when regexp_matches({_BLOB}, 'communityforensics-eval|comfor[-_]eval') then 'forensics-eval'
    when regexp_matches({_BLOB}, 'openfake[/-]holdout|openfake/(core|reddit)/test') then 'openfake'
    when regexp_matches({_BLOB}, 'coco-val2017|/val2017/|wildfake[-/]dalle|dalle-advanced') then 'demo-val' end"""


@query("is_held_out_ref", oracle(f"select id, {_REASON} is not null as held_out from samples", "samples"))
def is_held_out_ref(spark, sf):
    return fx.samples(spark, sf).select("id", H.is_held_out(F.col("path"), F.lit("")).alias("held_out"))


@query("held_out_reason", oracle(f"select id, {_REASON} as reason from samples where {_REASON} is not null", "samples"))
def held_out_reason(spark, sf):
    df = fx.samples(spark, sf).select("id", H.held_out_reason(F.col("path")).alias("reason"))
    return df.where(F.col("reason").isNotNull())


@query("assert_no_held_out", oracle(f"""
    select source, {_REASON} as reason, count(*) as rows from samples where {_REASON} is not null group by all""", "samples"))
def assert_no_held_out(spark, sf):
    """The violation report; ``assert_no_held_out`` raises when it is not empty."""
    return H.violations(fx.samples(spark, sf), "source", F.col("path"))


@query("min_side_filter", """
    select p_partkey, p_size * 20 as w, p_size * (10 + p_partkey % 15)::int as h,
           p_size * 20 > 256 and p_size * (10 + p_partkey % 15) > 256 as keep_strict,
           least(p_size * 20, p_size * (10 + p_partkey % 15)) < 256 as small from part""")
def min_side_filter(spark, sf):
    w, h = F.col("p_size") * 20, (F.col("p_size") * (F.lit(10) + F.col("p_partkey") % 15)).cast("int")
    return fx.table(spark, sf, "part").select(
        "p_partkey", w.alias("w"), h.alias("h"), ((w > 256) & (h > 256)).alias("keep_strict"),
        (F.least(w, h) < 256).alias("small"))


@query("slugify", r"""
    select page_id, regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g') as slug,
           substr(case when s = '' then 'sample' else s end, 1, 24) as short_part,
           'shard-' || page_id || '_00250' as shard_tag,
           substr(regexp_replace(trim(html), '[^\p{L}\p{N}_.\-+]+', '_', 'g'), 1, 120) as folder
    from (select *, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') as s
          from pages)""")
def slugify(spark, sf):
    name = F.concat(F.lit("data/shard-"), F.col("page_id"), F.lit("-of-00250.parquet"))
    return fx.table(spark, sf, "pages").select(
        "page_id", I.slug(F.col("url")).alias("slug"), I.file_part(F.col("url"), 24).alias("short_part"),
        I.shard_tag(name).alias("shard_tag"), I.folder_name(F.col("html")).alias("folder"))


@query("url_stem", "select page_id, substr(sha1(url), 1, 20) as stem from pages")
def url_stem(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", I.url_stem(F.col("url")).alias("stem"))


def distorted(spark, sf):
    raw = F.when(uniform("mal", F.col("id")) < 0.05, F.rtrim(F.col("distortions_raw"), F.lit("]"))).otherwise(
        F.col("distortions_raw"))
    return fx.samples(spark, sf).withColumn("tokens", L.parse_list(raw))


_TOKENS = f"""toks as (select id, label, is_distorted, architecture, case when {u('mal', 'id')} < 0.05 or distortions_raw = '[]'
    then [] else regexp_extract_all(distortions_raw, '''([a-z]+)''', 1) end as tokens from samples)"""


@query("parse_distortions", oracle(f"""with {_TOKENS}
    select id, len(tokens) as n_tokens, array_to_string(tokens, '+') as tokens from toks""", "samples"))
def parse_distortions(spark, sf):
    return distorted(spark, sf).select(
        "id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", "+").alias("tokens"))


@query("distortion_key", oracle(f"""with {_TOKENS}
    select coalesce(tokens[1], 'none') as key, count(*) as n from toks group by 1""", "samples"))
def distortion_key(spark, sf):
    return distorted(spark, sf).groupBy(L.distortion_key(F.col("tokens")).alias("key")).agg(F.count("*").alias("n"))


@query("distortion_vocab", oracle(f"""with {_TOKENS}
    select token, count(*) as n from (select unnest(tokens) as token from toks where is_distorted) group by token""", "samples"))
def distortion_vocab(spark, sf):
    return (distorted(spark, sf).where("is_distorted").select(F.explode("tokens").alias("token"))
            .groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token"))


@query("verdict", oracle("""
    select event_id, prob as pred, case when prob >= 0.3 then 'AI' else 'REAL' end as verdict from feed""", "feed"))
def verdict(spark, sf):
    return fx.feed(spark, sf).select(
        "event_id", F.round("prob", 6).alias("pred"), L.verdict(F.col("prob"), 0.3).alias("verdict"))


@query("sigmoid_tta", oracle("""
    with d as (select vec_id, sum(x * a.w) as d0, sum(x * b.w) as d1
               from (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings) e
               join weights a on a.i = e.i
               join weights b on b.i = ((e.i - 1) // 8) * 8 + 8 - ((e.i - 1) % 8)
               group by vec_id)
    select vec_id, round(1 / (1.0::double + exp(-8.0::double * d0)), 6) as single,
           round(0.5::double * (1 / (1.0::double + exp(-8.0::double * d0)) + 1 / (1.0::double + exp(-8.0::double * d1))), 6) as tta
    from d""", "weights"))
def sigmoid_tta(spark, sf):
    """Mean of the scores of the grid and of its left-right mirror.

    Mirroring the grid is the same as mirroring the weights, so both scores
    read the features once.
    """
    emb = fx.table(spark, sf, "embeddings")
    w = mean_difference_weights(emb.withColumn("y", (F.col("label") >= 5).cast("int")), "embedding", "y")
    x = [F.get("embedding", i).cast("double") for i in range(fx.DIMS)]
    wt = [F.get("w", i) for i in range(fx.DIMS)]
    g = fx.GRID
    mirror = [wt[(i // g) * g + g - 1 - i % g] for i in range(fx.DIMS)]
    d0 = sum((a * b for a, b in zip(x[1:], wt[1:])), x[0] * wt[0])
    d1 = sum((a * b for a, b in zip(x[1:], mirror[1:])), x[0] * mirror[0])
    p0, p1 = sigmoid(F.lit(8.0) * d0), sigmoid(F.lit(8.0) * d1)
    return emb.withColumn("w", w.scalar()).select(
        "vec_id", F.round(p0, 6).alias("single"), F.round(F.lit(0.5) * (p0 + p1), 6).alias("tta"))


@query("provenance", oracle("""
    select id, '{' || concat_ws(',', '"id":"' || id || '"', '"source":"' || source || '"', '"dataset":"documents"',
        case when id % 2 = 0 then '"source_type":"text"' end, '"image_name":"' || image_name || '"', '"image_path":"' || replace(path, chr(92), chr(92) || chr(92)) || '"',
        case when id % 3 = 0 then '"generator":"' || generator || '"' end,
        case when id % 5 > 0 then '"architecture":"' || architecture || '"' end,
        case when id % 7 > 0 then '"prompt":"about ' || source || '"' end, '"nsfw_flag":' || nsfw_flag,
        '"subset":"s' || (id % 4) || '"', case when label = 0 then '"real_source":"' || source || '"' end, '"format":"jpg"',
        '"distortions":["d' || (id % 3) || '","e"]', '"distortion_scales":[' || (id % 3) || ',2]',
        '"is_distorted":' || is_distorted, '"content_id":"c' || id || '"') || '}' as provenance from samples""", "samples"))
def provenance(spark, sf):
    """The id and all provenance fields that are not empty, as JSON."""
    some = lambda when, value: F.when(when, value).otherwise(F.lit(""))
    n = F.col("id")
    df = fx.samples(spark, sf).withColumns({
        "dataset": F.lit("documents"), "source_type": some(n % 2 == 0, F.lit("text")), "image_path": F.col("path"),
        "generator": some(n % 3 == 0, F.col("generator")), "architecture": F.when(n % 5 > 0, F.col("architecture")),
        "prompt": some(n % 7 > 0, F.concat(F.lit("about "), F.col("source"))), "subset": F.concat(F.lit("s"), n % 4),
        "real_source": F.when(F.col("label") == 0, F.col("source")), "format": F.lit("jpg"),
        "distortions": F.array(F.concat(F.lit("d"), n % 3), F.lit("e")), "distortion_scales": F.array(n % 3, F.lit(2).cast("long")),
        "content_id": F.concat(F.lit("c"), n)})
    return df.select("id", F.to_json(I.provenance(dict(df.dtypes), n)).alias("provenance"))


_DIR = "split_part(path, '/', -3)"


@query("label_from_dir_hints", oracle(f"""
    select dir, case when regexp_matches(dir, 'real|coco|nature|auth|photo|human')
                      and not regexp_matches(dir, 'fake|syn|dda|gen|ai|sd|flux') then 'real'
                 when regexp_matches(dir, 'fake|syn|dda|gen|ai|sd|flux') then 'fake' else 'skip' end as class,
           case when regexp_matches(dir, 'raise|real|flickr|coco') then 'real'
                when dir like '%-%' then 'fake/unknown' else 'fake/' || dir end as target, count(*) as n
    from (select lower({_DIR}) as dir from samples) group by all""", "samples"))
def label_from_dir_hints(spark, sf):
    name = F.lower(F.element_at(F.split("path", "/"), -3))
    return fx.samples(spark, sf).select(name.alias("dir")).groupBy("dir").agg(F.count("*").alias("n")).select(
        "dir", L.class_from_dir(F.col("dir")).alias("class"),
        L.class_or_generator(F.col("dir"), F.contains("dir", F.lit("-"))).alias("target"), "n")


@query("clean_only", oracle("select id, label from samples where not is_distorted", "samples"))
def clean_only(spark, sf):
    return fx.samples(spark, sf).where(~F.col("is_distorted")).select("id", "label")


@query("finite", """
    select event_type, count(*) filter (where event_id % 7 > 0 and event_id % 11 > 0) as n_finite,
           round(avg(value) filter (where event_id % 7 > 0 and event_id % 11 > 0), 6) as mean_value
    from events group by event_type""")
def finite(spark, sf):
    raw = (F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 == 0, float("inf"))
           .otherwise(F.col("value")))
    return M.rounded(fx.table(spark, sf, "events").withColumn("v", L.finite(raw)).groupBy("event_type").agg(
        F.count("v").alias("n_finite"), F.avg("v").alias("mean_value")))


# Per-channel mean and deviation.
MEAN, STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]


@query("standardize", oracle("""
    select id, cell, round((x - m) / s, 9) as z, round(least(1.0::double, greatest(0.0::double, ((x - m) / s) * s + m)), 6) as back
    from (select *, ([0.485::double, 0.456::double, 0.406::double])[1 + cell % 3] as m,
                 ([0.229::double, 0.224::double, 0.225::double])[1 + cell % 3] as s from cells)""", "cells"))
def standardize(spark, sf):
    df = fx.pixel_grid(spark, sf).select("id", F.posexplode("grid").alias("cell", "x"))
    m = F.get(F.array(*map(F.lit, MEAN)), F.col("cell") % 3)
    s = F.get(F.array(*map(F.lit, STD)), F.col("cell") % 3)
    z = (F.col("x") - m) / s
    return df.select("id", F.col("cell").cast("long").alias("cell"), F.round(z, 9).alias("z"),
                     F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), z * s + m)), 6).alias("back"))


# --------------------------------------------------------- de-duplication


def prompts(spark, sf, n):
    df = fx.samples(spark, sf).withColumn("prompt", F.col("text"))
    return C.harvest_prompts(df, n, "harvest")


_HARVEST = f"""harvest as (
    select id as key, u, trim(text) as prompt from (
        select *, {u('harvest', 'id')} as u,
               row_number() over (partition by lower(trim(text)) order by {u('harvest', 'id')}, id) as rn
        from samples where label = 1 and not nsfw_flag and length(trim(text)) >= 8)
    where rn = 1)"""


@query("harvest_prompts", oracle(f"""with {_HARVEST}
    select key as id, length(prompt) as n_chars from harvest order by u, key limit 30""", "samples"))
def harvest_prompts(spark, sf):
    return prompts(spark, sf, 30).select(F.col("key").alias("id"), F.length("prompt").cast("long").alias("n_chars"))


@query("harvest_bases", oracle(f"""
    select id as key, printf('real_%06d', row_number() over (order by u, id) - 1) as name from (
        select id, {u('bases', 'id')} as u from samples where label = 0 and n_chars >= 256 order by u, id limit 40)""", "samples"))
def harvest_bases(spark, sf):
    return C.harvest_bases(fx.samples(spark, sf), 40, "bases", "id", F.col("n_chars"), 256).select("key", "name")


@query("exact_dedup", """
    select sha256(text) as content_id, min(doc_id) as doc_id, arg_min(source, doc_id) as source, count(*) as copies
    from documents group by 1""")
def exact_dedup(spark, sf):
    df = fx.table(spark, sf, "documents").withColumn("content_id", F.sha2("text", 256))
    return C.exact_dedup(df, "content_id", "doc_id", ["source"])


@query("skip_present", f"""
    select doc_id from documents where not ({u('done', 'doc_id')} < 0.4 and n_chars > 1024)""")
def skip_present(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    existing = docs.where(uniform("done", F.col("doc_id")) < 0.4).withColumnRenamed("n_chars", "size")
    return C.skip_present(docs.select("doc_id"), existing, "doc_id", "size", 1024)


@query("prompt_assignment", oracle(f"""with {_HARVEST},
    numbered as (select row_number() over (order by u, key) - 1 as slot, key as prompt_key
                 from (select * from harvest order by u, key limit 30))
    select doc_id, prompt_key, floor({u('job', 'doc_id')} * 2147483648.0::double)::bigint as seed
    from documents join numbered on slot = doc_id % (select count(*) from numbered)""", "samples"))
def prompt_assignment(spark, sf):
    jobs = fx.table(spark, sf, "documents").select("doc_id")
    return C.prompt_assignment(jobs, "doc_id", prompts(spark, sf, 30), "job").select("doc_id", "prompt_key", "seed")


HELD_SOURCES = ["src3", "src7", "src11"]


@query("passage_leak_audit", """
    select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text) group by all""")
def passage_leak_audit(spark, sf):
    """Documents that contain a held-out passage, over whole texts."""
    return passage_leaks(fx.table(spark, sf, "documents"), fx.table(spark, sf, "benchmark"), "doc_id", "item_id")


_SHORT_SQL = """
    select item_id, text from benchmark
    union all select item_id + 1000000, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) from benchmark
    union all select item_id + 2000000, split_part(text, ' ', 4) from benchmark"""


@query("short_passage_leak_audit", f"""
    with p as ({_SHORT_SQL}) select item_id, count(*) as n_docs, min(doc_id) as first_doc, max(doc_id) as last_doc
    from (select distinct d.doc_id, p.item_id from documents d join p on p.text <> '' and contains(d.text, p.text)) group by item_id""")
def short_passage_leak_audit(spark, sf):
    """Documents per held-out passage, with one- and two-word passages beside the whole ones."""
    items = fx.table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text")
    word = lambda k: F.coalesce(F.get(F.split("text", " "), F.lit(k)), F.lit(""))
    pairs = items.select((F.col("item_id") + 1_000_000).alias("item_id"), F.concat_ws(" ", word(1), word(2)).alias("text"))
    single = items.select((F.col("item_id") + 2_000_000).alias("item_id"), word(3).alias("text"))
    leaks = passage_leaks(fx.table(spark, sf, "documents"), items.unionByName(pairs).unionByName(single), "doc_id", "item_id")
    return leaks.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("train_heldout_overlap", """
    with d as (select sha256(text) as content_id, source in ('src3', 'src7', 'src11') as held from documents)
    select content_id, count(*) filter (where not held) as train_rows, count(*) filter (where held) as held_rows
    from d group by content_id having count(*) filter (where held) > 0 and count(*) filter (where not held) > 0""")
def train_heldout_overlap(spark, sf):
    df = fx.table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("content_id"))
    held = F.col("source").isin(HELD_SOURCES)
    return C.overlap(df.where(~held), df.where(held), "content_id")


# ------------------------------------------------------------------- joins


@query("score_label_join", oracle("""
    select id, e.label as class, prob from scored join embeddings e on e.vec_id = id""", "scored"))
def score_label_join(spark, sf):
    truth = fx.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("class"))
    return fx.scored(spark, sf).select("id", "prob").join(truth, "id").select("id", "class", "prob")


HELD_SQL = f"{u('hold', 'id')} < 0.2 or source = 'src5'"


@query("holdout_anti_join", oracle(f"""
    with m as (select id, source, ({HELD_SQL}) as held from samples)
    select id, source, held as reused from m
    where not held or source not in (select source from m where not held)""", "samples"))
def holdout_anti_join(spark, sf):
    df = fx.samples(spark, sf).select("id", "source")
    held = df.where((uniform("hold", F.col("id")) < 0.2) | (F.col("source") == "src5")).select("id")
    return C.holdout_anti_join(df, held, "id").select("id", "source", "reused")


def prior_predictions(df):
    pred = F.when(uniform("nullpred", F.col("id")) < 0.1, F.lit(None)).otherwise(F.col("prob"))
    return df.where(uniform("prior", F.col("id")) < 0.6).select("id", pred.alias("pred"))


@query("resume_anti_join", oracle(f"""
    select id, prob from scored_big where not ({u('prior', 'id')} < 0.6 and {u('nullpred', 'id')} >= 0.1)""", "scored_big"))
def resume_anti_join(spark, sf):
    df = fx.scored_big(spark, sf).select("id", "prob")
    return C.resume_anti_join(df, prior_predictions(df), "id")


@query("done_shard_anti_join", oracle("""
    select shard, count(*) as rows from shards where shard % 3 > 0 group by shard""", "shards"))
def done_shard_anti_join(spark, sf):
    """Shards not yet in the ledger; the ledger has one row per shard."""
    df = fx.shards(spark, sf)
    ledger = fx.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("shard"))
    return df.join(ledger, "shard", "left_anti").groupBy("shard").agg(F.count("*").alias("rows"))


# ------------------------------------------------------------ set operations


@query("concat_parts", oracle("""
    select id, 'a' as part, label, null::bigint as n_chars from samples where label is not null
    union all select id, 'b', null, n_chars from samples where label is null
    union all select id, 'c', label, n_chars from samples where label = 1""", "samples"))
def concat_parts(spark, sf):
    s = fx.samples(spark, sf)
    a = s.where("label is not null").select("id", F.lit("a").alias("part"), "label")
    b = s.where("label is null").select("id", F.lit("b").alias("part"), "n_chars")
    c = s.where("label = 1").select("id", F.lit("c").alias("part"), "label", "n_chars")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("union_distinct_ordered", oracle(f"""with {_TOKENS},
    f as (select tokens[1] as name, min(id) as pos from toks where len(tokens) > 0 group by 1),
    s as (select tokens[2] as name, min(id) as pos from toks where len(tokens) > 1 group by 1)
    select name, 0 as part, pos from f union all
    select name, 1, pos from s where name not in (select name from f)""", "samples"))
def union_distinct_ordered(spark, sf):
    t = distorted(spark, sf)
    first = t.where("size(tokens) > 0").select(F.get("tokens", 0).alias("name"), F.col("id").alias("pos"))
    second = t.where("size(tokens) > 1").select(F.get("tokens", 1).alias("name"), F.col("id").alias("pos"))
    return C.union_distinct_ordered(first, second, "name", "pos")


@query("wanted_minus_excluded", oracle("""
    select distinct model from shards where model not in ('m3', 'm17', 'tiny-random-sana')""", "shards"))
def wanted_minus_excluded(spark, sf):
    models = fx.shards(spark, sf).select("model").distinct()
    out = spark.createDataFrame([("m3",), ("m17",), ("tiny-random-sana",)], "model string")
    return models.join(F.broadcast(out), "model", "left_anti")


@query("wanted_subset_caps", oracle("""
    select shard, bool_and(model not in ('m1', 'm2')) as covered, count(distinct model) as wanted
    from shards group by shard""", "shards"))
def wanted_subset_caps(spark, sf):
    """Per shard: is every model on it capped? Models meet caps once each."""
    df = fx.shards(spark, sf).select("shard", "model").distinct()
    caps = df.select("model").distinct().where(~F.col("model").isin("m1", "m2")).withColumn("cap", F.lit(100))
    return df.join(caps, "model", "left").groupBy("shard").agg(
        F.bool_and(F.col("cap").isNotNull()).alias("covered"), F.count("*").alias("wanted"))
