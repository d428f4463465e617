"""Scans, readers and sinks over the given tables and files written from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusbench.functions.identity import content_id
from corpusbench.functions.rng import choice, uniform
from corpusbench.operators import metrics as M
from corpusbench.plans import fixtures as fx
from corpusbench.plans.clean_queries import CONTENT_SQL, RAW_FLAGS, RAW_LABELS, _NORM, _REASON
from corpusbench.plans.fixtures import oracle, pick, u
from corpusbench.plans.metric_queries import metrics_sql
from corpusbench.plans.registry import query
from corpusbench.session import scratch
from corpusbench.sources import files as S
from corpusbench.sources import metrics_json as J
from corpusbench.sources import readers as R
from corpusbench.sources import sinks

EXTS = [".jpg", ".PNG", ".jpeg", ".txt", ".webp", ".gif"]


@query("shard_scan", """
    select doc_id % 12 as shard, count(*) as rows, sum(n_chars)::bigint as chars, doc_id % 12 + 1 as place
    from documents group by doc_id % 12""")
def shard_scan(spark, sf):
    """Shards in nested folders, read recursively; the path is given twice but read once."""
    root = scratch(spark, "shards")
    docs = fx.table(spark, sf, "documents").withColumn("part", F.col("doc_id") % 12)
    docs.write.partitionBy("part").parquet(root)
    scan = S.shard_scan(spark, [root, root]).select(
        F.regexp_extract("_metadata.file_path", r"/(part=\d+)/", 1).alias("folder"), "n_chars")
    per = scan.groupBy("folder").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))
    place = F.row_number().over(Window.orderBy(S.natural_key(F.col("folder"))))
    return per.select(F.substring("folder", 6, 9).cast("long").alias("shard"), "rows", "chars", place.cast("long").alias("place"))


@query("row_count", "select count(*) as rows from lineitem")
def row_count(spark, sf):
    """Rows of a shard set that also holds an unreadable file."""
    root = scratch(spark, "counted")
    line = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    line.write.parquet(f"{root}/good")
    fx.table(spark, sf, "region").select("r_name").write.text(f"{root}/broken")
    return S.row_count(spark, [f"{root}/good", f"{root}/broken"], line.schema)


@query("read_forensics_rows", oracle(f"""
    with raw as (select *, {pick(u('raw', 'id'), RAW_LABELS)} as rl, {pick(u('flag', 'id'), RAW_FLAGS)} as flag from samples)
    select id, case when id % 10 = 0 then 0 when rl in ('1', '0', '2', '-1', ' 07 ') then trim(rl)::int end as label,
           generator, substr(text, 1, 512) as prompt, flag in ('True', '1', 'yes', ' YES') as nsfw_flag, '' as subset,
           {CONTENT_SQL} as content_id
    from raw where id % 10 = 0 or rl in ('1', '0', '2', '-1', ' 07 ')""", "samples"))
def read_forensics_rows(spark, sf):
    s = fx.samples(spark, sf).select(
        F.col("text").alias("image_data"),
        F.when(F.col("id") % 10 > 0, choice(uniform("raw", F.col("id")), RAW_LABELS)).alias("label"),
        F.col("generator").alias("model_name"), "architecture", F.col("id").cast("string").alias("image_name"),
        F.col("text").alias("prompt"), choice(uniform("flag", F.col("id")), RAW_FLAGS).alias("nsfw_flag"))
    return R.forensics_rows(s).select(
        F.col("image_name").cast("long").alias("id"), "label", "generator", "prompt", "nsfw_flag", "subset",
        content_id(F.col("image_bytes")).alias("content_id"))


@query("read_generic_rows", oracle(f"""
    with raw as (select id, text, case when id % 4 = 0 then '' else architecture end as gen,
                        {pick(u('raw', 'id'), RAW_LABELS)} as raw from samples),
    m as (select *, case raw when '2' then 1 when '1' then 0 else {_NORM} end as label from raw)
    select id, label, case when gen = '' then 'docs' else gen end as generator, length(text) as chars
    from m where label = 1""", "samples"))
def read_generic_rows(spark, sf):
    """Text labels with a map and a class filter; an empty generator takes the source name."""
    s = fx.samples(spark, sf).select(
        "text", F.col("id").cast("string").alias("id"), F.when(F.col("id") % 4 == 0, "").otherwise(F.col("architecture")).alias("gen"),
        choice(uniform("raw", F.col("id")), RAW_LABELS).alias("raw"))
    out = R.generic_rows(s, "docs", "text", label_col="raw", generator_col="gen", label_map={"2": 1, 1: 0}, keep_label=1)
    return out.select(F.col("image_name").cast("long").alias("id"), "label", "generator",
                      F.length("image_bytes").cast("long").alias("chars"))


def listing(spark, sf):
    ext = choice(uniform("ext", F.col("id")), EXTS)
    return fx.samples(spark, sf).select("id", "label", F.regexp_replace("path", r"\.jpg$", "").alias("stem"), ext.alias("ext")).select(
        "id", "label", F.concat("stem", "ext").alias("path"))


_LIST = f"""files as (select id, label, replace(path, '.jpg', {pick(u('ext', 'id'), EXTS)}) as path,
    {pick(u('ext', 'id'), EXTS)} as ext from samples)"""


@query("folder_scan", oracle(f"""with {_LIST}
    select path, 1 as label, split_part(path, '/', -2) as generator from files where ext not in ('.txt', '.gif')""", "samples"))
def folder_scan(spark, sf):
    return S.folder_index(listing(spark, sf), F.lit(1), allow_held_out=True)


@query("path_list_scan", oracle(f"with {_LIST} select path from files", "samples"))
def path_list_scan(spark, sf):
    """A written list with padding and blank lines, read back."""
    out = scratch(spark, "list")
    padded = F.concat(F.lit("  "), F.col("path"), F.lit(" "))
    lines = listing(spark, sf).select(F.explode(F.array(padded, F.when(F.col("id") % 3 == 0, "   ").otherwise(""))).alias("value"))
    lines.write.text(out)
    return S.path_list(spark, out)


@query("folder_pair_source", oracle(f"""with {_LIST}
    select path, label, split_part(path, '/', -2) as generator from files
    where label is not null and ext not in ('.txt', '.gif') and {_REASON} is null""", "samples"))
def folder_pair_source(spark, sf):
    files = listing(spark, sf)
    return S.folder_pair(files.where("label = 0"), files.where("label = 1"))


@query("labelled_csv_join", """
    select l.doc_id, quality as label, case when l.doc_id % 3 = 0 then 'images/doc_' || l.doc_id || '.jpg'
           else 'images/nested/doc_' || l.doc_id || '.jpg' end as path
    from labels l join documents d using (doc_id)""")
def labelled_csv_join(spark, sf):
    """Labels through a CSV file; a third of the images are listed flat and nested, and those without a label find none."""
    out = scratch(spark, "csv")
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".jpg"))
    fx.table(spark, sf, "labels").select(name.alias("image_name"), F.col("quality").alias("label")).write.option("header", True).csv(out)
    labels = spark.read.option("header", True).schema("image_name string, label int").csv(out)
    docs = fx.table(spark, sf, "documents")
    nested = docs.select(F.concat(F.lit("images/nested/"), name).alias("path"))
    flat = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("images/"), name).alias("path"))
    joined = R.require_rows(R.labelled_csv_join(labels, nested.unionByName(flat)), "no images match the labels")
    return joined.select(F.regexp_extract("image_name", r"(\d+)", 1).cast("long").alias("doc_id"), "label", "path")


SPLITS = ["train", "train", "train", "val", "val_hard", "test"]


@query("split_select", oracle(f"""
    with s as (select id, is_distorted, {pick(u('split', 'id'), SPLITS)} as split, id % 6 as shard from samples)
    select 'train-all' as selection, count(*) as rows, count(distinct shard) as shards, min(id) as first_id from s where split = 'train'
    union all select 'train', count(*), count(distinct shard), min(id) from s where split = 'train' and shard = 2
    union all select 'val-hard', count(*), count(distinct shard), min(id) from s where split = 'val_hard'
    union all select 'test', count(*), count(distinct shard), min(id) from s where split = 'test' and not is_distorted""", "samples"))
def split_select(spark, sf):
    s = fx.samples(spark, sf).select(
        "id", "is_distorted", choice(uniform("split", F.col("id")), SPLITS).alias("split"), (F.col("id") % 6).alias("shard"))

    def count(name, df):
        return df.agg(F.lit(name).alias("selection"), F.count("*").alias("rows"),
                      F.count_distinct("shard").alias("shards"), F.min("id").alias("first_id"))

    return (count("train-all", R.split_select(s, "train-all"))
            .unionByName(count("train", R.split_select(s, "train", shard=2)))
            .unionByName(count("val-hard", R.split_select(s, "val-hard")))
            .unionByName(count("test", R.split_select(s, "test", clean_only=True))))


@query("archive_member_join", """
    select doc_id, case when doc_id % 4 < 2 then 'model_' || lang when doc_id % 4 = 2 and doc_id % 3 = 0 then 'unknown'
                        when doc_id % 4 = 2 then 'model_' || lang else 'unknown' end as model, doc_id % 4 = 3 as unlabeled
    from documents""")
def archive_member_join(spark, sf):
    docs = fx.table(spark, sf, "documents")
    k, base = F.col("doc_id") % 4, F.concat(F.col("doc_id"), F.lit(".jpg"))
    member = F.concat(F.lit("set/"), base)
    members = docs.select("doc_id", F.col("source").alias("archive"), member.alias("member"))
    model = F.when((k == 2) & (F.col("doc_id") % 3 == 0), "").otherwise(F.concat(F.lit("model_"), F.col("lang")))
    index = docs.where(k < 3).select(
        F.col("source").alias("archive"), F.when(k < 2, member).otherwise(base).alias("member"), model.alias("model"))
    return R.archive_member_join(members, index).select("doc_id", "model", "unlabeled")


@query("listing_sink", """
    select distinct regexp_extract(url, '^https?://([^/]+)/', 1) as host from pages""")
def listing_sink(spark, sf):
    out = scratch(spark, "listing")
    S.write_listing(fx.url_parts(spark, sf), "host", out)
    return spark.read.text(out).select(F.col("value").alias("host"))


@query("url_metadata_scan", oracle("""
    select page_id, url from urls where url like 'http%'
      and not coalesce(try_cast(width as int) < 256 or (try_cast(width as int) is not null and height::int < 256), false)
      and (punsafe = 'n/a' or try_cast(punsafe as double) < 0.5) and pwatermark::double < 0.8""", "urls"))
def url_metadata_scan(spark, sf):
    df = fx.urls(spark, sf).withColumnRenamed("url", "IMAGE_URL").withColumnRenamed("width", "WIDTH")
    return R.url_metadata(df, 256, 0.5, 0.8).select("page_id", F.col("resolved_url").alias("url"))


@query("id_list_scan", f"""
    with ids as (select case when event_id % 4 > 0 then 'train' else 'validation' end as split, event_id::varchar as image_id
                 from events where event_id % 9 > 0),
    r as (select *, row_number() over (partition by split order by {u('ids', 'image_id')}, image_id) as rn from ids)
    select split, image_id from r where split <> 'train' or rn <= 800""")
def id_list_scan(spark, sf):
    out = scratch(spark, "ids")
    k = F.col("event_id")
    fx.table(spark, sf, "events").select(
        F.when(k % 4 > 0, "train").otherwise("validation").alias("split"),
        F.when(k % 9 > 0, F.concat(F.lit(" "), k, F.lit(" "))).otherwise(" ").alias("ImageID"),
    ).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    raw = spark.read.option("header", True).schema("split string, ImageID string").csv(out)
    return R.id_list(raw, {"train": 800})


def metric_bodies(spark, sf):
    """One metrics JSON text per generator, in four layouts."""
    m = M.rounded(M.metrics(fx.scored_big(spark, sf), ["generator"])).withColumn("k", F.substring("generator", 4, 5).cast("int"))
    row = F.struct(*[F.col(c).alias(c) for c in J.COUNTS], *[F.col("ap" if c == "mAP" else c).alias(c) for c in J.RATES])
    root = F.regexp_replace(F.to_json(row), r"\}$", "")
    dataset = F.concat(F.lit("set"), F.col("k"))
    text = (
        F.when(F.col("k") % 4 == 0, F.concat(F.lit('{"dataset":"'), dataset, F.lit('"}')))
        .when(F.col("k") % 4 == 1, F.concat(root, F.lit(',"suite_name":"suite'), F.col("k"), F.lit('","robust_auroc":NaN}')))
        .when(F.col("k") % 4 == 2, F.concat(
            F.lit('{"macro_accuracy":NaN,"dataset":"'), dataset, F.lit('","perturbation_sweep":{"clean":'), F.to_json(row),
            F.lit(',"blur1.0":'), F.to_json(row), F.lit("}}")))
        .otherwise(F.concat(root, F.lit("}"))))
    file = F.when(F.col("k") % 4 == 2, "runs/eval/folders.json").otherwise(F.concat(F.lit("runs/eval/"), F.col("generator"), F.lit(".json")))
    return m.select("generator", "k", file.alias("file"), text.alias("json"))


_NORMED = f"""m as (select *, substr(generator, 4)::int as k from ({metrics_sql('scored_big', 'generator')}))"""


@query("normalize_metrics", oracle(f"""with {_NORMED}
    select case k % 4 when 1 then 'suite' || k when 2 then 'set' || k else generator end as name, 'clean' as perturbation,
           n, macro_accuracy, auroc, ap, null::double as robust_auroc, case when k % 4 = 2 then 2 else 0 end::bigint as nested
    from m where k % 4 > 0""", "scored_big"))
def normalize_metrics(spark, sf):
    records = J.normalize(J.parse(metric_bodies(spark, sf)))
    nested = J.breakdown(records).groupBy("name").agg(F.count("*").alias("nested"))
    return records.join(nested, "name", "left").select(
        "name", "perturbation", "n", "macro_accuracy", "auroc", F.col("mAP").alias("ap"), "robust_auroc",
        F.coalesce("nested", F.lit(0)).alias("nested"))


@query("metrics_json_scan", oracle(f"""with {_NORMED}
    select 'gen' || k as run, case when k % 4 in (1, 3) then n end as n,
           case when k % 4 in (1, 3) then macro_accuracy end as macro_accuracy from m""", "scored_big"))
def metrics_json_scan(spark, sf):
    """One folder per run with a JSON file in it; NaN is read as null."""
    out = scratch(spark, "runs")
    metric_bodies(spark, sf).select("generator", "json").write.partitionBy("generator").text(out)
    found = J.scan(spark, out, limit=30)
    return found.select(
        F.regexp_extract("file", "generator=([^/]+)/", 1).alias("run"), F.col("body.n").alias("n"),
        F.nanvl("body.macro_accuracy", F.lit(None).cast("double")).alias("macro_accuracy"))


@query("predictions_sink", oracle(f"""
    select 'img/' || id as image_path, case when {u('fail', 'id')} >= 0.02 then prob end as pred,
           count(*) over () as n_images, count(case when {u('fail', 'id')} >= 0.02 then prob end) over () as n_scored from scored""", "scored"))
def predictions_sink(spark, sf):
    out = scratch(spark, "predictions")
    df = fx.scored(spark, sf).select(
        F.concat(F.lit("img/"), F.col("id")).alias("image_path"),
        F.when(uniform("fail", F.col("id")) >= 0.02, F.col("prob")).alias("pred"))
    sinks.write_predictions(df, out)
    back = spark.read.schema("image_path string, pred double").json(out)
    head = sinks.run_header(back, res="512")
    return back.withColumn("n_images", head.select("n_images").scalar()).withColumn("n_scored", head.select("n_scored").scalar())


def detailed_predictions(spark, sf):
    """Scored grids with label, size and heat rows; failed ones have neither score nor label."""
    rows = fx.pixel_grid(spark, sf).select("id", "grid").join(fx.scored(spark, sf).select("id", "prob"), "id")
    heat = F.transform(F.sequence(F.lit(0), F.lit(fx.GRID - 1)), lambda r: F.transform(F.slice("grid", r * fx.GRID + 1, fx.GRID), lambda x: F.round(x, 4)))
    ok = lambda c: F.when(uniform("fail", F.col("id")) >= 0.02, c)
    return rows.select(
        F.concat(F.lit("img/"), F.col("id")).alias("image_path"), ok(F.col("prob")).alias("pred"), ok(F.when(F.col("prob") >= 0.5, "AI").otherwise("REAL")).alias("label"),
        F.struct(F.lit(fx.GRID * 16).alias("width"), F.lit(fx.GRID * 16).alias("height")).alias("size"), ok(heat).alias("heatmap"))


DETAIL = "image_path string, pred double, label string, size struct<width int, height int>, heatmap array<array<double>>"


@query("predictions_document", oracle(f"""
    with c as (select id, r, list(round(x, 4) order by c) as line from cells group by id, r),
         h as (select id, list(line order by r) as heatmap from c group by id)
    select 'img/' || id as image_path, case when ok then prob end as pred, case when ok then case when prob >= 0.5 then 'AI' else 'REAL' end end as label,
           128 as width, case when ok then round(list_sum(list_transform(heatmap, lambda l: list_sum(l))), 4) end as heat, case when ok then heatmap[8][1] end as corner,
           count(*) over () as n_images, count(*) filter (where ok) over () as n_scored, count(*) filter (where not ok) over () as n_failed
    from (select *, {u('fail', 'id')} >= 0.02 as ok from scored join h using (id))""", "scored", "cells"))
def predictions_document(spark, sf):
    """The detailed predictions as one JSON document with run metadata and counts, read back line by line."""
    out = scratch(spark, "predictions") + ".json"
    rows = detailed_predictions(spark, sf)
    sinks.write_document(rows, out, sinks.run_header(rows, checkpoint="probe", res="512"), "image_path")
    back, head = sinks.read_document(spark, out, DETAIL)
    heat = F.aggregate(F.flatten("heatmap"), F.lit(0.0), lambda s, x: s + x)
    return back.select("image_path", "pred", "label", F.col("size.width").alias("width"), F.round(heat, 4).alias("heat"), F.get(F.get("heatmap", F.lit(7)), F.lit(0)).alias("corner"),
                       *[F.lit(head[k]).cast("long").alias(k) for k in ("n_images", "n_scored", "n_failed")])
