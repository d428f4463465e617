"""Audits: column statistics, balance, confounds, headers, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusbench.functions import headers as H
from corpusbench.functions.rng import choice, uniform
from corpusbench.operators import audit as A
from corpusbench.operators import caps as K
from corpusbench.operators import metrics as M
from corpusbench.operators import sketches as S
from corpusbench.plans import fixtures as fx
from corpusbench.plans.fixtures import oracle, pick, u
from corpusbench.plans.registry import query
from corpusbench.session import materialize, scratch
from corpusbench.sources import sinks


@query("class_balance", oracle("""
    select architecture, count(*) as total, count(*) filter (where label = 0) as real, count(*) filter (where label = 1) as fake,
           round(100.0::double * count(*) filter (where label = 1) / count(*), 1) as fake_pct,
           count(*) filter (where is_distorted) as distorted from samples group by architecture""", "samples"))
def class_balance(spark, sf):
    df = fx.samples(spark, sf).withColumn("label", F.concat(F.col("label"), F.lit(" ")))
    return A.class_balance(df, "architecture")


STAT_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_tax"]
_KINDS = ["string", "string", "int", "bigint", "bigint", "double", "double"]


def _stats_sql() -> str:
    parts = " union all ".join(
        f"select '{c}' as \"column\", '{k}' as type, {c}::varchar as value, {f'{c}::double' if k != 'string' else 'null::double'} as x from lineitem"
        for c, k in zip(STAT_COLUMNS, _KINDS))
    return f"""with l as ({parts}),
      c as (select "column", value, count(*) as n from l group by all),
      t as (select "column", string_agg(value || '=' || n, ' ' order by n desc, value) as top_values
            from (select *, row_number() over (partition by "column" order by n desc, value) as r from c) where r <= 12 group by "column")
      select l."column", type, count(distinct value) as n_unique, min(x) as min, max(x) as max, sum(x::decimal(30,10))::varchar::double / count(x) as mean,
             count(*) filter (where value is null) as nan_count, any_value(top_values) as top_values
      from l join t on t."column" = l."column" group by l."column", type"""


@query("column_statistics", _stats_sql())
def column_statistics(spark, sf):
    return M.rounded(A.column_statistics(fx.table(spark, sf, "lineitem"), STAT_COLUMNS), skip=("mean",))


SKETCH_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_tax"]


def _sketch_sql() -> str:
    parts = " union all ".join(f"select '{c}' as \"column\", {c}::varchar as value, {f'{c}::double' if c not in SKETCH_COLUMNS[:2] else 'null::double'} as x from lineitem"
                               for c in SKETCH_COLUMNS)
    return f"""with l as ({parts}), c as (select "column", value, count(*) as n from l where value is not null group by all),
      t as (select "column", string_agg(value || '=' || n, ' ' order by n desc, value) as top_values
            from (select *, row_number() over (partition by "column" order by n desc, value) as r from c) where r <= 12 group by "column")
      select l."column", count(*) as n, count(*) filter (where value is null) as nan_count, min(x) as min, max(x) as max, count(distinct value) as n_unique,
             any_value(top_values) as top_values from l join t on t."column" = l."column" group by l."column\""""


@query("sketched_statistics", _sketch_sql())
def sketched_statistics(spark, sf):
    """Statistics from sketches kept per supplier and merged; these columns have so few values that the estimates are exact."""
    kept = materialize(S.shard_sketches(fx.table(spark, sf, "lineitem"), "l_suppkey", SKETCH_COLUMNS), "sketches")
    return S.sketch_statistics(S.merge_sketches(kept)).drop("quantiles")


_CONF = """select feature, value, fake, real, round(greatest(b, 1 - b), 6) as balanced_accuracy,
    case when b >= 0.5 then 'fake' else 'real' end as means, false as single_class
    from (select *, 0.5::double * (fake::double / sum(fake) over (partition by feature) + 1 - real::double / sum(real) over (partition by feature)) as b
          from (select feature, value, count(*) filter (where label = 1) as fake, count(*) filter (where label = 0) as real from f group by all))"""


@query("confound_audit", oracle(f"""with f as (
    select label, 'architecture' as feature, architecture as value from samples union all
    select label, 'source', source from samples union all select label, 'is_distorted', is_distorted::varchar from samples)
    {_CONF}""", "samples"))
def confound_audit(spark, sf):
    return M.rounded(A.confound_audit(fx.samples(spark, sf), ["architecture", "source", "is_distorted"]))


@query("meta_index", oracle("""
    select label, model, count(*) as n_sampled,
           round_even(count(*) * ((select count(distinct s_suppkey) from supplier)::double
             / (select count(*) from supplier where s_suppkey % 7 = 3)), 0)::bigint as n_estimated_total
    from shards where shard % 7 = 3 group by all""", "shards"))
def meta_index(spark, sf):
    shards = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("shard"))
    return A.meta_index(fx.shards(spark, sf), K.shard_stride(shards, "shard", 7, 3), shards)


# ------------------------------------------------------------------ headers


def images(spark, sf):
    """Byte strings with hand-made headers in front of the document text."""
    k = F.col("doc_id")
    w = (F.floor(uniform("iw", k) * 2000) + 1).cast("int")
    h = (F.floor(uniform("ih", k) * 2000) + 1).cast("int")
    kind = choice(uniform("fmt", k), ["png", "gif", "jpg", "vp8x", "vp8", "vp8l", "none"])

    def be(x, n):
        return F.lpad(F.hex(x), 2 * n, "0")

    def le(x, n):
        t = be(x, n)
        return F.concat(*[F.substring(t, 2 * n - 1 - 2 * i, 2) for i in range(n)])

    riff = F.concat(F.lit("52494646"), F.lit("00000000"), F.lit("57454250"))
    packed = (w - 1) + (h - 1) * 16384
    header = (
        F.when(kind == "png", F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4), F.lit("0802000000")))
        .when(kind == "gif", F.concat(F.lit("474946383961"), le(w, 2), le(h, 2)))
        .when(kind == "jpg", F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), be(h, 2), be(w, 2), F.lit("0300")))
        .when(kind == "vp8x", F.concat(riff, F.lit("56503858"), F.lit("0A00000000000000"), le(w - 1, 3), le(h - 1, 3)))
        .when(kind == "vp8", F.concat(riff, F.lit("56503820"), F.lit("00000000000000009D01"), le(w, 2), le(h, 2)))
        .when(kind == "vp8l", F.concat(riff, F.lit("5650384C"), F.lit("000000002F"), le(packed, 4)))
        .otherwise(F.lit("00"))
    )
    return fx.table(spark, sf, "documents").select(
        "doc_id", "source", w.alias("w"), h.alias("h"), kind.alias("kind"),
        F.concat(F.unhex(header), F.encode("text", "utf-8")).alias("content"))


_IMG = f"""img as (select doc_id, source, text, (floor({u('iw', 'doc_id')} * 2000) + 1)::int as w,
    (floor({u('ih', 'doc_id')} * 2000) + 1)::int as h,
    {pick(u('fmt', 'doc_id'), ['png', 'gif', 'jpg', 'vp8x', 'vp8', 'vp8l', 'none'])} as kind from documents),
  sized as (select *, strlen(text) + case kind when 'png' then 29 when 'gif' then 10 when 'jpg' then 31 when 'vp8x' then 30
      when 'vp8' then 30 when 'vp8l' then 25 else 1 end as bytes,
      case when kind in ('png', 'gif', 'jpg') then kind when kind like 'vp8%' then 'webp' end as format from img)"""


@query("magic_type", f"""with {_IMG}
    select doc_id, case when bytes >= 2048 and format <> 'gif' then format end as type,
           kind = 'jpg' and bytes > 1024 as is_jpeg from sized""")
def magic_type(spark, sf):
    return images(spark, sf).select("doc_id", H.magic_type(F.col("content")).alias("type"), H.is_jpeg(F.col("content")).alias("is_jpeg"))


def measured(spark, sf):
    df = images(spark, sf).withColumn("format", H.container(F.col("content")))
    return df.withColumn("size", H.image_size(F.col("content"), F.col("format"))).select(
        "doc_id", "source", "format", F.col("size.width").alias("width"), F.col("size.height").alias("height"))


@query("header_audit", f"""with {_IMG}
    select source, format, case when format is not null then least(w, h) // 500 end as size_bucket, count(*) as n,
           sum(case when format is not null then w end)::bigint as width_sum, sum(case when format is not null then h end)::bigint as height_sum
    from sized group by all""")
def header_audit(spark, sf):
    df = measured(spark, sf)
    return df.groupBy("source", "format", F.floor(F.least("width", "height") / 500).alias("size_bucket")).agg(
        F.count("*").alias("n"), F.sum("width").alias("width_sum"), F.sum("height").alias("height_sum"))


@query("reencode_triage", f"""with {_IMG}
    select class, count(*) as n from (select case when format is null then 0 when least(w, h) < 256 then -1
        when format = 'jpg' and doc_id % 3 > 0 and greatest(w, h) <= 1536 then 1 else 2 end as class from sized) group by class""")
def reencode_triage(spark, sf):
    mode = F.when(F.col("doc_id") % 3 > 0, "RGB").otherwise("CMYK")
    return measured(spark, sf).groupBy(H.triage(
        F.col("format"), mode, F.col("width"), F.col("height"), 1536, 256).alias("class")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- inventory


@query("materialize_slice", oracle("""
    select label, generator, count(*) as rows, max(length(prompt)) as longest from (
        select coalesce(label, -1) as label, generator, substr(text, 1, 200) as prompt from samples order by id limit 500)
    group by all""", "samples"))
def materialize_slice(spark, sf):
    """First 500 rows laid out by label and generator, then read back by partition."""
    first = fx.samples(spark, sf).orderBy("id").limit(500).select(
        F.coalesce("label", F.lit(-1)).alias("label"), "generator", "id", F.substring("text", 1, 200).alias("prompt"))
    path = scratch(spark, "slice")
    first.write.partitionBy("label", "generator").parquet(path)
    back = spark.read.schema("id long, prompt string, label int, generator string").parquet(path)
    return back.groupBy("label", "generator").agg(
        F.count("*").alias("rows"), F.max(F.length("prompt")).cast("long").alias("longest"))


@query("slices_by_shard", oracle("""
    select coalesce(label, -1) as label, generator, (id % 6)::int as shard, count(*) as rows, max(length(substr(text, 1, case when id % 6 = 3 then 120 else 200 end))) as longest
    from samples where id % 6 <> 3 or id % 2 = 1 group by all""", "samples"))
def slices_by_shard(spark, sf):
    """All samples by label, generator and shard; shard 3 is pulled again with shorter prompts and odd ids only, which replaces it."""
    rows = fx.samples(spark, sf).select(F.coalesce("label", F.lit(-1)).alias("label"), "generator", (F.col("id") % 6).cast("int").alias("shard"), "id", F.substring("text", 1, 200).alias("prompt"))
    path = scratch(spark, "slices")
    sinks.write_slices(rows, path, list(range(6)), rows_per_file=10_000)
    again = rows.where("shard = 3 and id % 2 = 1").withColumn("prompt", F.substring("prompt", 1, 120))
    sinks.write_slices(again, path, [3], rows_per_file=10_000)
    back = spark.read.schema("id long, prompt string, label int, generator string, shard int").parquet(path)
    return back.groupBy("label", "generator", "shard").agg(F.count("*").alias("rows"), F.max(F.length("prompt")).cast("long").alias("longest"))


@query("file_inventory", """
    with f as (select 'lang=' || lang as folder, sum(strlen(replace(text, chr(10), ' ')) + 1)::bigint as bytes from documents group by lang, doc_id % 16),
         r as (select *, row_number() over (partition by folder order by bytes desc) as place from f)
    select folder, count(*) as files, sum(bytes)::bigint as bytes, max(bytes) as largest, count(*) filter (where place <= 12) as listed,
           string_agg(bytes::varchar, ' ' order by bytes desc) filter (where place <= 12) as top_files
    from r group by folder""")
def file_inventory(spark, sf):
    """Files, bytes and the largest files per folder of a written corpus; contents are not read."""
    path = scratch(spark, "inventory")
    docs = fx.table(spark, sf, "documents").select("lang", (F.col("doc_id") % 16).alias("slot"), F.translate("text", "\n", " ").alias("value"))
    docs.repartition("lang", "slot").write.partitionBy("lang", "slot").text(path)
    from corpusbench.sources.files import list_files

    files = list_files(spark, path, ["txt"]).withColumn("folder", F.regexp_extract("path", "/([^/]+)/[^/]+/[^/]+$", 1))
    sizes = F.array_join(F.transform("top_files", lambda x: x["length"].cast("string")), " ")
    return A.file_inventory(files, "folder").withColumn("top_files", sizes)
