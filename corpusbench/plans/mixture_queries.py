"""Mixture shares, draws, composites, augmentation plans and source inventories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusbench.functions.permute import Permutation
from corpusbench.functions.rng import choice, uniform
from corpusbench.operators import metrics as M
from corpusbench.operators import mixture as X
from corpusbench.operators.ranking import seeded_row_number
from corpusbench.plans import fixtures as fx
from corpusbench.plans.fixtures import oracle, pick, u
from corpusbench.plans.registry import query
from corpusbench.session import materialize

_CLASSES = """cls as (select *, case when type = 'folders' then
        case when has_real_dirs = has_fake_dirs then [0, 1] when has_real_dirs then [0] else [1] end
      when keep_label is not null then [keep_label]
      when fixed_label is not null and label_col is null then [fixed_label] else [0, 1] end as classes from source_specs)"""
_SHARES = _CLASSES + """, per as (select source, k, greatest(weight, 0) as w,
        greatest(weight, 0) / (select sum(greatest(weight, 0)) from cls) as share, unnest(classes) as label from cls),
    shares as (select *, w / sum(w) over (partition by label) as class_share from per)"""


def specs(spark, sf):
    return X.source_classes(fx.source_specs(spark, sf))


def pool(spark, sf):
    return fx.samples(spark, sf).where("label is not null").select("id", "source", "label")


def draws(spark, sf, per_row=4):
    """Dense draw numbers, four per document (``doc_id`` is dense)."""
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))).alias("j")).select(
        (F.col("doc_id") * per_row + F.col("j")).alias("draw"))


_DRAWS = "draws as (select doc_id * 4 + j as draw from documents, (values (0), (1), (2), (3)) v(j))"


@query("source_classes", oracle(f"""with {_CLASSES}
    select source, type, array_to_string(classes, ',') as classes from cls""", "source_specs"))
def source_classes(spark, sf):
    return specs(spark, sf).select("source", "type", F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"))


@query("class_shares", oracle(f"""with {_SHARES}
    select source, label, round(share, 6) as share, round(class_share, 6) as class_share from shares""", "source_specs"))
def class_shares(spark, sf):
    return M.rounded(X.class_shares(specs(spark, sf)).select("source", "label", "share", "class_share"))


@query("max_share_guard", oracle(f"""with {_SHARES}
    select source, label, round(class_share, 6) as class_share from shares where class_share > 0.08""", "source_specs"))
def max_share_guard(spark, sf):
    """Sources above a share of their class (the fixture's 20 sources need a low bound)."""
    return M.rounded(X.class_shares(specs(spark, sf)).where("class_share > 0.08").select("source", "label", "class_share"))


@query("drop_dead_sources", oracle(f"""with {_CLASSES},
    live as (select * from cls where (case when list_contains(classes, 0) then n_real else 0 end)
       + (case when list_contains(classes, 1) then n_fake else 0 end) > 0),
    per as (select source, k, greatest(weight, 0) as w, unnest(classes) as label from live)
    select source, label, round(w / sum(w) over (partition by label), 6) as class_share from per""", "source_specs"))
def drop_dead_sources(spark, sf):
    live = X.live_sources(specs(spark, sf))
    return M.rounded(X.class_shares(live).select("source", "label", "class_share"))


@query("weighted_range_join", oracle(f"""with {_SHARES}, {_DRAWS},
    cum as (select source, k, sum(share) over (order by k) as hi from (select distinct source, k, share from shares) where share > 0),
    got as (select draw, coalesce(arg_min(source, k) filter (where {u('wr', 'draw')} < hi), arg_max(source, k)) as source
            from draws, cum group by draw)
    select source, count(*) as draws from got group by source""", "source_specs"))
def weighted_range_join(spark, sf):
    """Uniform draws to sources by cumulative weight, counted per source."""
    got = X.weighted_source(draws(spark, sf), X.class_shares(specs(spark, sf)), uniform("wr", F.col("draw")))
    return got.groupBy("source").agg(F.count("*").alias("draws"))


@query("document_range_join", f"""
    with cum as (select doc_id, lang, sum(n_chars) over w::double / sum(n_chars) over (partition by lang) as hi from documents
                 where n_chars > 0 window w as (partition by lang order by doc_id)),
         iv as (select *, coalesce(lag(hi) over (partition by lang order by doc_id), 0) as lo from cum),
         ev as (select event_id, (['de', 'en', 'es', 'fr'])[1 + event_id % 4] as lang, {u('dr', 'event_id')} as uu from events)
    select event_id, doc_id from ev asof join iv on ev.lang = iv.lang and ev.uu >= iv.lo""")
def document_range_join(spark, sf):
    """Every event to a document of its language, in proportion to the documents' lengths: one interval per document."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    bounds = X.count_bounds(docs, ["lang"], ["doc_id"], F.floor(F.col("doc_id") / 4096), "n_chars")
    lang = F.get(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.col("event_id") % 4)
    events = fx.table(spark, sf, "events").select("event_id", lang.alias("lang"))
    bins = max(1, docs.count())
    return X.range_join(events, bounds, uniform("dr", F.col("event_id")), ["lang"], bins, ["doc_id"]).select("event_id", "doc_id")


@query("weighted_pick", oracle(f"""with {_SHARES},
    cum as (select label, source, k, sum(class_share) over (partition by label order by k) as hi from shares where class_share > 0)
    select event_id, arg_min(source, k) filter (where {u('wp', 'event_id')} < hi) as source
    from events join cum on label = (event_type = 'error')::int group by event_id""", "source_specs"))
def weighted_pick(spark, sf):
    steps = X.intervals(X.class_shares(specs(spark, sf)))
    rows = fx.table(spark, sf, "events").select("event_id", (F.col("event_type") == "error").cast("int").alias("label"))
    return X.weighted_pick(rows, steps, uniform("wp", F.col("event_id"))).select("event_id", "source")


_MIX = f"""{_SHARES}, {_DRAWS},
    sizes as (select source, label, count(*) as pool_size from samples where label is not null group by all),
    usable as (select s.source, s.label, k, w, pool_size, w / sum(w) over (partition by s.label) as p
               from shares s join sizes z on z.source = s.source and z.label = s.label),
    cum as (select *, sum(p) over (partition by label order by k) as hi from usable where p > 0),
    coin as (select draw, ({u('mix.class', 'draw')} < 0.5)::int as label, {u('mix.source', 'draw')} as us from draws),
    src as (select draw, coin.label, coalesce(arg_min(source, k) filter (where us < hi), arg_max(source, k)) as source
            from coin join cum on cum.label = coin.label group by all),
    occ as (select *, row_number() over (partition by source, label order by draw) - 1 as occ from src),
    items as (select source, label, id, row_number() over (partition by source, label order by {u('mix.order', 'id')}, id) - 1 as slot
              from samples where label is not null)
"""


@query("mixture_draw", oracle(f"""with {_MIX}
    select o.draw, o.label, o.source, i.id, o.occ // z.pool_size as pass
    from occ o join sizes z on z.source = o.source and z.label = o.label
    join items i on i.source = o.source and i.label = o.label and i.slot = o.occ % z.pool_size""", "source_specs"))
def mixture_draw(spark, sf):
    return X.mixture_draw(draws(spark, sf), pool(spark, sf), X.class_shares(specs(spark, sf)), "mix")


@query("expected_repeats", oracle(f"""with {_SHARES}
    select s.source, s.label, n as pool_size, round((select 4 * count(*) from documents) * 0.5::double * class_share, 6) as expected_draws,
           round((select 4 * count(*) from documents) * 0.5::double * class_share / n, 6) as repeats
    from shares s join (select source, label, count(*) as n from samples where label is not null group by all) z
      on z.source = s.source and z.label = s.label""", "source_specs"))
def expected_repeats(spark, sf):
    n = fx.table(spark, sf, "documents").agg((F.count("*") * 4).alias("n")).scalar()
    sizes = pool(spark, sf).groupBy("source", "label").agg(F.count("*").alias("pool_size"))
    return M.rounded(X.expected_repeats(X.class_shares(specs(spark, sf)), sizes, n).select(
        "source", "label", "pool_size", "expected_draws", "repeats"))


@query("largest_remainder", oracle(f"""with {_SHARES},
    raw as (select source, label, k, 1000.0::double * w / sum(w) over (partition by label) as r from shares),
    f as (select *, floor(r) as whole, row_number() over (partition by label order by r - floor(r) desc, k) as place,
                 1000 - sum(floor(r)) over (partition by label) as spare from raw)
    select source, label, (whole + (place <= spare)::int)::bigint as slots from f""", "source_specs"))
def largest_remainder(spark, sf):
    df = X.class_shares(specs(spark, sf)).withColumn("budget", F.lit(1000.0))
    return X.largest_remainder(df, ["label"], "w", "budget", "k", "slots").select("source", "label", "slots")


@query("epoch_shuffle", f"""
    select event_id, row_number() over (order by {u('1049.3027', 'event_id')}, event_id) as place from events""")
def epoch_shuffle(spark, sf):
    """Seed 40 + 1009 of worker 1, epoch 3 * 1009: the place of every row in its seeded order."""
    df = fx.table(spark, sf, "events").select("event_id")
    return seeded_row_number(df, [], X.epoch_seed(40, 3, worker=1), "event_id", out="place")


def _draw_sql(i: int, half: str) -> str:
    return f"('0x' || substr(md5('40.1.3.0|{i}|' || {half}), 1, 15))::bigint"


def _rounds_sql(source: str) -> str:
    """The six rounds over ``source`` (event_id, x, n, a, b), one subquery each."""
    sql = f"select *, x // b as l, x % b as r from {source}"
    for i in range(6):
        half = f"(l + {_draw_sql(i, 'r')} % a) % a as l, r" if i % 2 == 0 else f"l, (r + {_draw_sql(i, 'l')} % b) % b as r"
        sql = f"select event_id, n, a, b, {half} from ({sql})"
    return f"select event_id, l * b + r as x, n, a, b from ({sql})"


@query("epoch_resume", f"""
    with recursive c as (select count(*) as n, floor(sqrt(count(*)))::bigint as top from events),
    g as (select n, a, (n + a - 1) // a as b from (select n, top, unnest(range(greatest(1, top // 2, top - 50000), top + 1)) as a from c)
          order by (a - n % a) % a, a desc limit 1),
    s as (select event_id, row_number() over (order by event_id) - 1 as x, n, a, b from events, g),
    walk as (select * from ({_rounds_sql('s')}) union all select * from ({_rounds_sql('(select * from walk where x >= n)')}))
    select event_id, x as place from walk where x < n and x >= n * 4 // 10""")
def epoch_resume(spark, sf):
    """Worker 1 resumes epoch 3 after four tenths: the rest of the order, looked up place by place."""
    events = fx.table(spark, sf, "events").select("event_id")
    rows = materialize(X.numbered(events, "event_id", F.floor(F.col("event_id") / 4096)), "epoch-rows")
    n = rows.count()
    return X.epoch_slice(rows, Permutation(n, X.epoch_key(40, 3, worker=1)), n * 4 // 10, n).select("event_id", "place")


BATCH = 64


def batches(spark, sf):
    ranked = seeded_row_number(pool(spark, sf).select("id", "label"), [], "batch", "id", out="rn")
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / BATCH)).drop("rn")


_COMP = f"""b as (select id, label, (row_number() over (order by {u('batch', 'id')}, id) - 1) // 64 as batch
          from samples where label is not null),
    r as (select *, row_number() over (partition by batch, label order by {u('comp.order', 'id')}, id) as rk,
                 label = 1 and {u('comp.pick', 'id')} < 0.6 as chosen from b),
    t as (select batch, count(*) filter (where label = 0) as nr, count(*) filter (where label = 1) as nf,
                 count(*) filter (where chosen) as nc from r group by batch),
    q as (select *, case when nr > 0 then nc // 3 + (nc % 3 > 0)::int else 0 end as q1,
                 case when nr > 0 then nc // 3 + (nc % 3 > 1)::int else 0 end as q2,
                 least(nr, round_even(nc / 3.0::double, 0)::bigint) as qr from t),
    c as (select r.*, nr, nf, case
            when chosen and place <= q1 then 'fake_on_real' when chosen and place <= q1 + q2 then 'real_on_fake'
            when chosen then 'fake_on_fake' when label = 0 and rk <= qr and nr > 1 then 'real_on_real' end as combo
          from (select *, sum(chosen::int) over (partition by batch, label order by rk) as place from r) r join q using (batch)),
    s as (select *, (combo = 'fake_on_fake')::int as pc,
            case when combo = 'real_on_real' then
                   case when floor({u('comp.partner', 'id')} * (nr - 1)) + 1 >= rk then floor({u('comp.partner', 'id')} * (nr - 1)) + 2
                        else floor({u('comp.partner', 'id')} * (nr - 1)) + 1 end
                 when combo = 'fake_on_fake' then floor({u('comp.partner', 'id')} * nf) + 1
                 else floor({u('comp.partner', 'id')} * nr) + 1 end as slot
          from c where combo is not null),
    plan as (select s.batch, s.id, s.label, s.combo, p.id as partner,
                    (floor({u('comp.overlays', 's.id')} * 3.0::double) + 1)::bigint as overlays
             from s join r p on p.batch = s.batch and p.label = s.pc and p.rk = s.slot)"""


@query("composite_plan", oracle(f"with {_COMP} select * from plan", "samples"))
def composite_plan(spark, sf):
    return X.composite_plan(batches(spark, sf), "comp", "id", "batch")


@query("draws_udtf", oracle(f"""with {_COMP}
    select id, combo, overlay::int as overlay, case when overlay = 1 then (combo in ('fake_on_real', 'fake_on_fake'))::int
           when combo = 'real_on_real' then 0 else ({u('ov.later', "id || '|' || overlay")} < 0.5)::int end as top_class
    from (select *, unnest(range(1, overlays + 1)) as overlay from plan)""", "samples"))
def draws_udtf(spark, sf):
    """One row per overlay by a Python table function; tests compare it with the generator form."""
    spark.udtf.register("overlay_rows", X.overlay_table_function("ov"))
    return spark.sql("select p.id, p.combo, o.overlay, o.top_class from {plan} p, lateral overlay_rows(p.id, p.combo, p.overlays) o",
                     plan=composite_plan(spark, sf))


def _aug_sql() -> str:
    parts = []
    for name, (prob, levels) in X.AUGMENT.items():
        param = f"{pick(u(f'aug.{name}.p', 'vec_id'), levels)}::double" if levels else "null::double"
        parts.append(f"select vec_id, '{name}' as slot, '{name}' as kind, {param} as param from embeddings "
                     f"where {u(f'aug.{name}', 'vec_id')} < {prob}")
    parts.append(f"select vec_id, 'crop', case when {u('aug.crop', 'vec_id')} < 0.15 then 'center_crop' else 'random_crop' end, null from embeddings")
    parts.append(f"select vec_id, 'codec', 'jpeg', {pick(u('aug.codec.p', 'vec_id'), X.JPEG_QUALITY)}::double from embeddings where {u('aug.codec', 'vec_id')} < 0.7")
    parts.append(f"select vec_id, 'codec', 'webp', {pick(u('aug.codec.p', 'vec_id'), X.WEBP_QUALITY)}::double from embeddings "
                 f"where {u('aug.codec', 'vec_id')} >= 0.7 and {u('aug.codec', 'vec_id')} < 0.7::double + 0.18::double")
    for i in range(X.EXTRA_MAX):
        parts.append(f"select vec_id, 'extra{i}', {pick(u(f'aug.extra{i}', 'vec_id'), X.EXTRA_KINDS)}, null from embeddings "
                     f"where {u('aug.extra', 'vec_id')} < 0.55 and floor({u('aug.extra.n', 'vec_id')} * 4) + 1 > {i}")
    return " union all ".join(parts)


@query("augment_plan", _aug_sql())
def augment_plan(spark, sf):
    return X.augment_plan(fx.table(spark, sf, "embeddings").select("vec_id"), "aug", "vec_id")


# --------------------------------------------------------------- inventory


@query("source_inventory", oracle("""
    select coalesce(source, '(all)') as source, grouping(source)::int as is_total, sum(n_fake)::bigint as fake,
           sum(n_real)::bigint as real, sum(n_unused)::bigint as unused, sum(n_total)::bigint as total
    from source_specs group by rollup (source)""", "source_specs"))
def source_inventory(spark, sf):
    s = fx.samples(spark, sf)
    return s.rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"), F.count_if(F.col("label") == 1).alias("fake"),
        F.count_if(F.col("label") == 0).alias("real"), F.count_if(F.col("label").isNull()).alias("unused"),
        F.count("*").alias("total")).withColumn("source", F.coalesce("source", F.lit("(all)")))


@query("generator_breadth", """
    with g as (select lang, source, count(*) as n from documents group by all)
    select lang, count(*) as generators, count(*) filter (where n > 6) as named, count(*) filter (where n <= 6) as tail,
           coalesce(sum(n) filter (where n > 6), 0)::bigint as named_rows, coalesce(sum(n) filter (where n <= 6), 0)::bigint as tail_rows
    from g group by lang""")
def generator_breadth(spark, sf):
    """Named and long-tail generators per family; counts per generator are taken first."""
    g = fx.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    named = F.col("n") > 6
    return g.groupBy("lang").agg(
        F.count("*").alias("generators"), F.count_if(named).alias("named"), F.count_if(~named).alias("tail"),
        F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).alias("named_rows"),
        F.coalesce(F.sum(F.when(~named, F.col("n"))), F.lit(0)).alias("tail_rows"))


@query("epoch_steps", oracle("""
    with s as (select type, case when type <> 'hf' then case when type = 'comfor' then least(n_total, 30) else n_total end end as n
               from source_specs)
    select 'known' as mixture, sum(n)::bigint as rows, greatest(1, sum(n)::bigint // 8) as steps from s where type <> 'hf'
    union all select 'all', null, null from s having count(*) filter (where n is null) > 0""", "source_specs"))
def epoch_steps(spark, sf):
    """Steps per epoch at batch 8; null once the size of any source is unknown."""
    n = F.when(F.col("type") != "hf", F.when(F.col("type") == "comfor", F.least("n_total", F.lit(30))).otherwise(F.col("n_total")))
    s = fx.source_specs(spark, sf).select("type", n.alias("n"))
    unknown = F.count_if(F.col("n").isNull()) > 0

    def steps(df, name):
        return df.agg(F.lit(name).alias("mixture"), F.when(~unknown, F.sum("n")).alias("rows")).select(
            "mixture", "rows", F.greatest(F.lit(1), F.floor(F.col("rows") / 8)).alias("_s")).select(
            "mixture", "rows", F.when(F.col("rows").isNotNull(), F.col("_s")).alias("steps"))

    return steps(s.where("type <> 'hf'"), "known").unionByName(steps(s, "all"))
