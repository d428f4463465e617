"""Caps, budgets, strides and stratified selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusbench.operators import caps as K
from corpusbench.operators import metrics as M
from corpusbench.operators import mixture as X
from corpusbench.plans import fixtures as fx
from corpusbench.plans.fixtures import oracle, u
from corpusbench.plans.registry import query


def model_caps(spark, sf):
    """Caps per model, from the models seen in the shards; three models are not wanted."""
    models = fx.shards(spark, sf).select("model").distinct()
    k = F.substring("model", 2, 5).cast("int")
    return models.where(k < 27).select("model", F.when(k % 5 != 4, (k * 7) % 40).alias("cap"))


_CAPS = """caps as (select distinct model, case when substr(model, 2)::int % 5 <> 4
    then (substr(model, 2)::int * 7) % 40 end as cap from shards where substr(model, 2)::int < 27)"""
_STATUS = f"""{_CAPS}, run as (
    select s.*, c.model is not null as wanted, coalesce(c.cap, 20) as cap,
           coalesce(sum((s.label = 'fake' and c.model is not null and s.bytes >= 50000 and side >= 200)::int) over (
             partition by s.model order by shard, pos rows between unbounded preceding and 1 preceding), 0) as used
    from shards s left join caps c using (model)),
    status as (select *, case when label <> 'fake' then 'skip_label' when not wanted then 'skip_model'
       when cap > 0 and used >= cap then 'skip_cap' when bytes < 50000 then 'skip_bad'
       when side < 200 then 'skip_small' else 'kept' end as status from run)"""


def scanned(spark, sf, rows=None):
    return K.scan_status(fx.shards(spark, sf) if rows is None else rows, model_caps(spark, sf), "shard", "pos", ["fake"],
                         F.col("bytes") >= 50000, F.col("side") < 200, default_cap=20)


@query("per_model_cap", oracle(f"""with {_CAPS},
    ok as (select * from shards where label = 'fake' and bytes >= 50000 and side >= 200)
    select model, shard, pos, taken from (
        select ok.*, coalesce(cap, 20) as cap, row_number() over (partition by model order by shard, pos) as taken
        from ok join caps using (model)) where cap = 0 or taken <= cap""", "shards"))
def per_model_cap(spark, sf):
    ok = fx.shards(spark, sf).where("label = 'fake' and bytes >= 50000 and side >= 200")
    return K.per_model_cap(ok, model_caps(spark, sf), "shard", "pos", default_cap=20).select(
        "model", "shard", "pos", "taken")


@query("cap_report", oracle(f"""with {_STATUS},
    per as (select shard, count(*) as rows, count(*) filter (where status = 'kept') as kept,
      count(*) filter (where status = 'skip_model') as skip_model, count(*) filter (where status = 'skip_cap') as skip_cap,
      count(*) filter (where status = 'skip_small') as skip_small, count(*) filter (where status = 'skip_bad') as skip_bad,
      coalesce(sum(bytes) filter (where status = 'kept'), 0)::bigint as bytes,
      count(distinct model) filter (where status = 'kept') as models from status group by shard)
    select *, (sum(kept) over (order by shard))::bigint as kept_so_far, (sum(bytes) over (order by shard))::bigint as bytes_so_far
    from per""", "shards"))
def cap_report(spark, sf):
    return K.cap_report(scanned(spark, sf), "shard")


@query("caps_satisfied", oracle(f"""with {_STATUS},
    n as (select model, count(*) filter (where status = 'kept') as n from status group by model)
    select count(*) as caps, (select count(distinct model) from shards where model not in (select model from caps)) as uncapped_wanted,
           bool_and(coalesce(n, 0) >= coalesce(cap, 0))
             and (select count(distinct model) from shards where model not in (select model from caps)) = 0 as satisfied
    from caps left join n using (model)""", "shards"))
def caps_satisfied(spark, sf):
    fakes = fx.shards(spark, sf).where("label = 'fake'")  # no other row is kept or counts
    counts = scanned(spark, sf, fakes).where("status = 'kept'").groupBy("model").agg(F.count("*").alias("n"))
    caps = model_caps(spark, sf).withColumn("cap", F.coalesce("cap", F.lit(0)))
    wanted = fx.shards(spark, sf).select("model").distinct()
    return K.caps_satisfied(caps, counts, wanted)


_RANK = """rank as (select generator as model, sum((label = 1 and prob >= 0.5)::int)::double / sum(label) as recall_mean
    from scored_big group by generator)"""
TIERS = [(0.765, 300), (0.77, 200), (0.775, 100)]
_TIER = "case when recall_mean < 0.765 then 300 when recall_mean < 0.77 then 200 when recall_mean < 0.775 then 100 end"


def ranked(spark, sf):
    return M.metrics(fx.scored_big(spark, sf), ["generator"], curves=False).select(
        F.col("generator").alias("model"), F.col("recall").alias("recall_mean"))


@query("tier_caps", oracle(f"""with {_RANK}
    select model, {_TIER} as cap from rank where model <> 'gen4' and {_TIER} is not null""", "scored_big"))
def tier_caps(spark, sf):
    """Harder generators get more rows; the bounds are picked for this fixture."""
    return K.tier_caps(ranked(spark, sf), TIERS, ["gen4"])


@query("cap_merge", oracle(f"""with {_RANK}, t as (select model, {_TIER} as cap from rank
      where model <> 'gen4' and {_TIER} is not null),
    o as (select distinct generator as model, substr(generator, 4)::int * 10 as override from scored_big
          where substr(generator, 4)::int % 6 = 4)
    select coalesce(t.model, o.model) as model, coalesce(override, greatest(cap, 150)) as cap
    from t full join o on t.model = o.model""", "scored_big"))
def cap_merge(spark, sf):
    k = F.substring("generator", 4, 5).cast("int")
    over = fx.scored_big(spark, sf).where(k % 6 == 4).select(
        F.col("generator").alias("model"), (k * 10).alias("override")).distinct()
    return K.cap_merge(tier_caps(spark, sf), 150, over)


# -------------------------------------------------------------- selections


@query("stratified_round_robin", oracle(f"""
    select generator, id from (select generator, id, row_number() over (
        partition by generator order by {u('rr', 'id')}, id) as turn from samples)
    order by turn, generator limit 333""", "samples"))
def stratified_round_robin(spark, sf):
    return K.stratified_round_robin(fx.samples(spark, sf), 333, "generator", "rr", "id").select("generator", "id")


@query("class_budget", oracle(f"""
    with r as (select label, generator, id, row_number() over (partition by label, generator order by {u('cb', 'id')}, id) as turn
               from samples where label is not null),
    p as (select *, row_number() over (partition by label order by turn, generator) as place from r)
    select label, generator, id, place from p where place <= case when label = 0 then 46 else 45 end""", "samples"))
def class_budget(spark, sf):
    df = fx.samples(spark, sf).where("label is not null")
    return K.class_budget(df, 91, "label", "generator", "cb", "id").select("label", "generator", "id", "place")


@query("balanced_subset", oracle(f"""
    with c as (select id, label, row_number() over (partition by label order by {u('bal', 'id')}, id) as rn
               from samples where label is not null and not is_distorted)
    select id, label from c where rn <= least(50, (select count(*) from c where label = 0), (select count(*) from c where label = 1))""",
    "samples"))
def balanced_subset(spark, sf):
    df = fx.samples(spark, sf).where("label is not null and not is_distorted")
    return K.balanced_subset(df, 100, "label", "bal", "id").select("id", "label")


@query("source_val_slice", oracle(f"""
    with q as (select source, k, case when type = 'folders' then
                   case when has_real_dirs = has_fake_dirs then [0, 1] when has_real_dirs then [0] else [1] end
                 when keep_label is not null then [keep_label]
                 when fixed_label is not null and label_col is null then [fixed_label] else [0, 1] end as classes,
               row_number() over (order by k) as pos, count(*) over () as n_src from source_specs),
    w as (select source, classes, greatest(1, 210 // n_src) + (pos <= 210 - (210 // n_src) * n_src)::int as want from q),
    x as (select source, unnest(classes) as label, len(classes) as nc, want from w),
    y as (select source, label, case when nc < 2 then want when label = 0 then (want + 1) // 2 else want // 2 end as quota from x),
    s as (select id, source, label, row_number() over (partition by source, label order by {u('val', 'id')}, id) as rn
          from samples where label is not null)
    select id, s.source, s.label from s join y on y.source = s.source and y.label = s.label where rn <= quota""",
    "source_specs"))
def source_val_slice(spark, sf):
    specs = X.source_classes(fx.source_specs(spark, sf))
    df = fx.samples(spark, sf).where("label is not null").select("id", "source", "label")
    return K.source_val_slice(df, K.val_quotas(specs, 210), "val", "id").select("id", "source", "label")


@query("shard_stride", """
    select s_suppkey as shard, s_suppkey >= 5 and (s_suppkey - 5) % 4 = 0 and (s_suppkey - 5) // 4 < 20 as strided,
           s_suppkey between 70 and 93 or (s_suppkey < 70 and s_suppkey % 3 = 0)
             or (s_suppkey > 93 and (s_suppkey - 94) % 3 = 0) as covering
    from supplier""")
def shard_stride(spark, sf):
    df = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("shard"))
    a = K.shard_stride(df, "shard", 4, 5, 20).select("shard", F.lit(True).alias("a"))
    b = K.coverage_shards(df, "shard", 3).select("shard", F.lit(True).alias("b"))
    return df.join(a, "shard", "left").join(b, "shard", "left").select(
        "shard", F.coalesce("a", F.lit(False)).alias("strided"), F.coalesce("b", F.lit(False)).alias("covering"))


@query("mod_shard", "select doc_id, ((row_number() over (order by doc_id) - 1) % 7)::int as worker from documents")
def mod_shard(spark, sf):
    df = fx.table(spark, sf, "documents").select("doc_id")
    return K.mod_shard(df, "doc_id", F.floor(F.col("doc_id") / 4096), 7)


@query("limit_n", "select event_id, value from events order by value desc, event_id limit 100")
def limit_n(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(100)


@query("budget_cap", oracle("""
    select shard, pos, bytes from (select *, coalesce(sum(bytes) over w, 0) as b, count(*) over w as n from shards
        window w as (order by shard, pos rows between unbounded preceding and 1 preceding))
    where b < 2000000000 and n < 9000""", "shards"))
def budget_cap(spark, sf):
    return K.budget_cap(fx.shards(spark, sf), "shard", "pos", "bytes", 9000, 2_000_000_000).select(
        "shard", "pos", "bytes")


@query("bernoulli_subsample", f"""
    select event_id from events where {u('bern', 'event_id')} <= 0.35 order by {u('bern.order', 'event_id')}, event_id limit 2000""")
def bernoulli_subsample(spark, sf):
    return K.bernoulli_subsample(fx.table(spark, sf, "events").select("event_id"), 0.35, "bern", "event_id", 2000)


@query("interleave", oracle(f"""
    with r as (select id, label, row_number() over (partition by label order by {u('inter', 'id')}, id) as rn
               from samples where label is not null)
    select id, label, row_number() over (order by rn, label) - 1 as position from r""", "samples"))
def interleave(spark, sf):
    df = fx.samples(spark, sf).where("label is not null").select("id", "label")
    return K.interleave(df, "label", "inter", "id").select("id", "label", "position")


@query("class_mix_pick", oracle("""
    with r as (select id, label, row_number() over (partition by label order by id) as rn from samples where label is not null)
    select id, label from r order by case when rn <= 200 then 1 - (label = 0)::int else 2 end, id limit 400""", "samples"))
def class_mix_pick(spark, sf):
    df = fx.samples(spark, sf).where("label is not null").select("id", "label")
    return K.class_mix_pick(df, 400, "label", "id", F.floor(F.col("id") / 4096)).select("id", "label")


@query("train_cap", f"""
    select user_id, event_id, event_type from (select *, row_number() over (partition by event_type order by {u('cap', 'event_id')}, event_id) as rn
        from events) where event_type <> 'view' or rn <= 500""")
def train_cap(spark, sf):
    df = fx.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return K.split_cap(df, "event_type", {"view": 500}, "cap", "event_id").drop("rn")
