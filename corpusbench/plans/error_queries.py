"""Error lists, manifests and flag rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusbench.functions.rng import uniform
from corpusbench.operators import errors as E
from corpusbench.operators import metrics as M
from corpusbench.plans import fixtures as fx
from corpusbench.plans.fixtures import oracle, u
from corpusbench.plans.registry import query
from corpusbench.session import scratch

_ERR = """err as (select *, case when label = 0 then 'fp' else 'fn' end as kind,
    case when label = 0 then prob else 1.0::double - prob end as score from {src}
    where (label = 0 and prob >= 0.5) or (label = 1 and prob < 0.5)),
  ranked as (select *, row_number() over (partition by kind order by score desc, id) as rank,
    count(*) over (partition by kind) as total from err)"""
_BIG = _ERR.format(src="(select * exclude (kind) from scored_big)")
_SMALL = _ERR.format(src="scored")


@query("error_topk", oracle(f"""with {_BIG}
    select kind, rank::int as rank, id, prob from ranked where rank <= 25""", "scored_big"))
def error_topk(spark, sf):
    return E.error_topk(fx.scored_big(spark, sf), 25).select("kind", "rank", "id", "prob")


@query("pick_errors", oracle(f"with {_BIG} select kind, id, prob, generator from err", "scored_big"))
def pick_errors(spark, sf):
    """All errors, worst first within a kind: a range-partitioned sort."""
    return E.errors(fx.scored_big(spark, sf)).select("kind", "id", "prob", "generator", "score").orderBy(
        "kind", F.desc("score"), "id").drop("score")


@query("error_cap", oracle(f"""with {_BIG}
    select kind, id, (rank - 1)::int as index, total, least(total, 64) as saved from ranked where rank <= 64""", "scored_big"))
def error_cap(spark, sf):
    return E.error_cap(fx.scored_big(spark, sf), 64).select("kind", "id", "index", "total", "saved")


@query("errors_by_source", oracle(f"with {_BIG} select generator, kind, count(*) as n from err group by all", "scored_big"))
def errors_by_source(spark, sf):
    return E.errors(fx.scored_big(spark, sf)).groupBy("generator", "kind").agg(F.count("*").alias("n"))


@query("error_manifest_sink", oracle(f"""with {_SMALL}
    select kind, 33500 as step, 'val' as split, label, prob, id::varchar as id, generator, architecture, id % 7 > 0 as saved, generator as by,
           kind || '/' || printf('%03d', rank - 1) || '_' || generator || '_vec_' || id || '_p' || printf('%.3f', prob) || '.jpg' as file
    from ranked where rank <= 40""", "scored"))
def error_manifest_sink(spark, sf):
    """JSONL manifest written next to the data and read back; each seventh copy cannot be saved."""
    rows = _manifest(spark, sf)
    path = scratch(spark, "manifest")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


def _manifest(spark, sf):
    capped = E.error_cap(fx.scored(spark, sf), 40)
    return E.manifest(capped, "generator", F.concat(F.lit("vec_"), F.col("id")), 33500, "val", saved=F.col("id") % 7 > 0)


@query("error_manifest_summary", oracle(f"""with {_SMALL},
    m as (select *, id % 7 > 0 as saved from ranked where rank <= 40),
    s as (select generator || '|' || kind as name, count(*) as n from m group by all)
    select 33500 as step, 'val' as split, (select count(*) from err where kind = 'fp') as n_fp, (select count(*) from err where kind = 'fn') as n_fn,
           (select count(*) from m where kind = 'fp' and saved) as saved_fp, (select count(*) from m where kind = 'fn' and saved) as saved_fn,
           40 as max_per_kind, (select string_agg(name || '=' || n, ' ' order by name) from s) as by_source""", "scored"))
def error_manifest_summary(spark, sf):
    """Totals of the manifest; the map of sources is shown as text."""
    found = E.errors(fx.scored(spark, sf))
    shown = F.array_join(F.transform(F.map_entries("by_source"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return E.manifest_summary(found, _manifest(spark, sf), 33500, "val", 40).withColumn("by_source", shown)


@query("flag_rate", oracle(f"""
    with p as (select id, case when {u('fail', 'id')} >= 0.02 then prob end as pred from scored_big)
    select count(pred) as scored, count(*) filter (where pred >= 0.5) as flagged,
           round(count(*) filter (where pred >= 0.5) / greatest(1, count(pred)), 6) as share,
           count(*) filter (where pred < 0.5) as below, count(*) filter (where pred is null) as failed,
           'cannot decode ' || min(id) filter (where pred is null) as first_error from p""", "scored_big"))
def flag_rate(spark, sf):
    failed = uniform("fail", F.col("id")) < 0.02
    df = fx.scored_big(spark, sf).select(
        "id", F.when(~failed, F.col("prob")).alias("pred"),
        F.when(failed, F.concat(F.lit("cannot decode "), F.col("id"))).alias("error"))
    return M.rounded(E.flag_rate(df))
