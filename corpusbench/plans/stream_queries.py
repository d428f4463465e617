"""Streams over shard files written from the tables; results equal the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusbench.functions.rng import uniform
from corpusbench.operators import curation as C
from corpusbench.operators import metrics as M
from corpusbench.operators import sweep as S
from corpusbench.plans import fixtures as fx
from corpusbench.plans.fixtures import oracle, u
from corpusbench.plans.metric_queries import metrics_sql
from corpusbench.plans.registry import query
from corpusbench.session import scratch
from corpusbench.streaming import caps as P
from corpusbench.streaming import scoring as T


def staged(spark, df, name: str, files: int, order: str) -> str:
    """Write ``df`` as shard files split by ranges of ``order``."""
    path = scratch(spark, name)
    df.repartitionByRange(files, order).write.parquet(path)
    return path


@query("stream_score", "select event_id, round(value / (value + 50.0::double), 6) as pred from events")
def stream_score(spark, sf):
    """Shards scored as they arrive, appended to files."""
    src = fx.table(spark, sf, "events").select("event_id", "value")
    path = staged(spark, src, "feed", 4, "event_id")
    stream = T.shard_stream(spark, path, src.schema, per_trigger=2)
    out = T.run_to_files(stream.select(
        "event_id", F.round(F.col("value") / (F.col("value") + F.lit(50.0)), 6).alias("pred")), "score")
    return spark.read.schema("event_id long, pred double").parquet(out)


@query("resume_progress", oracle(f"""
    select event_id, case when {u('prog', 'event_id')} < 0.7 and {u('null', 'event_id')} >= 0.1 then 'reused' else 'scored' end as origin,
           prob as pred from feed""", "feed"))
def resume_progress(spark, sf):
    """Finish an interrupted run: keep finished predictions, redo null ones, skip torn lines."""
    feed = fx.feed(spark, sf).select("event_id", F.concat(F.lit("img/"), F.col("event_id")).alias("image_path"), "prob")
    key = F.col("event_id")
    line = F.to_json(F.struct("image_path", F.when(uniform("null", key) >= 0.1, F.col("prob")).alias("pred")))
    torn = F.when(uniform("torn", key) < 0.01, F.concat(line, F.lit("\n"), F.substring(line, 1, 12))).otherwise(line)
    path = scratch(spark, "progress")
    feed.where(uniform("prog", key) < 0.7).select(torn.alias("value")).write.text(path)
    prior = T.read_progress(spark, path)
    todo = C.resume_anti_join(feed, prior, "image_path")
    reused = prior.where("pred is not null").select(
        F.regexp_extract("image_path", r"(\d+)$", 1).cast("long").alias("event_id"), F.lit("reused").alias("origin"), "pred")
    return reused.unionByName(todo.select("event_id", F.lit("scored").alias("origin"), F.col("prob").alias("pred")))


@query("stream_model_caps", oracle("""
    select model, shard, pos from (select *, row_number() over (partition by model order by shard, pos) as rn from shards where label = 'fake')
    where rn <= 40""", "shards"))
def stream_model_caps(spark, sf):
    """Per-model counters carried over three arrivals of shards; equals the batch cap.

    Each arrival is a run of its own on the same checkpoint, as after a
    restart: counts and finished files carry over.
    """
    src = fx.shards(spark, sf).where("label = 'fake'").select(
        F.col("model").alias("key"), "shard", "pos", F.lit("").alias("row"))
    path, out, state = (scratch(spark, n) for n in ("arriving", "capped", "capped-checkpoint"))
    edges = [0, 30, 60, 2**62]
    for lo, hi in zip(edges, edges[1:]):
        src.where((F.col("shard") >= lo) & (F.col("shard") < hi)).write.mode("append").parquet(path)
        stream = T.shard_stream(spark, path, src.schema, per_trigger=None)
        T.run_to_files(T.capped_by_key(stream, 40), "caps", checkpoint=state, out=out)
    return spark.read.schema(T.CAP_FIELDS).parquet(out).select(F.col("key").alias("model"), "shard", "pos")


_OWN_CAPS = "(values ('m1', 5), ('m2', 0), ('m3', null), ('m4', 60), ('m5', 1)) as caps(model, cap)"


@query("stream_own_caps", oracle(f"""
    select model, shard, pos, reached from (
        select s.model, shard, pos, row_number() over (partition by s.model order by shard, pos) as rn, coalesce(cap, 20) as cap,
               case when coalesce(cap, 20) > 0 then count(*) over (partition by s.model) >= coalesce(cap, 20) else false end as reached
        from shards s join {_OWN_CAPS} on caps.model = s.model where label = 'fake')
    where cap = 0 or rn <= cap""", "shards"))
def stream_own_caps(spark, sf):
    """A cap for each wanted model, 20 where none is named, 0 for all rows; ``reached`` is the ledger's stop rule."""
    caps = {"m1": 5, "m2": 0, "m3": None, "m4": 60, "m5": 1}
    src = fx.shards(spark, sf).where("label = 'fake'").select(
        F.col("model").alias("key"), "shard", "pos", F.lit("").alias("row"))
    path, out, state = (scratch(spark, n) for n in ("arriving", "capped", "capped-checkpoint"))
    for part in ("shard < 50", "shard >= 50"):
        src.where(part).write.mode("append").parquet(path)
        stream = T.shard_stream(spark, path, src.schema, per_trigger=None)
        T.run_to_files(T.capped_by_key(stream, caps, default=20), "own-caps", checkpoint=state, out=out)
    taken = spark.read.schema(T.CAP_FIELDS).parquet(out).select(F.col("key").alias("model"), "shard", "pos")
    ledger = T.cap_ledger(taken, caps, default=20)
    return taken.join(F.broadcast(ledger.select("model", "reached")), "model")


_STOP_CAPS = {"m1": 5, "m4": 12, "m5": 1, "m11": 9}
_STOP_SQL = ", ".join(f"('{m}', {n})" for m, n in _STOP_CAPS.items())


def capped_arrivals(spark, sf):
    """Fake lines as a capped stream takes them, and the shard ranges in which they arrive."""
    src = fx.shards(spark, sf).where("label = 'fake'").select(F.col("model").alias("key"), "shard", "pos", F.lit("").alias("row"))
    edges = [0, *range(10, 100, 10), 2**62]
    return src, list(zip(edges, edges[1:]))


@query("stream_stops_at_caps", oracle(f"""
    with caps(model, cap) as (values {_STOP_SQL}),
         s as (select model, shard, pos, least(shard // 10, 9) as arrival, row_number() over (partition by model order by shard, pos) as rn, cap
               from shards join caps using (model) where label = 'fake'),
         ends as (select count(*) = (select count(*) from caps) as reached, max(arrival) + 1 as arrivals from s where rn = cap)
    select model, shard, pos, reached, (case when reached then arrivals else 10 end)::bigint as arrivals_read
    from s, ends where rn <= cap""", "shards"))
def stream_stops_at_caps(spark, sf):
    """A pull that ends once every cap is reached: later arrivals are never read."""
    src, ranges = capped_arrivals(spark, sf)
    path, out, checkpoint = (scratch(spark, n) for n in ("arriving", "stopped", "stopped-checkpoint"))
    for lo, hi in ranges:
        src.where((F.col("shard") >= lo) & (F.col("shard") < hi)).write.mode("append").parquet(path)
        reached = P.run_until_capped(T.shard_stream(spark, path, src.schema, per_trigger=None), _STOP_CAPS, out, checkpoint)
        if reached:
            break
    read = len(P.written_batches(spark, f"{out}/ledger"))
    return P.read_capped(spark, out).select("model", "shard", "pos", F.lit(reached).alias("reached"), F.lit(read).cast("long").alias("arrivals_read"))


@query("stream_state_caps", oracle("""
    select model, shard, count(*) as taken, sum(count(*)) over (partition by model)::bigint as used
    from (select *, row_number() over (partition by model order by shard, pos) as rn from shards where label = 'fake')
    where rn <= 40 group by model, shard""", "shards"))
def stream_state_caps(spark, sf):
    """Caps in typed state over three runs of one checkpoint; the result is the state itself, read as tables."""
    src, _ = capped_arrivals(spark, sf)
    path, out, checkpoint = (scratch(spark, n) for n in ("arriving", "state-capped", "state-checkpoint"))
    edges = [0, 30, 60, 2**62]
    with P.state_settings(spark):
        for lo, hi in zip(edges, edges[1:]):
            src.where((F.col("shard") >= lo) & (F.col("shard") < hi)).write.mode("append").parquet(path)
            T.run_to_files(P.capped_with_state(T.shard_stream(spark, path, src.schema, per_trigger=None), 40), "state-caps", checkpoint, out)
        used = P.read_used(spark, checkpoint).select(F.col("key").alias("model"), F.col("taken").alias("used"))
        shards = P.read_shards(spark, checkpoint).select(F.col("key").alias("model"), "shard", "taken")
        return shards.join(used, "model")


@query("stream_running_metrics", oracle("""
    select event_id // 1000 as block, count(*) as n, count(*) filter (where (prob >= 0.5)::int = label) as correct,
           round(count(*) filter (where (prob >= 0.5)::int = label) / count(*)::double, 6) as accuracy, round(avg(prob), 6) as mean_p
    from feed group by 1""", "feed"))
def stream_running_metrics(spark, sf):
    """Running counts per block of 1,000 items; every trigger rewrites the small result."""
    src = fx.feed(spark, sf).select("event_id", "prob", "label")
    path = staged(spark, src, "running", 4, "event_id")
    out = scratch(spark, "running-out")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id:06d}")

    T.run_batches(T.running_counts(T.shard_stream(spark, path, src.schema), "event_id", 1000), keep, "running", mode="update")
    rows = spark.read.option("basePath", out).schema(
        "block long, n long, correct long, prob_sum double, batch int").parquet(out)
    last = rows.groupBy("block").agg(F.max_by(F.struct("n", "correct", "prob_sum"), "batch").alias("r")).select("block", "r.*")
    return M.rounded(last.select("block", "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"),
                                 (F.col("prob_sum") / F.col("n")).alias("mean_p")))


@query("periodic_eval", oracle(f"""
    with s as (select *, (event_id // (select count(*) // 4 from events))::int as step from feed),
    m as ({metrics_sql('s', 'step')})
    select step, n, macro_accuracy, auroc, max(auroc) over (order by step) as best_metric,
           (select m2.step from m m2 where m2.step <= m.step order by m2.auroc desc, m2.step limit 1) as best_step from m""", "feed"))
def periodic_eval(spark, sf):
    """Evaluate what has arrived, step by step, and mark the best step.

    Each micro-batch appends its score histogram, keyed by batch id so that a
    replay replaces its own part. Histograms of a step add up however its
    rows were spread over files and batches.
    """
    src = fx.feed(spark, sf).select("event_id", "prob", "label")
    quarter = F.floor(F.col("event_id") / src.agg(F.floor(F.count("*") / 4).alias("q")).scalar()).cast("int")
    tagged = src.withColumn("step", quarter)
    path, history = staged(spark, tagged, "eval", 8, "event_id"), scratch(spark, "history")

    def evaluate(batch, batch_id):
        M.score_histogram(batch, ["step"]).write.mode("overwrite").parquet(f"{history}/part={batch_id:06d}")

    T.run_batches(T.shard_stream(spark, path, tagged.schema, per_trigger=3), evaluate, "eval")
    parts = spark.read.option("recursiveFileLookup", True).parquet(history)
    done = M.rounded(M.metrics_from_histogram(parts, ["step"])).select("step", "n", "macro_accuracy", "auroc")
    best = S.best_step(done.select("step", "auroc"), "step", "auroc").drop("auroc")
    return done.join(best, "step")


@query("stream_first_seen_dedup", "select distinct user_id, 1::bigint as rows from events")
def stream_first_seen_dedup(spark, sf):
    src = fx.table(spark, sf, "events").select("event_id", "user_id")
    path = staged(spark, src, "dedup", 4, "event_id")
    out = T.run_to_files(T.first_seen(T.shard_stream(spark, path, src.schema, 2), "user_id"), "dedup")
    rows = spark.read.schema(src.schema).parquet(out)
    return rows.groupBy("user_id").agg(F.count("*").alias("rows"))
