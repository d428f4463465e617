"""Metrics, grouped tables, sweeps and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusbench.functions.rng import uniform, uniform_of
from corpusbench.operators import metrics as M
from corpusbench.operators import sweep as S
from corpusbench.plans import fixtures as fx
from corpusbench.plans.fixtures import oracle, u
from corpusbench.plans.registry import query

CONFUSION = ["n", "n_fake", "n_real", "accuracy", "macro_accuracy", "precision", "recall", "f1", "fpr", "fnr"]


def metrics_sql(src: str, by: str = "", curves: bool = True, confusion: bool = True,
                having: str = "", thr: str = "0.5") -> str:
    """Rank-based metrics per group: AUROC from mean ranks, AP as mean precision over positives."""
    part = f"partition by {by}" if by else ""
    comma = f"{by}, " if by else ""
    cols = ""
    if confusion:
        cols += """, n, n_fake, n_real,
            round((tp + n_real - fp) / greatest(1.0::double, n), 6) as accuracy,
            round(0.5::double * (tp / greatest(1.0::double, n_fake) + (n_real - fp) / greatest(1.0::double, n_real)), 6) as macro_accuracy,
            round(tp / greatest(1.0::double, tp + fp), 6) as precision,
            round(tp / greatest(1.0::double, n_fake), 6) as recall,
            round(case when tp > 0 then 2.0::double * tp / (2.0::double * tp + fp + n_fake - tp) else 0.0::double end, 6) as f1,
            round(fp / greatest(1.0::double, n_real), 6) as fpr,
            round((n_fake - tp) / greatest(1.0::double, n_fake), 6) as fnr"""
    if curves:
        cols += """,
            case when n_fake > 0 and n_real > 0 then
                round((rank_sum - n_fake * (n_fake + 1.0::double) / 2.0::double) / (n_fake::double * n_real), 6) end as auroc,
            case when n_fake > 0 and n_real > 0 then round(prec_mean, 6) end as ap"""
    cols = cols.lstrip(", \n")
    return f"""
        select {comma}{cols} from (
            select {comma}count(*) as n, count(*) filter (where label = 1) as n_fake,
                   count(*) filter (where label = 0) as n_real,
                   count(*) filter (where label = 1 and prob >= {thr}) as tp,
                   count(*) filter (where label = 0 and prob >= {thr}) as fp,
                   sum(rk) filter (where label = 1) as rank_sum,
                   avg(prec) filter (where label = 1) as prec_mean
            from (select {comma}label, prob,
                         rank() over ({part} order by prob)
                           + (count(*) over (partition by {comma}prob) - 1) / 2.0::double as rk,
                         count(*) filter (where label = 1) over ({part} order by prob desc)::double
                           / count(*) over ({part} order by prob desc) as prec
                  from {src})
            {f'group by {by}' if by else ''} {having})"""


# ------------------------------------------------------------------- basic


@query("confusion_metrics", oracle(metrics_sql("scored_big", curves=False), "scored_big"))
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return M.rounded(M.metrics(fx.scored_big(spark, sf), curves=False))


@query("auroc", oracle(metrics_sql("scored_big", confusion=False), "scored_big"))
def auroc(spark, sf):
    return M.rounded(M.metrics(fx.scored_big(spark, sf)).select("auroc", "ap"))


@query("average_precision", oracle(metrics_sql("scored", "architecture", confusion=False), "scored"))
def average_precision(spark, sf):
    """Scores of any precision: the curve runs over logit buckets."""
    return M.rounded(M.metrics(fx.scored(spark, sf), ["architecture"])
                     .select("architecture", "auroc", "ap"))


@query("group_metrics", oracle(metrics_sql("scored", "architecture"), "scored"))
def group_metrics(spark, sf):
    return M.rounded(M.metrics(fx.scored(spark, sf), ["architecture"]))


@query("metric_agg", oracle(metrics_sql("scored_big", "generator, is_distorted"), "scored_big"))
def metric_agg(spark, sf):
    return M.rounded(M.metrics(fx.scored_big(spark, sf), ["generator", "is_distorted"]))


@query("per_architecture", oracle(metrics_sql(
    "(select *, case when architecture = 'O' then 'O' else generator end as arch_key from scored_big)", "arch_key"),
    "scored_big"))
def per_architecture(spark, sf):
    df = fx.scored_big(spark, sf).withColumn(
        "architecture", F.when(F.col("architecture") == "O", "O").otherwise(""))
    return M.rounded(M.metrics(df.withColumn("arch_key", M.architecture_key()), ["arch_key"]))


@query("robust_metrics", oracle(metrics_sql(
    "(select *, case when is_distorted then 'distorted' else 'clean' end as part from scored_big)", "part"),
    "scored_big"))
def robust_metrics(spark, sf):
    return M.rounded(M.robust_metrics(fx.scored_big(spark, sf)))


@query("per_distortion", oracle(metrics_sql(
    "(select * from scored_big where is_distorted)", "kind", having="having count(*) >= 20"), "scored_big"))
def per_distortion(spark, sf):
    df = fx.scored_big(spark, sf).where("is_distorted")
    return M.rounded(M.per_distortion(df, "kind"))


@query("val_metrics", oracle(f"""
    select generator, case when n_fake > 0 and n_real > 0 then macro_accuracy end as val_balanced_acc,
           case when n_fake > 0 and n_real > 0 then recall end as val_tpr,
           case when n_fake > 0 and n_real > 0 then round(1.0::double - fpr, 6) end as val_tnr,
           case when n_fake > 0 and n_real > 0 then f1 end as val_f1, auroc as val_auroc, ap as val_ap, n as val_n
    from (select * from ({metrics_sql('scored_big', 'generator')})
          union all select * from ({metrics_sql('scored', 'generator')}))""", "scored_big", "scored"))
def val_metrics(spark, sf):
    """Validation view of the metrics; everything null for a single-class set."""
    cols = ["generator", "prob", "label"]
    big = M.metrics(fx.scored_big(spark, sf).select(*cols), ["generator"])
    small = M.metrics(fx.scored(spark, sf).select(*cols), ["generator"])
    both = (F.col("n_fake") > 0) & (F.col("n_real") > 0)

    def view(m):
        return m.select(
            "generator",
            F.when(both, F.col("macro_accuracy")).alias("val_balanced_acc"),
            F.when(both, F.col("recall")).alias("val_tpr"),
            F.when(both, F.lit(1.0) - F.col("fpr")).alias("val_tnr"),
            F.when(both, F.col("f1")).alias("val_f1"),
            F.col("auroc").alias("val_auroc"), F.col("ap").alias("val_ap"), F.col("n").alias("val_n"))

    return M.rounded(view(big).unionByName(view(small)))


@query("single_class_rules", oracle(f"""
    select generator, n, case when n_fake > 0 and n_real > 0 then macro_accuracy end as macro_accuracy,
           case when n_fake > 0 then f1 end as f1, case when n_fake > 0 then fnr end as fnr,
           case when n_real > 0 then fpr end as fpr
    from ({metrics_sql('scored', 'generator')})""", "scored"))
def single_class_rules(spark, sf):
    """Blank the numbers that mean nothing when one class is absent."""
    m = M.metrics(fx.scored(spark, sf), ["generator"])
    fake, real = F.col("n_fake") > 0, F.col("n_real") > 0
    return M.rounded(m.select(
        "generator", "n", F.when(fake & real, F.col("macro_accuracy")).alias("macro_accuracy"),
        F.when(fake, F.col("f1")).alias("f1"), F.when(fake, F.col("fnr")).alias("fnr"),
        F.when(real, F.col("fpr")).alias("fpr")))


@query("suite_summary", oracle(f"""
    with sets as (
        select 'probe' as dataset, prob, label from scored
        union all select 'lines_clean', prob, label from scored_big where not is_distorted
        union all select 'lines_distorted', prob, label from scored_big where is_distorted
        union all select 'lines_empty', prob, label from scored_big where prob > 2)
    select names.dataset, coalesce(n, 0) as n, macro_accuracy, fpr, auroc, ap,
           case when n is null then 'no scored rows' end as error
    from (values ('probe'), ('lines_clean'), ('lines_distorted'), ('lines_empty')) names(dataset)
    left join ({metrics_sql('sets', 'dataset')}) using (dataset)""", "scored", "scored_big"))
def suite_summary(spark, sf):
    """One row per evaluation set; a set without rows is reported, not dropped."""
    big = fx.scored_big(spark, sf)
    sets = {
        "probe": fx.scored(spark, sf),
        "lines_clean": big.where("not is_distorted"),
        "lines_distorted": big.where("is_distorted"),
        "lines_empty": big.where("prob > 2"),
    }
    union = None
    for name, df in sets.items():
        part = df.select(F.lit(name).alias("dataset"), "prob", "label")
        union = part if union is None else union.unionByName(part)
    names = spark.createDataFrame([(n,) for n in sets], "dataset string")
    m = M.metrics(union, ["dataset"])
    return M.rounded(names.join(m, "dataset", "left").select(
        "dataset", F.coalesce("n", F.lit(0)).alias("n"), "macro_accuracy", "fpr", "auroc", "ap",
        F.when(F.col("n").isNull(), "no scored rows").alias("error")))


# ------------------------------------------------------------------- sweeps

STRENGTH = {c: round(0.02 * i, 2) for i, c in enumerate(S.ALL_CONDITIONS)}


def sweep(spark, sf) -> DataFrame:
    """Scored lines under every reported condition; the fixture lowers scores by a seeded amount.

    A draw and a rounding per line and condition are nearly all the work. The
    start of the drawn text comes with the condition, and scores, which are
    not negative, are rounded by arithmetic, without a decimal for each.
    """
    scored = fx.scored_big(spark, sf).select("id", "label", "generator", "prob")
    df = S.with_conditions(scored, S.ALL_CONDITIONS, _strength=STRENGTH, _text={c: f"cond|{c}|" for c in STRENGTH})
    lowered = F.greatest(F.lit(0.0), F.col("prob") - F.col("_strength") * uniform_of(F.concat("_text", "id")))
    return df.select("id", "label", "generator", "condition", (F.floor(lowered * 100.0 + 0.5) / 100.0).alias("prob"))


SWEEP_SQL = f"""sweep as (
    select id, label, generator, condition,
           round(greatest(0.0::double, prob - strength * {u('cond', "condition || '|' || id")}), 2) as prob
    from scored_big, (values {', '.join(f"('{c}', {s}::double)" for c, s in STRENGTH.items())}) v(condition, strength))"""


@query("sweep_cross_join", oracle(f"""with {SWEEP_SQL}
    select condition, generator, count(*) as n, round(sum(prob), 2) as prob_sum from sweep group by all""",
    "scored_big"))
def sweep_cross_join(spark, sf):
    return sweep(spark, sf).groupBy("condition", "generator").agg(
        F.count("*").alias("n"), F.round(F.sum("prob"), 2).alias("prob_sum"))


@query("perturbation_sweep", oracle(f"""with {SWEEP_SQL}
    select condition, n, accuracy, macro_accuracy, precision, recall, f1, fpr, fnr, auroc, ap,
           condition = 'clean' as is_base from ({metrics_sql('sweep', 'condition')})""", "scored_big"))
def perturbation_sweep(spark, sf):
    m = M.metrics(sweep(spark, sf), ["condition"])
    return M.rounded(m.select(
        "condition", "n", "accuracy", "macro_accuracy", "precision", "recall", "f1", "fpr", "fnr",
        "auroc", "ap", (F.col("condition") == "clean").alias("is_base")))


@query("real_fpr_by_condition", oracle(f"""with {SWEEP_SQL}
    select condition, count(*) as n_real, round(avg((prob >= 0.5)::int), 6) as fpr, round(avg(prob), 6) as mean_p
    from sweep where label = 0 group by condition""", "scored_big"))
def real_fpr_by_condition(spark, sf):
    return M.rounded(S.real_rates(sweep(spark, sf), ["condition"]))


POOLED_RAW = """select {by}, generator, count(*) as n, avg((prob >= 0.5)::int) as recall, avg(prob) as mean_p,
           avg((below + 0.5::double * tied) / n_real) as auroc
    from (select {by}, generator, prob, label,
                 count(*) filter (where label = 0) over (partition by {by} order by prob)
                   - count(*) filter (where label = 0) over (partition by {by}, prob) as below,
                 count(*) filter (where label = 0) over (partition by {by}, prob) as tied,
                 count(*) filter (where label = 0) over (partition by {by}) as n_real
          from {src}) where label = 1 group by {by}, generator"""
POOLED_SQL = f"""select {{by}}, generator, n, round(recall, 6) as recall, round(mean_p, 6) as mean_p, round(auroc, 6) as auroc
    from ({POOLED_RAW})"""


@query("generator_auroc", oracle(f"with {SWEEP_SQL} {POOLED_SQL.format(by='condition', src='sweep')}", "scored_big"))
def generator_auroc(spark, sf):
    return M.rounded(M.pooled_generator_metrics(sweep(spark, sf), ["condition"]))


@query("pooled_real_join", oracle(POOLED_SQL.format(by="architecture", src="scored"), "scored"))
def pooled_real_join(spark, sf):
    return M.rounded(M.pooled_generator_metrics(fx.scored(spark, sf), ["architecture"]))


@query("difficulty_rank", oracle(f"""with {SWEEP_SQL}, per as ({POOLED_RAW.format(by='condition', src='sweep')})
    select generator, n, round(recall_mean, 6) as recall_mean, round(recall_clean, 6) as recall_clean,
           round(recall_min, 6) as recall_min, round(auroc_mean, 6) as auroc_mean,
           row_number() over (order by round(recall_mean, 6), generator) as hardness
    from (select generator, max(n) as n, avg(recall) as recall_mean,
                 max(recall) filter (where condition = 'clean') as recall_clean,
                 min(recall) as recall_min, avg(auroc) as auroc_mean from per group by generator)""", "scored_big"))
def difficulty_rank(spark, sf):
    """Hardest generators first. The rank window sees one row per generator."""
    ranked = M.rounded(M.difficulty_rank(M.pooled_generator_metrics(sweep(spark, sf), ["condition"])))
    return ranked.withColumn("hardness", F.row_number().over(Window.orderBy("recall_mean", "generator")))


@query("sweep_table", oracle(f"""with {SWEEP_SQL}, m as ({metrics_sql('sweep', 'condition', curves=False)}),
    fam(condition, family, family_rank) as (values
      {', '.join(f"('{k}', '{f}', {i + 1})" for i, (f, ks) in enumerate(S.FAMILIES.items()) for k in ks)})
    select family_rank::int as family_rank, family, condition, macro_accuracy,
           round(macro_accuracy - (select macro_accuracy from m where condition = 'clean'), 6) as delta, fpr, fnr
    from m join fam using (condition)""", "scored_big"))
def sweep_table(spark, sf):
    m = M.rounded(M.metrics(sweep(spark, sf), ["condition"], curves=False))
    return M.rounded(S.sweep_table(m))


@query("degradation_summary", oracle(f"""with {SWEEP_SQL}, m as ({metrics_sql('sweep', 'condition', curves=False)}),
    bad as (select * from m where condition not in ('clean', 'none'))
    select (select count(*) from bad) as conditions, c.macro_accuracy as clean_macro, w.condition as worst_condition,
           w.macro_accuracy as worst_macro,
           round((select avg(macro_accuracy) from bad) - c.macro_accuracy, 6) as mean_delta,
           (select max(fpr) from bad) as worst_fpr
    from (select * from m where condition = 'clean') c,
         (select * from bad order by macro_accuracy, condition limit 1) w""", "scored_big"))
def degradation_summary(spark, sf):
    m = M.rounded(M.metrics(sweep(spark, sf), ["condition"], curves=False))
    return M.rounded(S.degradation_summary(m))


@query("best_step", oracle(f"""
    with h as (select substr(generator, 4)::int * 500 as step, case when generator = 'gen3' then null else auroc end as metric
               from ({metrics_sql('scored_big', 'generator')}))
    select step, metric, max(metric) over (order by step) as best_metric,
           (select h2.step from h h2 where h2.step <= h.step and h2.metric is not null
            order by h2.metric desc, h2.step limit 1) as best_step
    from h""", "scored_big"))
def best_step(spark, sf):
    """Running best over a step history; the fixture reads generators as steps."""
    m = M.rounded(M.metrics(fx.scored_big(spark, sf), ["generator"]))
    h = m.select((F.substring("generator", 4, 5).cast("int") * 500).alias("step"),
                 F.when(F.col("generator") == "gen3", F.lit(float("nan"))).otherwise(F.col("auroc")).alias("metric"))
    return S.best_step(h).withColumn("metric", F.nanvl("metric", F.lit(None).cast("double")))


# ------------------------------------------------------------------- losses


def patch_rows(spark, sf) -> DataFrame:
    emb = fx.table(spark, sf, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    y = F.col("y")
    return emb.select(
        F.col("vec_id").alias("id"), y.alias("label"),
        F.transform("embedding", lambda x: x.cast("double") * 8.0).alias("patch_logits"),
        F.transform(F.sequence(F.lit(0), F.lit(63)),
                    lambda i: F.when(i % 8 < 3, y).otherwise(F.lit(0)).cast("double")).alias("patch_labels"),
    ).withColumn("logit", F.aggregate("patch_logits", F.lit(0.0), lambda s, x: s + x))


_PATCH_SQL = """patches as (
    select vec_id as id, (label >= 5)::int as label, 8.0::double * unnest(embedding)::double as x,
           generate_subscripts(embedding, 1) - 1 as cell from embeddings),
    labelled as (select id, label, x, cell, case when cell % 8 < 3 then label else 0 end as y from patches),
    pw as (select least(50.0::double, greatest(0.02::double, sum(1 - y)::double / sum(y))) as pos_weight from labelled)"""


@query("pos_weight", f"with {_PATCH_SQL} select round(pos_weight, 6) as pos_weight from pw")
def pos_weight(spark, sf):
    return M.rounded(M.patch_pos_weight(patch_rows(spark, sf), "patch_labels"))


@query("detection_log_loss", f"""with {_PATCH_SQL},
    items as (select id, max(label) as y, sum(x) as x from labelled group by id),
    a as (select avg(-(y * ln(1.0::double / (1.0::double + exp(-x)))
                     + (1 - y) * ln(1.0::double - 1.0::double / (1.0::double + exp(-x))))) as item_loss from items),
    b as (select avg(-(pos_weight * y * ln(1.0::double / (1.0::double + exp(-x)))
                     + (1 - y) * ln(1.0::double - 1.0::double / (1.0::double + exp(-x))))) as patch_loss
          from labelled, pw)
    select round(item_loss, 6) as item_loss, round(patch_loss, 6) as patch_loss,
           round(item_loss + 0.5::double * patch_loss, 6) as loss from a, b""")
def detection_log_loss(spark, sf):
    df = patch_rows(spark, sf)
    weight = M.patch_pos_weight(df, "patch_labels").scalar()
    return M.rounded(M.detection_log_loss(df, "logit", "label", "patch_logits", "patch_labels", weight, 0.5))


@query("mean_difference_probe", "with w as (" + fx.VIEWS["weights"][1] + """)
    select (i - 1)::int as dim, round(w, 9) as weight from w""")
def mean_difference_probe(spark, sf):
    from corpusbench.operators.probe import mean_difference_weights

    emb = fx.table(spark, sf, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    w = mean_difference_weights(emb, "embedding", "y")
    return w.select(F.posexplode("w").alias("dim", "weight")).select("dim", F.round("weight", 9).alias("weight"))


@query("batch_score", oracle("""
    select id, generator, prob as pred, case when prob >= 0.5 then 'AI' else 'REAL' end as verdict from scored""", "scored"))
def batch_score(spark, sf):
    """Linear model as a plain expression: scan and score without a shuffle."""
    return fx.scored(spark, sf).select(
        "id", "generator", F.col("prob").alias("pred"),
        F.when(F.col("prob") >= 0.5, "AI").otherwise("REAL").alias("verdict"))


def score_model():
    """A stand-in model for the Python scoring path: mean of the features."""
    import numpy as np

    def run(pdf):
        import pandas as pd

        x = np.stack(pdf["embedding"].to_numpy()).astype("float64")
        return pd.Series(np.round(1.0 / (1.0 + np.exp(-8.0 * x.mean(axis=1))), 6), index=pdf.index)

    return run


@query("score_udf", """
    select vec_id, label, round(1.0::double / (1.0::double + exp(-8.0::double * m)), 6) as pred, null::varchar as error
    from (select vec_id, label, list_sum(list_transform(embedding, lambda x: x::double)) / 64.0::double as m from embeddings)""")
def score_udf(spark, sf):
    """Batched Python model, loaded once per task, Arrow in and out."""
    from corpusbench.operators.probe import batch_score as run

    return run(fx.table(spark, sf, "embeddings"), score_model, ["vec_id", "label"])


@query("linear_probe_fit", f"""
    select count(*) as n, count(*) filter (where label >= 5) as n_fake, count(*) filter (where label < 5) as n_real,
           64::bigint as converged from embeddings where {u('probe', 'vec_id')} < 0.5""")
def linear_probe_fit(spark, sf):
    """Fit on one half, measured on the other (seeded split); dimensions whose gradient is zero at three digits."""
    from corpusbench.operators.probe import apply_linear_probe, fit_linear_probe, probe_gradient

    emb = fx.table(spark, sf, "embeddings").select(
        "vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("y"))
    hold = uniform("probe", F.col("vec_id")) < 0.5
    model = fit_linear_probe(emb.where(~hold), "embedding", "y")
    scored = apply_linear_probe(model, emb.where(hold), "embedding").select(F.col("y").alias("label"), "prob")
    gradient = probe_gradient(model, emb.where(~hold), "embedding", "y")
    flat = gradient.agg(F.count_if(F.abs("gradient") < 0.0005).alias("converged")).scalar()
    return M.metrics(scored).select("n", "n_fake", "n_real", flat.alias("converged"))


NEWTON_REG = 0.1


@query("linear_probe_newton", f"""
    with recursive e as (select vec_id, (label >= 5)::int as y, {u('probe', 'vec_id')} < 0.5 as held, embedding from embeddings),
    x as (select vec_id, y, held, unnest(range(1, 65)) as j, unnest(embedding)::double as v from e),
    s as (select j, avg(v) as m, stddev_samp(v) as d from x where not held group by j),
    z as materialized (select vec_id, y, held, list_append(list((v - m) / d order by j), 1.0::double) as z from x join s using (j) group by all),
    c as (select vec_id, unnest(range(1, 66)) as j, unnest(z) as v from z where not held),
    h as (select a.j as i, b.j, 0.25 * sum(a.v * b.v) / (select count(*) from z where not held) + case when a.j = b.j and a.j < 65 then {NEWTON_REG} else 0 end as v
          from c a join c b using (vec_id) group by a.j, b.j),
    m as (select list(r order by i) as m from (select i, list_concat(list(v order by j), list_transform(range(1, 66), lambda k: (k = i)::int::double)) as r from h group by i)),
    inv as (select 1 as k, m from m union all
            select k + 1, list_transform(m, lambda r, i: case when i = k then list_transform(r, lambda v: v / m[k][k])
                                                              else list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) end) from inv where k <= 65),
    b as materialized (select list_transform(m, lambda r: r[66:130]) as b from inv where k = 66),
    fit as (select 0 as t, list_transform(range(1, 66), lambda k: 0.0::double) as w union all
            select t + 1, list_transform(w, lambda v, i: v - list_dot_product(b[i], g)) from
              (select t, w, list(g order by j) as g from
                (select t, w, j, avg(miss * v) + case when j < 65 then {NEWTON_REG} * any_value(w[j]) else 0 end as g from
                  (select t, w, 1 / (1 + exp(-list_dot_product(w, z))) - y as miss, unnest(z) as v, unnest(range(1, 66)) as j from fit, z where not held and t < 150)
                 group by t, w, j) group by t, w), b),
    done as materialized (select w from fit where t = 150),
    o as (select y, list_dot_product(w, z) as o from z, done where held),
    auc as (select round(avg(case when p.o > q.o then 1.0::double when p.o = q.o then 0.5::double else 0.0::double end), 4) as auroc
            from o p, o q where p.y = 1 and q.y = 0)
    select j - 1 as dim, round(w, 4) as weight, auroc from (select unnest(w) as w, unnest(range(1, 66)) as j from done), auc""")
def linear_probe_newton(spark, sf):
    """Weights of the probe (the last is the bias) and its AUROC on the held-out half."""
    from corpusbench.operators.probe import newton_probe, score_newton

    emb = fx.table(spark, sf, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"))
    hold = uniform("probe", F.col("vec_id")) < 0.5
    fit = newton_probe(emb.where(~hold), "embedding", "label", reg=NEWTON_REG)
    auroc = M.metrics(score_newton(emb.where(hold), "embedding", fit).select("label", "prob")).select(F.round("auroc", 4).alias("auroc"))
    weights = F.array(*[F.lit(round(float(v), 4)) for v in [*fit.weights, fit.bias]])
    return auroc.select(F.posexplode(weights).alias("dim", "weight"), "auroc").select(F.col("dim").cast("long").alias("dim"), "weight", "auroc")


@query("fpr_operating_point", oracle("""
    with c as (select generator, prob, count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as n from scored_big group by all),
         h as (select generator, prob, sum(p) over w as tp, sum(n) over w as fp from c window w as (partition by generator order by prob desc)),
         g as (select generator, sum(p)::bigint as n_fake, sum(n)::bigint as n_real from c group by all)
    select g.generator, n_fake, n_real, min(h.prob) as threshold, round(max(h.fp) / greatest(1, n_real), 6) as fpr,
           round(coalesce(max(h.tp), 0) / greatest(1, n_fake), 6) as recall
    from g left join h on h.generator = g.generator and h.fp <= 0.01 * n_real group by g.generator, n_fake, n_real""", "scored_big"))
def fpr_operating_point(spark, sf):
    """Threshold and recall at a false positive rate of at most one percent."""
    return M.rounded(M.fpr_operating_point(fx.scored_big(spark, sf), ["generator"], 0.01))
