"""Display names, published references, leaderboards and breakdown tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusbench.functions import labels as L
from corpusbench.functions.rng import choice, uniform
from corpusbench.operators import audit as A
from corpusbench.operators import metrics as M
from corpusbench.operators.sweep import lookup
from corpusbench.plans import fixtures as fx
from corpusbench.plans.clean_queries import _TOKENS, distorted
from corpusbench.plans.fixtures import oracle, pick, u
from corpusbench.plans.metric_queries import metrics_sql
from corpusbench.plans.registry import query

# Display names of evaluation sets, families and conditions.
SET_NAMES = {
    "comfor_eval": "CommunityForensics-Eval", "openfake_test": "OpenFake core/test",
    "openfake_reddit": "OpenFake reddit/test", "mirage": "MIRAGE", "ntire_test": "NTIRE 2026 public test",
    "coco_val2017": "COCO val2017 (reals only)", "wildfake_dalle_advanced": "WildFake DALL·E Advanced (fakes only)",
}
FAMILY_NAMES = {"LatDiff": "Latent diffusion", "PixDiff": "Pixel diffusion", "Commercial": "Commercial",
                "GAN": "GAN", "Other": "Other"}
CONDITION_NAMES = {
    "clean": "Clean (no perturbation)", "jpeg90": "JPEG q90", "jpeg70": "JPEG q70", "jpeg50": "JPEG q50",
    "jpeg30": "JPEG q30", "blur0.5": "Blur σ 0.5", "blur1.0": "Blur σ 1.0", "blur2.0": "Blur σ 2.0",
    "resize0.5": "Resize 0.5×", "resize0.25": "Resize 0.25×", "noise0.02": "Noise σ 0.02",
    "noise0.05": "Noise σ 0.05", "noise0.10": "Noise σ 0.10", "jitter20": "Jitter ±20%",
    "crop80": "Center crop 80%", "pangram": "Pangram protocol (1024px + JPEG q50)",
    "none": "None (clean tag)", "jpeg": "JPEG", "jpeg_ai": "JPEG AI",
    "jpeg_recompression_comb_jpegai": "JPEG + JPEG AI recompress", "lensblur": "Lens blur",
    "wmforger": "WMForger", "brighten": "Brighten", "clahe": "CLAHE", "colorsat": "Color saturation",
    "impulsenoise": "Impulse noise", "isonoise": "ISO noise", "shotnoise": "Shot noise",
    "perspective": "Perspective", "randomaspectcrop": "Random aspect crop", "randomcrop": "Random crop",
    "randomtonecurve": "Tone curve", "rgbshift": "RGB shift", "adv_embed_clip": "Adversarial embed (CLIP)",
    "adv_embed_resnet": "Adversarial embed (ResNet)",
}
# Order of the held-out tables, published numbers, leaderboard rows.
HELDOUT_ORDER = list(SET_NAMES)
PUBLISHED = [
    ("CommunityForensics-Eval", "Pangram Image (2026)", 97.29, 99.70),
    ("CommunityForensics-Eval", "Ours-384 (CVPR 2025)", 89.3, 98.7),
    ("Synthbuster+RAISE-1K", "Pangram Image (2026)", 98.49, 99.96),
    ("Synthbuster+RAISE-1K", "B-Free (ICML 2024)", 94.9, 98.8),
]
LEADERBOARD = [
    ("MICV", 0.9978, 0.9738), ("Ant International", 0.9973, 0.9731), ("TeleAI-TeleGuard", 0.9762, 0.9215),
    ("INTSIG", 0.981, 0.909), ("vincentlc", 0.9497, 0.8633), ("UESTC", 0.9693, 0.8558),
    ("Reagvis Labs", 0.9423, 0.8474), ("PSU", 0.9132, 0.8334), ("Shallow Real", 0.9954, 0.8302),
]
SOURCE_NAMES = {
    "RMG": "Realistic model generation", "PCRMG": "Pose-consistent model generation", "T2I": "Text-to-image",
    "IID": "In-distribution, human-curated", "OOD-R": "Out-of-distribution, human-curated",
    "CB": "Background replacement", "TR": "Virtual try-on", "FS": "Face swap",
    "IP/OP": "Inpainting / outpainting", "IE": "Instruction-based editing",
}
PIPELINES = {"T2I": "full", "RMG": "full", "PCRMG": "full", "IE": "local", "IP/OP": "local", "FS": "local",
             "TR": "local", "CB": "local", "IID": "mixed", "OOD-R": "mixed"}


def eval_key(name, file):
    """Key of a result: its file's base name if known, else its name if known, else what there is."""
    base = F.regexp_replace(F.regexp_extract(F.coalesce(file, F.lit("")), r"([^/\\]*)$", 1), r"(?i)\.json$", "")
    known = list(SET_NAMES)
    return (F.when(base.isin(known), base).when(name.isin(known), name)
            .otherwise(F.coalesce(F.nullif(base, F.lit("")), name, F.lit(""))))


def _map_sql(key: str, names: dict[str, str], default: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + f" else {default} end"


SETS = ["comfor_eval", "mirage", "ntire_test", "other_run", "coco_val2017"]


@query("display_names", oracle(f"""with {_TOKENS},
    k as (select coalesce(tokens[1], 'none') as key, {pick(u('set', 'id'), SETS)} as set_key, id from toks)
    select key, {_map_sql('key', CONDITION_NAMES, 'key')} as label,
           case when id % 2 = 0 then set_key else 'last' end as set_key,
           {_map_sql("(case when id % 2 = 0 then set_key else 'last' end)", SET_NAMES, "(case when id % 2 = 0 then set_key else 'last' end)")} as set_name,
           count(*) as n from k group by all""", "samples"))
def display_names(spark, sf):
    df = distorted(spark, sf).select(
        L.distortion_key(F.col("tokens")).alias("key"), choice(uniform("set", F.col("id")), SETS).alias("name"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("runs/eval/"), choice(uniform("set", F.col("id")), SETS), F.lit(".json")))
        .otherwise("runs\\last.JSON").alias("file"))
    # Half of the rows carry an unknown file, and their name is unknown too.
    df = df.withColumn("set_key", eval_key(F.when(F.col("file").like("runs/eval%"), F.col("name")), F.col("file")))
    return df.groupBy("key", "set_key").agg(F.count("*").alias("n")).select(
        "key", lookup(F.col("key"), CONDITION_NAMES, F.col("key")).alias("label"), "set_key",
        lookup(F.col("set_key"), SET_NAMES, F.col("set_key")).alias("set_name"), "n")


GEN_SET = ["comfor_eval", "Synthbuster+RAISE-1K", "mirage", "other_run"]
_SETCASE = "case substr(generator, 4)::int % 4 when 0 then 'comfor_eval' when 1 then 'Synthbuster+RAISE-1K' when 2 then 'mirage' else 'other_run' end"


def by_set(spark, sf):
    k = F.substring("generator", 4, 5).cast("int") % 4
    df = fx.scored_big(spark, sf).withColumn("dataset", F.get(F.array(*map(F.lit, GEN_SET)), k))
    return M.metrics(df, ["dataset"])


@query("reference_join", oracle(f"""
    with m as ({metrics_sql(f"(select *, {_SETCASE} as dataset from scored_big)", 'dataset')})
    select dataset, macro_accuracy, method, ref_acc, round(100.0::double * macro_accuracy - ref_acc, 4) as gap
    from m left join (values {', '.join(f"('{'comfor_eval' if d.startswith('Comm') else d}', '{m}', {a}::double)" for d, m, a, _ in PUBLISHED)})
         p(dataset, method, ref_acc) using (dataset)""", "scored_big"))
def reference_join(spark, sf):
    """Own metrics beside published ones, joined on the display name of the set."""
    ref = spark.createDataFrame(PUBLISHED, "display string, method string, ref_acc double, ref_ap double")
    ours = M.rounded(by_set(spark, sf)).withColumn("display", lookup(F.col("dataset"), SET_NAMES, F.col("dataset")))
    return ours.join(F.broadcast(ref), "display", "left").select(
        "dataset", "macro_accuracy", "method", "ref_acc",
        F.round(F.lit(100.0) * F.col("macro_accuracy") - F.col("ref_acc"), 4).alias("gap"))


@query("leaderboard", oracle(f"""
    with l as (select * from (values {', '.join(f"('{m}', {a}::double, {r}::double, false)" for m, a, r in LEADERBOARD)}) v(method, auroc, robust, ours)
      union all select 'ours', (select auroc from ({metrics_sql('scored_big', confusion=False)})),
                       (select auroc from ({metrics_sql('(select * from scored_big where is_distorted)', confusion=False)})), true)
    select (row_number() over (order by robust desc, auroc desc))::int as rank, method, auroc, robust,
           case dense_rank() over (order by auroc desc) when 1 then 'best' when 2 then 'second' else '' end as auroc_mark,
           case dense_rank() over (order by robust desc) when 1 then 'best' when 2 then 'second' else '' end as robust_mark, ours
    from l""", "scored_big"))
def leaderboard(spark, sf):
    published = spark.createDataFrame(LEADERBOARD, "method string, auroc double, robust double")
    big = fx.scored_big(spark, sf)
    robust = M.rounded(M.metrics(big.where("is_distorted"))).select("auroc").scalar()
    ours = M.rounded(M.metrics(big)).select(
        F.lit("ours").alias("method"), "auroc", robust.alias("robust"), F.lit(True).alias("ours"))
    return A.leaderboard(published, ours)


@query("column_best", oracle(f"""
    with m as ({metrics_sql('scored_big', 'generator')})
    select generator, auroc, ap, fpr, fnr, auroc = max(auroc) over () as auroc_best, ap = max(ap) over () as ap_best,
           fpr = min(fpr) over () as fpr_best, fnr = min(fnr) over () as fnr_best from m""", "scored_big"))
def column_best(spark, sf):
    m = M.rounded(M.metrics(fx.scored_big(spark, sf), ["generator"])).select("generator", "auroc", "ap", "fpr", "fnr")
    return A.column_best(m, {"auroc": True, "ap": True, "fpr": False, "fnr": False})


@query("generator_holes", oracle(f"""
    with m as ({metrics_sql('scored', 'generator', curves=False)})
    select generator, case when n_fake > 0 then 'fake' else 'real' end as bucket, recall, fpr,
           n_fake > 0 and recall < 0.6 as hole from m where n_fake > 0 or n_real > 0""", "scored"))
def generator_holes(spark, sf):
    """Fake generators by recall with those below a bound marked; real-only buckets apart."""
    m = M.rounded(M.metrics(fx.scored(spark, sf), ["generator"], curves=False))
    fake = F.col("n_fake") > 0
    return m.where(fake | (F.col("n_real") > 0)).select(
        "generator", F.when(fake, "fake").otherwise("real").alias("bucket"), "recall", "fpr",
        (fake & (F.col("recall") < 0.6)).alias("hole")).orderBy("bucket", F.desc("recall"), "generator")


@query("family_breakdown", oracle(f"""
    with m as ({metrics_sql('scored', 'generator', curves=False)}),
    k as (select *, ([{', '.join(f"'{k}'" for k in SOURCE_NAMES)}])[1 + substr(generator, 4)::int] as key from m)
    select key, {_map_sql('key', SOURCE_NAMES, 'key')} as name, {_map_sql('key', PIPELINES, "'other'")} as pipeline, n,
           case when n_real > 0 then macro_accuracy else recall end as acc,
           (row_number() over (order by case when n_real > 0 then macro_accuracy else recall end desc, key))::int as place from k""", "scored"))
def family_breakdown(spark, sf):
    keys = F.array(*[F.lit(k) for k in SOURCE_NAMES])
    m = M.rounded(M.metrics(fx.scored(spark, sf), ["generator"], curves=False)).withColumn(
        "key", F.get(keys, F.substring("generator", 4, 5).cast("int")))
    acc = F.when(F.col("n_real") > 0, F.col("macro_accuracy")).otherwise(F.col("recall"))
    return m.select(
        "key", lookup(F.col("key"), SOURCE_NAMES, F.col("key")).alias("name"),
        lookup(F.col("key"), PIPELINES, F.lit("other")).alias("pipeline"), "n", acc.alias("acc"),
        F.row_number().over(Window.orderBy(acc.desc(), "key")).alias("place"))


ORDER_SETS = ["mirage", "comfor_eval", "zzz_local", "openfake_test", "wildfake_dalle_advanced", "abc_local"]


@query("fixed_order", oracle(f"""
    select dataset, count(*) as n, coalesce(list_position([{', '.join(f"'{k}'" for k in HELDOUT_ORDER)}], dataset), 99)::int as place
    from (select {pick(u('ord', 'id'), ORDER_SETS)} as dataset from samples) group by dataset""", "samples"))
def fixed_order(spark, sf):
    """Known sets in their fixed order, unknown ones last."""
    pos = F.array_position(F.array(*[F.lit(k) for k in HELDOUT_ORDER]), F.col("dataset"))
    df = fx.samples(spark, sf).select(choice(uniform("ord", F.col("id")), ORDER_SETS).alias("dataset"))
    return df.groupBy("dataset").agg(F.count("*").alias("n")).withColumn(
        "place", F.coalesce(F.nullif(pos, F.lit(0)), F.lit(99)).cast("int")).orderBy("place", "dataset")
