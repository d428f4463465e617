"""Weighted, class-balanced mixture plans over labelled sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusbench.functions.permute import Permutation
from corpusbench.functions.rng import choice, uniform
from corpusbench.operators.ranking import grouped_row_number, grouped_sum_before, join_groups, seeded_row_number


def source_classes(specs: DataFrame) -> DataFrame:
    """Labels a source can emit, as ``classes``."""
    real, fake = F.col("has_real_dirs"), F.col("has_fake_dirs")
    both, zero, one = (F.array(*map(F.lit, v)) for v in ([0, 1], [0], [1]))
    return specs.withColumn(
        "classes",
        F.when(F.col("type") == "folders", F.when(real & ~fake, zero).when(fake & ~real, one).otherwise(both))
        .when(F.col("keep_label").isNotNull(), F.array("keep_label"))
        .when(F.col("fixed_label").isNotNull() & F.col("label_col").isNull(), F.array("fixed_label"))
        .otherwise(both))


def class_shares(specs: DataFrame) -> DataFrame:
    """Share of every source overall and within each class it can emit.

    Negative weights count as 0. The windows see one row per (source, class).
    """
    w = F.greatest(F.lit(0.0), F.col("weight"))
    total = specs.agg(F.sum(w).alias("t")).scalar()
    per = specs.select("source", "k", w.alias("w"), (w / total).alias("share"), F.explode("classes").alias("label"))
    return per.withColumn("class_share", F.col("w") / F.sum("w").over(Window.partitionBy("label")))


def live_sources(specs: DataFrame) -> DataFrame:
    """Sources that have rows in at least one class they can emit."""
    n = F.when(F.array_contains("classes", 0), F.col("n_real")).otherwise(F.lit(0)) + F.when(
        F.array_contains("classes", 1), F.col("n_fake")).otherwise(F.lit(0))
    return specs.where(n > 0)


def intervals(shares: DataFrame, by: str = "label", weight: str = "class_share") -> DataFrame:
    """One row per class with its cumulative intervals as an array (one entry per source)."""
    w = Window.partitionBy(by).orderBy("k")
    cum = shares.where(F.col(weight) > 0).withColumn(
        "hi", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return cum.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("k", "hi", "source"))).alias("steps"))


def pick_interval(steps: Column, u: Column) -> Column:
    """Source whose interval holds ``u``; the last one closes the range."""
    hit = F.get(F.filter(steps, lambda s: u < s["hi"]), 0)
    return F.coalesce(hit["source"], F.element_at(steps, -1)["source"])


def weighted_pick(draws: DataFrame, steps: DataFrame, u: Column, by: str = "label", out: str = "source") -> DataFrame:
    """Add the source drawn by weight to every draw.

    ``steps`` holds one row per class, so the equi-join is a broadcast of two
    rows and every draw finds its interval in the array.
    """
    return draws.withColumn("_u", u).join(F.broadcast(steps), by).withColumn(
        out, pick_interval(F.col("steps"), F.col("_u"))).drop("steps", "_u")


def interval_bounds(shares: DataFrame, by: list[str], order: list[str], weight: str) -> DataFrame:
    """Each row of positive weight with its interval ``_lo`` to ``_hi`` of the cumulative weight; the last is open above.

    A class's weights are summed up in one task; see ``count_bounds`` for intervals as many as rows.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    hi = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = shares.where(F.col(weight) > 0).withColumn("_hi", hi)
    return cum.withColumns({"_lo": F.coalesce(F.lag("_hi").over(w), F.lit(0.0)), "_last": F.lead("_hi").over(w).isNull()})


def count_bounds(rows: DataFrame, by: list[str], order: list[str], bucket: Column, size: str) -> DataFrame:
    """Each row of positive whole ``size`` with its interval, in proportion to the sizes of its class.

    Sums go over buckets that follow the order (see ``ranking``), so a class of any number of rows is cut over tasks.
    """
    some = rows.where(F.col(size) > 0)
    totals = some.groupBy(*by).agg(F.sum(size).alias("_total"))
    cum = join_groups(grouped_sum_before(some, by, order, bucket, F.col(size), "_before"), totals, by)
    upto = F.col("_before") + F.col(size)
    return cum.withColumns({"_lo": F.col("_before") / F.col("_total"), "_hi": upto / F.col("_total"), "_last": upto == F.col("_total")}).drop("_before", "_total")


def range_join(draws: DataFrame, bounds: DataFrame, u: Column, by: list[str], bins: int, keep: list[str]) -> DataFrame:
    """Every draw with the interval that holds it, for tables of intervals too large for an array.

    Zero to one is cut into ``bins``; an interval is listed in each bin that
    it touches, a draw lies in one, so they meet by an equi-join and the
    bounds decide. With at least as many bins as intervals the lists hold
    at most twice as many rows as there are bins, and a draw meets two
    intervals on average whatever the weights are. A bin that holds many draws is
    split like any skewed join key.
    """
    cut = lambda x: F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1))
    last_bin = F.when(F.col("_last"), F.lit(bins - 1).cast("long")).otherwise(cut(F.col("_hi")))
    listed = bounds.select(*by, *keep, "_lo", "_hi", "_last", F.explode(F.sequence(cut(F.col("_lo")), last_bin)).alias("_bin"))
    placed = draws.withColumn("_u", u).withColumn("_bin", cut(F.col("_u")))
    inside = (F.col("_u") >= F.col("_lo")) & ((F.col("_u") < F.col("_hi")) | F.col("_last"))
    return join_groups(placed, listed, [*by, "_bin"]).where(inside).drop("_u", "_bin", "_lo", "_hi", "_last")


def weighted_source(draws: DataFrame, shares: DataFrame, u: Column, weight: str = "share",
                    out: str = "source") -> DataFrame:
    """Source by its overall weight; the one row of intervals is a scalar subquery."""
    one = intervals(shares.select("source", "k", weight).distinct().withColumn("_all", F.lit(1)), "_all", weight)
    return draws.withColumn("_steps", one.select("steps").scalar()).withColumn(
        out, pick_interval(F.col("_steps"), u)).drop("_steps")


def mixture_draw(draws: DataFrame, pool: DataFrame, shares: DataFrame, seed: str, block: int = 65536) -> DataFrame:
    """Class by fair coin, source by weight in the class, then the source's next item.

    ``draws`` has a dense ``draw`` number. Items of a (source, class) come in
    seeded order and start again when used up: ``pass`` counts the rounds.
    Both the order of the pool and the numbering of the draws are bucketed,
    so a source that takes a third of all draws is spread over many tasks.
    """
    coin = (uniform(f"{seed}.class", F.col("draw")) < 0.5).cast("int")
    sizes = pool.groupBy("source", "label").agg(F.count("*").alias("pool_size"))
    usable = shares.join(sizes, ["source", "label"]).withColumn(
        "class_share", F.col("w") / F.sum("w").over(Window.partitionBy("label")))
    drawn = weighted_pick(draws.withColumn("label", coin), intervals(usable),
                          uniform(f"{seed}.source", F.col("draw")))
    numbered = grouped_row_number(drawn, ["source", "label"], ["draw"],
                                  F.floor(F.col("draw") / block), out="_occ")
    items = seeded_row_number(pool.select("source", "label", "id"), ["source", "label"],
                              f"{seed}.order", "id", out="_slot")
    occ = F.col("_occ") - 1
    placed = numbered.join(sizes, ["source", "label"]).withColumn(
        "pass", F.floor(occ / F.col("pool_size"))).withColumn("_slot", occ % F.col("pool_size") + 1)
    return placed.join(items, ["source", "label", "_slot"]).select("draw", "label", "source", "id", "pass")


def expected_repeats(shares: DataFrame, sizes: DataFrame, draws: Column) -> DataFrame:
    """Draws per unique item for every (source, class) under fair classes."""
    joined = shares.join(sizes, ["source", "label"])
    return joined.withColumn("expected_draws", draws * F.lit(0.5) * F.col("class_share")).withColumn(
        "repeats", F.col("expected_draws") / F.col("pool_size"))


def largest_remainder(df: DataFrame, by: list[str], weight: str, slots: str, order: str, out: str) -> DataFrame:
    """Split ``slots`` by weight: whole parts, then the largest fractions in stable order."""
    group = Window.partitionBy(*by)
    w = F.greatest(F.lit(0.0), F.col(weight))
    total = F.sum(w).over(group)
    raw = F.when(total > 0, F.col(slots) * w / total).otherwise(F.lit(0.0))
    step = df.withColumn("_raw", raw).withColumn("_whole", F.floor("_raw"))
    left = F.col(slots) - F.sum("_whole").over(group)
    place = F.row_number().over(group.orderBy((F.col("_raw") - F.col("_whole")).desc(), order))
    return step.withColumn(out, (F.col("_whole") + F.when(
        (place <= left) & (F.sum("_raw").over(group) > 0), 1).otherwise(0)).cast("long")).drop("_raw", "_whole")


# Fixed value: how far the seeds of epochs, and of workers, are apart.
SEED_STEP = 1009


def epoch_seed(seed: int, epoch: int, worker: int = 0, step: int = 0, round_: int = 0) -> str:
    """Seed of an order: the worker's part, then that of epoch, round in the epoch and resume step.

    The parts are kept apart, so no worker meets another one's epoch.
    """
    return f"{seed + worker * SEED_STEP}.{epoch * SEED_STEP + round_ + max(0, step)}"


def epoch_shuffle(df: DataFrame, seed: int, epoch: int, key: str, worker: int = 0, step: int = 0, round_: int = 0) -> DataFrame:
    """A new order per epoch, round, worker and resume step: a distributed sort by seeded draws."""
    mixed = epoch_seed(seed, epoch, worker, step, round_)
    return df.withColumn("u", uniform(mixed, F.col(key))).orderBy("u", key)


def epoch_key(seed: int, epoch: int, worker: int = 0, round_: int = 0) -> str:
    """Key of an epoch's order. A resumed run keeps the key and starts at its place, so no step meets another epoch's order."""
    return f"{seed}.{worker}.{epoch}.{round_}"


def numbered(df: DataFrame, key: str, bucket: Column, out: str = "row") -> DataFrame:
    """Rows numbered from 0 in key order, once for all epochs; ``bucket`` follows the key (see ``ranking``). Write the result."""
    rows = grouped_row_number(df, [], [key], bucket, out="_rn")
    return rows.withColumn(out, F.col("_rn") - 1).drop("_rn")


def epoch_places(rows: DataFrame, order: Permutation, row: str = "row", out: str = "place") -> DataFrame:
    """Every row with its place in an epoch: a projection, nothing is sorted or shuffled."""
    return rows.withColumn(out, order.place(F.col(row)))


def epoch_slice(rows: DataFrame, order: Permutation, start: int, stop: int, row: str = "row", out: str = "place") -> DataFrame:
    """The rows at places from ``start`` up to ``stop`` (not included) of an epoch, where a resumed run goes on.

    Places are turned into row numbers and joined, so only the slice is
    shuffled, however far into the epoch it lies.
    """
    wanted = rows.sparkSession.range(max(0, start), min(stop, order.n)).select(F.col("id").alias(out), order.row(F.col("id")).alias(row))
    return rows.join(wanted, row)


# Probability and levels of each augmentation, and the kinds
# an extra distortion is drawn from (the aligned set keeps pixels in place).
AUGMENT = {
    "hflip": (0.5, None), "jitter": (0.30, None), "grayscale": (0.05, None),
    "blur": (0.10, [0.5, 1.0, 2.0, 4.0]), "hue": (0.08, None), "wb": (0.08, None),
    "downscale": (0.30, [0.5, 0.25, 0.125]), "noise": (0.15, [0.02, 0.05, 0.10, 0.20]),
}
CENTER_CROP_PROB = 0.15
JPEG_PROB, JPEG_QUALITY = 0.70, [90.0, 70.0, 50.0, 30.0, 20.0, 10.0, 5.0]
WEBP_PROB, WEBP_QUALITY = 0.18, [20.0, 40.0, 60.0, 80.0]
EXTRA_PROB, EXTRA_MAX = 0.55, 4
EXTRA_KINDS = [
    "jpeg", "doublejpeg", "webp", "blur", "impulse", "quantize", "motion", "shift", "pixelate",
    "bright", "chroma", "median", "unsharp", "rotate", "nudge", "gamma", "grain", "aberr", "fftlp",
    "autocontrast", "posterize", "social", "gridshift", "resample", "surface", "phase", "hue", "wb",
    "chroman", "equalize", "vignette", "perspective", "speckle", "recode",
]
UNALIGNED_KINDS = ["rotate", "nudge", "gridshift", "perspective"]


def augment_plan(df: DataFrame, seed: str, key: str, aligned: bool = False) -> DataFrame:
    """Draw the augmentations of every sample: ``slot, kind, param`` in long form.

    The aligned plan leaves out what moves pixels: flip, crops and four extras.
    """
    k = F.col(key)

    def draw(slot: str) -> Column:
        return uniform(f"{seed}.{slot}", k)

    def op(slot: str, when: Column, kind: Column, param: Column | None = None) -> Column:
        body = F.struct(F.lit(slot).alias("slot"), kind.alias("kind"),
                        (F.lit(None) if param is None else param).cast("double").alias("param"))
        return F.when(when, body)

    ops: list[Column] = []
    for name, (prob, levels) in AUGMENT.items():
        if not (aligned and name == "hflip"):
            ops.append(op(name, draw(name) < prob, F.lit(name),
                          choice(draw(name + ".p"), levels) if levels else None))
    if not aligned:
        crop = F.when(draw("crop") < CENTER_CROP_PROB, "center_crop").otherwise("random_crop")
        ops.append(op("crop", F.lit(True), crop))
    r = draw("codec")
    ops.append(op("codec", r < JPEG_PROB + WEBP_PROB, F.when(r < JPEG_PROB, "jpeg").otherwise("webp"),
                  F.when(r < JPEG_PROB, choice(draw("codec.p"), JPEG_QUALITY))
                  .otherwise(choice(draw("codec.p"), WEBP_QUALITY))))
    kinds = [x for x in EXTRA_KINDS if not (aligned and x in UNALIGNED_KINDS)]
    n_extra = F.when(draw("extra") < EXTRA_PROB, F.floor(draw("extra.n") * float(EXTRA_MAX)) + 1).otherwise(0)
    for i in range(EXTRA_MAX):
        ops.append(op(f"extra{i}", n_extra > i, choice(draw(f"extra{i}"), kinds)))
    planned = F.filter(F.array(*ops), lambda s: s.isNotNull())
    return df.select(key, F.inline(planned))


def composite_plan(df: DataFrame, seed: str, key: str, batch: str, prob: float = 0.6,
                   weights: tuple[float, float, float] = (1.0, 1.0, 1.0), ror_ratio: float = 1.0 / 3.0,
                   max_overlays: int = 3) -> DataFrame:
    """Per batch: which rows become composites, their pairing, partner and overlay count.

    Fakes are chosen with ``prob`` and split over fake-on-real, real-on-fake
    and fake-on-fake by largest remainder; the first reals in seeded order
    become real-on-real, ``round(chosen * ratio)`` of them. A batch has a
    fixed small size, so its rows meet in one array per class and the whole
    plan costs one shuffle.
    """
    order = uniform(f"{seed}.order", F.col(key))
    picked = uniform(f"{seed}.pick", F.col(key)) < prob
    item = F.struct(order.alias("u"), F.col(key).alias("id"), picked.alias("picked"))
    per = df.groupBy(batch).agg(
        F.array_sort(F.collect_list(F.when(F.col("label") == 0, item))).alias("reals"),
        F.array_sort(F.collect_list(F.when(F.col("label") == 1, item))).alias("fakes"),
    ).withColumn("chosen", F.filter("fakes", lambda s: s["picked"]))
    n_real, n_fake, n_chosen = (F.size(c) for c in ("reals", "fakes", "chosen"))

    # Largest remainder over the three pairings; without reals two of them are off.
    live = [F.when(n_real > 0, w).otherwise(0.0) for w in weights[:2]] + [F.lit(weights[2])]
    total = live[0] + live[1] + live[2]
    raw = [n_chosen * w / total for w in live]
    frac = [x - F.floor(x) for x in raw]
    left = n_chosen - sum((F.floor(x) for x in raw), F.lit(0))

    def quota(i: int) -> Column:
        ahead = [(frac[j] > frac[i]) if j > i else (frac[j] >= frac[i]) for j in range(3) if j != i]
        place = sum((a.cast("int") for a in ahead), F.lit(0))
        return (F.floor(raw[i]) + F.when(place < left, 1).otherwise(0)).cast("int")

    per = per.select(
        F.col(batch).alias("batch"), "reals", "fakes", "chosen", quota(0).alias("q1"), quota(1).alias("q2"),
        F.when(n_real > 1, F.least(n_real, F.bround(n_chosen * ror_ratio).cast("int"))).otherwise(0).alias("ror"))

    def plan_row(s: Column, label: int, combo: Column, partner: Column) -> Column:
        overlays = F.floor(uniform(f"{seed}.overlays", s["id"]) * float(max_overlays)) + 1
        return F.struct(s["id"].alias("id"), F.lit(label).alias("label"), combo.alias("combo"),
                        partner["id"].alias("partner"), overlays.alias("overlays"))

    def drawn(pool: Column, s: Column, size: Column) -> Column:
        return F.floor(uniform(f"{seed}.partner", s["id"]) * size).cast("int")

    def fake_row(s: Column, i: Column) -> Column:
        combo = (F.when(i < F.col("q1"), "fake_on_real").when(i < F.col("q1") + F.col("q2"), "real_on_fake")
                 .otherwise("fake_on_fake"))
        pool = F.when(combo == "fake_on_fake", F.col("fakes")).otherwise(F.col("reals"))
        return plan_row(s, 1, combo, F.get(pool, drawn(pool, s, F.size(pool))))

    def real_row(s: Column, i: Column) -> Column:
        # A row never pairs with itself: draw among the others and step over it.
        slot = drawn(F.col("reals"), s, F.size("reals") - 1)
        return plan_row(s, 0, F.lit("real_on_real"), F.get("reals", slot + (slot >= i).cast("int")))

    rows = F.concat(F.transform("chosen", fake_row), F.transform(F.slice("reals", 1, F.col("ror")), real_row))
    return per.select("batch", F.inline(rows))


def overlay_draws(plan: DataFrame, seed: str) -> DataFrame:
    """One row per overlay; after the first, real or fake at even odds unless real-on-real."""
    rows = plan.select("*", F.explode(F.sequence(F.lit(1), F.col("overlays").cast("int"))).alias("overlay"))
    first = F.when(F.col("combo").isin("fake_on_real", "fake_on_fake"), 1).otherwise(0)
    later = F.when(F.col("combo") == "real_on_real", 0).otherwise(
        (uniform(f"{seed}.later", F.col("id"), F.col("overlay")) < 0.5).cast("int"))
    return rows.withColumn("top_class", F.when(F.col("overlay") == 1, first).otherwise(later))


def overlay_table_function(seed: str):
    """The same rows as ``overlay_draws`` as a Python table function.

    For SQL users who call it with LATERAL; the generator form is faster.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="overlay int, top_class int")
    class Overlays:
        def eval(self, id: int, combo: str, overlays: int):
            import hashlib

            for i in range(1, int(overlays) + 1):
                if i == 1:
                    yield i, int(combo in ("fake_on_real", "fake_on_fake"))
                elif combo == "real_on_real":
                    yield i, 0
                else:
                    digest = hashlib.md5(f"{seed}.later|{id}|{i}".encode()).hexdigest()
                    yield i, int(int(digest[:8], 16) / 4294967296.0 < 0.5)

    return Overlays
