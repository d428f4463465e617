"""Patch grids as flat arrays: shaping, resampling and perturbation kernels.

A kernel maps an array of ``size * size`` values in [0, 1] to another one
with array expressions, so a sweep stays a map over the rows. Kernels that
move or average cells along rows and columns are a pair of small fixed
matrices (``separable``). ``let`` binds an array once where it is read
several times.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbench.functions.literals import array_literal
from corpusbench.functions.rng import normal, uniform

SIZE = 8
Matrix = list[list[float]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as needed in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def cells(size: int = SIZE) -> Column:
    return F.sequence(F.lit(0), F.lit(size * size - 1))


def patch_grid(logits: Column, size: int = SIZE, digits: int = 4) -> Column:
    """Flat logits to rows of rounded probabilities."""
    p = F.transform(logits, lambda x: F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-x)), digits))
    return to_rows(p, size)


def to_rows(flat: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice(flat, r * size + 1, F.lit(size)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _lit_matrix(m: Matrix) -> Column:
    return array_literal([[float(v) for v in row] for row in m])


def separable(x: Column, rows: Matrix, cols: Matrix) -> Column:
    """``rows @ grid @ cols.T`` on a flat square grid; ``x`` is evaluated once."""
    size, width = len(rows[0]), len(cols)

    def across(flat: Column) -> Column:
        return F.transform(to_rows(flat, size), lambda row: F.transform(_lit_matrix(cols), lambda w: _dot(w, row)))

    def down(h: Column) -> Column:
        columns = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                              lambda c: F.transform(h, lambda row: F.get(row, c)))
        return let(columns, lambda cs: F.flatten(
            F.transform(_lit_matrix(rows), lambda w: F.transform(cs, lambda col: _dot(w, col)))))

    return let(let(x, across), down)


# ----------------------------------------------- one-dimensional matrices


def identity(n: int) -> Matrix:
    return [[1.0 if i == j else 0.0 for j in range(n)] for i in range(n)]


def linear_resize(n_in: int, n_out: int, start: float = 0.0, span: float | None = None,
                  total: int | None = None) -> Matrix:
    """Linear interpolation with half-pixel centres over ``[start, start + span)``, edges clamped."""
    span = n_in if span is None else span
    total = total or n_in
    lo, hi = start, start + span - 1
    out = []
    for i in range(n_out):
        pos = min(max(start + (i + 0.5) * span / n_out - 0.5, lo), hi)
        a = math.floor(pos)
        b = min(a + 1, int(hi))
        row = [0.0] * total
        row[a] += 1.0 - (pos - a)
        row[b] += pos - a
        out.append(row)
    return out


def block_mean(n: int, parts: int) -> Matrix:
    """Mean over ``parts`` equal blocks, spread back over the block."""
    block = n // parts
    return [[1.0 / block if i // block == j // block else 0.0 for j in range(n)] for i in range(n)]


def nearest_down(n: int, parts: int) -> Matrix:
    return [[1.0 if j == int((i + 0.5) * n / parts) else 0.0 for j in range(n)] for i in range(parts)]


def nearest_up(parts: int, n: int) -> Matrix:
    return [[1.0 if j == i * parts // n else 0.0 for j in range(parts)] for i in range(n)]


def chain(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(a[i][k] * b[k][j] for k in range(len(b))) for j in range(len(b[0]))] for i in range(len(a))]


def window_mean(n: int, length: int) -> Matrix:
    """Box average of ``length`` cells with the edge repeated."""
    half = length // 2
    out = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for d in range(-half, -half + length):
            out[i][min(max(i + d, 0), n - 1)] += 1.0 / length
    return out


def gaussian(n: int, sigma: float) -> Matrix:
    """Gaussian of three sigmas with the edge repeated, rows sum to 1."""
    radius = math.ceil(3 * sigma)
    w = {d: math.exp(-d * d / (2.0 * sigma * sigma)) for d in range(-radius, radius + 1)}
    norm = sum(w.values())
    out = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for d, v in w.items():
            out[i][min(max(i + d, 0), n - 1)] += v / norm
    return out


def shifted(n: int, delta: float) -> Matrix:
    """Value at ``i + delta`` by linear interpolation, edges repeated."""
    out = [[0.0] * n for _ in range(n)]
    for i in range(n):
        a = math.floor(i + delta)
        t = i + delta - a
        out[i][min(max(a, 0), n - 1)] += 1.0 - t
        out[i][min(max(a + 1, 0), n - 1)] += t
    return out


def rolled(n: int, by: int) -> Matrix:
    return [[1.0 if j == (i - by) % n else 0.0 for j in range(n)] for i in range(n)]


def mean_of(*ms: Matrix) -> Matrix:
    return [[sum(m[i][j] for m in ms) / len(ms) for j in range(len(ms[0][0]))] for i in range(len(ms[0]))]


def flipped(n: int) -> Matrix:
    return [[1.0 if j == n - 1 - i else 0.0 for j in range(n)] for i in range(n)]


# ------------------------------------------------------------ grid reports


def heat_upsample(flat: Column, size: int, height: int, width: int) -> Column:
    """Bilinear upsample of a flat grid to ``height * width`` values."""
    return separable(flat, linear_resize(size, height), linear_resize(size, width))


def avg_pool(flat: Column, size: int, cell: int) -> Column:
    """Mean of every ``cell * cell`` block, clamped to [0, 1]."""
    n = size // cell
    m = [[1.0 / cell if j // cell == i else 0.0 for j in range(size)] for i in range(n)]
    return F.transform(separable(flat, m, m), lambda x: clamp(x))


def page_label(patches: Column) -> Column:
    return (F.array_max(patches) > 0).cast("int")


def rect_occupancy(cx: Column, cy: Column, rx: Column, ry: Column, size: int = SIZE) -> Column:
    return F.transform(cells(size), lambda i: F.when(
        (F.abs(i % size + 0.5 - cx) <= rx) & (F.abs(F.floor(i / size) + 0.5 - cy) <= ry), 1.0).otherwise(0.0))


def ellipse_occupancy(cx: Column, cy: Column, rx: Column, ry: Column, size: int = SIZE) -> Column:
    def inside(i: Column) -> Column:
        dx, dy = (i % size + 0.5 - cx) / rx, (F.floor(i / size) + 0.5 - cy) / ry
        return F.when(dx * dx + dy * dy <= 1.0, 1.0).otherwise(0.0)

    return F.transform(cells(size), inside)


def paste(base: Column, top: Column, occ: Column) -> Column:
    """Labels of the overlay where occupancy is above one half, else of the base."""
    picked = F.zip_with(top, occ, lambda t, o: F.when(o > 0.5, t))
    return F.zip_with(picked, base, lambda p, b: (F.coalesce(p, b) > 0).cast("double"))


def blend(base: Column, top: Column, alpha: Column) -> Column:
    mixed = F.zip_with(top, alpha, lambda t, a: F.struct(t.alias("t"), a.alias("a")))
    return F.zip_with(base, mixed, lambda b, m: b * (F.lit(1.0) - m["a"]) + m["t"] * m["a"])


def mask_bbox(occ: Column, size: int = SIZE, floor: float = 1e-3) -> Column:
    """Top, left, bottom, right (ends exclusive) of occupied cells; null when empty."""
    def box(hit: Column) -> Column:
        ys = F.transform(hit, lambda i: F.floor(i / size))
        xs = F.transform(hit, lambda i: i % size)
        return F.when(F.size(hit) > 0, F.struct(
            F.array_min(ys).cast("int").alias("y0"), F.array_min(xs).cast("int").alias("x0"),
            (F.array_max(ys) + 1).cast("int").alias("y1"), (F.array_max(xs) + 1).cast("int").alias("x1"),
            F.size(hit).alias("area")))

    return let(F.filter(F.transform(occ, lambda x, i: F.when(x > floor, i)), lambda i: i.isNotNull()), box)


# ------------------------------------------------------------------ kernels


def k_clean(x: Column, key: Column) -> Column:
    return x


def k_linear(rows: Matrix, cols: Matrix | None = None) -> Callable:
    """A kernel of two matrices. One that averages, so never leaves [0, 1], carries them as ``averages``."""
    def run(x: Column, key: Column) -> Column:
        return F.transform(separable(x, rows, cols or rows), lambda v: clamp(v))

    if all(min(row) >= 0 and sum(row) <= 1 + 1e-9 for m in (rows, cols or rows) for row in m):
        run.averages = (rows, cols or rows)
    return run


def folded_weights(weights: Column, rows: Matrix, cols: Matrix) -> Column:
    """Weights whose dot product with a grid is that of ``weights`` with the averaged grid."""
    return separable(weights, [list(r) for r in zip(*rows)], [list(c) for c in zip(*cols)])


def cell_sum(kernel: Callable, x: Column, key: Column) -> Column:
    """Sum of the cells of a kernel's grid; that of an averaging kernel is a weighted sum of ``x``."""
    averages = getattr(kernel, "averages", None)
    if averages is None:
        return F.aggregate(kernel(x, key), F.lit(0.0), lambda s, v: s + v)
    rows, cols = ([sum(column) for column in zip(*m)] for m in averages)
    return _dot(x, array_literal([float(r * c) for r in rows for c in cols]))


def k_noise(sigma: float, seed: str) -> Callable:
    return lambda x, key: F.transform(x, lambda v, i: clamp(v + F.lit(sigma) * normal(seed, key, i)))


def k_speckle(sigma: float, seed: str) -> Callable:
    return lambda x, key: F.transform(
        x, lambda v, i: clamp(v * (F.lit(1.0) + F.lit(sigma) * normal(seed, key, i))))


def k_grain(sigma: float, scale: int, seed: str, size: int = SIZE) -> Callable:
    """Noise shared by coarse cells of ``scale`` patches, drawn once for each."""
    per_row = max(1, size // scale)
    coarse = [i // size // scale * per_row + i % size // scale for i in range(size * size)]

    def run(x: Column, key: Column) -> Column:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(max(coarse))), lambda c: normal(seed, key, c))
        return let(drawn, lambda z: F.transform(x, lambda v, i: clamp(v + F.lit(sigma) * F.get(z, F.get(array_literal(coarse), i)))))

    return run


def k_impulse(amount: float, seed: str) -> Callable:
    def at(key: Column) -> Callable:
        return lambda v, i: F.when(uniform(f"{seed}.hit", key, i) < amount, F.when(
            uniform(f"{seed}.value", key, i) < 0.5, 0.0).otherwise(1.0)).otherwise(v)

    return lambda x, key: F.transform(x, at(key))


def k_jitter(amount: float) -> Callable:
    """Brightness up by ``amount``, then contrast around the mean."""
    gain = 1.0 + amount

    def run(x: Column, key: Column) -> Column:
        def contrast(b: Column) -> Column:
            mean = F.aggregate(b, F.lit(0.0), lambda s, v: s + v) / F.size(b)
            return let(mean, lambda m: F.transform(b, lambda v: clamp(m + (v - m) * gain)))

        return let(F.transform(x, lambda v: clamp(v * gain)), contrast)

    return run


def k_quantize(levels: int) -> Callable:
    return lambda x, key: F.transform(x, lambda v: F.floor(v * float(levels)) / F.lit(float(levels)))


def k_posterize(bits: int) -> Callable:
    step = 2 ** (8 - bits)
    return lambda x, key: F.transform(x, lambda v: F.floor(F.floor(v * 255.0) / step) * step / F.lit(255.0))


def k_shift(delta: float) -> Callable:
    return lambda x, key: F.transform(x, lambda v: clamp(v + F.lit(delta / 255.0)))


def k_gamma(gamma: float) -> Callable:
    return lambda x, key: F.transform(x, lambda v: F.pow(clamp(v), F.lit(gamma)))


def k_vignette(strength: float, size: int = SIZE) -> Callable:
    def at(v: Column, i: Column) -> Column:
        xx = F.lit(-1.0) + (i % size) * (2.0 / (size - 1))
        yy = F.lit(-1.0) + F.floor(i / size) * (2.0 / (size - 1))
        return clamp(v * clamp(F.lit(1.0) - F.lit(strength) * (xx * xx + yy * yy), 0.25, 1.0))

    return lambda x, key: F.transform(x, at)


def k_median3(size: int = SIZE) -> Callable:
    def run(x: Column, key: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            r, c = F.floor(i / size), i % size
            around = []
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    rr = F.least(F.greatest(r + dr, F.lit(0)), F.lit(size - 1))
                    cc = F.least(F.greatest(c + dc, F.lit(0)), F.lit(size - 1))
                    around.append(F.get(x, (rr * size + cc).cast("int")))
            return F.get(F.array_sort(F.array(*around)), 4)

        return F.transform(x, at)

    return run


def k_unsharp(percent: float, sigma: float, threshold: float, size: int = SIZE) -> Callable:
    g = gaussian(size, sigma)

    def sharpen(v: Column, b: Column) -> Column:
        return F.when(F.abs(v - b) >= threshold / 255.0, clamp(v + F.lit(percent / 100.0) * (v - b))).otherwise(v)

    return lambda x, key: F.zip_with(x, separable(x, g, g), sharpen)


def k_surface(sigma: float, edge: float, size: int = SIZE) -> Callable:
    g = gaussian(size, sigma)

    def smooth(v: Column, b: Column) -> Column:
        w = F.lit(1.0) / (F.lit(1.0) + F.abs(v - b) * 255.0 / edge)
        return clamp(b * w + v * (F.lit(1.0) - w))

    return lambda x, key: F.zip_with(x, separable(x, g, g), smooth)


def stretched(x: Column) -> Column:
    """Cells from the least, 0, to the greatest, 1; not a number in a flat grid."""
    lo, span = F.array_min(x), F.array_max(x) - F.array_min(x)
    return let(F.struct(lo.alias("lo"), span.alias("span")), lambda s: F.transform(
        x, lambda v: F.when(s["span"] > 0, (v - s["lo"]) / s["span"]).otherwise(v * math.nan)))


def ranked(x: Column, size: int = SIZE) -> Column:
    """Number of smaller cells, over that of all other cells of the grid. Equal cells share theirs, nulls come last."""

    def run(s: Column) -> Column:
        def smaller(v: Column) -> Column:
            return F.coalesce(F.array_position(s, v) - 1, F.size(s).cast("long"))

        return F.transform(x, lambda v: smaller(v) / F.lit(size * size - 1.0))

    return let(F.array_sort(F.array_compact(x)), run)


def unless_flat(change: Callable[[Column], Column]) -> Callable:
    """A kernel that leaves a grid of equal cells as it is."""
    return lambda x, key: F.when(F.array_min(x) < F.array_max(x), change(x)).otherwise(x)


k_autocontrast = unless_flat(stretched)
k_equalize = unless_flat(ranked)


def _keep(scale: float, size: int = SIZE) -> int:
    return max(1, round(size * scale))


def resize_pair(scale: float, size: int = SIZE) -> Callable:
    return k_linear(block_mean(size, _keep(scale, size)))


def crop(scale: float, size: int = SIZE) -> Callable:
    n = _keep(scale, size)
    return k_linear(linear_resize(n, size, start=(size - n) // 2, span=n, total=size))


def pixelate(scale: float, size: int = SIZE) -> Callable:
    n = _keep(scale, size)
    return k_linear(chain(nearest_up(n, size), nearest_down(size, n)))


def mismatch(scale: float, size: int = SIZE) -> Callable:
    n = _keep(scale, size)
    return k_linear(chain(linear_resize(n, size), nearest_down(size, n)))


def lowpass(n: int, cutoff: float) -> Matrix:
    """Gaussian fall-off over frequency along one axis, as the circular filter it amounts to.

    The fall-off of a two-dimensional frequency is that of its rows times
    that of its columns, so this matrix serves both.
    """
    waves = [k / n for k in range(-(n // 2), n - n // 2)]
    return [[sum(math.exp(-0.5 * (f / cutoff) ** 2) * math.cos(2 * math.pi * f * (i - j)) for f in waves) / n for j in range(n)] for i in range(n)]


def waves_above(n: int, cutoff: float) -> list[tuple[int, int]]:
    """Waves (rows, columns) of a higher frequency, one of each pair of opposite ones, without those that are their own opposite."""
    half = n // 2
    return [(a, b) for a in range(-half, half) for b in range(-half, half)
            if (a, b) > ((-a + half) % n - half, (-b + half) % n - half) and math.hypot(a, b) / n > cutoff]


def k_phase(amount: float, cutoff: float, seed: str) -> Callable:
    """Turn the phase of every higher wave by up to ``amount`` half circles, drawn per grid and wave.

    A wave's part in the grid is a cosine and a sine sum; turning it changes
    both, and the changes are added to the grid.
    """
    waves = waves_above(SIZE, cutoff)
    angle = [[2 * math.pi * (a * (i // SIZE) + b * (i % SIZE)) / SIZE for i in range(SIZE * SIZE)] for a, b in waves]
    cos, sin = ([[f(t) for t in row] for row in angle] for f in (math.cos, math.sin))
    by_cell = [[*c, *s] for c, s in zip(zip(*cos), zip(*sin))]

    def run(x: Column, key: Column) -> Column:
        turns = F.transform(F.sequence(F.lit(0), F.lit(len(waves) - 1)), lambda h: F.lit(amount * math.pi) * (
            F.lit(2.0) * uniform(seed, F.concat(key.cast("string"), F.lit("|"), h.cast("string"))) - 1.0))
        sums = F.arrays_zip(F.transform(_lit_matrix(cos), lambda w: _dot(w, x)).alias("a"), F.transform(_lit_matrix(sin), lambda w: _dot(w, x)).alias("b"), turns.alias("t"))

        def change(rows: Column) -> Column:
            added = F.concat(
                F.transform(rows, lambda r: r["a"] * (F.cos(r["t"]) - 1.0) + r["b"] * F.sin(r["t"])),
                F.transform(rows, lambda r: r["b"] * (F.cos(r["t"]) - 1.0) - r["a"] * F.sin(r["t"])))
            return let(added, lambda d: F.zip_with(x, F.transform(_lit_matrix(by_cell), lambda w: _dot(w, d)), lambda v, e: clamp(v + e * 2.0 / SIZE**2)))

        return let(sums, change)

    return run


# The two sweeps, in order. A kernel maps (grid, key) to a
# grid; None marks names that need an image codec or colour space.
ALL = {
    "clean": k_clean,
    "jpeg90": None, "jpeg70": None, "jpeg50": None, "jpeg30": None,
    "blur0.5": k_linear(gaussian(SIZE, 0.5)), "blur1.0": k_linear(gaussian(SIZE, 1.0)),
    "blur2.0": k_linear(gaussian(SIZE, 2.0)),
    "resize0.5": resize_pair(0.5), "resize0.25": resize_pair(0.25),
    "noise0.02": k_noise(0.02, "noise0.02"), "noise0.05": k_noise(0.05, "noise0.05"),
    "noise0.10": k_noise(0.10, "noise0.10"),
    "jitter20": k_jitter(0.2), "crop80": crop(0.8),
}
EXTRA = {
    "jpeg20": None, "jpeg10": None,
    "blur4.0": k_linear(gaussian(SIZE, 4.0)), "resize0.125": resize_pair(0.125),
    "noise0.20": k_noise(0.20, "noise0.20"), "jitter40": k_jitter(0.4), "crop60": crop(0.6),
    "impulse0.02": k_impulse(0.02, "impulse0.02"), "quantize32": k_quantize(32),
    "motion9": k_linear(identity(SIZE), window_mean(SIZE, 9)), "shift20": k_shift(20.0),
    "pixelate8": pixelate(0.125),
    "jpeg5": None, "doublejpeg": None, "webp20": None, "chroma420": None,
    "median3": k_median3(), "unsharp": k_unsharp(150.0, 1.5, 2.0), "rotate3": None,
    "nudge1": k_linear(shifted(SIZE, -0.4), shifted(SIZE, 0.7)), "gamma07": k_gamma(0.7),
    "grain": k_grain(0.04, 8, "grain"),
    "aberr2": k_linear(identity(SIZE), mean_of(rolled(SIZE, 2), identity(SIZE), rolled(SIZE, -2))),
    "fftlp": k_linear(lowpass(SIZE, 0.32)), "autocontrast": k_autocontrast, "posterize4": k_posterize(4),
    "social": None, "gridshift": None, "resample": mismatch(0.35), "surface": k_surface(2.0, 12.0),
    "phase": k_phase(0.35, 0.18, "phase"), "hue18": None, "wb": None, "chroman": None, "equalize": k_equalize,
    "vignette": k_vignette(0.4), "perspective": None, "speckle": k_speckle(0.08, "speckle"), "recode": None,
}
PROTOCOL = {"pangram": None}
KERNELS: dict = {**ALL, **EXTRA, **PROTOCOL}
# The names of sweeps and the groups of kernels each takes, in order.
SWEEPS: dict[str, list[dict]] = {"all": [ALL], "extra": [EXTRA], "hard": [EXTRA], "all+extra": [ALL, EXTRA], "all+hard": [ALL, EXTRA]}


def register_kernel(name: str, kernel: Callable) -> None:
    """Add or replace a named kernel."""
    KERNELS[name] = kernel


def kernel(name: str) -> Callable:
    """The kernel of a name; unknown and unsupported names are errors."""
    if name not in KERNELS:
        raise ValueError(f"unknown perturbation {name!r}; known: {', '.join(KERNELS)}")
    found = KERNELS[name]
    if found is None:
        raise NotImplementedError(f"perturbation {name!r} needs an image codec, a colour space or a warp that grids do not have")
    return found


def sweep_names(spec: str | None) -> list[str] | None:
    """Names of a sweep; None for a single clean pass."""
    if spec in (None, "", "clean"):
        return None
    groups = SWEEPS.get(spec) or ([{spec: None}] if spec in KERNELS else None)
    if groups is None:
        raise ValueError(f"unknown sweep {spec!r}; known: {', '.join(SWEEPS)}")
    return [name for group in groups for name in group]
