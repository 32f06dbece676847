"""Kinetics: survival fits, shared Gaussian hidden Markov models, state paths, and the number of levels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .population import dwells, exit_rates

#: Names, start values and upper bounds of the parameters of each survival form (lower bounds are 0).
FORMS = {
    "single": (("k", "a"), (1, 1), (np.inf, np.inf)),
    "double": (("k1", "k2", "a", "b"), (1, 1, 0.5, 0.5), (np.inf, np.inf, 1, 1)),
    "triple": (("k1", "k2", "k3", "a", "b", "c"), (1, 1, 1, 0.5, 0.5, 1), (np.inf, np.inf, np.inf, 1, 1, np.inf)),
    "stretched": (("k", "beta", "a"), (1, 0.5, 1), (np.inf, 1, np.inf)),
}


def form(model: str, t: np.ndarray, p: np.ndarray) -> np.ndarray:
    if model == "stretched":
        return p[2] * np.exp(-((p[0] * t) ** p[1]))
    n = len(p) // 2
    return np.exp(-np.outer(t, p[:n])) @ p[n:]


def t_quantile(q: float, dof: int) -> float:
    """Quantile of Student's t for q >= 0.5: bisection over Simpson's rule."""
    c = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)

    def above(x: float) -> bool:
        u = np.linspace(0, x, 4001)
        y = (1 + u * u / dof) ** (-(dof + 1) / 2)
        return 0.5 + c * x / 12000 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) > q

    low, high = 0.0, 1.0
    while not above(high) and high < 1e4:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if above(mid) else (mid, high)
    return high


def fit_curve(t: np.ndarray, s: np.ndarray, model: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Least squares inside the bounds by damped steps from the plain and a spread start: parameters and their
    covariance, None if there are no more points than parameters or the curvature is singular."""
    _, start, top = FORMS[model]
    if len(t) <= len(start):
        return None
    top = np.array(top, float)
    rates = [i for i, n in enumerate(FORMS[model][0]) if n.startswith("k")]
    spread = np.array(start, float)
    spread[rates] = [4.0**-i / max(t.mean(), 1e-9) for i in range(len(rates))]
    best = None
    for p in (np.array(start, float), spread):
        cost, damp = np.sum((form(model, t, p) - s) ** 2), 1e-3
        for _ in range(400):
            h = 1e-7 * np.maximum(np.abs(p), 1e-3)
            j = np.column_stack([(form(model, t, p + h * e) - form(model, t, np.maximum(p - h * e, 0))) / (h[i] + min(h[i], p[i])) for i, e in enumerate(np.eye(len(p)))])
            a, g = j.T @ j, j.T @ (s - form(model, t, p))
            new = np.clip(p + np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0], 0, top)
            trial = np.sum((form(model, t, new) - s) ** 2)
            if trial < cost:
                done = cost - trial <= 1e-15 * (1 + cost)
                p, cost, damp = new, trial, damp / 5
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    break
        if best is None or cost < best[0]:
            best = cost, p, a
    cost, p, a = best
    try:
        return p, np.linalg.inv(a) * cost / (len(t) - len(p))
    except np.linalg.LinAlgError:
        return None


def fit_survival(curves: DataFrame, model: str = "single", dt: float = 1.0, level: float = 0.95) -> DataFrame:
    """state, parameter, value, error, half_width, r2, success for curves (state, tau in frames, s).

    One task per state; a curve has at most as many rows as its longest dwell has frames. Rates come with ascending
    values, their amplitudes in the same order. A fit that fails has null values and success false."""
    if model not in FORMS:
        raise ValueError(f"unknown survival model: {model}")
    names = FORMS[model][0]

    def one(d: pd.DataFrame) -> pd.DataFrame:
        d = d.dropna().sort_values("tau")
        t, s = d.tau.to_numpy(float) * dt, d.s.to_numpy(float)
        got = fit_curve(t, s, model)
        out = pd.DataFrame({"state": d.state.iloc[0] if len(d) else -1, "parameter": names, "value": None, "error": None, "half_width": None, "r2": None, "success": False})
        if got is None:
            return out
        p, cov = got
        error = np.sqrt(np.maximum(np.diag(cov), 0))
        if model in ("double", "triple"):
            n = len(p) // 2
            order = np.argsort(p[:n], kind="stable")
            order = np.concatenate([order, order + n])
            p, error = p[order], error[order]
        whole = np.sum((s - s.mean()) ** 2)
        r2 = 1 - np.sum((form(model, t, p) - s) ** 2) / whole if whole > 0 else None
        return out.assign(value=p, error=error, half_width=error * t_quantile(0.5 + level / 2, len(t) - len(p)), r2=r2, success=True)

    return curves.select(F.col("state").cast("long").alias("state"), "tau", "s").groupBy("state").applyInPandas(one, "state long, parameter string, value double, error double, half_width double, r2 double, success boolean")


def series(values: DataFrame) -> DataFrame:
    """molecule_id, frames, xs: each molecule's finite values in the order of its frames."""
    s = values.filter("x IS NOT NULL AND NOT isnan(x)").groupBy("molecule_id").agg(F.array_sort(F.collect_list(F.struct("frame", F.col("x").cast("double").alias("x")))).alias("s"))
    return s.select("molecule_id", F.col("s.frame").alias("frames"), F.col("s.x").alias("xs"))


#: Values (frames of all series, padded) that are worked on at once.
TOGETHER = 1 << 18
#: Values for each task of a fit, so that a round isn't spent on starting tasks.
A_TASK = 1 << 17


def padded(xs: Sequence[Sequence[float]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The series, alike in length, as (places in ``xs``, values, mask) of arrays of at most TOGETHER values (a longer one alone)."""
    lengths = np.array([len(x) for x in xs])
    order = np.argsort(lengths, kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * lengths[order[j]] <= TOGETHER:
            j += 1
        own = order[i:j]
        out, mask = np.zeros((len(own), lengths[own[-1]])), np.zeros((len(own), lengths[own[-1]]), bool)
        for k, at in enumerate(own):
            out[k, : lengths[at]], mask[k, : lengths[at]] = xs[at], True
        yield own, out, mask
        i = j


def emissions(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    return np.maximum(np.exp(-((x[..., None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var), 1e-300)


def expectations(x: np.ndarray, mask: np.ndarray, start: np.ndarray, trans: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Occupation, value, squared deviation from the current mean and first frame of each state, transitions, likelihood, summed over
    the series that are the rows of ``x``; all series take a step at once. ``mask`` holds the first frames of each row."""
    lengths = mask.sum(1)
    order = np.argsort(lengths, kind="stable")
    lengths, x, mask = lengths[order], np.ascontiguousarray(x[order].T), np.ascontiguousarray(mask[order].T)
    ended = np.searchsorted(lengths, np.arange(len(x)), side="right")  # how many series, the first ones, have no such frame
    b = np.ascontiguousarray(emissions(x, mean, var).transpose(0, 2, 1))
    n, k, rows = b.shape
    f, scale, back = np.zeros_like(b), np.ones((n, rows)), np.ones_like(b)
    for t in range(n):
        i = ended[t]
        now = (trans.T @ f[t - 1, :, i:] if t else start[:, None]) * b[t, :, i:]
        scale[t, i:] = np.maximum(now.sum(0), 1e-300)
        f[t, :, i:] = now / scale[t, i:]
    seen = b / scale[:, None]
    for t in range(n - 2, -1, -1):
        i = ended[t + 1]
        back[t, :, i:] = trans @ (seen[t + 1, :, i:] * back[t + 1, :, i:])
    g = f * back
    g /= np.where(mask, g.sum(1), 1.0)[:, None]
    by_state = lambda z: z.transpose(1, 0, 2).reshape(k, -1)
    moves = trans * (by_state(f[:-1]) @ by_state(seen[1:] * back[1:] * mask[1:, None]).T)
    flat, value = by_state(g), x.reshape(-1)
    return np.concatenate([flat.sum(1), flat @ value, ((value - mean[:, None]) ** 2 * flat).sum(1), g[0].sum(1), moves.ravel(), [np.log(scale).sum()]])


def climb(sums: Callable[..., np.ndarray], model: tuple[np.ndarray, ...], iterations: int, tolerance: float, floor: float) -> tuple[np.ndarray, ...]:
    """start, trans, mean, var after rounds of expectation (``sums`` of a model) and maximisation, until the likelihood stays."""
    start, trans, mean, var = model
    states, before = len(mean), None
    for _ in range(iterations):
        v = sums(start, trans, mean, var)
        n, sx, s2, s0 = v[: 4 * states].reshape(4, states)
        moves, likelihood = v[4 * states : -1].reshape(states, states), v[-1]
        held = n > 0
        fresh = np.where(held, sx / np.where(held, n, 1), mean)
        var = np.maximum(np.where(held, s2 / np.where(held, n, 1) - (fresh - mean) ** 2, var), floor)
        mean, start = fresh, s0 / s0.sum()
        left = moves.sum(1, keepdims=True)
        trans = np.where(left > 0, moves / np.where(left > 0, left, 1), trans)
        if before is not None and abs(likelihood - before) <= tolerance * (1 + abs(before)):
            break
        before = likelihood
    return start, trans, mean, var


def fit_hmm(values: DataFrame, states: int = 2, iterations: int = 200, tolerance: float = 1e-6, floor: float = 1e-6) -> dict[str, list]:
    """One Gaussian model for all molecules of ``values`` (molecule_id, frame, x): start, trans, mean, var by rising mean.

    Series are gathered and padded once, about A_TASK values for each task. A round is one stage, from which tasks return their sums,
    numbers of a fixed count whatever the number of molecules; values of no more than one task take all their rounds in it. Means
    start from (approximate) quantiles."""
    if states < 1:
        raise ValueError("states must be positive")
    rows, blocks = series(values).persist(), None
    try:
        flat = rows.select(F.explode("xs").alias("x"))
        first = flat.agg(F.percentile_approx("x", [(k + 0.5) / states for k in range(states)], 10_000).alias("q"), F.stddev_pop("x").alias("s"), F.count("*").alias("n")).first()
        if first["q"] is None:
            raise ValueError("no finite value")
        mean = np.array(first["q"], float)
        for k in range(1, states):
            mean[k] = max(mean[k], mean[k - 1] + 1e-6)
        trans = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(trans, 0.95 if states > 1 else 1.0)
        model = np.full(states, 1 / states), trans, mean, np.full(states, max(first["s"] / states, 1e-3) ** 2)

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                yield pd.DataFrame([(len(x), x.tobytes(), mask.tobytes()) for _, x, mask in padded(d["xs"])], columns=["n", "x", "mask"])

        def unpacked(r: Row) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(r["x"]).reshape(r["n"], -1), np.frombuffer(r["mask"], bool).reshape(r["n"], -1)

        def whole(own: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
            held = list(own)
            yield climb(lambda *now: sum(expectations(x, mask, *now) for x, mask in held), model, iterations, tolerance, floor)

        def told(*now: np.ndarray) -> np.ndarray:
            step = lambda own: [sum((expectations(x, mask, *now) for x, mask in own), 0)]
            return sum(blocks.mapPartitions(step).collect())

        packed = rows.select("xs").coalesce(1 + first["n"] // A_TASK).mapInPandas(pack, "n int, x binary, mask binary")
        blocks = packed.rdd.map(unpacked).persist(StorageLevel.MEMORY_AND_DISK)
        if first["n"] < A_TASK:
            start, trans, mean, var = blocks.mapPartitions(whole).first()
        else:
            start, trans, mean, var = climb(told, model, iterations, tolerance, floor)
    finally:
        rows.unpersist()
        if blocks is not None:
            blocks.unpersist()
    o = np.argsort(mean, kind="stable")
    return {"start": start[o].tolist(), "trans": trans[o][:, o].tolist(), "mean": mean[o].tolist(), "var": var[o].tolist()}


def viterbi(values: DataFrame, model: dict[str, list]) -> DataFrame:
    """molecule_id, frame, state: the likeliest path of each molecule over its finite frames (ties: the smaller state)."""
    start, trans, mean, var = (np.array(model[n], float) for n in ("start", "trans", "mean", "var"))
    rows = series(values)
    kind = rows.schema["molecule_id"].dataType.simpleString()

    def paths(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            ls, lt, lb = np.log(start), np.log(trans), np.log(emissions(x, mean, var))
        score, came = ls + lb[:, 0], np.tile(np.arange(len(mean)), (*x.shape, 1))
        for t in range(1, x.shape[1]):
            each = score[:, :, None] + lt
            live = mask[:, t, None]
            came[:, t] = np.where(live, each.argmax(1), came[:, t])
            score = np.where(live, each.max(1) + lb[:, t], score)
        out = np.empty(x.shape, int)
        out[:, -1] = score.argmax(1)
        for t in range(x.shape[1] - 1, 0, -1):
            out[:, t - 1] = came[np.arange(len(x)), t, out[:, t]]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            states: list = [None] * len(d)
            for own, x, mask in padded(d["xs"]):
                got = paths(x, mask)
                for k, at in enumerate(own):
                    states[at] = got[k, mask[k]]
            yield pd.DataFrame({"molecule_id": d.molecule_id, "frames": d["frames"], "states": states})

    told = rows.mapInPandas(run, f"molecule_id {kind}, frames array<long>, states array<int>")
    return told.select("molecule_id", F.explode(F.arrays_zip("frames", "states")).alias("z")).select("molecule_id", F.col("z.frames").alias("frame"), F.col("z.states").alias("state"))


def rate_constants(values: DataFrame, dt: float, states: int = 2) -> DataFrame:
    """state, k, n: exit rates of the dwells on the paths of a model fitted to the same values."""
    return exit_rates(dwells(viterbi(values, fit_hmm(values, states))), dt)


def active_levels(reference: DataFrame) -> DataFrame:
    """The levels of a benchmark whose oracle is active."""
    return reference.filter("oracle = 'active'")


def within_band(rates: DataFrame, truth: DataFrame, band: float) -> DataFrame:
    """state, k, truth, deviation (relative), within: advisory comparison of exit rates (state, k) with known ones (state, truth); a rate
    that is missing isn't within."""
    both = truth.join(rates.select("state", "k"), "state", "left")
    off = F.abs(F.col("k") - F.col("truth")) / F.col("truth")
    return both.select("state", "k", "truth", off.alias("deviation"), F.coalesce(off <= band, F.lit(False)).alias("within"))


def elbow(ks: list[int], rmse: list[float]) -> int | None:
    """The k farthest from the chord between the ends, both axes scaled to [0, 1]; None for fewer than three points and a flat curve."""
    if len(ks) < 3:
        return None
    x, y = np.array(ks, float), np.array(rmse, float)
    if not (np.isfinite(y).all() and np.ptp(y) > 0):
        return None
    x, y = (x - x[0]) / (x[-1] - x[0]), (y - y.min()) / np.ptp(y)
    away = np.abs((y[-1] - y[0]) * x - (y - y[0]))
    return ks[1 + int(away[1:-1].argmax())]


#: Cells of equal width into which values are counted for the level curve.
CELLS = 1 << 16


def level_curve(values: DataFrame, most: int = 8) -> DataFrame:
    """k, rmse, is_elbow of one-dimensional k-means for k up to ``most`` (or the number of distinct values), from quantiles, until
    nothing moves.

    Values are counted once, with their sums and squares, in CELLS cells of equal width between the least and the largest; all
    rounds go over that bounded table. A cell goes to the centre nearest to its mean, so the curve is exact where every cell
    has one value, and else a boundary may be off by a cell."""
    v = values.filter("x IS NOT NULL AND NOT isnan(x)").select(F.col("x").cast("double").alias("x"))
    ends = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends["lo"] is None:
        return values.sparkSession.createDataFrame([], "k int, rmse double, is_elbow boolean")
    width = (ends["hi"] - ends["lo"]) / CELLS or 1.0
    cell = F.least(F.lit(CELLS - 1), F.floor((F.col("x") - ends["lo"]) / width))
    got = v.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.coalesce(F.var_pop("x") * F.count("*"), F.lit(0.0)).alias("sq"), F.max("x").alias("top"), F.min("x").alias("low")).toPandas().sort_values("c")
    n, m, own = got["n"].to_numpy(float), got["m"].to_numpy(), got["sq"].to_numpy().sum()
    whole = (got["top"] == got["low"]).to_numpy()
    upto = np.cumsum(n)
    error = {}
    for k in range(1, min(most, len(m) + int((~whole).sum())) + 1):
        c = np.unique(m[np.searchsorted(upto, np.array([(i + 0.5) / k for i in range(k)]) * upto[-1])])
        while True:
            at = np.searchsorted((c[:-1] + c[1:]) / 2, m)
            size = np.bincount(at, n, len(c))
            new = np.bincount(at, n * m, len(c))[size > 0] / size[size > 0]
            if len(new) == len(c) and np.allclose(new, c, rtol=0, atol=1e-12 * (abs(ends["lo"]) + abs(ends["hi"]) + width)):
                break
            c = new
        error[k] = math.sqrt((own + (n * (m - c[at]) ** 2).sum()) / upto[-1])
    best = elbow(list(error), list(error.values()))
    return values.sparkSession.createDataFrame([(k, e, k == best) for k, e in error.items()], "k int, rmse double, is_elbow boolean")
