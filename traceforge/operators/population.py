"""Population analytics over frames and state paths: histograms, transitions, dwells, correlations, features."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import NO_STATE, bin_index

def by_frame():
    return W.partitionBy("molecule_id").orderBy("frame")


def filled(counts: DataFrame, key: str, bins: int) -> DataFrame:
    """One row for each of 0..bins-1, zero where nothing was counted. The left side is as small as the result."""
    return counts.sparkSession.range(bins).select(F.col("id").cast("int").alias(key)).join(counts, key, "left").fillna(0)


def histogram(e: DataFrame, bins: int = 151, low: float = -0.25, high: float = 1.25, equal_weight: bool = False, by: list[str] | None = None) -> DataFrame:
    """bin, n (weight) and density over the in-range mass, by ``by`` if given (only bins that were met, then).

    With ``equal_weight`` a frame weighs 1 / finite frames of its molecule."""
    if bins < 1 or not high > low:
        raise ValueError("bins must be positive and the range ascending")
    by = by or []
    e = e.filter(F.col("e").isNotNull())
    w = 1 / F.count("*").over(W.partitionBy("molecule_id")) if equal_weight else F.lit(1)
    got = e.select(*by, bin_index(F.col("e"), low, high, bins).alias("bin"), w.alias("w")).filter("bin IS NOT NULL").groupBy(*by, "bin").agg(F.sum("w").cast("double").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    width = (high - low) / bins
    dense = got if by else filled(got, "bin", bins)
    return dense.withColumn("density", F.when(total > 0, F.col("n") / (total * width)).otherwise(0.0))


def pooled_totals(e: DataFrame, low: float = -0.25, high: float = 1.25, by: list[str] | None = None) -> DataFrame:
    """n_molecules with a finite value, n_samples (finite values) and n_in_range, by ``by`` if given."""
    fine = e.filter(F.col("e").isNotNull() & ~F.isnan("e"))
    return fine.groupBy(*(by or [])).agg(F.countDistinct("molecule_id").alias("n_molecules"), F.count("*").alias("n_samples"), F.count_if(F.col("e").between(low, high)).alias("n_in_range"))


def condition_histograms(e: DataFrame, requested: Sequence, bins: int = 151, low: float = -0.25, high: float = 1.25, equal_weight: bool = False) -> DataFrame:
    """ord, condition_id, bin, n, density, n_molecules: dense histograms on the same edges for the requested conditions, in that order;
    those without a finite value are skipped, a repeated one counts once."""
    kind = dict(e.dtypes)["condition_id"]
    want = F.broadcast(e.sparkSession.createDataFrame([(c, i) for i, c in enumerate(dict.fromkeys(requested))], f"condition_id {kind}, ord int"))
    own = e.filter(F.col("condition_id").isin(list(requested))).filter(F.col("e").isNotNull() & ~F.isnan("e"))
    met = own.groupBy("condition_id").agg(F.countDistinct("molecule_id").alias("n_molecules")).join(want, "condition_id")
    grid = met.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    got = histogram(own, bins, low, high, equal_weight, ["condition_id"])
    return grid.join(got, ["condition_id", "bin"], "left").fillna(0.0, ["n", "density"]).select("ord", "condition_id", "bin", "n", "density", "n_molecules")


def _weighted(rows: DataFrame, equal_weight: bool) -> DataFrame:
    """Finite rows with w: 1, or 1 / finite frames of the molecule."""
    fine = rows.filter(F.col("e").isNotNull() & ~F.isnan("e"))
    return fine.withColumn("w", 1 / F.count("*").over(W.partitionBy("molecule_id")) if equal_weight else F.lit(1.0))


def _surface(cells: DataFrame, keys: tuple[str, str], area: float, density: bool) -> DataFrame:
    if not density:
        return cells
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("n").alias("__t")))).select(*keys, (F.col("n") / (F.col("__t") * area)).alias("n"))


def time_heatmap(e: DataFrame, time_bins: int = 100, bins: int = 61, low: float = -0.2, high: float = 1.2, equal_weight: bool = False, density: bool = False, dt: float = 1.0) -> DataFrame:
    """t, bin, n; the last bin is open at its end here. With ``equal_weight`` a frame weighs 1 / finite frames of its molecule, with
    ``density`` n is a density over time (frames of ``dt``) and value; only cells that were met."""
    if time_bins < 1 or bins < 1 or not high > low or not 0 < dt < float("inf"):
        raise ValueError("bins and dt must be positive and the range ascending")
    rows = _weighted(e, equal_weight).filter(F.col("t") < time_bins).select("t", bin_index(F.col("e"), low, high, bins, closed=False).alias("bin"), "w").filter("bin IS NOT NULL")
    n = F.sum("w") if equal_weight or density else F.count("*")
    return _surface(rows.groupBy("t", "bin").agg(n.alias("n")), ("t", "bin"), dt * (high - low) / bins, density)


def jumps(paths: DataFrame) -> DataFrame:
    """Frames where an assigned state follows a different assigned one; prev and next are the molecule's jumps beside."""
    j = paths.withColumn("from_state", F.lag("state").over(by_frame())).filter((F.col("state") != NO_STATE) & (F.col("from_state") != NO_STATE) & (F.col("state") != F.col("from_state")))
    return j.select("molecule_id", F.col("frame").alias("at"), "from_state", F.col("state").alias("to_state"), F.lag("frame").over(by_frame()).alias("prev"), F.lead("frame").over(by_frame()).alias("next"))


def transition_sync(
    paths: DataFrame, before: int = 50, time_bins: int = 100, bins: int = 61, low: float = -0.2, high: float = 1.2, from_state: int | None = None, to_state: int | None = None, single_dwell: bool = True, density: bool = False, dt: float = 1.0,
) -> DataFrame:
    """dt, bin, n: frames around every jump, aligned at the last frame before it; -before <= dt <= time_bins - before.

    Only jumps from ``from_state`` and to ``to_state``, if given. With ``single_dwell`` from the start of the dwell before to (not
    including) the last frame of the dwell after, as all jumps, chosen or not, bound them; else all frames of the window, which
    may count for several jumps. With ``density`` n is a density over time (frames of ``dt``) and value."""
    if not 0 <= before <= time_bins or time_bins < 1 or bins < 1 or not high > low or not 0 < dt < float("inf"):
        raise ValueError("bins and dt must be positive, the range ascending, and the jump inside the columns")
    length = paths.groupBy("molecule_id").agg(F.count("*").alias("len"))
    span = jumps(paths.withColumn("frame", F.col("t"))).join(length, "molecule_id").withColumn("sync", F.col("at") - 1)
    for name, given in (("from_state", from_state), ("to_state", to_state)):
        if given is not None:
            span = span.filter(F.col(name) == given)
    a, b = F.col("sync") - before, F.col("sync") + time_bins - before
    if single_dwell:
        a, b = F.greatest(F.coalesce("prev", F.lit(0)), a), F.least(F.coalesce(F.col("next") - 1, F.col("len") - 1) - 1, b)
    else:
        a, b = F.greatest(F.lit(0), a), F.least(F.col("len") - 1, b)
    each = span.withColumn("a", a.cast("long")).withColumn("b", b.cast("long")).filter("a <= b").withColumn("t", F.explode(F.sequence("a", "b")))
    got = each.select("molecule_id", "sync", "t").join(paths.select("molecule_id", F.col("t").cast("long").alias("t"), "e"), ["molecule_id", "t"])
    cells = got.select((F.col("t") - F.col("sync")).alias("dt"), bin_index(F.col("e"), low, high, bins, closed=False).alias("bin")).filter("bin IS NOT NULL").groupBy("dt", "bin").agg(F.count("*").alias("n"))
    return _surface(cells, ("dt", "bin"), dt * (high - low) / bins, density)


def transition_density(paths: DataFrame, nskip: int = 2) -> DataFrame:
    """from_state, to_state, n: (v[t], v[t + nskip]) where v[t + 1] differs from v[t], all assigned."""
    if nskip < 1:
        raise ValueError("nskip must be positive")
    p = paths.select("state", F.lead("state").over(by_frame()).alias("b"), F.lead("state", nskip).over(by_frame()).alias("to_state"))
    return p.filter((F.col("state") != NO_STATE) & (F.col("b") != NO_STATE) & (F.col("to_state") != NO_STATE) & (F.col("b") != F.col("state"))).groupBy(F.col("state").alias("from_state"), "to_state").agg(F.count("*").alias("n"))


def transition_probability(paths: DataFrame, init: int, final: int) -> DataFrame:
    """molecule_id, p = #(init to final) / #(init with an assigned successor); null where the latter is 0."""
    p = paths.select("molecule_id", "state", F.lead("state").over(by_frame()).alias("b"))
    out = (F.col("state") == init) & (F.col("b") != NO_STATE)
    den = F.sum(out.cast("int"))
    return p.groupBy("molecule_id").agg(F.when(den > 0, F.sum((out & (F.col("b") == final)).cast("int")) / den).alias("p"))


def probability_density(paths: DataFrame, init: int, final: int, states: int, bins: int = 25, low: float = -0.05, high: float = 1.05) -> DataFrame:
    """bin, n, density of the molecules' transition probabilities, all bins. ValueError for states that the model hasn't."""
    if not (0 <= init < states and 0 <= final < states):
        raise ValueError(f"states must lie from 0 to {states - 1}")
    p = transition_probability(paths, init, final).filter("p IS NOT NULL")
    got = p.select(bin_index(F.col("p"), low, high, bins).alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count("*").cast("double").alias("n"))
    dense = filled(got, "bin", bins)
    total = F.sum("n").over(W.partitionBy(F.lit(0)))  # as many rows as bins
    return dense.withColumn("density", F.when(total > 0, F.col("n") / (total * ((high - low) / bins))).otherwise(0.0))


def dwell_summary(d: DataFrame, means: Sequence[float], dt: float = 1.0) -> DataFrame:
    """state, level (its mean), n_dwells, mean_dwell (in units of ``dt``) of every state with a dwell."""
    level = F.element_at(F.array(*map(F.lit, means)), F.col("state").cast("int") + 1)
    return d.groupBy("state").agg(F.count("*").alias("n_dwells"), (F.avg("length") * dt).alias("mean_dwell")).select("state", level.alias("level"), "n_dwells", "mean_dwell")


def dwell_histogram(d: DataFrame, bins: int = 51, dt: float = 1.0) -> DataFrame:
    """state, bin, left, n, density of each state's dwells from its shortest to its longest, all bins; a state whose dwells are all alike
    has half a unit of room on both sides."""
    x = F.col("length") * dt
    by = d.groupBy("state", "length").agg(F.count("*").alias("n"))
    ends = by.groupBy("state").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum("n").alias("total"))
    ends = ends.select("state", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total")
    at = F.least(F.lit(bins - 1), F.floor((x - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int")
    got = by.join(ends, "state").groupBy("state", at.alias("bin")).agg(F.sum("n").alias("n"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(got, ["state", "bin"], "left").fillna(0, ["n"]).select("state", "bin", (F.col("lo") + F.col("bin") * width).alias("left"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))


def state_number(paths: DataFrame) -> DataFrame:
    n = paths.filter(F.col("state") != NO_STATE).groupBy("molecule_id").agg(F.countDistinct("state").alias("states"))
    return n.groupBy("states").agg(F.count("*").alias("n"))


def runs(paths: DataFrame) -> DataFrame:
    """Run-length encoding with gaps as separators: molecule_id, state, start, length."""
    c = paths.withColumn("new", F.coalesce((F.col("state") != F.lag("state").over(by_frame())).cast("int"), F.lit(1)))
    return c.withColumn("run", F.sum("new").over(by_frame())).groupBy("molecule_id", "run").agg(F.first("state").alias("state"), F.min("frame").alias("start"), F.count("*").alias("length")).filter(F.col("state") != NO_STATE).drop("run")


def dwells(paths: DataFrame, include_first: bool = False) -> DataFrame:
    """molecule_id, state, length: gap frames go first, so equal states across a gap are one run; the last run of a
    molecule never counts, the first only with ``include_first``."""
    r = runs(paths.filter(F.col("state") != NO_STATE))
    o = W.partitionBy("molecule_id").orderBy("start")
    r = r.withColumn("k", F.row_number().over(o)).withColumn("last", F.lead("start").over(o).isNull())
    return r.filter(~F.col("last") & (F.lit(include_first) | (F.col("k") > 1))).select("molecule_id", "state", "length")


def survival(d: DataFrame) -> DataFrame:
    """state, tau, s: share of dwells longer than tau, tau from 0 below the longest. Works on distinct lengths."""
    by = d.groupBy("state", "length").agg(F.count("*").alias("c"))
    order = W.partitionBy("state").orderBy(F.desc("length"))
    # from the longest: how many last longer than the length before, which holds from there up to this one
    run = by.withColumn("k", F.sum("c").over(order)).withColumn("m", F.sum("c").over(W.partitionBy("state"))).withColumn("shorter", F.coalesce(F.lead("length").over(order), F.lit(0)))
    return run.select("state", F.explode(F.sequence(F.col("shorter").cast("long"), F.col("length") - 1)).alias("tau"), (F.col("k") / F.col("m")).alias("s"))


def exit_rates(d: DataFrame, dt: float) -> DataFrame:
    return d.groupBy("state").agg((1 / (F.avg("length") * dt)).alias("k"), F.count("*").alias("n"))


def pooled_cross_correlation(frames: DataFrame, max_lag: int | None = None) -> DataFrame:
    """lag, r, molecules: as cross_correlation, over the lags that all molecules have: up to the shortest usable trace's length less one,
    or ``max_lag`` if that is less. Usable are molecules of two frames and more, all of them finite; ValueError without any.

    Traces are correlated whole in their task, whatever the number of lags; what is shuffled are sums by lag."""
    if max_lag is not None and max_lag < 0:
        raise ValueError("max_lag must not be negative")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    pair = F.struct("frame", F.col("donor").cast("double").alias("d"), F.col("acceptor").cast("double").alias("a"))
    rows = frames.groupBy("molecule_id").agg(F.count("*").alias("n"), F.bool_or(bad("donor") | bad("acceptor")).alias("bad"), F.array_sort(F.collect_list(pair)).alias("v")).filter("n >= 2 AND NOT bad")
    rows = rows.select("n", F.transform("v", lambda s: s["d"]).alias("d"), F.transform("v", lambda s: s["a"]).alias("a"))
    common = rows.agg(F.min("n").alias("n")).first()["n"]
    if common is None:
        raise ValueError("no molecule has two finite frames")
    k = min(common - 1, max_lag) if max_lag is not None else common - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros(2 * k + 1), 0
        for f in batches:
            for d, a in zip(f["d"], f["a"]):
                d, a = np.asarray(d) - np.mean(d), np.asarray(a) - np.mean(a)
                sd, sa = d.std(), a.std()
                if not (np.ptp(d) > 0 and np.ptp(a) > 0):
                    continue
                mid = len(d) - 1
                total += np.correlate(d, a, "full")[mid - k : mid + k + 1] / (len(d) * sd * sa)
                count += 1
        yield pd.DataFrame({"lag": np.arange(-k, k + 1), "s": total, "m": count})

    got = rows.select("d", "a").mapInPandas(run, "lag int, s double, m long").groupBy("lag").agg(F.sum("s").alias("s"), F.sum("m").alias("molecules"))
    return got.select("lag", F.try_divide("s", "molecules").alias("r"), "molecules")


def cross_correlation(frames: DataFrame, max_lag: int) -> DataFrame:
    """lag, r, molecules: mean over molecules of the biased Pearson correlation; flat channels are skipped."""
    m = W.partitionBy("molecule_id")
    x = frames.filter("donor IS NOT NULL AND acceptor IS NOT NULL").withColumn("d0", F.col("donor") - F.avg("donor").over(m)).withColumn("a0", F.col("acceptor") - F.avg("acceptor").over(m))
    x = x.withColumn("n", F.count("*").over(m)).withColumn("sd", F.stddev_pop("donor").over(m)).withColumn("sa", F.stddev_pop("acceptor").over(m))
    x = x.withColumn("flat", (F.max("donor").over(m) == F.min("donor").over(m)) | (F.max("acceptor").over(m) == F.min("acceptor").over(m))).filter("NOT flat")
    sums = x.select("molecule_id", "n", "sd", "sa", "d0", *[(F.lag("a0", k) if k >= 0 else F.lead("a0", -k)).over(by_frame()).alias(f"l{k + max_lag}") for k in range(-max_lag, max_lag + 1)])
    per = sums.groupBy("molecule_id", "n", "sd", "sa").agg(*[F.sum(F.col("d0") * F.coalesce(F.col(f"l{k}"), F.lit(0.0))).alias(f"s{k}") for k in range(2 * max_lag + 1)])
    r = per.select("molecule_id", F.posexplode(F.array(*[F.col(f"s{k}") / (F.col("n") * F.col("sd") * F.col("sa")) for k in range(2 * max_lag + 1)])).alias("k", "r"))
    return r.groupBy((F.col("k") - max_lag).alias("lag")).agg(F.avg("r").alias("r"), F.count("*").alias("molecules"))


def sliding_correlation(frames: DataFrame, window: int = 15) -> DataFrame:
    """molecule_id, start, lag0 of every full window of ``window`` frames; null for flat windows."""
    if window < 2:
        raise ValueError("window must be at least 2")
    w = by_frame().rowsBetween(0, window - 1)
    x = frames.select("molecule_id", F.col("frame").alias("start"), F.covar_pop("donor", "acceptor").over(w).alias("cov"), (F.stddev_pop("donor").over(w) * F.stddev_pop("acceptor").over(w)).alias("sd"), F.count("*").over(w).alias("n"), (F.max("donor").over(w) == F.min("donor").over(w)).alias("fd"), (F.max("acceptor").over(w) == F.min("acceptor").over(w)).alias("fa"))
    return x.filter(F.col("n") == window).select("molecule_id", "start", F.when(~F.col("fd") & ~F.col("fa") & (F.col("sd") > 0), F.col("cov") / F.col("sd")).alias("lag0"))


def trace_features(frames: DataFrame) -> DataFrame:
    """n_frames, total_intensity, snr, fret_mean, fret_var, anticorr_lag0 of each molecule (population variances)."""
    total = F.col("donor") + F.col("acceptor")
    return frames.withColumn("total", total).groupBy("molecule_id").agg(
        F.count("*").alias("n_frames"), F.avg("total").alias("total_intensity"), F.when(F.stddev_pop("total") > 0, F.avg("total") / F.stddev_pop("total")).alias("snr"),
        F.avg("e").alias("fret_mean"), F.var_pop("e").alias("fret_var"), F.when((F.max("donor") > F.min("donor")) & (F.max("acceptor") > F.min("acceptor")), F.try_divide(F.covar_pop("donor", "acceptor"), F.stddev_pop("donor") * F.stddev_pop("acceptor"))).alias("anticorr_lag0"),
    )


def kde(values: DataFrame, value: str, points: int = 100, factor: float = 0.25) -> DataFrame:
    """x, density: Gaussian kernel density on ``points`` points of [0, 1]. Each value is spread over the grid (a bounded
    number of rows), summed by point before any shuffle."""
    s = values.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s")).first()
    if not s["n"] or s["n"] < 2 or not s["s"]:
        return values.sparkSession.createDataFrame([], "k int, density double")
    h = factor * s["s"]
    grid = values.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    z = (F.col("k") / float(points - 1) - F.col("v")) / h
    return grid.groupBy("k").agg((F.sum(F.exp(-z * z / 2)) / (s["n"] * h * math.sqrt(2 * math.pi))).alias("density"))


def gaussian_overlay(spark, means, variances, shares, low: float = -0.25, high: float = 1.25, points: int = 1001) -> DataFrame:
    """k, y: sum of share * normal density on a grid; states without a positive variance are refused."""
    if len(shares) != len(means) or any(not v > 0 for v in variances):
        raise ValueError("every state needs a share and a positive variance")
    x = F.lit(low) + F.col("id") * ((high - low) / (points - 1))
    y = sum((F.lit(f / math.sqrt(2 * math.pi * v)) * F.exp(-(x - m) * (x - m) / (2 * v)) for m, v, f in zip(means, variances, shares)), F.lit(0.0))
    return spark.range(points).select(F.col("id").alias("k"), y.alias("y"))
