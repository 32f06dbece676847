"""Agreement of models, density regions, bootstrap intervals and anticorrelation events."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import fused
from ..functions.scalar import NO_STATE, bin_index
from .population import by_frame


def canonical(paths: DataFrame, level_means: Sequence[float] | None = None) -> DataFrame:
    """States renumbered by the rank of their mean (ties: the smaller state); gaps stay. ``level_means``: the fitted model's mean of
    each state; without them the means are those of the frames' e."""
    if level_means is not None:
        order = sorted(range(len(level_means)), key=lambda k: level_means[k])
        ranks = F.array(*[F.lit(order.index(k)) for k in range(len(level_means))])
        return paths.withColumn("state", F.when(F.col("state") == NO_STATE, NO_STATE).otherwise(F.element_at(ranks, F.col("state").cast("int") + 1)))
    means = paths.filter(F.col("state") != NO_STATE).groupBy("state").agg(F.avg("e").alias("level"))
    rank = means.select("state", (F.row_number().over(W.orderBy("level", "state")) - 1).alias("rank"))
    return paths.join(F.broadcast(rank), "state", "left").withColumn("state", F.coalesce("rank", F.lit(NO_STATE))).drop("rank")


def path_agreement(ref: DataFrame, test: DataFrame) -> DataFrame:
    """One row. same_number: share of molecules, of those with a state in either path, that have equally many; same_state:
    share of frames with a state in both that have the same (0 if there is none); frames: how many those are."""
    r = ref.select("molecule_id", "frame", F.col("state").alias("r"))
    both = r.join(test.select("molecule_id", "frame", F.col("state").alias("t")), ["molecule_id", "frame"], "full")
    seen = lambda c: F.collect_set(F.when(F.col(c) != NO_STATE, F.col(c)))
    in_both = (F.col("r") != NO_STATE) & (F.col("t") != NO_STATE)
    per = both.groupBy("molecule_id").agg(F.size(seen("r")).alias("nr"), F.size(seen("t")).alias("nt"), F.count(F.when(in_both, 1)).alias("f"), F.count(F.when(in_both & (F.col("r") == F.col("t")), 1)).alias("s"))
    per = per.filter("nr > 0 OR nt > 0")
    return per.agg(F.avg((F.col("nr") == F.col("nt")).cast("double")).alias("same_number"), F.coalesce(F.sum("s") / F.when(F.sum("f") > 0, F.sum("f")), F.lit(0.0)).alias("same_state"), F.coalesce(F.sum("f"), F.lit(0)).alias("frames"))


def cloud(points: DataFrame, time_bins: int = 100, bins: int = 100, low: float = -0.25, high: float = 1.25, time_range: tuple[float, float] = (0.0, 100.0)) -> DataFrame:
    """tb, bin, n of the points (t, e) inside both ranges; only cells that were met. Last bins are closed."""
    got = points.select(bin_index(F.col("t"), *time_range, time_bins).alias("tb"), bin_index(F.col("e"), low, high, bins).alias("bin"))
    return got.filter("tb IS NOT NULL AND bin IS NOT NULL").groupBy("tb", "bin").agg(F.count("*").alias("n"))


#: Deviations beyond which a kernel counts as zero (it is under 3e-18 of its top there).
FAR = 9.0


def density_surface(points: DataFrame, dt: float = 1.0, time_bins: int = 100, bins: int = 100, low: float = -0.25, high: float = 1.25, time_range: tuple[float, float] | None = None, factor: float | str = "scott") -> DataFrame:
    """tb, bin, density, factor: Gaussian kernel density of the points (t * dt, e) at the middle of every cell of the grid.

    The kernel has the covariance of the points inside the grid (divisor n - 1) times the squared ``factor`` (scott and silverman
    are the same in two dimensions: n to the power of -1/6). ``time_range`` defaults to 0 up to the latest point. No rows if the
    surface isn't defined: fewer than two points in the grid, or all of them on a line.

    Moments are one aggregate. Each task then adds its points' kernels up on its own grid, each on the columns of time at most FAR
    deviations away, and the grids are summed cell by cell."""
    if time_bins < 1 or bins < 1 or not high > low or not 0 < dt < float("inf"):
        raise ValueError("bins and dt must be positive and the range not empty")
    fine = points.filter(F.col("e").isNotNull() & ~F.isnan("e") & (F.abs("e") != float("inf"))).select((F.col("t") * dt).cast("double").alias("t"), F.col("e").cast("double").alias("e"))
    t0, t1 = time_range or (0.0, fine.agg(F.max("t")).first()[0])
    if t1 is None or not t1 > t0:
        if time_range:
            raise ValueError("time_range must not be empty")
        t1 = t0 + dt
    inside = fine.filter(F.col("t").between(t0, t1) & F.col("e").between(low, high))
    m = inside.agg(F.count("*").alias("n"), F.var_samp("t").alias("tt"), F.var_samp("e").alias("ee"), F.covar_samp("t", "e").alias("te")).first()
    schema = "tb int, bin int, density double"
    det = (m["tt"] or 0.0) * (m["ee"] or 0.0) - (m["te"] or 0.0) ** 2
    if m["n"] < 2 or not det > 1e-14 * (m["tt"] or 0.0) * (m["ee"] or 0.0):
        return points.sparkSession.createDataFrame([], schema + ", factor double")
    k = float(m["n"]) ** (-1 / 6) if factor in ("scott", "silverman") else float(factor)
    if not k > 0:
        raise ValueError("factor must be positive")
    tt, ee, te, far = m["tt"] * k * k, m["ee"] * k * k, m["te"] * k * k, FAR
    times = t0 + (np.arange(time_bins) + 0.5) * ((t1 - t0) / time_bins)
    signals = low + (np.arange(bins) + 0.5) * ((high - low) / bins)
    det = tt * ee - te * te
    top = 1 / (m["n"] * 2 * math.pi * math.sqrt(det))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = np.zeros((time_bins, bins))
        for b in batches:
            t, e = b.column(0).to_numpy(), b.column(1).to_numpy()
            order = np.argsort(t, kind="stable")
            t, e = t[order], e[order]
            reach = far * math.sqrt(tt)
            for i, at in enumerate(times):
                own = slice(*np.searchsorted(t, (at - reach, at + reach)))
                d, s = at - t[own], signals[:, None] - e[own]
                grid[i] += np.exp(-0.5 * (ee * d * d - 2 * te * d * s + tt * s * s) / det).sum(1)
        tb, sb = np.nonzero(grid)
        yield pa.RecordBatch.from_arrays([pa.array(tb, pa.int32()), pa.array(sb, pa.int32()), pa.array(grid[tb, sb])], names=["tb", "bin", "density"])

    got = inside.mapInArrow(run, schema).groupBy("tb", "bin").agg((F.sum("density") * top).alias("density"))
    cells = points.sparkSession.range(time_bins * bins).select(F.floor(F.col("id") / bins).cast("int").alias("tb"), (F.col("id") % bins).cast("int").alias("bin"))
    return cells.join(got, ["tb", "bin"], "left").select("tb", "bin", F.coalesce("density", F.lit(0.0)).alias("density"), F.lit(k).alias("factor"))


def cloud_totals(points: DataFrame, dt: float = 1.0, low: float = -0.25, high: float = 1.25, time_range: tuple[float, float] | None = None) -> DataFrame:
    """One row: n_samples (finite points), n_out_of_range (of these beyond the ranges), n_molecules with a finite point."""
    fine = points.filter(F.col("e").isNotNull() & ~F.isnan("e") & (F.abs("e") != float("inf")))
    out = ~F.col("e").between(low, high)
    if time_range:
        out = out | ~(F.col("t") * dt).between(*time_range)
    return fine.agg(F.count("*").alias("n_samples"), F.count_if(out).alias("n_out_of_range"), F.countDistinct("molecule_id").alias("n_molecules"))


def density_levels(cells: DataFrame, value: str, coverages: list[float]) -> DataFrame:
    """coverage, level: the value of the first cell, from the densest, at which the summed share reaches the coverage.

    Cells are summed by value first, so the running sum is over distinct values of a grid of fixed size."""
    by = cells.groupBy(F.col(value).alias("level")).agg(F.sum(value).alias("mass")).filter("mass > 0")
    down = W.orderBy(F.desc("level"))
    run = by.withColumn("share", F.sum("mass").over(down.rowsBetween(W.unboundedPreceding, 0)) / F.sum("mass").over(W.partitionBy(F.lit(1))))
    each = run.select("level", "share", F.explode(F.array(*[F.lit(float(c)) for c in coverages])).alias("coverage"))
    return each.filter("share >= coverage - 1e-12").groupBy("coverage").agg(F.max("level").alias("level"))


def bootstrap_histogram(e: DataFrame, resamples: int = 1000, level: float = 0.95, bins: int = 151, low: float = -0.25, high: float = 1.25, seed: int = 0) -> DataFrame:
    """bin, low, high, spread: percentile interval and sample deviation of the density over resamples of molecules.

    Every resample draws as many molecules as there are, with replacement: draw i of resample r is the molecule whose
    number is a hash of (seed, r, i) scaled to the count, so that results repeat on any partitioning. Draws are counted
    per molecule before they meet its bins. Bins that no value falls into have zeros."""
    if resamples < 2 or not 0 < level < 1:
        raise ValueError("two resamples and a level inside (0, 1) are needed")
    own = e.filter(F.col("e").isNotNull()).select("molecule_id", bin_index(F.col("e"), low, high, bins).alias("bin"))
    number = numbered(own.select("molecule_id").distinct(), "molecule_id")
    counts = own.filter("bin IS NOT NULL").groupBy("molecule_id", "bin").agg(F.count("*").alias("c"))
    n = number.agg(F.count("*")).first()[0]
    draws = number.select("i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "r", "i")), 1, 8), 16, 10).cast("long")
    drawn = draws.select("r", F.floor(part * F.lit(n) / F.lit(4294967296.0)).cast("long").alias("i")).groupBy("r", "i").agg(F.count("*").alias("times"))
    mass = drawn.join(number, "i").join(counts, "molecule_id").groupBy("r", "bin").agg(F.sum(F.col("times") * F.col("c")).alias("m"))
    width = (high - low) / bins
    density = mass.withColumn("d", F.col("m") / (F.sum("m").over(W.partitionBy("r")) * width))
    spark = e.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"), F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    full = grid.join(density, ["bin", "r"], "left").fillna(0.0, ["d"])
    q = F.percentile("d", [(1 - level) / 2, (1 + level) / 2])
    return full.groupBy("bin").agg(q.alias("q"), F.stddev_samp("d").alias("spread")).select("bin", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "spread")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with i, from 0 in the order of the distinct ``key``: ranks within buckets of its hash order come first,
    then the buckets' sizes are summed."""
    s = rows.withColumn("h", F.md5(F.col(key).cast("string"))).withColumn("part", F.substring("h", 1, 3))
    size = s.groupBy("part").agg(F.count("*").alias("c"))
    before = size.select("part", F.coalesce(F.sum("c").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("h")) - 1
    return s.withColumn("k", inside).join(F.broadcast(before), "part").select(key, (F.col("before") + F.col("k")).alias("i"))


def sliding_lags(frames: DataFrame, window: int = 15, min_magnitude: float | None = None) -> DataFrame:
    """molecule_id, start, lag0, lag1 (magnitude) of every full window, or of those with a lag 1 of at least ``min_magnitude``; null
    where a channel is flat.

    Lag 0 is that of the frames with both channels. Lag 1 is the biased correlation of the donor with the acceptor one frame
    before, by the window's own means. Windows whose lags are equal differ by rounding, so all moments take the frames one by one in
    their order, which is the same on any partitioning, and products of deviations are added without being rounded first."""
    if window < 2:
        raise ValueError("window must be at least 2")
    w = by_frame().rowsBetween(0, window - 1)
    spread = lambda c: F.sqrt(F.covar_pop(c, c).over(w))
    paired = lambda c, other: F.when(F.col(other).isNotNull(), F.col(c))
    x = frames.select(
        "molecule_id", F.col("frame").alias("start"), F.collect_list(F.struct("donor", "acceptor")).over(w).alias("v"), F.avg("donor").over(w).alias("md"), F.avg("acceptor").over(w).alias("ma"),
        (spread(F.col("donor")) * spread(F.col("acceptor"))).alias("sd"), (spread(paired("donor", "acceptor")) * spread(paired("acceptor", "donor"))).alias("both"),
    ).filter(F.size("v") == window)
    lagged = F.zip_with(F.slice("v", 2, window - 1), F.slice("v", 1, window - 1), lambda now, before: (now["donor"] - F.col("md")) * (before["acceptor"] - F.col("ma")))
    cross = F.aggregate(lagged, F.lit(0.0), lambda s, y: s + F.coalesce(y, F.lit(0.0)))
    x = x.withColumn("lag1", F.when(F.col("sd") > 0, F.abs(cross / (window * F.col("sd")))))
    if min_magnitude is not None:
        x = x.filter(F.col("lag1") >= min_magnitude)

    def moment(s: Column, v: Column) -> Column:
        n, d = s["n"] + 1, s["d"] + (v["donor"] - s["d"]) / (s["n"] + 1)
        return F.struct(n.alias("n"), d.alias("d"), (s["a"] + (v["acceptor"] - s["a"]) / n).alias("a"), fused(v["acceptor"] - s["a"], v["donor"] - d, s["c"]).alias("c"))

    none = F.struct(*[F.lit(0.0).alias(c) for c in "ndac"])
    cov = F.aggregate(F.filter("v", lambda v: v["donor"].isNotNull() & v["acceptor"].isNotNull()), none, moment, lambda s: s["c"] / s["n"])
    return x.select("molecule_id", "start", F.when((F.col("sd") > 0) & (F.col("both") > 0), cov / F.col("both")).alias("lag0"), "lag1")


def anticorrelation(frames: DataFrame, window: int = 15, min_magnitude: float = 0.5, min_windows: int = 1) -> DataFrame:
    """molecule_id, start, stop, windows, peak_frame, peak, mean: runs of windows with negative lag 0 and lag 1 of at
    least ``min_magnitude``; the peak is the centre of the window with the least lag 0 (ties: the first)."""
    o = W.partitionBy("molecule_id").orderBy("start")
    hit = sliding_lags(frames, window, min_magnitude).filter("lag0 < 0").withColumn("g", F.col("start") - F.row_number().over(o))
    e = hit.groupBy("molecule_id", "g").agg(F.min("start").alias("start"), (F.max("start") + window).alias("stop"), F.count("*").alias("windows"), F.min(F.struct("lag0", "start")).alias("least"), F.avg("lag0").alias("mean"))
    return e.filter(F.col("windows") >= min_windows).select("molecule_id", "start", "stop", "windows", (F.col("least.start") + window // 2).alias("peak_frame"), F.col("least.lag0").alias("peak"), "mean")
