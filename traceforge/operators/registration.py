"""Registration maps between two channels, fitted from matched points by aggregated moments: one small sum a map."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points from which a map has degree two; fewer, at least two, give a similarity.
POLYNOMIAL_POINTS, SIMILARITY_POINTS = 6, 2
#: The gate of the root mean square residual, in pixels.
GATE = 0.5
#: Powers of x and y of the six terms of degree two, in the order in which coefficients are stored.
TERMS = ((0, 0), (1, 0), (0, 1), (1, 1), (2, 0), (0, 2))
_MAP = "degree int, n_points long, a array<double>, b array<double>, mean_x double, mean_y double, scale_x double, scale_y double, fault string"


def mapped(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """Where a fitted map (a struct of _MAP's fields) takes a point: centred and scaled, then the polynomial."""
    u, v = (x - m["mean_x"]) / m["scale_x"], (y - m["mean_y"]) / m["scale_y"]
    term = lambda i, j: F.lit(1.0) if i + j == 0 else u if (i, j) == (1, 0) else v if (i, j) == (0, 1) else u * v if i == j else u * u if i else v * v
    value = lambda c: sum((m[c][k] * term(*p) for k, p in enumerate(TERMS)), F.lit(0.0))
    return value("a"), value("b")


def _solved(r, sides: Sequence[str]) -> dict:
    """The map of one row of moments; its fault, if it has none."""
    n = int(r["n"])
    out = {"degree": None, "n_points": n, "a": None, "b": None, "mean_x": r["mx"], "mean_y": r["my"], "scale_x": r["sx"], "scale_y": r["sy"], "fault": None}
    if r["odd"]:
        return out | {"fault": "positions that are not finite"}
    if n < SIMILARITY_POINTS:
        return out | {"fault": "fewer than two points"}
    if n >= POLYNOMIAL_POINTS:
        normal = np.array([[r[f"p{i + k}{j + m}"] for k, m in TERMS] for i, j in TERMS]) / n
        values = np.linalg.eigvalsh(normal)
        if values[0] <= values[-1] * 1e-13:
            return out | {"fault": "points on a line or a conic, or the same ones"}
        right = np.array([[r[f"q{i}{j}"], r[f"r{i}{j}"]] for i, j in TERMS]) / n
        c = np.linalg.solve(normal, right)
        return out | {"degree": 2, "a": c[:, 0].tolist(), "b": c[:, 1].tolist()}
    # similarity, reflections excluded: in centred moments of normalised x, y the scales come back in
    sx, sy = r["sx"], r["sy"]
    mu = np.array([r["q00"], r["r00"]]) / n
    cov = np.array([[r["q10"] * sx, r["q01"] * sy], [r["r10"] * sx, r["r01"] * sy]]) / n
    spread = (r["p20"] * sx * sx + r["p02"] * sy * sy) / n
    if spread <= 0:
        return out | {"fault": "points at one place"}
    # the rotation that comes nearest to the cross-covariance, in the plane: its angle in closed form
    c, s = cov[0, 0] + cov[1, 1], cov[1, 0] - cov[0, 1]
    linear = np.array([[c, -s], [s, c]]) / spread
    return out | {"degree": 1, "a": [mu[0], linear[0, 0], linear[0, 1], 0.0, 0.0, 0.0], "b": [mu[1], linear[1, 0], linear[1, 1], 0.0, 0.0, 0.0], "scale_x": 1.0, "scale_y": 1.0}


def fitted(pairs: DataFrame, by: Sequence[str] = (), source: Sequence[str] = ("ax", "ay"), target: Sequence[str] = ("bx", "by")) -> DataFrame:
    """A map (struct m) from ``source`` to ``target`` positions for each of ``by``: least squares of degree two from six points on,
    else the similarity. A map that can't be fitted says why in m.fault.

    Positions are centred and scaled by their own mean and deviation first; then one aggregate gives the moments up to the fourth,
    from which each map is solved. Nothing but the moments meets in a task."""
    by = list(by)
    (x, y), (u, v) = (map(F.col, source)), (map(F.col, target))
    bad = F.lit(False)
    for c in (x, y, u, v):
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = pairs.select(*by, x.cast("double").alias("__x"), y.cast("double").alias("__y"), u.cast("double").alias("__u"), v.cast("double").alias("__v"), bad.alias("__bad"))
    scale = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    stats = rows.groupBy(*by).agg(F.avg("__x").alias("mx"), F.avg("__y").alias("my"), scale("__x").alias("sx"), scale("__y").alias("sy"), F.bool_or("__bad").alias("odd"))
    both = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))  # the second: one row
    nx, ny = (F.col("__x") - F.col("mx")) / F.col("sx"), (F.col("__y") - F.col("my")) / F.col("sy")
    power = lambda c, k: F.lit(1.0) if k == 0 else c * power(c, k - 1) if k > 1 else c
    sums = {f"p{i}{j}": power(nx, i) * power(ny, j) for i in range(5) for j in range(5 - i)}
    sums |= {f"{n}{i}{j}": power(nx, i) * power(ny, j) * F.col(c) for n, c in (("q", "__u"), ("r", "__v")) for i, j in TERMS}
    moments = both.groupBy(*by, "mx", "my", "sx", "sy", "odd").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in sums.items()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_solved(r, source) for r in f.to_dict("records")]
            yield pd.concat([f[by].reset_index(drop=True), pd.DataFrame(got)], axis=1)

    kinds = dict(moments.dtypes)
    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], _MAP])
    names = [c.split()[0] for c in _MAP.split(", ")]
    return moments.mapInPandas(run, schema).select(*by, F.struct(*names).alias("m"))


def registration(pairs: DataFrame, by: Sequence[str] = (), gate: float = GATE) -> DataFrame:
    """forward and back maps of matched points (ax, ay in the reference, bx, by in the moving channel) for each of ``by``, with degree,
    n_points, rms (root mean square residual of the forward map) and low_confidence (rms over ``gate``; never left out)."""
    by = list(by)
    forward, back = fitted(pairs, by).withColumnRenamed("m", "forward"), fitted(pairs, by, ("bx", "by"), ("ax", "ay")).withColumnRenamed("m", "back")
    maps = forward.join(back, by) if by else forward.crossJoin(back)
    at = pairs.join(maps.select(*by, "forward"), by) if by else pairs.crossJoin(F.broadcast(forward))
    px, py = mapped(F.col("ax"), F.col("ay"), F.col("forward"))
    square = lambda d: d * d
    rms = at.groupBy(*by).agg(F.sqrt(F.avg(square(px - F.col("bx")) + square(py - F.col("by")))).alias("rms"))
    got = maps.join(rms, by) if by else maps.crossJoin(F.broadcast(rms))
    return got.select(*by, "forward", "back", F.col("forward.degree").alias("degree"), F.col("forward.n_points").alias("n_points"), "rms", F.coalesce(F.col("rms") > gate, F.lit(False)).alias("low_confidence"))


def plain_coefficients(m) -> tuple[list[float], list[float]]:
    """The coefficients of x and of y of a fitted map (a collected struct) for positions as they are, neither centred nor scaled."""
    if m["fault"]:
        raise ValueError(m["fault"])
    kx, ky, mx, my = 1 / m["scale_x"], 1 / m["scale_y"], m["mean_x"], m["mean_y"]

    def of(c: Sequence[float]) -> list[float]:
        one, x, y, xy, xx, yy = c
        return [
            one - x * kx * mx - y * ky * my + xy * kx * ky * mx * my + xx * kx * kx * mx * mx + yy * ky * ky * my * my,
            x * kx - xy * kx * ky * my - 2 * xx * kx * kx * mx, y * ky - xy * kx * ky * mx - 2 * yy * ky * ky * my, xy * kx * ky, xx * kx * kx, yy * ky * ky,
        ]

    return of(m["a"]), of(m["b"])


def save_maps(maps: DataFrame, path: str) -> None:
    """Writes fitted maps (see registration) as Parquet; an existing folder is an error."""
    maps.write.parquet(path)


def load_maps(spark: SparkSession, path: str) -> DataFrame:
    """The maps that save_maps wrote; ValueError if the folder holds something else."""
    got = spark.read.parquet(path)
    missing = sorted({"forward", "back", "degree", "n_points", "rms"} - set(got.columns))
    if missing:
        raise ValueError(f"not a table of maps: {missing} missing")
    return got
