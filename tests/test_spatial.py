"""Nearest neighbours and suppression against brute force: lone, coincident, clustered and unknown positions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.operators import spatial

SCHEMA = "group_id string, id long, x double, y double"


def brute_nearest(rows):
    out = {}
    for g, i, x, y in rows:
        known = lambda v: v is not None and math.isfinite(v)
        best = min(((math.hypot(x - u, y - v), j) for h, j, u, v in rows if h == g and j != i and known(u) and known(v)), default=(None, None)) if known(x) and known(y) and g is not None else (None, None)
        out[i] = (best[1], best[0])
    return out


def scattered():
    rng = np.random.default_rng(8)
    at = [("even", *p) for p in rng.uniform(0, 100, (150, 2)).tolist()]
    at += [("clusters", *(c + rng.normal(0, s, 2)).tolist()) for c, s, n in (((0, 0), 1e-6, 90), ((1e4, 5), 1e-2, 80), ((-3e5, 1e5), 30, 60)) for _ in range(n)]
    at += [("clusters", 7e6, 7e6), ("lone", 1.0, 2.0), ("same", 3.0, 3.0), ("same", 3.0, 3.0), ("same", 3.0, 3.0), ("line", 0.0, 5.0), ("line", 0.0, 5.5), ("line", 0.0, 9.0)]
    at += [("mixed", 0.0, 0.0), ("mixed", -0.0, 0.0), ("mixed", 1.0, 0.0), ("mixed", 3.0, 0.0), ("mixed", 1.0, 1.0)]
    at += [("even", None, 1.0), ("even", float("nan"), 1.0), ("even", 1.0, float("inf")), (None, 1.0, 1.0), (None, 1.5, 1.0)]
    return [(g, (k * 7919) % 100_003, x, y) for k, (g, x, y) in enumerate(at)]


def test_nearest_against_brute_force(spark):
    rows = scattered()
    want = brute_nearest(rows)
    got = {r.id: r for r in spatial.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), 3.0).collect()}
    assert set(got) == set(want)
    for i, (j, d) in want.items():
        assert got[i].distance == (pytest.approx(d, rel=1e-12, abs=0) if d else d), (i, rows)
        if j is not None:
            x = {r[1]: r for r in rows}
            near = got[i].neighbour
            assert math.hypot(x[i][2] - x[near][2], x[i][3] - x[near][3]) == pytest.approx(d) and x[near][0] == x[i][0]
        assert got[i].overlaps == (d is not None and d < 6)
    features = {r.id: (r.neighbor_distance, r.aperture_overlap) for r in spatial.spatial_features(spark.createDataFrame(rows, SCHEMA)).collect()}
    lone = next(r[1] for r in rows if r[0] == "lone")
    assert features[lone] == (None, 0.0)
    for g, i, x, y in rows:
        if x is None or not math.isfinite(x) or not math.isfinite(y):
            assert features[i] == (None, None)
    with pytest.raises(ValueError):
        spatial.spatial_features(spark.createDataFrame(rows, SCHEMA), 0.0)
    assert spatial.nearest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_grow_with_the_points(spark, monkeypatch):
    """Pairs that the search makes, for a table and one four times as large in the same uneven shape, all in one group."""

    def made(n):
        rng = np.random.default_rng(n)
        rows = [("g", k, *(rng.normal(0, 10.0 ** rng.integers(-6, 3), 2)).tolist()) for k in range(n)]
        counted, real = [], spatial._around

        def around(*given):
            pairs = real(*given).cache()
            counted.append(pairs.count())
            return pairs

        monkeypatch.setattr(spatial, "_around", around)
        assert spatial.nearest(spark.createDataFrame(rows, SCHEMA)).filter("neighbour IS NULL").isEmpty()
        monkeypatch.setattr(spatial, "_around", real)
        return sum(counted)

    small, large = made(500), made(2000)
    assert large <= 4 * small and large < 100 * 2000


def test_suppression_one_by_one(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if k % 3 else "b", k, float(x), float(y), float(b)) for k, ((x, y), b) in enumerate(zip(rng.uniform(0, 30, (220, 2)), rng.integers(0, 12, 220)))]
    rows += [("a", 900, 500.0, 0.0, None), ("a", 901, 500.5, 0.0, 1.0), ("a", 902, 502.5, 0.0, float("nan")), ("a", 903, 504.5, 0.0, 5.0), ("a", 904, float("nan"), 0.0, 9.0), ("b", 905, 500.0, 0.0, 2.0)]
    rows += [("c", 1000 + k, float(k), 0.0, float(100 - k)) for k in range(25)]  # a run of falling brightness
    value = lambda b: (1, b) if b is not None and not math.isnan(b) else (0, 0)
    taken = []
    for r in sorted((r for r in rows if math.isfinite(r[2])), key=lambda r: (value(r[4]), r[1]), reverse=True):
        if all(r[0] != t[0] or (r[2] - t[2]) ** 2 + (r[3] - t[3]) ** 2 >= 4.0 for t in taken):
            taken.append(r)
    got = spatial.suppressed(spark.createDataFrame(rows, SCHEMA + ", brightness double"), 2.0)
    assert sorted(r.id for r in got.collect()) == sorted(t[1] for t in taken)
    assert spatial.suppressed(got.filter("false"), 2.0).count() == 0
    with pytest.raises(ValueError):
        spatial.suppressed(got, 0.0)
    assert got.withColumn("z", F.lit(1)).columns[-1] == "z"
