"""Drift against enumeration and published values, registration against NumPy's least squares."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.operators import drift, matching, registration


def test_tail_of_the_statistic():
    assert 1 - drift.kolmogorov_tail(0.274, 10) == pytest.approx(0.6284796154565043, rel=1e-12)  # published
    assert drift.kolmogorov_tail(0.5, 1) == pytest.approx(1.0) and drift.kolmogorov_tail(0.75, 1) == pytest.approx(0.5)  # |u - step| by hand
    assert (drift.kolmogorov_tail(0.0, 5), drift.kolmogorov_tail(1.0, 5)) == (1.0, 0.0)
    # where the exact form ends, the expansion goes on
    real = drift.EXACT
    try:
        for d in (0.04, 0.06, 0.08, 0.1, 0.13, 0.18, 0.24):
            for n in (141, 300):
                drift.EXACT = 1000
                exact = drift.kolmogorov_tail(d, n)
                drift.EXACT = 140
                assert drift.kolmogorov_tail(d, n) == pytest.approx(exact, rel=0.02, abs=2e-5), (d, n)
    finally:
        drift.EXACT = real


def test_drift_of_features(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, 60).round(1), rng.normal(0.9, 1, 45).round(1)
    rows = [(0, float(x), float(k), None if k else 1.0, 7.0) for k, x in enumerate(a)] + [(1, float(x), float(k), 2.0, 7.0) for k, x in enumerate(b)] + [(0, float("nan"), float("inf"), None, None)]
    got = {r.feature: r for r in drift.condition_drift(spark.createDataFrame(rows, "side int, moved double, ranks double, rare double, flat double").repartition(5), ["moved", "ranks", "rare", "flat"]).collect()}
    brute = lambda u, v: max(abs(np.mean(u <= t) - np.mean(v <= t)) for t in [*u, *v])
    assert got["moved"].statistic == pytest.approx(brute(a, b)) and (got["moved"].n_source, got["moved"].n_target) == (60, 45)
    assert got["ranks"].statistic == pytest.approx(brute(np.arange(60), np.arange(45)))
    assert (got["rare"].tested, got["rare"].statistic, got["rare"].pvalue, got["rare"].drifted) == (False, None, None, False)
    assert (got["flat"].statistic, got["flat"].pvalue, got["flat"].drifted) == (0.0, 1.0, False)
    assert got["moved"].pvalue == drift.kolmogorov_tail(got["moved"].statistic, round(60 * 45 / 105)) and got["moved"].drifted == (got["moved"].pvalue < 0.05 / 3)
    few = spark.createDataFrame([(0, 1.0), (1, 2.0)], "side int, x double")
    with pytest.raises(ValueError):
        drift.condition_drift(few, ["x"])
    with pytest.raises(ValueError):
        drift.condition_drift(few, ["x"], alpha=1.0)


def test_conditions_need_known_molecules(spark):
    features = spark.createDataFrame([(k, float(k)) for k in range(8)], "molecule_id long, x double")
    molecules = spark.createDataFrame([(k, "a" if k < 4 else "b") for k in range(8)], "molecule_id long, condition_id string")
    r = drift.between_conditions(features, molecules, ["x"], "a", "b").first()
    assert (r.statistic, r.n_source, r.n_target) == (1.0, 4, 4)
    with pytest.raises(KeyError):
        drift.between_conditions(features, molecules, ["x"], "a", "c")
    for bad in (molecules.filter("molecule_id > 0"), molecules.unionByName(molecules.limit(1))):
        with pytest.raises(ValueError):
            drift.between_conditions(features, bad, ["x"], "a", "b")


def basis(x, y):
    return np.stack([np.ones_like(x), x, y, x * y, x * x, y * y], 1)


def test_maps_against_least_squares(spark):
    rng = np.random.default_rng(6)
    groups = {"poly": rng.uniform(0, 512, (40, 2)), "six": rng.uniform(0, 512, (6, 2)), "few": rng.uniform(0, 512, (4, 2)), "two": np.array([[0.0, 0.0], [3.0, 4.0]]), "one": np.array([[1.0, 1.0]]), "line": np.stack([np.arange(9.0), 2 * np.arange(9.0)], 1), "same": np.ones((3, 2)), "odd": rng.uniform(0, 9, (7, 2))}
    rows = []
    for g, a in groups.items():
        b = a @ np.array([[0.99, 0.02], [-0.02, 0.99]]).T + [3.0, -2.0] + 1e-5 * a**2 + rng.normal(0, 0.4, a.shape)
        rows += [(g, *map(float, (*p, *q))) for p, q in zip(a, b)]
    rows[-1] = ("odd", float("nan"), 1.0, 1.0, 1.0)
    df = spark.createDataFrame(rows, "g string, ax double, ay double, bx double, by double").repartition(4)
    got = {r.g: r for r in registration.registration(df, ["g"]).collect()}
    assert {g: bool(got[g].forward.fault) for g in groups} == {"poly": False, "six": False, "few": False, "two": False, "one": True, "line": True, "same": True, "odd": True}
    assert {g: got[g].degree for g in groups} == {"poly": 2, "six": 2, "few": 1, "two": 1, "one": None, "line": None, "same": None, "odd": None}
    for g in ("poly", "six"):
        p = np.array([r[1:] for r in rows if r[0] == g])
        for m, s, t in ((got[g].forward, p[:, :2], p[:, 2:]), (got[g].back, p[:, 2:], p[:, :2])):
            want = basis(*((s - s.mean(0)) / s.std(0)).T) @ np.linalg.lstsq(basis(*((s - s.mean(0)) / s.std(0)).T), t, rcond=None)[0]
            a, b = registration.plain_coefficients(m)
            assert np.abs(basis(s[:, 0], s[:, 1]) @ np.array([a, b]).T - want).max() < 1e-6
        assert got[g].rms == pytest.approx(math.sqrt(((p[:, 2:] - (basis(p[:, 0], p[:, 1]) @ np.array(registration.plain_coefficients(got[g].forward)).T)) ** 2).sum(1).mean()), abs=1e-6)
    assert got["six"].rms < 1e-6 and not got["six"].low_confidence and got["poly"].low_confidence == (got["poly"].rms > 0.5)
    # the similarity: no nearby rotation and scale is better
    p = np.array([r[1:] for r in rows if r[0] == "few"])
    loss = lambda k, th, u, v: ((p[:, :2] @ (k * np.array([[math.cos(th), -math.sin(th)], [math.sin(th), math.cos(th)]])).T + [u, v] - p[:, 2:]) ** 2).sum()
    a, b = registration.plain_coefficients(got["few"].forward)
    best = (math.hypot(a[1], b[1]), math.atan2(b[1], a[1]), a[0], b[0])
    assert loss(*best) / 4 == pytest.approx(got["few"].rms ** 2) and a[3:] == b[3:] == [0.0] * 3 and (a[1], b[1]) == pytest.approx((b[2], -a[2]))
    for step in itertools.product((-1e-4, 0, 1e-4), repeat=4):
        assert loss(*np.add(best, step)) >= loss(*best) - 1e-9
    # a mirrored pair of triangles still gives a rotation
    tri = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (1.0, 0.0, -1.0, 0.0), (0.0, 2.0, 0.0, 2.0)], "ax double, ay double, bx double, by double")
    m = registration.fitted(tri).first()["m"]
    assert m["a"][1] * m["b"][2] - m["a"][2] * m["b"][1] > 0
    with pytest.raises(ValueError):
        registration.plain_coefficients(got["line"].forward)
    assert registration.registration(df.filter("false"), ["g"]).count() == 0
    x, y = registration.mapped(F.lit(1.5), F.lit(2.5), F.col("forward"))
    at = registration.registration(df.filter("g = 'poly'")).select(x.alias("x"), y.alias("y")).first()
    flat = spark.range(1).select(*[matching.quadratic(F.lit(1.5), F.lit(2.5), c).alias(n) for c, n in zip(registration.plain_coefficients(got["poly"].forward), "xy")]).first()
    assert (at.x, at.y) == pytest.approx((flat.x, flat.y))


def test_maps_are_stored_and_read(spark, tmp_path):
    rows = [(k, float(k), float(k * k % 7), 2.0 * k, float(k * k % 7)) for k in range(9)]
    maps = registration.registration(spark.createDataFrame(rows, "k int, ax double, ay double, bx double, by double"))
    registration.save_maps(maps, f"{tmp_path}/maps")
    assert registration.load_maps(spark, f"{tmp_path}/maps").collect() == maps.collect()
    spark.range(1).write.parquet(f"{tmp_path}/odd")
    with pytest.raises(ValueError):
        registration.load_maps(spark, f"{tmp_path}/odd")
