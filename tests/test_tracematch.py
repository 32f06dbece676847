"""Trace matching against brute force: values at the edges of cells, padding, hints, rows that want the same."""

import numpy as np
import pytest

from traceforge.operators import tracematch

SCHEMA = "id long, frame int, donor double, acceptor double"


def table(spark, traces):
    return spark.createDataFrame([(i, t, float(d), float(a)) for i, x in traces.items() for t, (d, a) in enumerate(x)], SCHEMA).repartition(4)


def one_by_one(returned, stored, atol, rtol, hints=None):
    width = lambda side: max(len(x) for x in side.values())
    t = min(width(returned), width(stored))
    pad = lambda x: np.vstack([x, np.zeros((max(0, t - len(x)), 2))])
    out, used = {}, set()
    for i in sorted(returned):
        x = pad(np.array(returned[i], float))
        found = []
        for j, y in stored.items():
            y = pad(np.array(y, float))
            gap = np.abs(x[:t] - y[:t])
            if j not in used and (gap <= atol + rtol * np.abs(y[:t])).all() and not x[t:].any() and not y[t:].any():
                found.append(((hints or {}).get(i) != j, gap.max(), j))
        out[i] = min(found)[2] if found else None
        used.add(out[i])
    return out


@pytest.mark.parametrize("atol,rtol", [(1e-6, 0.0), (0.5, 0.0), (0.0, 0.01), (0.0, 0.0)])
def test_matches_against_one_by_one(spark, atol, rtol):
    rng = np.random.default_rng(7)
    stored = {k: rng.integers(-40, 40, (12, 2)) * 0.5 for k in range(30)}
    stored |= {30 + k: stored[k].copy() for k in range(5)}  # the same trace twice
    stored |= {40: np.vstack([stored[6], np.zeros((5, 2))]), 41: np.zeros((12, 2)), 42: np.ones((9, 2)), 43: np.vstack([stored[7], np.ones((2, 2))])}
    returned = {}
    for n, k in enumerate([*range(0, 30, 2), 1, 1, 1, 3, 40, 41, 42, 43]):
        x = np.array(stored[k], float)
        off = (atol + rtol * np.abs(x)) * rng.choice([-1.0, 1.0, 0.5, 0.0], x.shape)  # just at, within or without the tolerance
        returned[n] = x + off * (1.0 if n % 5 else 1.5)
    returned[60] = np.vstack([stored[9], np.zeros((20, 2))])
    returned[61] = np.vstack([stored[11], np.zeros((19, 2)), np.ones((1, 2))])
    got = {r.r: r.s for r in tracematch.matched(table(spark, returned), table(spark, stored), atol, rtol).collect()}
    assert got == one_by_one(returned, stored, atol, rtol)
    hints = {0: 30, 5: 29, 15: 31, 16: 31}
    want = one_by_one(returned, stored, atol, rtol, hints)
    given = spark.createDataFrame(list(hints.items()), "r long, s long")
    assert {r.r: r.s for r in tracematch.matched(table(spark, returned), table(spark, stored), atol, rtol, given).collect()} == want


def test_missing_values_and_empty_sides(spark):
    some, none = table(spark, {1: [(1, 2)], 2: [(float("nan"), 1)]}), spark.createDataFrame([], SCHEMA)
    assert sorted((r.r, r.s) for r in tracematch.matched(some, some.filter("id = 2")).collect()) == [(1, None), (2, None)]
    assert sorted((r.r, r.s) for r in tracematch.matched(some, none).collect()) == [(1, None), (2, None)]
    assert tracematch.matched(none, some).count() == 0
    with pytest.raises(ValueError):
        tracematch.matched(some, some, -1.0)


def test_coordinates(spark):
    schema = "id long, donor_x double, donor_y double, acceptor_x double, acceptor_y double"
    one, two = spark.createDataFrame([(5, 1.0, 2.0, 3.0, 4.0)], schema), spark.createDataFrame([(5, 9.0, 9.0, 9.0, 9.0)], schema)
    m = spark.createDataFrame([(0, 5), (1, None)], "r long, s long")
    got = {r.r: r for r in tracematch.with_coordinates(m, tracematch.recovered(one, two)).collect()}
    assert (got[0].donor_x, got[0].acceptor_y, got[1].donor_x) == (1.0, 4.0, None)
    assert tracematch.recovered(one.filter("false"), two).first().source == "other"
    with pytest.raises(ValueError):
        tracematch.recovered(None, None)
