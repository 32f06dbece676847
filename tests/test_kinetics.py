"""Fits, hidden Markov models, level numbers, bootstrap and events on small data with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.functions import scalar
from traceforge.operators import agreement, kinetics


def test_fits_find_the_parameters_of_exact_curves(spark):
    t = np.arange(40)
    rows = [(0, int(i), float(0.9 * np.exp(-0.2 * i))) for i in t] + [(1, 0, 1.0)]
    got = {(r.state, r.parameter): r for r in kinetics.fit_survival(spark.createDataFrame(rows, "state int, tau long, s double")).collect()}
    assert abs(got[0, "k"].value - 0.2) < 1e-4 and abs(got[0, "a"].value - 0.9) < 1e-4 and got[0, "k"].r2 > 0.9999
    assert got[1, "k"].success is False and got[1, "k"].value is None
    p, _ = kinetics.fit_curve(t.astype(float), 0.6 * np.exp(-0.8 * t) + 0.4 * np.exp(-0.05 * t), "double")
    assert np.allclose(sorted(p[:2]), [0.05, 0.8], atol=1e-3)
    p, _ = kinetics.fit_curve(t.astype(float), 0.9 * np.exp(-((0.3 * t) ** 0.7)), "stretched")
    assert np.allclose(p, [0.3, 0.7, 0.9], atol=1e-3)
    with pytest.raises(ValueError):
        kinetics.fit_survival(spark.createDataFrame(rows, "state int, tau long, s double"), "other")


def test_t_quantile():
    assert abs(kinetics.t_quantile(0.975, 10) - 2.228139) < 1e-4 and abs(kinetics.t_quantile(0.975, 1) - 12.7062) < 1e-2


def test_model_and_paths_recover_two_levels(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for m in range(12):
        s = 0
        for f in range(120):
            s = s if rng.random() > 0.1 else 1 - s
            truth[m, f] = s
            rows.append((m, f, float((0.2, 0.8)[s] + rng.normal(0, 0.05))))
    rows.append((0, 120, None))
    v = spark.createDataFrame(rows, "molecule_id int, frame int, x double")
    model = kinetics.fit_hmm(v)
    assert np.allclose(model["mean"], [0.2, 0.8], atol=0.02) and np.allclose(np.diag(model["trans"]), 0.9, atol=0.03)
    got = {(r.molecule_id, r.frame): r.state for r in kinetics.viterbi(v, model).collect()}
    assert set(got) == set(truth) and sum(got[k] == truth[k] for k in truth) >= 0.99 * len(truth)
    rates = kinetics.rate_constants(v, 0.5).collect()
    assert len(rates) == 2 and all(abs(r.k - 0.2) < 0.06 for r in rates)
    with pytest.raises(ValueError):
        kinetics.fit_hmm(v.filter("x IS NULL"))


def test_level_curve_bends_at_the_number_of_levels(spark):
    rows = [(float(c + d),) for c in (0.0, 1.0, 2.0) for d in (-0.01, 0.0, 0.01)] * 4 + [(None,)]
    got = {r.k: r for r in kinetics.level_curve(spark.createDataFrame(rows, "x double"), 5).collect()}
    assert [k for k, r in got.items() if r.is_elbow] == [3] and abs(got[3].rmse - np.sqrt(2 / 3) * 0.01) < 1e-9
    assert kinetics.level_curve(spark.createDataFrame([], "x double")).count() == 0


def test_bootstrap_equals_direct_resampling_and_repeats(spark):
    rows = [(m, (m % 3) * 0.3 + 0.1 * (k % 2)) for m in range(9) for k in range(m + 1)]
    e = spark.createDataFrame(rows, "molecule_id int, e double")
    run = lambda d: {r.bin: (r.low, r.high, r.spread) for r in agreement.bootstrap_histogram(d, 50, 0.9, 4, 0.0, 1.0).collect()}
    got = run(e)
    assert got == run(e.repartition(3)) and sorted(got) == [0, 1, 2, 3]
    import hashlib

    order = sorted(range(9), key=lambda m: hashlib.md5(str(m).encode()).hexdigest())
    own = [np.histogram([x for m, x in rows if m == i], 4, (0.0, 1.0))[0] for i in order]
    all_d = []
    for r in range(50):
        c = sum(own[int(hashlib.md5(f"0:{r}:{i}".encode()).hexdigest()[:8], 16) * 9 // 2**32] for i in range(9))
        all_d.append(c / c.sum() * 4)
    want = np.percentile(all_d, [5, 95], axis=0)
    assert np.allclose([got[b][:2] for b in range(4)], want.T) and np.allclose([got[b][2] for b in range(4)], np.std(all_d, axis=0, ddof=1))


def test_lags_equal_the_direct_sums(spark):
    rng = np.random.default_rng(3)
    d, a = rng.random(20), rng.random(20)
    f = spark.createDataFrame([(1, t, float(d[t]), float(a[t])) for t in range(20)] + [(2, t, 1.0, float(t)) for t in range(16)], "molecule_id int, frame int, donor double, acceptor double")
    got = {(r.molecule_id, r.start): r for r in agreement.sliding_lags(f).collect()}
    assert len(got) == 8 and got[2, 0].lag0 is None
    for s in range(6):
        x, y = d[s : s + 15] - d[s : s + 15].mean(), a[s : s + 15] - a[s : s + 15].mean()
        den = 15 * x.std() * y.std()
        assert np.isclose(got[1, s].lag0, (x * y).sum() / den) and np.isclose(got[1, s].lag1, abs((x[1:] * y[:-1]).sum() / den))
    assert agreement.anticorrelation(f.limit(0)).count() == 0


def test_a_small_fit_takes_its_rounds_in_one_task_and_a_large_one_in_many_alike(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(m, t, float(x)) for m in range(12) for t, x in enumerate(rng.normal(np.where(rng.random(3 + m // 2) < 0.4, 0.3, 0.6), 0.15))]
    v = spark.createDataFrame(rows, "molecule_id long, frame int, x double").repartition(4)
    sc = spark.sparkContext
    sc.setJobGroup("small fit", "")
    small = kinetics.fit_hmm(v, iterations=40, tolerance=0)
    sc.setJobGroup("others", "")
    assert len(sc.statusTracker().getJobIdsForGroup("small fit")) < 20
    monkeypatch.setattr(kinetics, "A_TASK", 20)
    large = kinetics.fit_hmm(v, iterations=40, tolerance=0)
    one = kinetics.fit_hmm(v, iterations=1, tolerance=0)
    # the same rounds by all paths of each series
    first = v.agg(F.percentile_approx("x", [0.25, 0.75], 10_000).alias("q"), F.stddev_pop("x").alias("s")).first()
    model = np.full(2, 0.5), np.array([[0.95, 0.05], [0.05, 0.95]]), np.array(first.q), np.full(2, (first.s / 2) ** 2)
    own = [np.array([x for k, _, x in rows if k == m]) for m in range(12)]
    for n, got in ((1, [one]), (40, [small, large])):
        want = kinetics.climb(lambda *now: sum(plain_expectations(x, *now)[0] for x in own), model, n, 0, 1e-6)
        for g in got:
            assert all(np.allclose(g[name], w, rtol=1e-9, atol=1e-12) for name, w in zip(("start", "trans", "mean", "var"), want))


def test_peaks_among_equal_windows_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from traceforge.plans import queries

    # every event six times in a row: windows of the same values in another order have the same lag 0 but for its rounding
    again = "SELECT * REPLACE (event_id + 100000 * k AS event_id) FROM range(6) r(k), '/root/testdata/sf0.01/events.parquet'"
    con = duckdb.connect()
    con.execute(f"COPY ({again}) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(queries.ORACLES["w4_anticorrelation_events"]).fetchall()
    got = queries.w4_anticorrelation_events(spark, str(tmp_path)).collect()
    assert len(want) > 500 and sorted(map(tuple, got)) == sorted(want)


def test_lag_0_is_that_of_the_frames_with_both_channels(spark):
    d, a = [1.0, None, 4.0, 2.0, 7.0], [5.0, 1.0, None, 3.0, 1.0]
    got = agreement.sliding_lags(spark.createDataFrame([(1, t, d[t], a[t]) for t in range(5)], "molecule_id int, frame int, donor double, acceptor double"), 5).first()
    assert np.isclose(got.lag0, np.corrcoef([1, 2, 7], [5, 3, 1])[0, 1])
    md, ma = np.mean([1, 4, 2, 7]), np.mean([5, 1, 3, 1])
    assert np.isclose(got.lag1, abs((4 - md) * (1 - ma) + (7 - md) * (3 - ma)) / (5 * np.std([1, 4, 2, 7]) * np.std([5, 1, 3, 1])))


def test_window_bounds_end_with_the_trace(spark):
    d = spark.createDataFrame([(10, 25, 20), (1, 5, 20), (19, 20, 20)], "a int, d int, n int")
    tail = d.select(*scalar.tail_window(F.col("a"), F.col("d"), F.col("n"))).collect()
    assert [tuple(r) for r in tail] == [(10, 20), (1, 5), (19, 20)]
    around = d.select(*scalar.gamma_windows(F.col("a"), 3, F.col("n"))).collect()
    assert [tuple(r) for r in around] == [(7, 10, 10, 13), (0, 1, 1, 4), (16, 19, 19, 20)]


def test_registered_fits_do_the_whole_job(spark, monkeypatch):
    import inspect

    from traceforge.plans import queries

    seen = {}
    for module, name in ((kinetics, "fit_hmm"), (agreement, "bootstrap_histogram")):
        whole = inspect.signature(getattr(module, name))

        def asked(*a, whole=whole, name=name, **k):
            b = whole.bind(*a, **k)
            b.apply_defaults()
            seen[name] = b.arguments
            raise LookupError(name)

        monkeypatch.setattr(module, name, asked)
    for query in (queries.i4_state_paths, queries.a3_bootstrap):
        with pytest.raises(LookupError):
            query(spark, "/root/testdata/sf0.001")
    assert seen["fit_hmm"]["iterations"] == 200 and seen["fit_hmm"]["tolerance"] == 1e-6 and seen["bootstrap_histogram"]["resamples"] == 1000


def test_density_surface_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(k % 7, int(t), float(e)) for k, (t, e) in enumerate(zip(rng.integers(0, 80, 500), rng.normal(0.5, 0.2, 500)))] + [(1, 3, float("nan")), (2, 90, 4.0), (3, 5, None)]
    df = spark.createDataFrame(rows, "molecule_id long, t int, e double").repartition(3)
    got = {(r.tb, r.bin): r.density for r in agreement.density_surface(df, 0.5, 12, 9).collect()}
    own = np.array([(t * 0.5, e) for _, t, e in rows if e is not None and e == e and -0.25 <= e <= 1.25])
    c = np.cov(own.T) * len(own) ** (-1 / 3)
    top = max(t for _, t, e in rows if e is not None and e == e) * 0.5
    at = np.array([((i + 0.5) * top / 12, -0.25 + (j + 0.5) * 1.5 / 9) for i in range(12) for j in range(9)])
    d = at[:, None, :] - own[None]
    want = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", d, np.linalg.inv(c), d)).sum(1) / (len(own) * 2 * np.pi * np.sqrt(np.linalg.det(c)))
    assert np.abs(np.array([got[i, j] for i in range(12) for j in range(9)]) - want).max() < 1e-12 * want.max()
    assert tuple(agreement.cloud_totals(df, 0.5).first()) == (501, 1, 7)
    for few in (df.filter("false"), df.limit(1), spark.createDataFrame([(1, t, 0.5) for t in range(9)], "molecule_id long, t int, e double"), spark.createDataFrame([(1, t, t / 10) for t in range(9)], "molecule_id long, t int, e double")):
        assert agreement.density_surface(few, time_range=(0.0, 10.0)).count() == 0
    with pytest.raises(ValueError):
        agreement.density_surface(df, time_range=(1.0, 1.0))


def plain_expectations(x, start, trans, mean, var):
    """By all paths of a short series."""
    import itertools

    k, n = len(mean), len(x)
    b = np.exp(-((np.array(x)[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var)
    total, occupation, moves, best = 0.0, np.zeros((n, k)), np.zeros((k, k)), (-1.0, None)
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * b[0, path[0]] * np.prod([trans[i, j] * b[t + 1, j] for t, (i, j) in enumerate(zip(path, path[1:]))])
        total += p
        best = max(best, (p, path), key=lambda z: z[0])
        for t, s in enumerate(path):
            occupation[t, s] += p
        for i, j in zip(path, path[1:]):
            moves[i, j] += p
    g = occupation / total
    return np.concatenate([g.sum(0), np.array(x) @ g, ((np.array(x)[:, None] - mean) ** 2 * g).sum(0), g[0], (moves / total).ravel(), [np.log(total)]]), best[1]


def test_padded_series_against_all_paths(spark, monkeypatch):
    rng = np.random.default_rng(3)
    start, trans, mean, var = np.array([0.2, 0.5, 0.3]), np.array([[0.7, 0.2, 0.1], [0.3, 0.6, 0.1], [0.25, 0.25, 0.5]]), np.array([0.1, 0.5, 0.8]), np.array([0.02, 0.01, 0.03])
    xs = [rng.normal(0.5, 0.3, n).tolist() for n in (1, 4, 2, 6, 6, 3, 1)]
    want = [plain_expectations(x, start, trans, mean, var) for x in xs]
    for together in (1, 12, 1 << 18):
        monkeypatch.setattr(kinetics, "TOGETHER", together)
        parts = list(kinetics.padded(xs))
        assert sorted(np.concatenate([own for own, _, _ in parts]).tolist()) == list(range(7))
        got = sum(kinetics.expectations(x, mask, start, trans, mean, var) for _, x, mask in parts)
        assert np.allclose(got, sum(w for w, _ in want), rtol=1e-10)
    v = spark.createDataFrame([(m, 10 + t, x) for m, s in enumerate(xs) for t, x in enumerate(s)], "molecule_id int, frame long, x double")
    model = {"start": start.tolist(), "trans": trans.tolist(), "mean": mean.tolist(), "var": var.tolist()}
    path = {}
    for r in kinetics.viterbi(v, model).orderBy("molecule_id", "frame").collect():
        path.setdefault(r.molecule_id, []).append(r.state)
    assert path == {m: list(w[1]) for m, w in enumerate(want)}


def test_level_curve_against_plain_rounds(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.05, 80) for c in (0.1, 0.45, 0.9)])
    got = {r.k: r.rmse for r in kinetics.level_curve(spark.createDataFrame([(float(v),) for v in x], "x double"), 5).collect()}
    s = np.sort(x)
    for k in range(1, 6):
        c = np.unique(s[np.ceil(np.array([(i + 0.5) / k for i in range(k)]) * len(s)).astype(int) - 1])
        while True:
            at = np.abs(s[:, None] - c).argmin(1)
            new = np.array([s[at == i].mean() for i in range(len(c)) if (at == i).any()])
            if len(new) == len(c) and np.allclose(new, c, rtol=0, atol=1e-12):
                break
            c = new
        assert got[k] == pytest.approx(np.sqrt(((s - c[at]) ** 2).mean()), rel=1e-3)
    few = [(0.5,), (0.5,), (2.0,), (None,)]
    assert [r.k for r in kinetics.level_curve(spark.createDataFrame(few, "x double")).collect()] == [1, 2]
    assert [(r.k, r.rmse) for r in kinetics.level_curve(spark.createDataFrame(few[:2], "x double")).collect()] == [(1, 0.0)]
