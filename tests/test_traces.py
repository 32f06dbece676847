"""Small cases with hand-made answers, and every query with SQL against that SQL."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from traceforge.functions import scalar
from traceforge.operators import corrections, curation, population, select, spatial
from traceforge.plans import queries

SF = "/root/testdata/sf0.001"


def paths(spark, *rows):
    return spark.createDataFrame([(m, t, t, s, 0.5) for m, p in enumerate(rows) for t, s in enumerate(p)], "molecule_id int, frame int, t int, state int, e double")


def test_dwells_drop_first_and_last_and_merge_across_gaps(spark):
    got = population.dwells(paths(spark, [0, 0, 1, -1, 1, 1, 0, 2, 2], [0, 0, 0])).orderBy("state").collect()
    assert [(r.state, r.length) for r in got] == [(0, 1), (1, 3)]
    assert {(r.state, r.start, r.length) for r in population.runs(paths(spark, [1, -1, 1, 1])).collect()} == {(1, 0, 1), (1, 2, 2)}


def test_transition_probability_needs_an_assigned_successor(spark):
    assert population.transition_probability(paths(spark, [0, 1, 0, -1, 0, 0]), 0, 1).first().p == 0.5
    assert population.transition_probability(paths(spark, [1, 1]), 0, 1).first().p is None


def test_histogram_closes_the_last_bin_and_skips_nulls(spark):
    e = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, None), (2, 1.1)], "molecule_id int, e double")
    assert [r.n for r in population.histogram(e, 2, 0.0, 1.0).orderBy("bin").collect()] == [1, 1]
    empty = population.histogram(e.filter("false"), 2, 0.0, 1.0).collect()
    assert [r.density for r in empty] == [0, 0]
    with pytest.raises(ValueError):
        population.histogram(e, 0)


def test_windows_fall_back_and_rejects_go(spark):
    f = spark.createDataFrame([(m, t, 1.0, 1.0) for m in (1, 2, 3) for t in range(4)], "molecule_id int, frame int, donor double, acceptor double")
    m = spark.createDataFrame([(1, 0, 0, 0, 4, 0, 0), (2, 0, 0, 0, 4, 1, 3), (3, 0, 0, -1, 4, 0, 0)], "molecule_id int, movie_id int, condition_id int, label int, n int, w0 int, w1 int")
    assert {(r.molecule_id, r["count"]) for r in select.windowed(f, m).groupBy("molecule_id").count().collect()} == {(1, 4), (2, 2)}


def test_efficiency_is_null_only_for_zero_over_zero(spark):
    d = spark.createDataFrame([(0.0, 0.0), (-1.0, 3.0)], "d double, a double").select(scalar.apparent_efficiency(F.col("d"), F.col("a")).alias("e"))
    assert [r.e for r in d.collect()] == [None, 1.5]


def test_photobleach_finds_a_step_and_its_absence(spark):
    rows = [(1, t, 1000.0 + t % 3 if t < 30 else float(t % 3)) for t in range(50)] + [(2, t, 1000.0 + t % 5) for t in range(40)] + [(3, 0, 1.0)]
    got = {r.molecule_id: r.bleach for r in corrections.photobleach(spark.createDataFrame(rows, "molecule_id int, frame int, value double")).collect()}
    assert got == {1: 30, 2: 40, 3: 1}


def test_ranking_keeps_all_rows_with_missing_scores_last(spark):
    s = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5), (4, float("nan")), (5, 0.9)], "id int, score double")
    assert [r.id for r in curation.ranked(s).orderBy("rank").collect()] == [5, 1, 3, 2, 4]


def test_label_log_and_merge(spark):
    cols = "event_seq long, molecule_key string, labeler string, timestamp string, source_file string, source string, label_value int"
    log = spark.createDataFrame([(1, "a", "x", "1", "f", "human", 1), (2, "a", "x", "2", "f", "human", -1), (3, "b", "x", "3", "f", "human", 1), (4, "b", "x", "4", "f", "human", 0)], cols)
    assert [(r.molecule_key, r.label_value) for r in curation.current_labels(log).collect()] == [("a", -1)]
    assert curation.merge_labels(log, log.union(log)).count() == 4


def test_nearest_of_a_lone_point(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (2, 3, 0.0, 0.0)], "group_id int, id int, x double, y double")
    got = {r.id: (r.neighbour, r.distance, r.overlaps) for r in spatial.nearest(p).collect()}
    assert got == {1: (2, 5.0, True), 2: (1, 5.0, True), 3: (None, None, False)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda d: sorted(tuple("" if pd.isna(v) else v if isinstance(v, str) else f"{round(float(v), 6) + 0.0}" for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert text(got) == text(want)


def test_dangling_ignores_molecules_without_a_condition_and_rekeying_moves_one_condition(spark):
    m = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "molecule_id int, condition_id string")
    known = spark.createDataFrame([("b",)], "condition_id string")
    assert sorted(r.molecule_id for r in curation.dangling(m, known).collect()) == [1, 4]
    assert curation.dangling(m.limit(0), known).count() == 0
    moved = curation.rekeyed(m, "a", "c")
    assert {r.molecule_id: r.condition_id for r in moved.collect()} == {1: "c", 2: "b", 3: None, 4: "c"}


def test_similarity_skips_missing_features_and_breaks_ties_by_id(spark):
    p = spark.createDataFrame([(1, 0.0, 5.0), (4, 2.0, 5.0), (3, 2.0, 5.0), (2, 4.0, 5.0), (5, None, 5.0)], "id int, x double, y double")
    assert [r.id for r in spatial.similar(p, ["x", "y"], [1]).collect()] == [3, 4, 2]
    assert [r.id for r in spatial.similar(p, ["x", "y"], [1, 2], 1).collect()] == [3]
    with pytest.raises(KeyError):
        spatial.similar(p, ["x"], [9])


def plain_scores(x, a=1.0, b=1.0, beta=1.0, mu=1000.0):
    n = len(x)
    out = []
    for t in range(n):
        k = n if t == n - 1 else t
        own, rest = np.array(x[:k]), np.array(x[k:])
        score = 0.0
        if k:
            spread = ((own - own.mean()) ** 2).sum()
            score += math.lgamma(a + k / 2) - math.lgamma(a) + a * math.log(b) - (a + k / 2) * math.log(b + spread / 2 + beta * k * (own.mean() - mu) ** 2 / (2 * (beta + k))) + 0.5 * math.log(beta / (beta + k)) - k / 2 * math.log(2 * math.pi)
        if n > k:
            score += math.lgamma(a + (n - k) / 2) - math.lgamma(a) + a * math.log(b) - (a + (n - k) / 2) * math.log(b + (rest**2).sum() / 2) - (n - k) / 2 * math.log(2 * math.pi)
        out.append(score)
    return np.array(out)


def test_bleaching_of_one_and_of_all(spark):
    rng = np.random.default_rng(2)
    traces = {m: np.concatenate([rng.normal(900, 60, 10 + 3 * m), rng.normal(0, 40, 30 - 2 * m)]).tolist() for m in range(12)} | {50: rng.normal(900, 60, 25).tolist(), 51: [5.0], 52: rng.normal(0, 1, 9).tolist()}
    df = spark.createDataFrame([(m, t, x) for m, v in traces.items() for t, x in enumerate(v)], "molecule_id long, frame int, value double").repartition(3)
    end = lambda p, n: n if n < 2 or p == n - 1 else int(p)
    scores = {m: plain_scores(v) for m, v in traces.items()}
    assert {r.molecule_id: r.bleach for r in corrections.photobleach(df).collect()} == {m: end(s.argmax(), len(s)) for m, s in scores.items()}
    first = [int((np.exp(s - s.max()) * np.arange(len(s))).sum() / np.exp(s - s.max()).sum()) for s in scores.values()]
    rate = (1 + len(first)) / (1 + sum(first))
    got = {r.molecule_id: (r.bleach, r.rate) for r in corrections.ensemble_photobleach(df).collect()}
    assert {m: b for m, (b, _) in got.items()} == {m: end((s + math.log(rate) - rate * np.arange(len(s))).argmax(), len(s)) for m, s in scores.items()}
    assert {round(r, 12) for _, r in got.values()} == {round(rate, 12)}
    assert corrections.ensemble_photobleach(df.filter("false")).count() == 0


def test_lgamma(spark):
    xs = [1.0, 1.5, 2.0, 3.5, 40.0, 1000.5, 5e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(corrections.lgamma(F.col("x"))).collect()]
    assert all(abs(g - math.lgamma(x)) <= 1e-13 * max(1, abs(math.lgamma(x))) for g, x in zip(got, xs))


def test_bleached_windows_and_factors(spark):
    rows = [(1, t, 800.0 if t < 16 else 0.0, 500.0 if t < 12 else 0.0) for t in range(4, 24)] + [(2, t, 800.0 if t < 14 else 0.0, 0.0) for t in range(20)] + [(3, t, 0.0, 0.0) for t in range(8)]
    frames = spark.createDataFrame(rows, "molecule_id long, frame int, donor double, acceptor double")
    molecules = spark.createDataFrame([(1, 4, 24, 4, 24), (2, 0, 20, 3, 9), (3, 0, 8, 0, 8), (4, 0, 0, 0, 0)], "molecule_id long, frame_start int, frame_end int, w0 int, w1 int")
    got = {r.molecule_id: (r.donor_bleach, r.acceptor_bleach, r.w0, r.w1) for r in corrections.bleached_molecules(frames, molecules).collect()}
    assert got[1] == (16, 12, 4, 16) and got[2][0] == 14 and got[2][2:] == (3, 9)
    assert got[3][2:] == (0, 8) and got[4] == (-1, -1, 0, 0)
    own = spark.createDataFrame([(k, float(k) if k % 2 else None) for k in range(22)], "molecule_id long, gamma double")
    filled = {r.molecule_id: r.gamma for r in corrections.effective_gamma(own).collect()}
    assert filled[3] == 3.0 and filled[2] == 11.0
    assert {r.gamma for r in corrections.effective_gamma(own.limit(4), 10).filter("molecule_id % 2 = 0").collect()} == {None}
    m = spark.createDataFrame([(1, 0.1, 1.2), (2, None, 1.2), (3, float("nan"), 1.2), (4, 0.1, 0.0), (5, 0.1, None)], "molecule_id long, alpha double, gamma double")
    of = lambda **k: {r.molecule_id: (r.method, r.confidence, r.alpha, r.gamma) for r in corrections.chosen_methods(m, **k).collect()}
    no = corrections.UNAVAILABLE
    assert {k: v[0] for k, v in of().items()} == {1: "corrected", 2: no, 3: no, 4: no, 5: no}
    assert of(gamma=2.0)[4] == ("manual", 1.0, 0.1, 2.0) and of(gamma=2.0)[2][:2] == (no, 0.0) and of(alpha=0.0)[2] == ("manual", 1.0, 0.0, 1.2)
    assert {v[:2] for v in of(apparent_only=True, gamma=2.0).values()} == {(corrections.TOGGLE, 0.0)}
    assert tuple(corrections.method_totals(corrections.chosen_methods(m)).first()) == (5, 1, 0, 4, False)
    assert corrections.method_totals(corrections.chosen_methods(m.filter("false"))).first().total_failure
    for bad in ({"gamma": 0.0}, {"gamma": float("nan")}, {"alpha": float("inf")}):
        with pytest.raises(ValueError):
            corrections.chosen_methods(m, **bad)


def test_pooled_lags_and_refusals(spark):
    rng = np.random.default_rng(4)
    traces = {m: rng.normal(size=(n, 2)) for m, n in ((1, 9), (2, 6), (3, 1), (4, 12))} | {5: np.ones((8, 2))}
    df = spark.createDataFrame([(m, t, float(d), float(a)) for m, x in traces.items() for t, (d, a) in enumerate(x)] + [(6, 0, 1.0, None), (6, 1, 2.0, 1.0)], "molecule_id long, frame int, donor double, acceptor double")
    got = {r.lag: (r.r, r.molecules) for r in population.pooled_cross_correlation(df).collect()}
    assert sorted(got) == list(range(-5, 6))
    for lag in got:
        r = []
        for m in (1, 2, 4):
            d, a = (traces[m][:, i] - traces[m][:, i].mean() for i in (0, 1))
            r.append(sum(d[t] * a[t - lag] for t in range(len(d)) if 0 <= t - lag < len(d)) / (len(d) * d.std() * a.std()))
        assert got[lag][1] == 3 and abs(got[lag][0] - np.mean(r)) < 1e-12
    assert population.pooled_cross_correlation(df, 2).count() == 5
    with pytest.raises(ValueError):
        population.pooled_cross_correlation(df.filter("molecule_id IN (3, 6)"))
    with pytest.raises(ValueError):
        population.probability_density(df, 0, 3, 3)
    with pytest.raises(ValueError):
        population.time_heatmap(df, dt=0.0)
