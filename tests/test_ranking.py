"""Boosting against a plain booster that looks at every row, training weights, prequential folds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceforge.operators import boosting, ranking, stored


def plain_split(x, g, h, edges, p):
    """Every feature, edge and side of missing values tried on the rows themselves."""
    score = lambda own: g[own].sum() ** 2 / (h[own].sum() + p.l2)
    best = None
    for j, e in enumerate(edges):
        missing = np.isnan(x[:, j])
        for side in (False, True) if missing.any() else (None,):
            for t in [*e, np.inf]:  # the last: missing values against all others
                left = np.where(missing, bool(side), np.nan_to_num(x[:, j]) <= t)
                if min(left.sum(), (~left).sum()) < p.least_rows or min(h[left].sum(), h[~left].sum()) < boosting.LEAST_HESSIAN:
                    continue
                gain = score(left) + score(~left) - score(np.ones(len(g), bool))
                if gain > (best[0] if best else 1e-12) + 1e-12:
                    best = (gain, j, t, side if side is not None else left.sum() > (~left).sum(), left)
    return best


def plain_booster(x, y, w, edges, p, test):
    base = math.log((w * y).sum() / (w * (1 - y)).sum())
    f, out = np.full(len(y), base), np.full(len(test), base)
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-f))
        g, h = (prob - y) * w, prob * (1 - prob) * w
        leaves = [(np.arange(len(y)), np.arange(len(test)))]
        splits = [plain_split(x, g, h, edges, p)]
        while len(leaves) < p.leaves and any(splits):
            k = max(range(len(leaves)), key=lambda i: splits[i][0] if splits[i] else -1)
            (own, of), (_, j, t, side, left) = leaves.pop(k), splits.pop(k)
            go = np.where(np.isnan(test[of, j]), bool(side), np.nan_to_num(test[of, j]) <= t)
            for a, b in ((own[left], of[go]), (own[~left], of[~go])):
                leaves.append((a, b)), splits.append(plain_split(x[a], g[a], h[a], edges, p))
        for own, of in leaves:
            v = -p.learning_rate * g[own].sum() / (h[own].sum() + p.l2) if len(leaves) > 1 else 0.0
            f[own] += v
            out[of] += v
    return 1 / (1 + np.exp(-out))


def sample(n=260, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.normal(size=n).round(1), rng.integers(0, 4, n).astype(float), rng.normal(size=n)], 1)
    x[rng.random(x.shape) < 0.12] = np.nan
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + np.isnan(x[:, 2]) + rng.normal(0, 0.6, n)) > 0.9
    return x, y.astype(float), np.where(rng.random(n) < 0.3, 0.3 / (1 + rng.integers(0, 5, n)), 1.0)


def frame(spark, x, y, w, parts=3):
    cell = lambda v: None if math.isnan(v) else float(v)
    rows = [(k, bool(y[k]), float(w[k]), cell(x[k, 0]), *map(float, x[k, 1:])) for k in range(len(y))]
    return spark.createDataFrame(rows, "id long, good boolean, w double, a double, b double, c double, d double").repartition(parts)


NAMES = ["a", "b", "c", "d"]


def test_boosting_against_a_plain_booster(spark, monkeypatch):
    x, y, w = sample()
    df = frame(spark, x, y, w)
    p = boosting.Params(trees=12, leaves=6)
    edges = boosting.bin_edges(df, NAMES)
    for j in range(4):  # few values: all of them have their own bin
        known = np.unique(x[~np.isnan(x[:, j]), j])
        assert len(edges[j]) <= 254 and (len(known) > 250 or np.allclose(edges[j], (known[1:] + known[:-1]) / 2))
    want = plain_booster(x, y, w, edges, p, x)
    for whole in (65_536, 60, 0):  # grown in one task, partly, by sums only
        monkeypatch.setattr(boosting, "WHOLE", whole)
        model = boosting.fit(df, NAMES, "good", "w", p)
        got = {r.id: r.score for r in boosting.scored(df, model, ["id"]).collect()}
        assert np.abs(np.array([got[k] for k in range(len(y))]) - want).max() < 1e-9, whole
        assert (model.n_train, model.n_good) == (len(y), int(y.sum()))
        assert all(len(t.value) <= 6 for t in model.trees)


def test_boosting_needs_both_classes_and_fine_weights(spark):
    x, y, w = sample(40)
    df = frame(spark, x, y, w)
    p = boosting.Params(trees=1)
    with pytest.raises(ValueError):
        boosting.fit(df.filter("good"), NAMES, "good", params=p)
    with pytest.raises(ValueError):
        boosting.fit(df.filter("false"), NAMES, "good", params=p)
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="weights must be finite"):
            boosting.fit(df.withColumn("w", F.lit(bad)), NAMES, "good", "w", p)
    # rows of no weight don't count in the sums; constant features and columns of nulls are never split
    flat = df.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(None).cast("double"))
    model = boosting.fit(flat, NAMES, "good", params=boosting.Params(trees=3))
    assert {s.feature for t in model.trees for s in t.split.values()} <= {2, 3}
    constant = boosting.fit(flat.withColumn("c", F.lit(0.0)).withColumn("d", F.lit(0.0)), NAMES, "good", params=p)
    assert boosting.scored(flat, constant, ["id"]).select("score").distinct().count() == 1


def test_training_weights(spark):
    seeds = stored.SEED_SOURCES
    features = spark.createDataFrame([(k, float(k)) for k in range(6)], "molecule_id long, x double")
    molecules = spark.createDataFrame([(0, 0, "a", "c1", 1), (1, 1, "b", "c1", -1), (2, 2, "s", "c1", 0), (3, 3, "t", None, 0), (4, 4, "u", "c1", 0), (5, 5, "a", "c2", 0)], "store_ord long, molecule_id long, molecule_key string, condition_id string, label int")
    log = spark.createDataFrame([(1, "s", seeds[0], -1), (2, "s", seeds[1], 1), (3, "t", seeds[0], -1), (4, "a", seeds[0], -1), (5, "u", "model", 1)], "event_seq long, molecule_key string, source string, label_value int")
    got = {r.molecule_id: (r.x, r.good, round(r.weight, 9)) for r in ranking.training_set(features, molecules, log).collect()}
    # 5 has the key of 0, whose seed counts there with the condition of the key's last row
    assert got == {0: (0.0, True, 1.0), 1: (1.0, False, 1.0), 2: (2.0, True, 0.1), 3: (3.0, False, 0.3), 5: (5.0, False, 0.3)}


def test_every_movie_by_the_earlier_ones(spark):
    x, y, _ = sample(120, 5)
    movie = np.repeat([0, 1, 2, 3], 30)
    y[movie == 0] = 1  # one class only: movie 1 has no model before it
    df = frame(spark, x, y, np.ones(120)).withColumn("movie_ord", F.floor(F.col("id") / 30)).withColumn("movie", F.concat(F.lit("m"), "movie_ord")).withColumn("store_ord", -F.col("id"))
    p = boosting.Params(trees=4, leaves=4)
    got = {r.movie: r for r in ranking.prequential(df, NAMES, 7, p).collect()}
    assert {m: (r.n_labeled, r.skipped) for m, r in got.items()} == {"m0": (30, True), "m1": (30, True), "m2": (30, False), "m3": (30, False)}
    edges = boosting.bin_edges(df, NAMES)
    for k in (2, 3):
        before, own = movie < k, np.flatnonzero(movie == k)
        score = plain_booster(x[before], y[before], np.ones(before.sum()), edges, p, x[own])
        top = sorted(range(30), key=lambda i: (-score[i], own[i]))[:7]
        assert got[f"m{k}"].precision == pytest.approx(y[own][top].mean()) and got[f"m{k}"].baseline == pytest.approx(y[own][-7:].mean())
    # labels of a movie and of later ones change nothing in its own ranking
    odd = df.withColumn("good", F.when(F.col("movie_ord") >= 2, ~F.col("good")).otherwise(F.col("good")))
    models = [boosting.fit_prefixes(d, NAMES, "good", "movie_ord", [2], params=p) for d in (df, odd)]
    scores = [{r.id: r.score for r in boosting.scored(df.filter("movie_ord = 2"), m, ["id"], "movie_ord").collect()} for m in models]
    assert scores[0] == scores[1] and len(scores[0]) == 30
    gate = stored.ship_gate(ranking.prequential(df, NAMES, 7, p).filter("NOT skipped"), 10.0).first()
    assert gate.videos == 2
    with pytest.raises(ValueError):
        ranking.prequential(df.filter("movie_ord = 0"), NAMES, 7, p)
    with pytest.raises(ValueError):
        ranking.prequential(df, NAMES, 0, p)
