"""Photobleach change points, leakage and gamma factors, and the choice of the correction method."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import numbered_rows

def by_frame():
    return W.partitionBy("molecule_id").orderBy("frame")


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function of positive numbers: Stirling's series eight steps up, good to some 1e-15 of its size."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * F.pow(z, F.lit(7.0))) + 1 / (1188 * F.pow(z, F.lit(9.0))) - 691 / (360360 * F.pow(z, F.lit(11.0)))
    down = x
    for i in range(1, 8):
        down = down * (x + i)
    return series - F.log(down)


def change_scores(trace: DataFrame, value: str = "value", a: float = 1.0, b: float = 1.0, beta: float = 1.0, mu: float = 1000.0) -> DataFrame:
    """molecule_id, n, t, score: the log evidence of a change from a signal to zero behind t of a trace's n frames, by running sums
    (normal-inverse-gamma prior). At t = n - 1 stands the whole trace as signal, at t = 0 none of it; NaN scores are minus infinity."""
    m = W.partitionBy("molecule_id")
    x = trace.select("molecule_id", "frame", F.col(value).cast("double").alias("x")).withColumn("i", F.row_number().over(by_frame())).withColumn("n", F.count("*").over(m))
    s, q = F.sum("x").over(by_frame()), F.sum(F.col("x") * F.col("x")).over(by_frame())
    x = x.withColumn("s", s).withColumn("q", q).withColumn("all", F.sum(F.col("x") * F.col("x")).over(m))
    own = x.select("molecule_id", "n", (F.col("i") - 1).alias("t"), "s", "q", "all")
    own = own.withColumn("ps", F.lag("s").over(m.orderBy("t"))).withColumn("pq", F.lag("q").over(m.orderBy("t")))
    last = F.col("t") == F.col("n") - 1
    k = F.when(last, F.col("n")).otherwise(F.col("t"))
    ks, kq = F.when(last, F.col("s")).otherwise(F.coalesce("ps", F.lit(0.0))), F.when(last, F.col("q")).otherwise(F.coalesce("pq", F.lit(0.0)))
    own = own.select("molecule_id", "n", "t", k.cast("double").alias("k"), (F.col("n") - k).cast("double").alias("r"), ks.alias("ks"), kq.alias("kq"), F.greatest(F.col("all") - kq, F.lit(0.0)).alias("rq"))
    c0, two_pi = -math.lgamma(a) + a * math.log(b), math.log(2 * math.pi)
    kd, rd = F.col("k"), F.col("r")
    mean = F.col("ks") / F.when(kd > 0, kd)
    spread = F.greatest(F.col("kq") - F.col("ks") * mean, F.lit(0.0))
    signal = lgamma(a + kd / 2) + c0 - (a + kd / 2) * F.log(b + spread / 2 + beta * kd * F.pow(mean - mu, F.lit(2.0)) / (2 * (beta + kd))) + 0.5 * math.log(beta) - 0.5 * F.log(beta + kd) - kd / 2 * two_pi
    dark = lgamma(a + rd / 2) + c0 - (a + rd / 2) * F.log(b + F.col("rq") / 2) - rd / 2 * two_pi
    score = F.when(kd > 0, signal).otherwise(0.0) + F.when(rd > 0, dark).otherwise(0.0)
    return own.select("molecule_id", "n", "t", F.when(F.isnan(score) | score.isNull(), float("-inf")).otherwise(score).alias("score"))


def _best(scores: DataFrame, score: Column) -> DataFrame:
    best = scores.groupBy("molecule_id", "n").agg(F.max_by(F.col("t"), F.struct(score, -F.col("t"))).alias("t"))
    return best.select("molecule_id", F.when((F.col("n") < 2) | (F.col("t") == F.col("n") - 1), F.col("n")).otherwise(F.col("t")).cast("int").alias("bleach"))


def photobleach(trace: DataFrame, value: str = "value", a: float = 1.0, b: float = 1.0, beta: float = 1.0, mu: float = 1000.0) -> DataFrame:
    """molecule_id, bleach: the most likely single change from a signal to zero, the trace's length if there is none."""
    return _best(change_scores(trace, value, a, b, beta, mu), F.col("score"))


def ensemble_photobleach(trace: DataFrame, value: str = "value", a: float = 1.0, b: float = 1.0, beta: float = 1.0, mu: float = 1000.0) -> DataFrame:
    """molecule_id, bleach, rate: as photobleach, with a lifetime that all traces share: the posterior mean of each trace's change,
    cut to a whole frame, gives one exponential rate, under which the likeliest change is taken again."""
    scores = change_scores(trace, value, a, b, beta, mu)
    top = scores.withColumn("top", F.max("score").over(W.partitionBy("molecule_id")))
    w = F.exp(F.col("score") - F.col("top"))
    first = top.groupBy("molecule_id").agg((F.sum(w * F.col("t")) / F.sum(w)).cast("long").alias("first"))
    rate = first.agg(((1.0 + F.count("*")) / (1.0 + F.sum("first"))).alias("rate"))
    r = rate.first()["rate"]
    if r is None:
        return _best(scores, F.col("score")).withColumn("rate", F.lit(None).cast("double"))
    return _best(scores, F.col("score") + math.log(r) - r * F.col("t")).withColumn("rate", F.lit(r))


def bleached_molecules(frames: DataFrame, molecules: DataFrame, **prior: float) -> DataFrame:
    """``molecules`` (molecule_id, frame_start, frame_end, w0, w1, ...) with donor_bleach and acceptor_bleach, absolute frames of the change
    within their own range, and with a window up to the change of the sum where it's still the whole range. A sum that is dark from
    the first frame leaves the window, and molecules without frames keep -1."""
    own = molecules.select("molecule_id", "frame_start", "frame_end")
    inside = frames.join(own, "molecule_id").filter("frame >= frame_start AND frame < frame_end")
    of = lambda c, name: photobleach(inside.select("molecule_id", "frame", c.alias("value")), **prior).withColumnRenamed("bleach", name)
    got = of(F.col("donor"), "__d").join(of(F.col("acceptor"), "__a"), "molecule_id").join(of(F.col("donor") + F.col("acceptor"), "__s"), "molecule_id")
    rows = molecules.drop("donor_bleach", "acceptor_bleach").join(got, "molecule_id", "left")
    at = lambda n: F.coalesce(F.col("frame_start") + F.col(n), F.lit(-1)).cast("int")
    whole = (F.col("w0") == F.col("frame_start")) & (F.col("w1") == F.col("frame_end")) & (F.col("__s") > 0)
    rows = rows.withColumn("donor_bleach", at("__d")).withColumn("acceptor_bleach", at("__a"))
    return rows.withColumn("w1", F.when(whole, F.col("frame_start") + F.col("__s")).otherwise(F.col("w1")).cast("int")).drop("__d", "__a", "__s")


def leakage(frames: DataFrame, bleach: DataFrame, min_frames: int = 20, ceiling: float = 0.3) -> DataFrame:
    """molecule_id, alpha, reason: mean acceptor over mean donor in the donor-only tail [acceptor_bleach, donor_bleach)."""
    x = frames.join(bleach, "molecule_id")
    tail = (F.col("frame") >= F.col("acceptor_bleach")) & (F.col("frame") < F.col("donor_bleach"))
    g = x.groupBy("molecule_id").agg(F.count(F.when(tail, 1)).alias("frames"), F.avg(F.when(tail, F.col("donor"))).alias("d"), F.avg(F.when(tail, F.col("acceptor"))).alias("a"))
    ratio = F.when(F.col("d") != 0, F.col("a") / F.col("d"))
    reason = F.when(F.col("frames") < min_frames, "short tail").when(~(F.col("d") > 0), "no donor").when((ratio < 0) | (ratio > ceiling), "out of range").otherwise("ok")
    return g.select("molecule_id", F.when(reason == "ok", ratio).alias("alpha"), reason.alias("reason"))


def dataset_factor(values: DataFrame, value: str, least: int = 10) -> DataFrame:
    """One row: n and the exact median, withheld (null) below ``least`` qualifying traces. The middle values are found by their places
    in a range shuffle, so no task holds all."""
    placed = numbered_rows(values.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).cast("double").alias("v")), ["v"], "k")
    n = placed.agg(F.count("*").alias("n"))
    mid = placed.crossJoin(F.broadcast(n)).filter((F.col("k") == F.floor((F.col("n") - 1) / 2)) | (F.col("k") == F.floor(F.col("n") / 2)))
    return n.crossJoin(mid.agg(F.avg("v").alias("m"))).select("n", F.when(F.col("n") >= least, F.col("m")).alias("factor"))


def gamma(frames: DataFrame, bleach: DataFrame, alpha: float, half: int = 3, min_frames: int = 20, ceiling: float = 5.0) -> DataFrame:
    """molecule_id, gamma: fall of the corrected acceptor over rise of the donor across the acceptor's bleach; pre and
    tail must be longer than ``min_frames``; in (0, ceiling]."""
    x = frames.join(bleach, "molecule_id").withColumn("ac", F.col("acceptor") - alpha * F.col("donor"))
    s, d = F.col("acceptor_bleach"), F.col("donor_bleach")
    pre, post = (F.col("frame") >= s - half) & (F.col("frame") < s), (F.col("frame") >= s) & (F.col("frame") < F.least(s + half, d))
    g = x.groupBy("molecule_id", "acceptor_bleach", "donor_bleach").agg(*[F.avg(F.when(c, F.col(v))).alias(n) for c, v, n in ((pre, "ac", "a0"), (post, "ac", "a1"), (pre, "donor", "d0"), (post, "donor", "d1"))])
    den = F.col("d1") - F.col("d0")
    ratio = F.when(den != 0, (F.col("a0") - F.col("a1")) / den)
    ok = (s > min_frames) & (d - s > min_frames) & (ratio > 0) & (ratio <= ceiling)
    return g.select("molecule_id", F.when(ok, ratio).alias("gamma"))


def effective_gamma(own: DataFrame, least: int = 10) -> DataFrame:
    """molecule_id, gamma: a molecule's own, else the dataset's median (null below ``least`` own values)."""
    return own.crossJoin(F.broadcast(dataset_factor(own, "gamma", least))).select("molecule_id", F.coalesce("gamma", "factor").alias("gamma"))


#: The methods a molecule can have.
CORRECTED, MANUAL, UNAVAILABLE, TOGGLE = "corrected", "manual", "apparent-E (corrections unavailable)", "apparent-E (user toggle)"


def chosen_methods(molecules: DataFrame, apparent_only: bool = False, alpha: float | None = None, gamma: float | None = None) -> DataFrame:
    """molecule_id, method, confidence, alpha, gamma of ``molecules`` (molecule_id, alpha, gamma).

    The toggle wins, then factors that can't be applied (leakage not finite, gamma not finite or not positive) make it apparent, then a
    manual ``alpha`` or ``gamma`` stands in for the stored one, else it is corrected. Confidence is 1 where a correction is applied."""
    if alpha is not None and not math.isfinite(alpha):
        raise ValueError("alpha must be finite")
    if gamma is not None and not (math.isfinite(gamma) and gamma > 0):
        raise ValueError("gamma must be finite and positive")
    a = F.lit(float(alpha)) if alpha is not None else F.col("alpha").cast("double")
    g = F.lit(float(gamma)) if gamma is not None else F.col("gamma").cast("double")
    fine = lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    able = fine(a) & fine(g) & F.coalesce(g > 0, F.lit(False))
    method = F.when(F.lit(apparent_only), TOGGLE).when(~able, UNAVAILABLE).when(F.lit(alpha is not None or gamma is not None), MANUAL).otherwise(CORRECTED)
    got = molecules.select("molecule_id", method.alias("method"), F.col("alpha").alias("__a"), F.col("gamma").alias("__g"))
    applied = F.col("method").isin(CORRECTED, MANUAL)
    manual = F.col("method") == MANUAL
    stored = lambda c, given: F.when(manual & F.lit(given is not None), F.lit(given)).otherwise(F.col(c)).cast("double")
    return got.select("molecule_id", "method", applied.cast("double").alias("confidence"), stored("__a", alpha).alias("alpha"), stored("__g", gamma).alias("gamma"))


def method_totals(chosen: DataFrame) -> DataFrame:
    """One row: n_molecules, n_corrected, n_manual, n_apparent and total_failure (nothing is corrected, or there is no molecule)."""
    n = lambda *names: F.count_if(F.col("method").isin(*names))
    return chosen.agg(F.count("*").alias("n_molecules"), n(CORRECTED).alias("n_corrected"), n(MANUAL).alias("n_manual"), n(UNAVAILABLE, TOGGLE).alias("n_apparent"), (n(CORRECTED, MANUAL) == 0).alias("total_failure"))


def methods(molecules: DataFrame, apparent_only: bool = False) -> DataFrame:
    """molecule_id, method: apparent if asked for or if a factor is missing or out of its range, else corrected."""
    ok = F.col("alpha").between(0, 0.3) & (F.col("gamma") > 0) & (F.col("gamma") <= 5)
    return molecules.select("molecule_id", F.when(F.lit(not apparent_only) & F.coalesce(ok, F.lit(False)), "corrected").otherwise("apparent").alias("method"))


def remapped_factors(rows: DataFrame, alpha: str = "legacy_alpha", beta: str = "legacy_beta", gamma: str = "legacy_gamma") -> DataFrame:
    """``rows`` with the factors of an older naming under ours: its beta is the leakage alpha, gamma stays, delta is 0; its alpha, the
    direct excitation, is kept as direct_excitation for the record only."""
    return rows.withColumns({"alpha": F.col(beta), "gamma": F.col(gamma), "delta": F.lit(0.0), "direct_excitation": F.col(alpha)}).drop(alpha, beta, gamma)


def median_deviation(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The median of the distances from the median, by ``by``: exact, each group's values counted before they are sorted."""
    counts = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count("*").alias("__n"))
    mid = counts.groupBy(*by).agg(F.percentile(value, 0.5, F.col("__n")).alias("__m"))
    both = counts.join(mid, list(by)) if by else counts.crossJoin(F.broadcast(mid))
    return both.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("__m")), 0.5, F.col("__n")).alias("mad"))
