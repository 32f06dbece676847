"""Drift of feature distributions between two conditions: two-sample Kolmogorov-Smirnov tests of many features at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import cut

#: Finite values that each side needs for a test.
LEAST = 2
#: Samples up to which the distribution of the statistic is computed exactly.
EXACT = 140


def kolmogorov_tail(d: float, n: int) -> float:
    """Chance that the largest distance of a sample of ``n`` from its own distribution is over ``d``.

    Exact up to EXACT samples (powers of a small matrix), then an expansion in powers of the root of n, for small tails twice
    the one-sided limit with its first correction."""
    if d <= 0:
        return 1.0
    if d >= 1 or n < 1:
        return 0.0
    if n * d * d >= 18:
        return 2 * math.exp(-2 * n * d * d)
    if n <= EXACT:
        k = int(n * d) + 1
        h, m = k - n * d, 2 * k - 1
        a = np.tri(m, m, 1)
        for i in range(m):
            a[i, 0] -= h ** (i + 1)
            a[m - 1, i] -= h ** (m - i)
        a[m - 1, 0] += max(2 * h - 1, 0) ** m
        a /= np.array([[float(math.factorial(max(i - j + 1, 0))) if i - j + 1 > 0 else 1.0 for j in range(m)] for i in range(m)])
        q, shift, base, base_shift, power = np.eye(m), 0, a, 0, n
        while power:
            if power & 1:
                q, shift = q @ base, shift + base_shift
            base, base_shift, power = base @ base, 2 * base_shift, power >> 1
            if base.max() > 1e140:
                base, base_shift = base * 1e-140, base_shift + 140
            if q.max() > 1e140:
                q, shift = q * 1e-140, shift + 140
        value = float(q[k - 1, k - 1])
        if value <= 0:
            return 1.0
        log = math.log(value) + shift * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
        return min(1.0, max(0.0, -math.expm1(log)))
    z = math.sqrt(n) * d
    if z > 2.5:
        return 2 * math.exp(-2 * z * z - 4 * z / (3 * math.sqrt(n)))
    odd = [(k + 0.5) ** 2 for k in range(20)]
    e = [math.exp(-math.pi**2 * o / (2 * z * z)) for o in odd]
    p2, root = math.pi**2, math.sqrt(math.pi / 2)
    k0 = 2 * root / z * sum(e)
    k1 = root / (6 * z**4) * 2 * sum((p2 * o - z * z) * x for o, x in zip(odd, e))
    first = 2 * sum(((6 * z**6 + 2 * z**4) + p2 * (2 * z**4 - 5 * z * z) * o + p2 * p2 * (1 - 2 * z * z) * o * o) * x for o, x in zip(odd, e))
    whole = sum(k * k * math.exp(-p2 * k * k / (2 * z * z)) for k in range(1, 20))
    k2 = root / (72 * z**7) * first - root / (36 * z**3) * 2 * p2 * whole
    return min(1.0, max(0.0, 1 - (k0 + k1 / math.sqrt(n) + k2 / n)))


def ks_by_feature(samples: DataFrame) -> DataFrame:
    """feature, statistic, n_source, n_target of ``samples`` (feature, side: 0 source and 1 target, x), finite values only.

    Values are counted before they are sorted; running counts are taken within ranges of (feature, value) of about equal size,
    so no feature and no common value is one task's."""
    fine = samples.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") != float("inf")))
    count = lambda k: F.count_if(F.col("side") == k)
    by = fine.groupBy("feature", "x").agg(count(0).alias("a"), count(1).alias("b"))
    by = cut(by.repartitionByRange("feature", "x").withColumn("part", F.spark_partition_id()))
    part = by.groupBy("feature", "part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    before, whole = W.partitionBy("feature").orderBy("part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("feature")
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    part = part.select("feature", "part", zero("pa").alias("ba"), zero("pb").alias("bb"), F.sum("pa").over(whole).alias("na"), F.sum("pb").over(whole).alias("nb"))
    run = W.partitionBy("feature", "part").orderBy("x")
    gap = F.abs(F.try_divide(F.col("ba") + F.col("ca"), F.col("na")) - F.try_divide(F.col("bb") + F.col("cb"), F.col("nb")))
    each = by.withColumn("ca", F.sum("a").over(run)).withColumn("cb", F.sum("b").over(run)).join(part, ["feature", "part"])
    return each.groupBy("feature").agg(F.max(gap).alias("statistic"), F.max("na").alias("n_source"), F.max("nb").alias("n_target"))


def condition_drift(rows: DataFrame, names: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """feature, statistic, pvalue, n_source, n_target, tested, drifted for each of ``names``, columns of ``rows`` with ``side`` (0 source,
    1 target).

    Values that are missing or not finite are left out feature by feature. A feature with fewer than two values on a side isn't
    tested: no statistic, no p value, not drifted. The others drift if their p value is under ``alpha`` over the number of tested
    features. ValueError if none can be tested, or alpha isn't between 0 and 1."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])).alias("p")
    got = {r["feature"]: r for r in ks_by_feature(rows.select("side", pairs).select("side", "p.feature", "p.x")).collect()}  # a row a feature
    tested = {n for n, r in got.items() if min(r["n_source"], r["n_target"]) >= LEAST}
    if not tested:
        raise ValueError("no feature has two finite values on both sides")
    out = []
    for n in names:
        r = got.get(n)
        a, b = (r["n_source"], r["n_target"]) if r else (0, 0)
        d = r["statistic"] if n in tested else None
        p = kolmogorov_tail(d, round(a * b / (a + b))) if n in tested else None
        out.append((n, d, p, a, b, n in tested, n in tested and p < alpha / len(tested)))
    return rows.sparkSession.createDataFrame(out, "feature string, statistic double, pvalue double, n_source long, n_target long, tested boolean, drifted boolean")


def between_conditions(features: DataFrame, molecules: DataFrame, names: Sequence[str], source: str, target: str, alpha: float = 0.05) -> DataFrame:
    """condition_drift of the stored features (molecule_id, ...) of two conditions of ``molecules`` (molecule_id, condition_id), curated
    or not. ValueError if a molecule of the features is unknown or there twice, KeyError for a condition without features."""
    own = molecules.select("molecule_id", "condition_id")
    per = features.select("molecule_id").join(own.withColumn("__in", F.lit(1)), "molecule_id", "left").groupBy("molecule_id").agg(F.count("*").alias("n"), F.count("__in").alias("m"))
    odd = per.agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if(F.col("m") == 0).alias("lost")).first()
    if odd["twice"] or odd["lost"]:
        raise ValueError(f"{odd['twice']} molecules are there twice, {odd['lost']} are unknown")
    rows = features.join(own.filter(F.col("condition_id").isin(source, target)), "molecule_id").withColumn("side", (F.col("condition_id") == target).cast("int"))
    there = {r["condition_id"] for r in rows.select("condition_id").distinct().collect()}
    for c in (source, target):
        if c not in there:
            raise KeyError(c)
    return condition_drift(rows, names, alpha)
