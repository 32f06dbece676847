"""Registered queries of the trace operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import agreement, corrections, curation, kinetics, population, select, spatial
from . import proxy

BASE = """WITH f AS (SELECT user_id AS molecule_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
 CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(json_extract(props, '$.k') AS DOUBLE) END AS donor, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS acceptor FROM events),
m AS (SELECT molecule_id, molecule_id % 10 AS movie_id, molecule_id % 5 AS condition_id, CASE WHEN molecule_id % 7 = 0 THEN -1 WHEN molecule_id % 3 = 0 THEN 1 ELSE 0 END AS label, n,
 CASE WHEN molecule_id % 4 = 0 THEN 0 ELSE 5 END AS w0, CASE WHEN molecule_id % 4 = 0 THEN 0 ELSE n - 5 END AS w1 FROM (SELECT molecule_id, count(*) AS n FROM f GROUP BY 1)),
b AS (SELECT molecule_id, movie_id, condition_id, label, CASE WHEN w1 > w0 THEN w0 ELSE 0 END AS lo, CASE WHEN w1 > w0 THEN w1 ELSE n END AS hi FROM m WHERE label <> -1),
e AS (SELECT f.molecule_id, frame, frame - lo AS t, donor, acceptor, condition_id, CASE WHEN donor + acceptor <> 0 THEN acceptor / (donor + acceptor) END AS e FROM f JOIN b ON f.molecule_id = b.molecule_id WHERE frame >= lo AND frame < hi),
p AS (SELECT *, CASE WHEN e IS NULL THEN -1 WHEN e < 0.25 THEN 0 WHEN e < 0.5 THEN 1 ELSE 2 END AS state FROM e),
nx AS (SELECT *, lead(state) OVER w AS s1, lead(state, 2) OVER w AS s2, lag(state) OVER w AS s0 FROM p WINDOW w AS (PARTITION BY molecule_id ORDER BY frame)),
q AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY frame) AS rn FROM p WHERE state <> -1),
r AS (SELECT *, rn - row_number() OVER (PARTITION BY molecule_id, state ORDER BY rn) AS g FROM q),
d0 AS (SELECT molecule_id, state, g, min(rn) AS st, count(*) AS length FROM r GROUP BY 1, 2, 3),
d1 AS (SELECT *, row_number() OVER (PARTITION BY molecule_id ORDER BY st) AS k, row_number() OVER (PARTITION BY molecule_id ORDER BY st DESC) AS kd FROM d0),
d AS (SELECT molecule_id, state, length FROM d1 WHERE kd > 1 AND k > 1)
"""
_BIN = "CAST(least(floor((e - {lo}) * {n} / {w}), {n} - 1) AS INTEGER)"
BIN = _BIN.format(lo="-0.25", n=151, w="1.5").replace("- -", "+ ")
BIN2 = _BIN.format(lo="-0.2", n=61, w="1.4").replace("- -", "+ ")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(BASE + f"""SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(c.n, 0)::DOUBLE AS n, round(coalesce(c.n, 0) / ((sum(coalesce(c.n, 0)) OVER ()) * (1.5 / 151)), 9) AS density
FROM range(151) g(bin) LEFT JOIN (SELECT {BIN} AS bin, count(*) AS n FROM e WHERE e BETWEEN -0.25 AND 1.25 GROUP BY 1) c ON g.bin = c.bin""")
def a2_efficiency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(population.histogram(proxy.efficiencies(spark, sf)), "density")


@query(BASE + f"""SELECT CAST(g.bin AS INTEGER) AS bin, round(coalesce(c.n, 0), 9) AS n FROM range(151) g(bin) LEFT JOIN (SELECT {BIN} AS bin, sum(1.0 / k) AS n
FROM (SELECT e, count(*) OVER (PARTITION BY molecule_id) AS k FROM e WHERE e IS NOT NULL) WHERE e BETWEEN -0.25 AND 1.25 GROUP BY 1) c ON g.bin = c.bin""")
def a2_equal_weight_histogram(spark, sf):
    return rounded(population.histogram(proxy.efficiencies(spark, sf), equal_weight=True), "n").select("bin", "n")


@query(BASE + f"SELECT condition_id, {BIN} AS bin, count(*)::DOUBLE AS n FROM e WHERE e BETWEEN -0.25 AND 1.25 GROUP BY 1, 2")
def a4_condition_histograms(spark, sf):
    return population.histogram(proxy.efficiencies(spark, sf), by=["condition_id"]).select("condition_id", "bin", "n")


@query(BASE + f"SELECT t, {BIN2} AS bin, count(*) AS n FROM e WHERE t < 100 AND e >= -0.2 AND e < 1.2 GROUP BY 1, 2")
def a5_time_heatmap(spark, sf):
    return population.time_heatmap(proxy.efficiencies(spark, sf)).select(F.col("t").cast("long").alias("t"), "bin", "n")


@query(BASE + "SELECT condition_id, count(DISTINCT molecule_id) AS n_molecules, count(*) AS n_samples, count(*) FILTER (e BETWEEN -0.25 AND 0.6) AS n_in_range FROM e WHERE e IS NOT NULL GROUP BY 1")
def a2_pooled_totals(spark, sf):
    return population.pooled_totals(proxy.efficiencies(spark, sf), high=0.6, by=["condition_id"])


@query(BASE + f""", rq AS (SELECT * FROM (VALUES (0, 3), (1, 0), (3, 2)) v(ord, condition_id)), hc AS (SELECT condition_id, {BIN} AS bin, count(*) AS n FROM e WHERE e BETWEEN -0.25 AND 1.25 GROUP BY 1, 2), mc AS (SELECT condition_id, count(DISTINCT molecule_id) AS n_molecules FROM e WHERE e IS NOT NULL GROUP BY 1)
SELECT rq.ord::INTEGER AS ord, rq.condition_id::BIGINT AS condition_id, g.bin::INTEGER AS bin, coalesce(hc.n, 0)::DOUBLE AS n, round(coalesce(hc.n, 0) / ((sum(coalesce(hc.n, 0)) OVER (PARTITION BY rq.condition_id)) * (1.5 / 151)), 9) AS density, n_molecules
FROM rq JOIN mc ON mc.condition_id = rq.condition_id CROSS JOIN range(151) g(bin) LEFT JOIN hc ON hc.condition_id = rq.condition_id AND hc.bin = g.bin""")
def a4_requested_conditions(spark, sf):
    """Conditions in the order they're asked for, of which one isn't there and one is asked for twice."""
    return rounded(population.condition_histograms(proxy.efficiencies(spark, sf), [3, 0, 77, 2, 3]), "density")


@query(BASE + f""", wf AS (SELECT t, e, 1.0::DOUBLE / count(*) OVER (PARTITION BY molecule_id) AS w FROM e WHERE e IS NOT NULL), ct AS (SELECT t, {BIN2} AS bin, sum(w) AS n FROM wf WHERE t < 100 AND e >= -0.2 AND e < 1.2 GROUP BY 1, 2)
SELECT t, bin, round(n / ((SELECT sum(n) FROM ct) * 0.5 * 1.4 / 61), 9) AS n FROM ct""")
def a5_equal_weight_density(spark, sf):
    got = population.time_heatmap(proxy.efficiencies(spark, sf), equal_weight=True, density=True, dt=0.5)
    return rounded(got.select(F.col("t").cast("long").alias("t"), "bin", "n"), "n")


@query(BASE + f""", j AS (SELECT molecule_id, t - 1 AS sync FROM nx WHERE state = 1 AND s0 = 0), l AS (SELECT molecule_id, count(*) AS len FROM p GROUP BY 1)
SELECT p.t - j.sync AS dt, {BIN2} AS bin, count(*) AS n FROM j JOIN l USING (molecule_id) JOIN p ON p.molecule_id = j.molecule_id AND p.t BETWEEN greatest(0, sync - 10) AND least(len - 1, sync + 20) WHERE e >= -0.2 AND e < 1.2 GROUP BY 1, 2""")
def a6_fixed_windows(spark, sf):
    """Fixed windows around jumps from state 0 to state 1."""
    return population.transition_sync(proxy.paths(spark, sf), 10, 30, from_state=0, to_state=1, single_dwell=False)


@query(BASE + f""", j0 AS (SELECT molecule_id, state, s0, t - 1 AS sync, lag(t) OVER w AS pv, lead(t) OVER w AS nt FROM nx WHERE state <> -1 AND s0 <> -1 AND s0 <> state WINDOW w AS (PARTITION BY molecule_id ORDER BY t)), j AS (SELECT * FROM j0 WHERE s0 = 2),
l AS (SELECT molecule_id, count(*) AS len FROM p GROUP BY 1),
ct AS (SELECT p.t - j.sync AS dt, {BIN2} AS bin, count(*) AS n FROM j JOIN l USING (molecule_id) JOIN p ON p.molecule_id = j.molecule_id AND p.t >= coalesce(pv, 0) AND p.t < coalesce(nt, len) - 1 AND p.t BETWEEN sync - 50 AND sync + 50 WHERE e >= -0.2 AND e < 1.2 GROUP BY 1, 2)
SELECT dt, bin, round(n / ((SELECT sum(n) FROM ct) * 0.2 * 1.4 / 61), 9) AS n FROM ct""")
def a6_density_from_state(spark, sf):
    return rounded(population.transition_sync(proxy.paths(spark, sf), from_state=2, density=True, dt=0.2), "n")


@query(BASE + """, v AS (SELECT CASE WHEN count(*) FILTER (state = 1 AND s1 <> -1) > 0 THEN count(*) FILTER (state = 1 AND s1 = 2)::DOUBLE / count(*) FILTER (state = 1 AND s1 <> -1) END AS p FROM nx GROUP BY molecule_id),
h AS (SELECT CAST(least(floor((p + 0.05) * 25 / (1.05 - -0.05)), 24) AS INTEGER) AS bin, count(*) AS n FROM v WHERE p IS NOT NULL GROUP BY 1)
SELECT g.bin::INTEGER AS bin, coalesce(n, 0)::DOUBLE AS n, round(coalesce(n, 0) / ((SELECT sum(n) FROM h) * (1.1::DOUBLE / 25)), 9) AS density FROM range(25) g(bin) LEFT JOIN h ON h.bin = g.bin""")
def a9_probability_density(spark, sf):
    return rounded(population.probability_density(proxy.paths(spark, sf), 1, 2, 3), "density")


@query(BASE + "SELECT state, CASE state WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.4::DOUBLE ELSE 0.8::DOUBLE END AS level, count(*) AS n_dwells, round(avg(length) * 0.2, 9) AS mean_dwell FROM d GROUP BY 1")
def a13_dwell_levels(spark, sf):
    return rounded(population.dwell_summary(population.dwells(proxy.paths(spark, sf)), [0.2, 0.4, 0.8], 0.2), "mean_dwell")


@query(BASE + """, x AS (SELECT state, min(length)::DOUBLE AS lo, max(length)::DOUBLE AS hi, count(*) AS total FROM d GROUP BY 1), y AS (SELECT state, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi, total FROM x),
c AS (SELECT d.state, least(50, floor((length - lo) * 51 / (hi - lo)))::INTEGER AS bin, count(*) AS n FROM d JOIN y ON y.state = d.state GROUP BY 1, 2)
SELECT y.state, g.bin::INTEGER AS bin, round(lo + g.bin * (hi - lo) / 51, 9) AS left, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * (hi - lo) / 51), 9) AS density FROM y CROSS JOIN range(51) g(bin) LEFT JOIN c ON c.state = y.state AND c.bin = g.bin""")
def a13_dwell_histogram(spark, sf):
    return rounded(population.dwell_histogram(population.dwells(proxy.paths(spark, sf))), "left", "density")


@query(BASE + """, c AS (SELECT *, donor - avg(donor) OVER w AS d0, acceptor - avg(acceptor) OVER w AS a0, count(*) OVER w AS n, stddev_pop(donor) OVER w AS sd, stddev_pop(acceptor) OVER w AS sa FROM e WINDOW w AS (PARTITION BY molecule_id)),
h AS (SELECT least(min(n) - 1, 12) AS h FROM c WHERE n >= 2), k AS (SELECT unnest(range(-h, h + 1)) AS lag FROM h),
z AS (SELECT x.molecule_id, k.lag, sum(x.d0 * y.a0) / any_value(x.n * x.sd * x.sa) AS r FROM c x CROSS JOIN k JOIN c y ON y.molecule_id = x.molecule_id AND y.frame = x.frame - k.lag WHERE x.n >= 2 AND x.sd > 0 AND x.sa > 0 GROUP BY 1, 2)
SELECT CAST(lag AS INTEGER) AS lag, round(avg(r), 7) AS r, count(*) AS molecules FROM z GROUP BY 1""")
def a14_common_lags(spark, sf):
    return rounded(population.pooled_cross_correlation(proxy.efficiencies(spark, sf), 12), "r", digits=7)


@query(BASE + f""", j AS (SELECT molecule_id, t - 1 AS sync, lag(t) OVER w AS pv, lead(t) OVER w AS nt FROM nx WHERE state <> -1 AND s0 <> -1 AND s0 <> state WINDOW w AS (PARTITION BY molecule_id ORDER BY t)),
l AS (SELECT molecule_id, count(*) AS len FROM p GROUP BY 1)
SELECT p.t - j.sync AS dt, {BIN2} AS bin, count(*) AS n FROM j JOIN l USING (molecule_id) JOIN p ON p.molecule_id = j.molecule_id AND p.t >= coalesce(pv, 0) AND p.t < coalesce(nt, len) - 1 AND p.t BETWEEN sync - 50 AND sync + 50
WHERE e >= -0.2 AND e < 1.2 GROUP BY 1, 2""")
def a6_transition_sync(spark, sf):
    return population.transition_sync(proxy.paths(spark, sf))


@query(BASE + "SELECT state AS from_state, s2 AS to_state, count(*) AS n FROM nx WHERE state <> -1 AND s1 <> -1 AND s2 <> -1 AND s1 <> state GROUP BY 1, 2")
def a8_transition_density(spark, sf):
    return population.transition_density(proxy.paths(spark, sf))


@query(BASE + """SELECT molecule_id, round(CASE WHEN count(*) FILTER (state = 0 AND s1 <> -1) > 0 THEN count(*) FILTER (state = 0 AND s1 = 1)::DOUBLE / count(*) FILTER (state = 0 AND s1 <> -1) END, 9) AS p FROM nx GROUP BY 1""")
def a9_transition_probability(spark, sf):
    return rounded(population.transition_probability(proxy.paths(spark, sf), 0, 1), "p")


@query(BASE + "SELECT states, count(*) AS n FROM (SELECT molecule_id, count(DISTINCT state) AS states FROM p WHERE state <> -1 GROUP BY 1) GROUP BY 1")
def a10_state_number(spark, sf):
    return population.state_number(proxy.paths(spark, sf))


@query(BASE + "SELECT state, length, count(*) AS n FROM d GROUP BY 1, 2")
def a11_dwells(spark, sf):
    return population.dwells(proxy.paths(spark, sf)).groupBy("state", "length").agg(F.count("*").alias("n"))


@query(BASE + """SELECT state, tau, round((SELECT count(*) FROM d x WHERE x.state = z.state AND x.length > tau)::DOUBLE / m, 9) AS s
FROM (SELECT state, count(*) AS m, unnest(range(0, max(length))) AS tau FROM d GROUP BY state) z""")
def a12_survival(spark, sf):
    return rounded(population.survival(population.dwells(proxy.paths(spark, sf))), "s")


@query(BASE + "SELECT state, round(1 / (avg(length) * 0.2), 9) AS k, count(*) AS n FROM d GROUP BY 1")
def a27_exit_rates(spark, sf):
    return rounded(population.exit_rates(population.dwells(proxy.paths(spark, sf)), 0.2), "k")


@query(BASE + """, c AS (SELECT *, sum(ch) OVER (PARTITION BY molecule_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN s0 IS NULL OR s0 <> state THEN 1 ELSE 0 END AS ch FROM nx))
SELECT molecule_id, state, min(frame) AS start, count(*) AS length FROM c GROUP BY molecule_id, run, state HAVING state <> -1""")
def w2_runs(spark, sf):
    return population.runs(proxy.paths(spark, sf)).select("molecule_id", "state", F.col("start").cast("long").alias("start"), "length")


@query(BASE + """, c AS (SELECT *, donor - avg(donor) OVER w AS d0, acceptor - avg(acceptor) OVER w AS a0, count(*) OVER w AS n, stddev_pop(donor) OVER w AS sd, stddev_pop(acceptor) OVER w AS sa FROM e WINDOW w AS (PARTITION BY molecule_id)),
k AS (SELECT unnest(range(-5, 6)) AS lag), z AS (SELECT x.molecule_id, k.lag, sum(x.d0 * y.a0) / any_value(x.n * x.sd * x.sa) AS r FROM c x CROSS JOIN k JOIN c y ON y.molecule_id = x.molecule_id AND y.frame = x.frame - k.lag WHERE x.sd > 0 AND x.sa > 0 GROUP BY 1, 2)
SELECT CAST(lag AS INTEGER) AS lag, round(avg(r), 7) AS r, count(*) AS molecules FROM z GROUP BY 1""")
def a14_cross_correlation(spark, sf):
    return rounded(population.cross_correlation(proxy.efficiencies(spark, sf), 5), "r", digits=7)


@query(BASE + """SELECT molecule_id, start, round(lag0, 6) AS lag0 FROM (SELECT molecule_id, frame AS start, corr(donor, acceptor) OVER w AS lag0, count(*) OVER w AS c FROM e WINDOW w AS (PARTITION BY molecule_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)) WHERE c = 15""")
def w3_sliding_correlation(spark, sf):
    got = population.sliding_correlation(proxy.efficiencies(spark, sf))
    return rounded(got, "lag0", digits=6).withColumn("start", F.col("start").cast("long"))


@query(BASE + """SELECT molecule_id, count(*) AS n_frames, round(avg(donor + acceptor), 6) AS total_intensity, round(avg(donor + acceptor) / stddev_pop(donor + acceptor), 6) AS snr, round(avg(e), 9) AS fret_mean, round(var_pop(e), 9) AS fret_var, round(corr(donor, acceptor), 6) AS anticorr_lag0 FROM e GROUP BY 1""")
def a22_trace_features(spark, sf):
    return rounded(rounded(population.trace_features(proxy.efficiencies(spark, sf)), "total_intensity", "snr", "anticorr_lag0", digits=6), "fret_mean", "fret_var")


@query(BASE + """, v AS (SELECT e FROM e WHERE e IS NOT NULL), s AS (SELECT count(*) AS n, 0.25 * stddev_samp(e) AS h FROM v)
SELECT CAST(k AS INTEGER) AS k, round(sum(exp(-((k / 99.0 - e) / h) * ((k / 99.0 - e) / h) / 2)) / any_value(n * h * sqrt(2 * pi())), 7) AS density FROM v CROSS JOIN s CROSS JOIN range(100) g(k) GROUP BY 1""")
def a17_kernel_density(spark, sf):
    return rounded(population.kde(proxy.efficiencies(spark, sf), "e"), "density", digits=7)


@query("SELECT k, round(0.4 / sqrt(2 * pi() * 0.01) * exp(-(x - 0.2) * (x - 0.2) / 0.02) + 0.6 / sqrt(2 * pi() * 0.02) * exp(-(x - 0.7) * (x - 0.7) / 0.04), 9) AS y FROM (SELECT k, -0.25 + k * 0.0015 AS x FROM range(1001) g(k))")
def a7_gaussian_overlay(spark, sf):
    return rounded(population.gaussian_overlay(spark, [0.2, 0.7], [0.01, 0.02], [0.4, 0.6]), "y")


_BLEACH = "SELECT molecule_id, n // 2 AS s, n - n // 8 AS db FROM m"


def _bleach(f: DataFrame) -> DataFrame:
    return proxy.molecules(f).select("molecule_id", F.expr("n DIV 2").alias("acceptor_bleach"), F.expr("n - n DIV 8").alias("donor_bleach"))


@query(BASE + f""", h AS ({_BLEACH}), g AS (SELECT molecule_id, count(*) FILTER (frame >= s AND frame < db) AS c, avg(donor) FILTER (frame >= s AND frame < db) AS d, avg(acceptor) FILTER (frame >= s AND frame < db) AS a FROM f JOIN h USING (molecule_id) GROUP BY 1)
SELECT molecule_id, round(CASE WHEN c >= 20 AND d > 0 AND a / d BETWEEN 0 AND 3 THEN a / d END, 9) AS alpha, CASE WHEN c < 20 THEN 'short tail' WHEN NOT coalesce(d > 0, false) THEN 'no donor' WHEN a / d < 0 OR a / d > 3 THEN 'out of range' ELSE 'ok' END AS reason FROM g""")
def a18_leakage(spark, sf):
    f = proxy.frames(spark, sf)
    return rounded(corrections.leakage(f, _bleach(f), ceiling=3.0), "alpha")


@query(BASE + f""", h AS ({_BLEACH}), x AS (SELECT *, acceptor - 0.1 * donor AS ac FROM f JOIN h USING (molecule_id)),
g AS (SELECT molecule_id, s, db, avg(ac) FILTER (frame >= s - 3 AND frame < s) - avg(ac) FILTER (frame >= s AND frame < least(s + 3, db)) AS num, avg(donor) FILTER (frame >= s AND frame < least(s + 3, db)) - avg(donor) FILTER (frame >= s - 3 AND frame < s) AS den FROM x GROUP BY 1, 2, 3)
SELECT molecule_id, round(CASE WHEN den <> 0 AND s > 20 AND db - s > 20 AND num / den > 0 AND num / den <= 5 THEN num / den END, 9) AS gamma FROM g""")
def a19_gamma(spark, sf):
    f = proxy.frames(spark, sf)
    return rounded(corrections.gamma(f, _bleach(f), 0.1), "gamma")


@query(BASE + "SELECT count(*) AS n, round(median(v), 9) AS factor FROM (SELECT avg(e) AS v FROM e GROUP BY molecule_id)")
def a18_dataset_median(spark, sf):
    e = proxy.efficiencies(spark, sf).groupBy("molecule_id").agg(F.avg("e").alias("v"))
    return rounded(corrections.dataset_factor(e, "v"), "factor")


_SCORES = BASE + """, px AS (SELECT molecule_id, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY molecule_id) AS n, sum(x) OVER w AS s, sum(x * x) OVER w AS q, sum(x * x) OVER (PARTITION BY molecule_id) AS al, x FROM (SELECT molecule_id, frame, acceptor AS x FROM f) WINDOW w AS (PARTITION BY molecule_id ORDER BY frame)),
pk AS (SELECT molecule_id, n, t, (CASE WHEN t = n - 1 THEN n ELSE t END)::DOUBLE AS k, CASE WHEN t = n - 1 THEN s ELSE s - x END AS ks, CASE WHEN t = n - 1 THEN q ELSE q - x * x END AS kq, al FROM px),
sc AS (SELECT molecule_id, n, t, CASE WHEN k > 0 THEN lgamma(1 + k / 2) - lgamma(1::DOUBLE) - (1 + k / 2) * ln(1 + greatest(kq - ks * ks / k, 0) / 2 + k * pow(ks / k - 1000, 2) / (2 * (1 + k))) - 0.5 * ln(1 + k) - k / 2 * ln(2 * pi()) ELSE 0 END
 + CASE WHEN n > k THEN lgamma(1 + (n - k) / 2) - lgamma(1::DOUBLE) - (1 + (n - k) / 2) * ln(1 + greatest(al - kq, 0) / 2) - (n - k) / 2 * ln(2 * pi()) ELSE 0 END AS score FROM pk)
"""


@query(_SCORES.replace("acceptor AS x", "20 * acceptor AS x") + "SELECT molecule_id, (CASE WHEN n < 2 OR t = n - 1 THEN n ELSE t END)::INTEGER AS bleach FROM sc QUALIFY row_number() OVER (PARTITION BY molecule_id ORDER BY score DESC, t) = 1")
def i3_photobleach(spark, sf):
    return corrections.photobleach(proxy.frames(spark, sf).select("molecule_id", "frame", (20 * F.col("acceptor")).alias("value")))


@query(_SCORES + """, ft AS (SELECT molecule_id, trunc(sum(exp(score - top) * t) / sum(exp(score - top))) AS v FROM (SELECT *, max(score) OVER (PARTITION BY molecule_id) AS top FROM sc) GROUP BY 1), rt AS (SELECT (1.0 + count(*)) / (1.0 + sum(v)) AS r FROM ft)
SELECT molecule_id, (CASE WHEN n < 2 OR t = n - 1 THEN n ELSE t END)::INTEGER AS bleach, round(r, 9) AS rate FROM sc CROSS JOIN rt QUALIFY row_number() OVER (PARTITION BY molecule_id ORDER BY score + ln(r) - r * t DESC, t) = 1""")
def i3_ensemble_photobleach(spark, sf):
    f = proxy.frames(spark, sf)
    return rounded(corrections.ensemble_photobleach(f.withColumn("value", F.col("acceptor"))), "rate")


@query(BASE + ", h AS (SELECT condition_id, count(*) FILTER (label <> 0) AS c FROM m GROUP BY 1) SELECT molecule_id, round(CASE WHEN label <> 0 THEN 1.0 ELSE 0.3 / (1 + c) END, 9) AS weight FROM m JOIN h USING (condition_id)")
def f12_label_weights(spark, sf):
    return rounded(curation.weights(proxy.molecules(proxy.frames(spark, sf))), "weight")


@query(BASE + "SELECT movie_id, count(*) AS n, CAST(list_sort(list(molecule_id)) AS VARCHAR) AS keys FROM m GROUP BY 1")
def a25_movie_roll_up(spark, sf):
    r = curation.roll_up(proxy.molecules(proxy.frames(spark, sf)), "movie_id")
    return r.withColumn("keys", F.concat(F.lit("["), F.concat_ws(", ", F.col("keys").cast("array<string>")), F.lit("]")))


@query(BASE + "SELECT molecule_id FROM m WHERE condition_id IN (1, 3) AND molecule_id % 11 <> 0")
def j2_live_query(spark, sf):
    m = proxy.molecules(proxy.frames(spark, sf))
    stored = m.select("molecule_id", F.col("molecule_id").alias("molecule_key"), F.lit("a").alias("hash"))
    now = m.select("molecule_id", F.when(F.col("molecule_id") % 11 == 0, "b").otherwise("a").alias("hash"))
    live = select.live_keys(stored, now).withColumnRenamed("molecule_key", "molecule_id")
    return select.query_molecules(m, condition_ids=[1, 3]).join(live, "molecule_id", "left_semi").select("molecule_id")


def _points(spark, sf):
    v = proxy.table(spark, sf, "embeddings")
    return v.select(F.col("label").alias("group_id"), F.col("vec_id").alias("id"), (F.col("embedding")[0].cast("double") * 100).alias("x"), (F.col("embedding")[1].cast("double") * 100).alias("y"))


_PTS = "WITH p AS (SELECT label AS g, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings), d AS (SELECT a.g, a.id, b.id AS other, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.g = b.g AND a.id <> b.id)"


@query(_PTS + " SELECT id, neighbour, round(dd, 6) AS distance, dd < 6 AS overlaps FROM (SELECT id, other AS neighbour, d AS dd, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM d) WHERE k = 1")
def j8_nearest(spark, sf):
    return rounded(spatial.nearest(_points(spark, sf)), "distance", digits=6)


@query(_PTS + """, h AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.g = b.g AND a.id % 2 = 0 AND b.id % 2 = 1)
SELECT a, b, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS ka, row_number() OVER (PARTITION BY b ORDER BY d, a) AS kb FROM h) WHERE ka = 1 AND kb = 1 AND d <= 2""")
def j10_mutual_pairs(spark, sf):
    p = _points(spark, sf)
    return rounded(spatial.mutual_pairs(p.filter("id % 2 = 0"), p.filter("id % 2 = 1")), "distance", digits=6)


@query("""WITH s AS (SELECT event_id AS id, value FROM events WHERE event_type = 'view'), c AS (SELECT value FROM events WHERE event_type = 'click'),
u AS (SELECT value AS x, 1.0 / (SELECT count(*) FROM s) AS a, 0.0 AS b FROM s UNION ALL SELECT value, 0.0, 1.0 / (SELECT count(*) FROM c) FROM c), g AS (SELECT x, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (SELECT x, a::DOUBLE AS a, b::DOUBLE AS b FROM u) GROUP BY x)
SELECT round(max(abs(v)), 9) AS d FROM (SELECT sum(a - b) OVER (ORDER BY x) AS v FROM g)""")
def a31_ks_statistic(spark, sf):
    e = proxy.table(spark, sf, "events").filter("event_type IN ('view', 'click')")
    return rounded(curation.ks_statistic(e.select(F.when(F.col("event_type") == "view", 0).otherwise(1).alias("side"), F.col("value").alias("x"))), "d")


def _scores(spark, sf):
    return proxy.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.pmod(F.col("doc_id") * 37, F.lit(101)) / 100.0).alias("score"), (F.col("quality") == 1).alias("good"))


@query("SELECT doc_id AS id, round((doc_id * 37 % 101) / 100.0, 9) AS score, row_number() OVER (ORDER BY (doc_id * 37 % 101) DESC, doc_id) AS rank FROM labels")
def t1_ranking(spark, sf):
    return rounded(curation.ranked(_scores(spark, sf).select("id", "score")), "score")


@query("SELECT round(avg(quality), 9) AS precision FROM (SELECT quality FROM labels ORDER BY (doc_id * 37 % 101) DESC, doc_id LIMIT 50)")
def a32_precision_at_k(spark, sf):
    s = _scores(spark, sf)
    return rounded(curation.precision_at_k(curation.ranked(s.select("id", "score")), s.select("id", "good"), 50), "precision")


@query("SELECT doc_id AS id, round(1 - abs(2 * (doc_id * 37 % 101) / 100.0 - 1), 9) AS info FROM labels WHERE toxic = 0 ORDER BY info DESC, id LIMIT 1")
def t3_next_to_label(spark, sf):
    s, done = _scores(spark, sf), proxy.table(spark, sf, "labels").filter("toxic <> 0").select(F.col("doc_id").alias("id"))
    return rounded(curation.next_to_label(s, done), "info").select("id", "info")


@query("SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT DISTINCT doc_id AS id, quality AS v FROM labels)")
def u1_merged_labels(spark, sf):
    log = proxy.table(spark, sf, "labels").select(F.col("doc_id").alias("event_seq"), F.col("doc_id").cast("string").alias("molecule_key"), F.lit("x").alias("labeler"), F.lit("t").alias("timestamp"), F.lit("f").alias("source_file"), F.lit("human").alias("source"), F.col("quality").alias("label_value"))
    merged = curation.merge_labels(log.filter("event_seq % 2 = 0"), log)
    return merged.agg(F.count("*").alias("n"), F.countDistinct("molecule_key").alias("ids"))


@query("SELECT vec_id AS id, sha256(concat_ws('|', 'movie', CAST(CAST(round(embedding[1]::DOUBLE / 0.1) AS BIGINT) AS VARCHAR), CAST(CAST(round(embedding[2]::DOUBLE / 0.1) AS BIGINT) AS VARCHAR))) AS key FROM embeddings")
def f4_molecule_key(spark, sf):
    v = proxy.table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("id"), scalar.molecule_key(F.lit("movie"), F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")).alias("key"))


@query(BASE + """, u AS (SELECT molecule_id, frame, CASE WHEN e IS NULL THEN -1 WHEN e < 0.3 THEN 0 WHEN e < 0.6 THEN 1 ELSE 2 END AS t, state AS r FROM p),
g AS (SELECT molecule_id, count(DISTINCT r) FILTER (r <> -1) AS nr, count(DISTINCT t) FILTER (t <> -1) AS nt, count(*) FILTER (r <> -1 AND t <> -1) AS f, count(*) FILTER (r <> -1 AND r = t) AS s FROM u GROUP BY 1)
SELECT round(avg((nr = nt)::INTEGER), 9) AS same_number, round(sum(s)::DOUBLE / sum(f), 9) AS same_state, sum(f)::BIGINT AS frames FROM g WHERE nr > 0 OR nt > 0""")
def a28_path_agreement(spark, sf):
    got = agreement.path_agreement(agreement.canonical(proxy.paths(spark, sf)), agreement.canonical(proxy.paths(spark, sf, 0.3, 0.6)))
    return rounded(got, "same_number", "same_state")


_CELLS = BASE + """, c AS (SELECT CAST(least(floor((t - 0.0) * 100 / 100.0), 99) AS INTEGER) AS tb, CAST(least(floor((e + 0.25) * 100 / 1.5), 99) AS INTEGER) AS bin, count(*) AS n FROM e WHERE e BETWEEN -0.25 AND 1.25 AND t BETWEEN 0 AND 100 GROUP BY 1, 2)"""


@query(_CELLS + " SELECT tb, bin, n FROM c")
def a15_cloud(spark, sf):
    return agreement.cloud(proxy.efficiencies(spark, sf))


_SURFACE = BASE + """, pt AS (SELECT t * 0.2::DOUBLE AS t, e FROM e WHERE e IS NOT NULL), ti AS (SELECT max(t) AS t1 FROM pt), gi AS (SELECT t, e FROM pt WHERE e BETWEEN -0.25 AND 1.25),
mo AS (SELECT count(*) AS n, var_samp(t) * pow(count(*), -1.0 / 3) AS tt, var_samp(e) * pow(count(*), -1.0 / 3) AS ee, covar_samp(t, e) * pow(count(*), -1.0 / 3) AS te FROM gi),
ds AS (SELECT t, e, count(*) AS c FROM gi GROUP BY 1, 2), gr AS (SELECT a.i AS tb, b.j AS bin, (a.i + 0.5) * t1 / 60 AS gt, -0.25 + (b.j + 0.5) * (1.5 / 50) AS ge FROM range(60) a(i) CROSS JOIN range(50) b(j) CROSS JOIN ti),
su AS (SELECT tb, bin, sum(c * exp(-0.5 * (ee * (gt - t) * (gt - t) - 2 * te * (gt - t) * (ge - e) + tt * (ge - e) * (ge - e)) / (tt * ee - te * te))) / any_value(n * 2 * pi() * sqrt(tt * ee - te * te)) AS density FROM gr CROSS JOIN ds CROSS JOIN mo GROUP BY 1, 2)
"""


def _surface(spark, sf):
    return agreement.density_surface(proxy.efficiencies(spark, sf), dt=0.2, time_bins=60, bins=50)


@query(_SURFACE + "SELECT tb::INTEGER AS tb, bin::INTEGER AS bin, round(density, 7) AS density FROM su")
def a15_density_surface(spark, sf):
    return rounded(_surface(spark, sf), "density", digits=7).drop("factor")


@query(_SURFACE + """, dn AS (SELECT density, sum(density) OVER (ORDER BY density DESC) / sum(density) OVER () AS share FROM su)
SELECT c.coverage::DOUBLE AS coverage, round(max(density), 7) AS level FROM dn CROSS JOIN (VALUES (0.5), (0.9)) c(coverage) WHERE share >= c.coverage - 1e-12 GROUP BY 1""")
def a16_surface_levels(spark, sf):
    return rounded(agreement.density_levels(_surface(spark, sf), "density", [0.5, 0.9]), "level", digits=7)


@query(BASE + "SELECT count(*) AS n_samples, count(*) FILTER (e NOT BETWEEN 0.1 AND 0.9 OR t * 0.2::DOUBLE > 8) AS n_out_of_range, count(DISTINCT molecule_id) AS n_molecules FROM e WHERE e IS NOT NULL")
def a15_cloud_totals(spark, sf):
    return agreement.cloud_totals(proxy.efficiencies(spark, sf), 0.2, 0.1, 0.9, (0.0, 8.0))


@query(_CELLS + """, g AS (SELECT n, sum(n) AS m FROM c GROUP BY 1), s AS (SELECT n, (sum(m) OVER (ORDER BY n DESC))::DOUBLE / (sum(m) OVER ()) AS share FROM g)
SELECT k.coverage::DOUBLE AS coverage, max(n)::BIGINT AS level FROM s JOIN (VALUES (0.5), (0.95)) k(coverage) ON share >= k.coverage - 1e-12 GROUP BY 1""")
def a16_density_levels(spark, sf):
    return agreement.density_levels(agreement.cloud(proxy.efficiencies(spark, sf)), "n", [0.5, 0.95])


@query()
def a3_bootstrap(spark, sf):
    return rounded(agreement.bootstrap_histogram(proxy.efficiencies(spark, sf)), "low", "high", "spread")


_LAGS = """, x AS (SELECT molecule_id, frame, list(donor) OVER w AS ds, list(acceptor) OVER w AS ac, count(*) OVER w AS c, avg(donor) OVER w AS md, avg(acceptor) OVER w AS ma, stddev_pop(donor) OVER w * stddev_pop(acceptor) OVER w AS sd, corr(donor, acceptor) OVER w AS lag0
FROM e WINDOW w AS (PARTITION BY molecule_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING)),
y AS (SELECT molecule_id, frame AS start, lag0, abs(list_sum(list_transform(range(2, 16), lambda i: (ds[i] - md) * (ac[i - 1] - ma))) / (15 * sd)) AS lag1 FROM x WHERE c = 15 AND sd > 0)"""


@query(BASE + _LAGS + """, h AS (SELECT *, start - row_number() OVER (PARTITION BY molecule_id ORDER BY start) AS g FROM y WHERE lag0 < 0 AND lag1 >= 0.5)
SELECT molecule_id, min(start)::BIGINT AS start, (max(start) + 15)::BIGINT AS stop, count(*) AS windows, (arg_min(start, lag0) + 7)::BIGINT AS peak_frame, round(min(lag0), 6) AS peak, round(avg(lag0), 6) AS mean FROM h GROUP BY molecule_id, g""")
def w4_anticorrelation_events(spark, sf):
    got = rounded(agreement.anticorrelation(proxy.efficiencies(spark, sf)), "peak", "mean", digits=6)
    return got.withColumns({c: F.col(c).cast("long") for c in ("start", "stop", "peak_frame")})


_FACTORS = "(SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'inf'::DOUBLE ELSE doc_id % 40 / 100.0::DOUBLE END AS alpha, CASE WHEN doc_id % 5 = 0 THEN 'nan'::DOUBLE WHEN doc_id % 13 = 0 THEN -1.0 ELSE doc_id % 60 / 10.0::DOUBLE END AS gamma FROM labels)"


def _factors(spark, sf):
    i = F.col("doc_id")
    alpha = F.when(i % 11 == 0, float("inf")).otherwise(i % 40 / 100.0)
    return proxy.table(spark, sf, "labels").select(i.alias("molecule_id"), F.when(i % 7 != 0, alpha).alias("alpha"), F.when(i % 5 == 0, float("nan")).when(i % 13 == 0, -1.0).otherwise(i % 60 / 10.0).alias("gamma"))


@query(f"SELECT id AS molecule_id, CASE WHEN isfinite(alpha) AND isfinite(gamma) AND gamma > 0 THEN 'corrected' ELSE 'apparent-E (corrections unavailable)' END AS method, (alpha IS NOT NULL AND isfinite(alpha) AND isfinite(gamma) AND gamma > 0)::INTEGER::DOUBLE AS confidence FROM {_FACTORS}")
def a20_chosen_methods(spark, sf):
    return corrections.chosen_methods(_factors(spark, sf)).select("molecule_id", "method", "confidence")


@query(f"SELECT count(*) AS n_molecules, 0::BIGINT AS n_corrected, count(*) FILTER (isfinite(alpha)) AS n_manual, count(*) FILTER (alpha IS NULL OR NOT isfinite(alpha)) AS n_apparent, FALSE AS total_failure FROM {_FACTORS}")
def a20_manual_totals(spark, sf):
    """A manual gamma makes up for the missing ones, not for missing leakage."""
    return corrections.method_totals(corrections.chosen_methods(_factors(spark, sf), gamma=1.5))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 AND (doc_id % 40) / 100.0 <= 0.3 AND doc_id % 7 BETWEEN 1 AND 5 THEN 'corrected' ELSE 'apparent' END AS method FROM labels")
def a20_correction_methods(spark, sf):
    i = F.col("doc_id")
    m = proxy.table(spark, sf, "labels").select(i.alias("molecule_id"), F.when(i % 5 != 0, (i % 40) / 100.0).alias("alpha"), (i % 7).cast("double").alias("gamma"))
    return corrections.methods(m).withColumnRenamed("molecule_id", "id")


@query("SELECT t::BIGINT AS t, round(0.7 * exp(-0.2 * t), 9) AS single, round(0.6 * exp(-0.5 * t) + 0.4 * exp(-0.05 * t), 9) AS double, round(0.9 * exp(-pow(0.1 * t, 0.6)), 9) AS stretched FROM range(50) g(t)")
def f11_survival_forms(spark, sf):
    t = F.col("id")
    return rounded(spark.range(50).select(t.alias("t"), scalar.survival("single", t, 0.2, 0.7).alias("single"), scalar.survival("double", t, 0.5, 0.05, 0.6, 0.4).alias("double"), scalar.survival("stretched", t, 0.1, 0.6, 0.9).alias("stretched")), "single", "double", "stretched")


def _values(spark, sf):
    return proxy.efficiencies(spark, sf).select("molecule_id", "frame", F.col("e").alias("x"))


@query()
def i1_survival_fits(spark, sf):
    return rounded(kinetics.fit_survival(population.survival(population.dwells(proxy.paths(spark, sf)))), "value", "error", "half_width", "r2", digits=6)


@query()
def i4_state_paths(spark, sf):
    v = _values(spark, sf)
    return kinetics.viterbi(v, kinetics.fit_hmm(v))


@query()
def i6_level_curve(spark, sf):
    return rounded(kinetics.level_curve(_values(spark, sf)), "rmse", digits=6)


@query("""WITH v AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM v),
z AS (SELECT id, (a - ma) / sa AS a, (b - mb) / sb AS b FROM v CROSS JOIN s), q AS (SELECT * FROM z WHERE id IN (1, 7))
SELECT z.id, round(min(sqrt((z.a - q.a) * (z.a - q.a) + (z.b - q.b) * (z.b - q.b))), 7) AS distance FROM z CROSS JOIN q WHERE z.id NOT IN (1, 7) GROUP BY 1""")
def j14_similar(spark, sf):
    v = proxy.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return rounded(spatial.similar(v, ["a", "b"], [1, 7]), "distance", digits=7)
