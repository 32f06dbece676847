"""Registered queries of the stored-table operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import state_of
from ..operators import agreement, curation, population, ranking, select, stored
from . import proxy
from .queries import BASE, BIN, query, rounded

MEANS = (0.2, 0.55, 0.85)
_LEVEL = "CASE state WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.55::DOUBLE WHEN 2 THEN 0.85::DOUBLE END"
#: Fitted paths of which every eleventh molecule's hash has changed since.
_FIT = BASE + f", fit AS (SELECT molecule_id, frame, state, {_LEVEL} AS v FROM p WHERE molecule_id % 11 <> 0), "


def _levels(spark, sf):
    p = proxy.paths(spark, sf).withColumn("hash", F.lit("a"))
    now = p.select("molecule_id").distinct().withColumn("hash", F.when(F.col("molecule_id") % 11 == 0, "b").otherwise("a"))
    return stored.fitted_levels(p, proxy.molecules(proxy.frames(spark, sf)), MEANS, now)


@query(_FIT.rstrip(", ") + " SELECT molecule_id, count(*) AS frames, count(v) AS assigned, round(sum(v), 9) AS total FROM fit GROUP BY 1")
def j1_fitted_levels(spark, sf):
    got = _levels(spark, sf).groupBy("molecule_id").agg(F.count("*").alias("frames"), F.count("level").alias("assigned"), F.sum("level").alias("total"))
    return rounded(got, "total")


_PAIRS = _FIT + "l AS (SELECT molecule_id, v AS i, lead(v) OVER w AS b, lead(v, 2) OVER w AS j FROM fit WINDOW w AS (PARTITION BY molecule_id ORDER BY frame)), t AS (SELECT * FROM l WHERE i IS NOT NULL AND j IS NOT NULL AND b <> i)"


_BIN101 = BIN.replace("151", "101").replace("150", "100")


@query(_PAIRS + f""", g AS (SELECT {_BIN101.replace('(e ', '(i ')} AS initial_bin, {_BIN101.replace('(e ', '(j ')} AS final_bin, count(*) AS n FROM t WHERE i BETWEEN -0.25 AND 1.25 AND j BETWEEN -0.25 AND 1.25 GROUP BY 1, 2)
SELECT CAST(a.b AS INTEGER) AS initial_bin, CAST(z.b AS INTEGER) AS final_bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / ((SELECT sum(n) FROM g) * (1.5 / 101) * (1.5 / 101)), 6) AS density FROM range(101) a(b) CROSS JOIN range(101) z(b) LEFT JOIN g ON initial_bin = a.b AND final_bin = z.b""")
def a8_level_bins(spark, sf):
    return rounded(stored.transition_bins(stored.level_transitions(_levels(spark, sf))), "density", digits=6)


@query(_PAIRS + " SELECT count(*) AS n_transitions, count(DISTINCT molecule_id) AS n_molecules, count(*) FILTER (NOT (i BETWEEN 0.3 AND 1.25 AND j BETWEEN 0.3 AND 1.25)) AS n_outside FROM t")
def a8_level_totals(spark, sf):
    return stored.transition_totals(stored.level_transitions(_levels(spark, sf)), 0.3)


@query(BASE + "SELECT molecule_id, first AS first, last AS last, last - first + 1 AS n FROM (SELECT molecule_id, min(frame) FILTER (state <> -1)::BIGINT AS first, max(frame) FILTER (state <> -1)::BIGINT AS last FROM p GROUP BY 1) WHERE first IS NOT NULL")
def p3_trimmed_paths(spark, sf):
    t = select.trimmed(proxy.paths(spark, sf)).groupBy("molecule_id")
    return t.agg(F.min("frame").cast("long").alias("first"), F.max("frame").cast("long").alias("last"), F.count("*").alias("n"))


@query(BASE + ", d2 AS (SELECT CASE WHEN e IS NULL THEN -1 WHEN abs(e - 0.2) <= abs(e - 0.55) AND abs(e - 0.2) <= abs(e - 0.85) THEN 0 WHEN abs(e - 0.55) <= abs(e - 0.85) THEN 1 ELSE 2 END AS state FROM e) SELECT state, count(*) AS n FROM d2 GROUP BY 1")
def f9_nearest_states(spark, sf):
    return proxy.efficiencies(spark, sf).select(stored.nearest_state(F.col("e"), MEANS).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query(BASE + """, k AS (SELECT molecule_id, count(DISTINCT state) AS states FROM p WHERE state <> -1 GROUP BY 1), c AS (SELECT states, count(*) AS n FROM k GROUP BY 1)
SELECT g.states::BIGINT AS states, coalesce(n, 0) AS n, (SELECT coalesce(sum(n), 0)::BIGINT FROM c WHERE states > 2) AS outside FROM range(1, 3) g(states) LEFT JOIN c ON c.states = g.states""")
def a10_state_tally(spark, sf):
    return stored.state_tally(proxy.paths(spark, sf), 1, 2)


@query(BASE + """, v AS (SELECT CASE WHEN count(*) FILTER (state = 0 AND s1 <> -1) > 0 THEN count(*) FILTER (state = 0 AND s1 = 1)::DOUBLE / count(*) FILTER (state = 0 AND s1 <> -1) END AS p FROM nx GROUP BY molecule_id),
h AS (SELECT CAST(least(floor(p * 20 / 1.0), 19) AS INTEGER) AS bin, count(*) AS n FROM v WHERE p IS NOT NULL GROUP BY 1)
SELECT g.bin::INTEGER AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) * 20.0 / (SELECT sum(n) FROM h), 9)::DOUBLE AS density FROM range(20) g(bin) LEFT JOIN h ON h.bin = g.bin""")
def a9_probability_histogram(spark, sf):
    return rounded(stored.probability_histogram(population.transition_probability(proxy.paths(spark, sf), 0, 1)), "density")


@query(BASE + "SELECT condition_id, CAST(list(molecule_id ORDER BY n, molecule_id) AS VARCHAR) AS keys FROM m GROUP BY 1")
def a24_condition_keys(spark, sf):
    m = proxy.molecules(proxy.frames(spark, sf)).withColumn("ord", F.struct("n", "molecule_id"))
    k = stored.keys_by(m, "condition_id", "molecule_id", "ord")
    return k.withColumn("keys", F.concat(F.lit("["), F.concat_ws(", ", F.col("keys").cast("array<string>")), F.lit("]")))


@query("SELECT user_id, min(event_id) AS first FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def a25_first_seen(spark, sf):
    return stored.first_seen(proxy.table(spark, sf, "events"), "user_id", "event_id")


def _log(spark, sf):
    """Label events: several for each key, of people, of both seeds and of a program, some of them twice, some without a file."""
    e = proxy.table(spark, sf, "events")
    u, i = F.col("user_id"), F.col("event_id")
    source = F.when(i % 10 == 0, "model").when(i % 10 == 5, "deeplasi-provisional").when(i % 10 == 3, "cross-condition-seed").otherwise("human")
    return e.select(
        i.alias("event_seq"), u.cast("string").alias("molecule_key"), F.concat(F.lit("p"), (i % 3).cast("string")).alias("labeler"), (i % 4).cast("string").alias("timestamp"),
        F.when(i % 4 != 1, "f").alias("source_file"), source.alias("source"), (i % 3 - 1).cast("int").alias("label_value"), F.lit(None).cast("long").alias("condition_id"),
    )


_LOG = """WITH log AS (SELECT event_id AS event_seq, CAST(user_id AS VARCHAR) AS molecule_key, 'p' || (event_id % 3) AS labeler, CAST(event_id % 4 AS VARCHAR) AS timestamp, CASE WHEN event_id % 4 <> 1 THEN 'f' END AS source_file,
 CASE event_id % 10 WHEN 0 THEN 'model' WHEN 5 THEN 'deeplasi-provisional' WHEN 3 THEN 'cross-condition-seed' ELSE 'human' END AS source, CAST(event_id % 3 - 1 AS INTEGER) AS label_value, user_id FROM events)"""


@query(_LOG + " SELECT molecule_key, label_value FROM (SELECT molecule_key, arg_max(label_value, event_seq) AS label_value FROM log WHERE source IN ('deeplasi-provisional', 'cross-condition-seed') GROUP BY 1) WHERE label_value <> 0")
def p15_provisional_labels(spark, sf):
    return stored.provisional_labels(_log(spark, sf))


@query(_LOG + " SELECT molecule_key, label_value FROM (SELECT molecule_key, arg_max(label_value, event_seq) AS label_value FROM log WHERE source = 'human' GROUP BY 1) WHERE label_value = -1")
def s5_rejected_keys(spark, sf):
    return curation.current_labels(_log(spark, sf)).filter("label_value = -1")


@query(BASE + """, t AS (SELECT molecule_id, round(avg(donor + acceptor), 6) AS total_intensity FROM e GROUP BY 1), c AS (SELECT user_id, arg_max(CAST(event_id % 3 - 1 AS INTEGER), event_id) AS v FROM events WHERE event_id % 10 NOT IN (0, 3, 5) GROUP BY 1)
SELECT molecule_id, total_intensity, v AS label_value FROM t JOIN c ON user_id = molecule_id WHERE v <> 0""")
def j6_ranking_dataset(spark, sf):
    x = population.trace_features(proxy.efficiencies(spark, sf)).select("molecule_id", "total_intensity")
    return rounded(ranking.ranking_data(x, _log(spark, sf)), "total_intensity", digits=6)


def _merged(spark, sf):
    """The merge of two logs, and the owner's rows: every sixth key has two, whose labels differ."""
    log = _log(spark, sf)
    k = F.col("molecule_key").cast("long")
    own = log.select(k.alias("k"), "molecule_key").distinct().filter("k % 9 <> 0")
    label = lambda c: F.when(c % 3 == 0, 1).when(c % 3 == 1, 0).otherwise(-1)
    rows = own.select("molecule_key", (F.col("k") % 5).alias("condition_id"), label(F.col("k")).alias("label"), F.col("k").alias("store_ord"))
    rows = rows.unionByName(own.filter("k % 8 = 0").select("molecule_key", F.lit(77).cast("long").alias("condition_id"), F.lit(1).alias("label"), (F.col("k") + 10**6).alias("store_ord")))
    rows = rows.unionByName(own.filter("k % 6 = 5").select("molecule_key", (F.col("k") % 5).alias("condition_id"), label(F.col("k") + 1).alias("label"), (-F.col("k")).alias("store_ord")))
    return stored.label_merge(log.filter("event_seq % 2 = 0"), log.filter("event_seq % 3 <> 0"), rows), rows.filter(k % 8 != 0)


_MERGE = _LOG + """, had AS (SELECT DISTINCT molecule_key, labeler, timestamp, source_file, source, label_value FROM log WHERE event_seq % 2 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY molecule_key, labeler, timestamp, source_file, source, label_value ORDER BY event_seq) AS k FROM log WHERE event_seq % 3 <> 0),
z AS (SELECT event_seq, molecule_key, user_id, label_value, CASE WHEN source <> 'human' THEN 'skipped' WHEN user_id % 9 = 0 THEN 'unmatched' WHEN user_id % 8 = 0 THEN 'ambiguous'
 WHEN k > 1 OR EXISTS (SELECT 1 FROM had h WHERE h.molecule_key = o.molecule_key AND h.labeler = o.labeler AND h.timestamp = o.timestamp AND h.source_file IS NOT DISTINCT FROM o.source_file AND h.source = o.source AND h.label_value = o.label_value) THEN 'duplicate' ELSE 'appended' END AS outcome FROM o)"""


@query(_MERGE + " SELECT event_seq, outcome, CASE WHEN outcome = 'appended' THEN user_id % 5 END AS condition_id FROM z")
def u1_merge_outcomes(spark, sf):
    return _merged(spark, sf)[0].select("event_seq", "outcome", "condition_id")


# the first row in store order of a key with two is the one whose label is that of the next number
@query(_MERGE + """, l AS (SELECT molecule_key, any_value(user_id) AS u, arg_max(label_value, event_seq) AS decision FROM z WHERE outcome IN ('appended', 'duplicate') GROUP BY 1),
w AS (SELECT *, CASE (CASE WHEN u % 6 = 5 THEN u + 1 ELSE u END) % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE -1 END AS own FROM l WHERE decision <> 0)
SELECT molecule_key, decision, CASE WHEN own = 0 THEN 'adopted' WHEN own = decision THEN 'agreement' ELSE 'conflict' END AS verdict FROM w""")
def j5_label_verdicts(spark, sf):
    return stored.label_verdicts(*_merged(spark, sf))


def _amount(k):
    """Amounts of all magnitudes, most of them not whole."""
    return F.when(k % 3 == 0, F.concat((k % 997).cast("string"), F.lit("e"), (k % 31 - 12).cast("string")).cast("double") / 7)


def _condition_fields():
    k = F.col("p_partkey")
    return {"construct_variant": F.col("p_brand"), "dye": F.col("p_type"), "ligand": F.when(k % 3 == 0, "Mg").otherwise(""), "ligand_concentration": _amount(k), "temperature_c": F.when(k % 5 == 0, k / 8.0), "laser_power": -(k % 2).cast("double") * 0.0005}


_AMOUNT = "CAST((p_partkey % 997) || 'e' || (p_partkey % 31 - 12) AS DOUBLE) / 7"
_CANON = f"""'{{"construct":"' || p_brand || '","dye":"' || p_type || '","ligand":"' || CASE WHEN p_partkey % 3 = 0 THEN 'Mg' ELSE '' END || '","ligand_conc":' || CASE WHEN p_partkey % 3 = 0 THEN CAST({_AMOUNT} AS VARCHAR) ELSE 'null' END
 || ',"ligand_unit":"","buffer":"","temp_c":' || CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey / 8.0::DOUBLE AS VARCHAR) ELSE 'null' END || ',"laser":' || CAST(-(p_partkey % 2)::DOUBLE * 0.0005::DOUBLE AS VARCHAR) || '}}'"""


@query(f"SELECT p_partkey, {_CANON} AS canonical, 'cond-' || substr(sha256({_CANON}), 1, 12) AS condition_id FROM part")
def f7_condition_ids(spark, sf):
    t = proxy.table(spark, sf, "part").select("p_partkey", stored.canonical_condition(_condition_fields()).alias("canonical"))
    return t.withColumn("condition_id", stored.condition_id(F.col("canonical")))


@query("SELECT p_partkey, p_brand AS construct, CASE WHEN p_partkey % 3 = 0 THEN " + _AMOUNT + " END AS amount, CASE WHEN p_partkey % 5 = 0 THEN p_partkey / 8.0::DOUBLE END AS degrees FROM part")
def f7_condition_fields(spark, sf):
    """The fields read back from the canonical text are what it was made of. The table is a small file and each row's text much work, so rows are dealt out first."""
    k = proxy.table(spark, sf, "part").repartition("p_partkey").select("p_partkey", stored.condition_key(stored.canonical_condition(_condition_fields())).alias("k"))
    return k.select("p_partkey", F.col("k.construct_variant").alias("construct"), F.col("k.ligand_concentration").alias("amount"), F.col("k.temperature_c").alias("degrees"))


@query("SELECT p_partkey FROM part WHERE p_partkey % 13 = 0 AND p_type <> p_type || 'x'")
def j3_inconsistent_conditions(spark, sf):
    t = proxy.table(spark, sf, "part")
    t = t.withColumns({n: c for n, c in _condition_fields().items()}).withColumn("condition_id", stored.condition_id(stored.canonical_condition(_condition_fields())))
    edited = t.withColumn("dye", F.when(F.col("p_partkey") % 13 == 0, F.concat("dye", F.lit("x"))).otherwise(F.col("dye")))
    return stored.inconsistent_conditions(edited).select("p_partkey")


_FILE = """WITH x AS (SELECT p_partkey AS k, p_size AS s, CASE WHEN p_partkey % 3 = 0 OR p_size % 7 = 0 THEN p_size + 1 ELSE p_size END AS said FROM part WHERE p_partkey % 11 <> 0 AND p_size >= 5),
y AS (SELECT k, s, said, 'c' || said || '_Mg_' || said || 'nM_0' || (k % 10) || '.tif' AS f, 'cond-' || substr(sha256('{"construct":"c' || s || '","dye":"","ligand":"Mg","ligand_conc":' || s || '.0,"ligand_unit":"nM","buffer":"","temp_c":null,"laser":null}'), 1, 12) AS condition_id FROM x)"""


@query(_FILE + " SELECT condition_id, arg_min(f, k) FILTER (s = said) AS source_filename, any_value('c' || s) FILTER (s = said) AS construct_variant, any_value(s::DOUBLE) FILTER (s = said) AS ligand_concentration FROM y GROUP BY 1")
def j4_new_conditions(spark, sf):
    """Names of acquisitions, of which every third (and all of some conditions) say another condition than the stored one."""
    k, s = F.col("p_partkey"), F.col("p_size")
    key = lambda n: stored.condition_id(stored.canonical_condition({"construct_variant": F.concat(F.lit("c"), n), "ligand": F.lit("Mg"), "ligand_concentration": n.cast("double"), "ligand_concentration_unit": F.lit("nM")}))
    said = F.when((k % 3 == 0) | (s % 7 == 0), s + 1).otherwise(s)
    name = F.concat(F.lit("c"), said, F.lit("_Mg_"), said, F.lit("nM_0"), k % 10, F.lit(".tif"))
    m = proxy.table(spark, sf, "part").select(F.when(k % 11 == 0, "").otherwise(key(s)).alias("condition_id"), name.alias("source_filename"), k.alias("store_ord"))
    return stored.new_conditions(m, spark.range(5).select(key(F.col("id")).alias("condition_id"))).select("condition_id", "source_filename", "construct_variant", "ligand_concentration")


@query("""WITH o AS (SELECT o_custkey, CAST(o_orderkey % 6 + 1 AS INTEGER) AS nstates, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE ELSE -(o_orderkey % 50)::DOUBLE END AS elbo FROM orders),
s AS (SELECT *, CASE WHEN isfinite(elbo) THEN elbo ELSE '-inf'::DOUBLE END AS score FROM o)
SELECT o_custkey, nstates, CASE WHEN isfinite(elbo) THEN elbo END AS elbo FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, nstates) = 1""")
def t7_best_model(spark, sf):
    k = F.col("o_orderkey")
    elbo = F.when(k % 7 == 1, float("nan")).when(k % 7 == 2, float("inf")).when(k % 7 != 0, -(k % 50).cast("double"))
    best = stored.best_by_elbo(proxy.table(spark, sf, "orders").select("o_custkey", (k % 6 + 1).cast("int").alias("nstates"), elbo.alias("elbo")), ["o_custkey"])
    fine = ~F.isnan("elbo") & (F.abs("elbo") != float("inf"))
    return best.withColumn("elbo", F.when(fine, F.col("elbo")))


@query(BASE + """, pu AS (SELECT molecule_id, state AS r, CASE WHEN e IS NULL THEN -1 WHEN e < 0.26 THEN 0 WHEN e < 0.51 THEN 1 ELSE 2 END AS t FROM p),
pg AS (SELECT count(DISTINCT r) FILTER (r <> -1) AS a, count(DISTINCT t) FILTER (t <> -1) AS b, count(*) FILTER (r <> -1 AND t <> -1) AS f, count(*) FILTER (r <> -1 AND r = t) AS s FROM pu GROUP BY molecule_id),
pq AS (SELECT count(*) FILTER (a = b AND (a > 0 OR b > 0))::DOUBLE / count(*) FILTER (a > 0 OR b > 0) AS c, sum(s)::DOUBLE / sum(f) AS v FROM pg)
SELECT round(c, 9) AS state_count_fraction, 0.01::DOUBLE AS state_mean_abs_delta, round(v, 9) AS viterbi_agreement, 0.005::DOUBLE AS relative_elbo, c >= 0.95 AND v >= 0.95 AS passes FROM pq""")
def a28_model_parity(spark, sf):
    p = proxy.paths(spark, sf).select("molecule_id", F.col("state").alias("ref"), state_of(F.col("e"), 0.26, 0.51).alias("test"))
    got = stored.model_parity(p, [0.2, 0.55, 0.85], [0.21, 0.55, 0.85], -1000.0, -1005.0)
    return rounded(got, "state_count_fraction", "state_mean_abs_delta", "viterbi_agreement", "relative_elbo")


@query("""WITH r AS (SELECT 0.9 + (p_partkey % 10) / 100.0 AS a, (p_partkey % 5) / 100.0 AS b, 0.97 + (p_partkey % 3) / 100.0 AS c, (p_partkey % 4) / 1000.0 AS d FROM part)
SELECT round(least(0.95, greatest(0, min(a) - 0.5 * (1 - min(a)))), 4)::DOUBLE AS state_count_fraction, round(greatest(0.02, max(b) * 1.5), 4)::DOUBLE AS state_mean_abs_delta, round(least(0.95, greatest(0, min(c) - 0.5 * (1 - min(c)))), 4)::DOUBLE AS viterbi_agreement, round(greatest(0.01, max(d) * 1.5), 4)::DOUBLE AS relative_elbo FROM r""")
def a29_frozen_bounds(spark, sf):
    return stored.frozen_bounds(_runs(spark, sf))


def _runs(spark, sf):
    k = F.col("p_partkey")
    return proxy.table(spark, sf, "part").select((0.9 + (k % 10) / 100.0).alias("state_count_fraction"), ((k % 5) / 100.0).alias("state_mean_abs_delta"), (0.97 + (k % 3) / 100.0).alias("viterbi_agreement"), ((k % 4) / 1000.0).alias("relative_elbo"), k.alias("k"))


@query("""WITH r AS (SELECT 0.9 + (p_partkey % 10) / 100.0 AS a, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 5) / 100.0 END AS b, 0.97 + (p_partkey % 3) / 100.0 AS c FROM part)
SELECT round(least(0.95, greatest(0, min(a) - 0.5 * (1 - min(a)))), 4)::DOUBLE AS state_count_fraction, 'inf'::DOUBLE AS state_mean_abs_delta, round(quantile_cont(b::DOUBLE, 0.95), 9) AS state_mean_abs_delta_p, round(quantile_cont(c::DOUBLE, 0.95), 9) AS viterbi_agreement_p FROM r""")
def a29_bounds_of_failed_runs(spark, sf):
    """A run without one measure makes that ceiling infinite; percentiles are those of the runs that have it."""
    runs = _runs(spark, sf).withColumn("state_mean_abs_delta", F.when(F.col("k") % 17 != 0, F.col("state_mean_abs_delta")))
    return rounded(stored.frozen_bounds(runs, percentile=95).select("state_count_fraction", "state_mean_abs_delta", "state_mean_abs_delta_p", "viterbi_agreement_p"), "state_mean_abs_delta_p", "viterbi_agreement_p")


_VIDEO = """WITH l AS (SELECT doc_id, doc_id % 4 AS movie, quality = 1 AS good, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY (doc_id * 37 % 101) DESC, doc_id) AS a, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS b FROM labels),
v AS (SELECT movie, avg(good::INTEGER) FILTER (a <= 20) AS p, avg(good::INTEGER) FILTER (b <= 20) AS q FROM l GROUP BY 1)"""


def _videos(spark, sf):
    t = proxy.table(spark, sf, "labels")
    i = F.col("doc_id")
    rank = curation.ranked(t.select(i.alias("id"), (F.pmod(i * 37, F.lit(101)) / 100.0).alias("score")))
    return stored.uplift(rank, t.select(i.alias("id"), i.alias("store_ord"), (i % 4).alias("movie")), t.select(i.alias("id"), (F.col("quality") == 1).alias("good")), 20, ["movie"])


@query(_VIDEO + " SELECT movie, round(p, 9) AS precision, round(q, 9) AS baseline, round(p - q, 9) AS uplift FROM v")
def a32_uplift(spark, sf):
    return rounded(_videos(spark, sf), "precision", "baseline", "uplift")


@query(_VIDEO + " SELECT count(*) AS videos, round(median(p - q) * 100, 7) AS median_points, median(p - q) * 100 >= 5 AS shipped FROM v")
def a35_ship_gate(spark, sf):
    return rounded(stored.ship_gate(_videos(spark, sf), 5.0), "median_points", digits=7)


_TRI = "SELECT vec_id AS id, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS ay, embedding[3]::DOUBLE AS bx, embedding[4]::DOUBLE AS bz, embedding[5]::DOUBLE AS cx, embedding[6]::DOUBLE AS cy FROM embeddings"


def _triangles(spark, sf):
    v = proxy.table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("id"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("ax", "ay", "bx", "by", "cx", "cy"))])


@query(f"SELECT round(sqrt(avg((ax - bx) * (ax - bx) + (ay - bz) * (ay - bz))), 9) AS rms FROM ({_TRI})")
def f15_point_rms(spark, sf):
    return rounded(stored.point_rms(_triangles(spark, sf)), "rms")


@query(f"SELECT id, round(sqrt((ax-bx)*(ax-bx)+(ay-bz)*(ay-bz)) * sqrt((bx-cx)*(bx-cx)+(bz-cy)*(bz-cy)) * sqrt((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)) / (2 * abs((bx-ax)*(cy-ay)-(cx-ax)*(bz-ay))), 6) AS radius FROM ({_TRI}) WHERE abs((bx-ax)*(cy-ay)-(cx-ax)*(bz-ay)) > 0.01")
def f18_circumradius(spark, sf):
    t, c = _triangles(spark, sf), F.col
    far = F.abs((c("bx") - c("ax")) * (c("cy") - c("ay")) - (c("cx") - c("ax")) * (c("by") - c("ay"))) > 0.01
    return rounded(t.filter(far).select("id", stored.circumradius(*[c(n) for n in ("ax", "ay", "bx", "by", "cx", "cy")]).alias("radius")), "radius", digits=6)


@query(BASE + ", x AS (SELECT molecule_id, frame, donor, acceptor, CASE WHEN max(donor + acceptor) OVER w > 0 THEN max(donor + acceptor) OVER w ELSE 1 END AS s, row_number() OVER (PARTITION BY molecule_id ORDER BY frame) - 1 AS slot FROM f WINDOW w AS (PARTITION BY molecule_id)) SELECT molecule_id, round(sum(donor / s), 7) AS donor, round(sum(acceptor / s), 7) AS acceptor, count(*) AS real, 60::BIGINT AS slots FROM x WHERE slot < 60 GROUP BY 1")
def f17_normalised_pairs(spark, sf):
    n = stored.normalised(proxy.frames(spark, sf), 60)
    got = n.groupBy("molecule_id").agg(F.sum("donor").alias("donor"), F.sum("acceptor").alias("acceptor"), F.count_if("real").alias("real"), F.count("*").alias("slots"))
    return rounded(got, "donor", "acceptor", digits=7)


@query(BASE + "SELECT molecule_id, count(*) AS n FROM f WHERE molecule_id IN (3, 5, 8) GROUP BY 1")
def p6_chosen_molecules(spark, sf):
    f = proxy.frames(spark, sf).withColumn("molecule_key", F.col("molecule_id").cast("string")).withColumn("label", F.lit(0))
    return stored.chosen(f, ["5", "3", "8", "5"]).groupBy("molecule_id").agg(F.count("*").alias("n"))


@query("SELECT event_type AS status, count(*) AS movies FROM events GROUP BY 1")
def a34_batch_summary(spark, sf):
    return proxy.table(spark, sf, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("movies"))
