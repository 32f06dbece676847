"""Registered queries of range joins, text tables and the lag feature, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import names
from ..operators import drift, matching, registration, select, spatial, stored, tracematch
from ..operators._tables import shared_dir
from ..sources import tables
from . import proxy
from .queries import _PTS, BASE, ORACLES, _points, query, rounded

_FORWARD = ([0.5, 1.0, 0.0, 0.001, 0.0, 0.0], [-0.25, 0.0, 1.0, 0.0, 0.0, 0.0])
_BACK = ([-0.5, 1.0, 0.0, 0.0, 0.0, 0.0], [0.25, 0.0, 1.0, 0.0, 0.0, 0.0])
_SHAPE = (128, 128)
_SIDES = "a AS (SELECT g, id, x + 64 AS x, y + 64 AS y FROM p WHERE id % 2 = 0), b AS (SELECT g, id, x + 64 AS x, y + 64 AS y FROM p WHERE id % 2 = 1)"


def _sides(spark, sf):
    p = _points(spark, sf).withColumns({"x": F.col("x") + 64, "y": F.col("y") + 64})
    return p.filter("id % 2 = 0"), p.filter("id % 2 = 1")


@query(_PTS + f""", {_SIDES}, k AS (SELECT g, id, x, y, 0.5::DOUBLE + x + 0.001::DOUBLE * x * y AS ax, y - 0.25::DOUBLE AS ay FROM a),
f AS (SELECT * FROM k WHERE round(x) >= 10 AND round(x) < 118 AND round(y) >= 10 AND round(y) < 118 AND round(ax) >= 10 AND round(ax) < 118 AND round(ay) >= 10 AND round(ay) < 118),
w AS (SELECT g, id, x - 0.5::DOUBLE AS x, y + 0.25::DOUBLE AS y FROM b),
n AS (SELECT f.id, w.id AS acceptor, row_number() OVER (PARTITION BY f.id ORDER BY sqrt((f.x - w.x) * (f.x - w.x) + (f.y - w.y) * (f.y - w.y)), w.id) AS k FROM f JOIN w ON f.g = w.g WHERE sqrt((f.x - w.x) * (f.x - w.x) + (f.y - w.y) * (f.y - w.y)) < 3)
SELECT f.id, round(ax, 6) AS acceptor_x, round(ay, 6) AS acceptor_y, acceptor FROM f LEFT JOIN n ON n.id = f.id AND k = 1""")
def j9_colocalised(spark, sf):
    a, b = _sides(spark, sf)
    return rounded(matching.colocalised(a, b, _FORWARD, _BACK, _SHAPE, _SHAPE), "acceptor_x", "acceptor_y", digits=6).select("id", "acceptor_x", "acceptor_y", "acceptor")


@query(_PTS + f""", {_SIDES} SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance FROM a JOIN b ON a.g = b.g
WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 2""")
def j11_near_pairs(spark, sf):
    return rounded(matching.near_pairs(*_sides(spark, sf), 2.0), "distance", digits=6)


# taking pairs one by one has no SQL; a test holds it against brute force
@query()
def a30_detection_scores(spark, sf):
    a, b = _sides(spark, sf)
    return matching.detection_scores(a, b, matching.one_to_one(matching.near_pairs(a, b, 2.0)))


_CELL = "CASE WHEN {0} IS NULL THEN '' ELSE CAST({0} AS VARCHAR) END"


@query(BASE + """, s AS (SELECT molecule_id, label, CASE WHEN w1 > w0 THEN w0 ELSE 0 END AS lo, CASE WHEN w1 > w0 THEN w1 ELSE n END AS hi FROM m),
x AS (SELECT s.molecule_id, CASE WHEN donor + acceptor <> 0 THEN acceptor / (donor + acceptor) END AS e FROM s JOIN f ON f.molecule_id = s.molecule_id AND frame >= lo AND frame < hi)
SELECT s.molecule_id, CASE label WHEN 1 THEN 'accept' WHEN 0 THEN 'uncurated' ELSE 'reject' END AS curation_label, lo::INTEGER AS window_start, hi::INTEGER AS window_end, count(e) AS n_finite_frames,
round(avg(e), 9) AS mean_apparent_e, round(median(e), 9) AS median_apparent_e FROM s LEFT JOIN x USING (molecule_id) GROUP BY 1, 2, 3, 4""")
def k3_molecule_summary(spark, sf):
    f = proxy.frames(spark, sf)
    got = rounded(tables.efficiency_summary(proxy.molecules(f), f), "mean_apparent_e", "median_apparent_e")
    return got.select("molecule_id", tables.label_text(F.col("label")).alias("curation_label"), "window_start", "window_end", "n_finite_frames", "mean_apparent_e", "median_apparent_e")


@query(BASE + """, c AS (SELECT molecule_id, frame, donor, acceptor, donor - avg(donor) OVER (PARTITION BY molecule_id) AS d0, acceptor - avg(acceptor) OVER (PARTITION BY molecule_id) AS a0 FROM e),
l AS (SELECT *, lag(a0) OVER (PARTITION BY molecule_id ORDER BY frame) AS before FROM c)
SELECT molecule_id, CASE WHEN count(*) > 1 AND count(donor) = count(*) AND count(acceptor) = count(*) AND max(donor) > min(donor) AND max(acceptor) > min(acceptor)
THEN round(abs(sum(d0 * before)) / (count(*) * stddev_pop(donor) * stddev_pop(acceptor)), 9) END AS anticorr_lag1 FROM l GROUP BY 1""")
def a22_lag1(spark, sf):
    return rounded(matching.lag1_magnitude(proxy.efficiencies(spark, sf)), "anticorr_lag1")


_ODD = """, o AS (SELECT g, id, CASE WHEN id % 17 = 0 THEN 'nan'::DOUBLE WHEN id % 19 = 0 THEN 500.0 WHEN id % 23 = 0 THEN id * 1000.0 ELSE x END AS x, CASE WHEN id % 19 = 0 THEN 500.0 ELSE y END AS y FROM p)"""


def _odd_points(spark, sf):
    """Points of which some have no position, some share one place and some lie far from all others."""
    i, x = F.col("id"), F.col("x")
    p = _points(spark, sf)
    return p.withColumns({"x": F.when(i % 17 == 0, float("nan")).when(i % 19 == 0, 500.0).when(i % 23 == 0, i * 1000.0).otherwise(x), "y": F.when((i % 19 == 0) & (i % 17 != 0), 500.0).otherwise(F.col("y"))})


@query(_PTS + _ODD + """, w AS (SELECT a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM o a JOIN o b ON a.g = b.g AND a.id <> b.id WHERE NOT isnan(a.x) AND NOT isnan(b.x) GROUP BY 1)
SELECT o.id, round(d, 6) AS neighbor_distance, CASE WHEN NOT isnan(x) THEN coalesce(d < 6, FALSE)::INTEGER::DOUBLE END AS aperture_overlap FROM o LEFT JOIN w ON w.id = o.id""")
def a23_spatial_features(spark, sf):
    return rounded(spatial.spatial_features(_odd_points(spark, sf)), "neighbor_distance", digits=6)


# taking points one by one has no SQL; a test holds it against brute force
@query()
def t5_suppressed(spark, sf):
    p = _points(spark, sf).withColumn("brightness", F.pmod(F.col("id") * 37, F.lit(50)).cast("double"))
    return spatial.suppressed(p, 4.0).select("group_id", "id", "brightness")


_POLY = "0.5::DOUBLE + 1.01::DOUBLE * x - 0.02::DOUBLE * y + 0.001::DOUBLE * x * y", "2.0::DOUBLE + 0.03::DOUBLE * x + 0.99::DOUBLE * y - 0.0005::DOUBLE * y * y"


def _control_points(spark, sf):
    """Points and where an exact map of degree two takes them; every seventh isn't a control point."""
    p, x, y = _points(spark, sf), F.col("x"), F.col("y")
    return p.select("group_id", "id", x.alias("ax"), y.alias("ay"), (0.5 + 1.01 * x - 0.02 * y + 0.001 * x * y).alias("bx"), (2.0 + 0.03 * x + 0.99 * y - 0.0005 * y * y).alias("by"))


@query(_PTS + f" SELECT id, round({_POLY[0]}, 6) AS bx, round({_POLY[1]}, 6) AS by FROM p WHERE id % 7 = 0")
def i19_mapped_points(spark, sf):
    """The points that weren't fitted, by the map fitted from the others of their group."""
    p = _control_points(spark, sf)
    maps = registration.fitted(p.filter("id % 7 <> 0"), ["group_id"])
    bx, by = registration.mapped(F.col("ax"), F.col("ay"), F.col("m"))
    return rounded(p.filter("id % 7 = 0").join(maps, "group_id").select("id", bx.alias("bx"), by.alias("by")), "bx", "by", digits=6)


@query("""WITH p AS (SELECT vec_id // 4 AS g, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS u, embedding[4]::DOUBLE AS v FROM embeddings),
m AS (SELECT g, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(u, x) + covar_pop(v, y) AS c, covar_pop(v, x) - covar_pop(u, y) AS s, var_pop(x) + var_pop(y) AS w, count(*) AS n FROM p GROUP BY 1),
f AS (SELECT p.g, n, mu + (c * (x - mx) - s * (y - my)) / w - u AS du, mv + (s * (x - mx) + c * (y - my)) / w - v AS dv FROM p JOIN m ON m.g = p.g)
SELECT g, n AS n_points, round(sqrt(avg(du * du + dv * dv)), 9) AS rms, sqrt(avg(du * du + dv * dv)) > 0.1 AS low_confidence FROM f GROUP BY 1, 2""")
def i18_similarities(spark, sf):
    """Maps of four points each: similarities and their residuals."""
    e = proxy.table(spark, sf, "embeddings")
    p = e.select(F.floor(F.col("vec_id") / 4).alias("g"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(("ax", "ay", "bx", "by"))])
    return rounded(registration.registration(p, ["g"], gate=0.1).select("g", "n_points", "rms", "low_confidence"), "rms")


@query(ORACLES["j9_colocalised"])
def j9_fitted_map(spark, sf):
    """Colocalisation through a map that is fitted from control points first."""
    a, b = _sides(spark, sf)
    points = a.unionByName(b).select(F.col("x").alias("ax"), F.col("y").alias("ay"), matching.quadratic(F.col("x"), F.col("y"), _FORWARD[0]).alias("bx"), matching.quadratic(F.col("x"), F.col("y"), _FORWARD[1]).alias("by"))
    forward = registration.plain_coefficients(registration.fitted(points).first()["m"])
    return rounded(matching.colocalised(a, b, forward, _BACK, _SHAPE, _SHAPE), "acceptor_x", "acceptor_y", digits=6).select("id", "acceptor_x", "acceptor_y", "acceptor")


_DRIFT = """WITH r AS (SELECT CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS side, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CASE WHEN event_id % 3 = 0 THEN (user_id % 7)::DOUBLE END AS part, CASE WHEN event_type = 'view' THEN 1.0::DOUBLE END AS one_side FROM events WHERE event_type IN ('view', 'click')),
l AS (SELECT side, 'value' AS feature, value AS x FROM r UNION ALL SELECT side, 'k', k FROM r UNION ALL SELECT side, 'some', part FROM r UNION ALL SELECT side, 'one_side', one_side FROM r),
n AS (SELECT feature, count(x) FILTER (side = 0) AS n_source, count(x) FILTER (side = 1) AS n_target FROM l GROUP BY 1),
g AS (SELECT l.feature, x, (count(*) FILTER (side = 0))::DOUBLE / any_value(n_source) AS a, (count(*) FILTER (side = 1))::DOUBLE / any_value(n_target) AS b FROM l JOIN n ON n.feature = l.feature WHERE x IS NOT NULL GROUP BY 1, 2),
c AS (SELECT feature, sum(a - b) OVER (PARTITION BY feature ORDER BY x) AS v FROM g), d AS (SELECT feature, max(abs(v)) AS d FROM c GROUP BY 1)
"""


def _drift(spark, sf):
    e = proxy.table(spark, sf, "events").filter("event_type IN ('view', 'click')")
    view = F.col("event_type") == "view"
    rows = e.select((~view).cast("int").alias("side"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), F.when(F.col("event_id") % 3 == 0, (F.col("user_id") % 7).cast("double")).alias("some"), F.when(view, 1.0).alias("one_side"))
    return drift.condition_drift(rows, ["value", "k", "some", "one_side"])


@query(_DRIFT + "SELECT n.feature, CASE WHEN n_source >= 2 AND n_target >= 2 THEN round(d, 9) END AS statistic, n_source, n_target, n_source >= 2 AND n_target >= 2 AS tested FROM n LEFT JOIN d ON d.feature = n.feature")
def a31_feature_drift(spark, sf):
    return rounded(_drift(spark, sf), "statistic").select("feature", "statistic", "n_source", "n_target", "tested")


# the distribution of the statistic has no SQL; tests hold it against enumeration and published values
@query()
def a31_drift_report(spark, sf):
    return _drift(spark, sf)


_BACK_AGAIN = BASE + """, rt AS (SELECT molecule_id + 1000 AS id, frame, donor + (frame % 2) * 5e-7::DOUBLE + CASE WHEN molecule_id % 15 = 0 AND frame = 2 THEN 1 ELSE 0 END AS donor, acceptor - (frame % 3) * 4e-7::DOUBLE AS acceptor FROM f WHERE molecule_id % 3 = 0),
tt AS (SELECT least((SELECT max(frame) FROM rt), (SELECT max(frame) FROM f)) + 1 AS t), gr AS (SELECT unnest(range(t)) AS frame FROM tt),
ra AS (SELECT id, g.frame, coalesce(any_value(donor), 0) AS d, coalesce(any_value(acceptor), 0) AS a FROM (SELECT DISTINCT id FROM rt) CROSS JOIN gr g LEFT JOIN rt USING (id, frame) GROUP BY 1, 2),
sa AS (SELECT molecule_id, g.frame, coalesce(any_value(donor), 0) AS d, coalesce(any_value(acceptor), 0) AS a FROM (SELECT DISTINCT molecule_id FROM f) CROSS JOIN gr g LEFT JOIN f USING (molecule_id, frame) GROUP BY 1, 2),
ls AS (SELECT molecule_id FROM f CROSS JOIN tt WHERE frame >= t AND (donor <> 0 OR acceptor <> 0) GROUP BY 1),
pr AS (SELECT ra.id AS r, sa.molecule_id AS s FROM ra JOIN sa USING (frame) WHERE sa.molecule_id NOT IN (SELECT molecule_id FROM ls) GROUP BY 1, 2 HAVING bool_and(abs(ra.d - sa.d) <= 1e-6 AND abs(ra.a - sa.a) <= 1e-6))
"""


@query(_BACK_AGAIN + "SELECT i.id AS r, pr.s FROM (SELECT DISTINCT id FROM rt) i LEFT JOIN pr ON pr.r = i.id")
def j12_returned_traces(spark, sf):
    """Every third trace comes back a little off under another id, some of them with one frame changed."""
    f = proxy.frames(spark, sf)
    m, t = F.col("molecule_id"), F.col("frame")
    changed = F.when((m % 15 == 0) & (t == 2), 1.0).otherwise(0.0)
    back = f.filter("molecule_id % 3 = 0").select((m + 1000).alias("id"), "frame", (F.col("donor") + (t % 2) * 5e-7 + changed).alias("donor"), (F.col("acceptor") - (t % 3) * 4e-7).alias("acceptor"))
    return tracematch.matched(back, f.withColumnRenamed("molecule_id", "id"))


@query(BASE + """, s AS (SELECT *, CASE WHEN w1 > w0 THEN w0 ELSE 0 END AS lo, CASE WHEN w1 > w0 THEN w1 ELSE n END AS hi FROM m),
x AS (SELECT s.molecule_id, CASE WHEN donor + acceptor <> 0 THEN acceptor / (donor + acceptor) END AS e FROM s JOIN f ON f.molecule_id = s.molecule_id AND frame >= lo AND frame < hi),
g AS (SELECT molecule_id, count(e) AS c, round(avg(e), 9) AS mean_e, round(median(e), 9) AS median_e FROM x GROUP BY 1)
SELECT s.molecule_id::VARCHAR AS molecule_id, 'k' || s.molecule_id AS molecule_key, movie_id::VARCHAR AS movie_id, '' AS source_filename, condition_id::VARCHAR AS condition_id, '' AS condition_id_provisional, CASE label WHEN 1 THEN 'accept' WHEN 0 THEN 'uncurated' ELSE 'reject' END AS curation_label,
 '' AS category, '' AS quality_class, '' AS aperture_id, CASE WHEN s.molecule_id % 3 = 0 THEN '' ELSE CAST(s.molecule_id * 0.0001::DOUBLE AS VARCHAR) END AS alpha, CAST(s.molecule_id * 1e15::DOUBLE AS VARCHAR) AS gamma, '0.0' AS delta, '' AS correction_method, '' AS correction_confidence, '' AS donor_bleach_frame, '' AS acceptor_bleach_frame,
 '' AS frame_start, '' AS frame_end, lo::VARCHAR AS window_start, hi::VARCHAR AS window_end, '' AS tags, coalesce(c, 0)::VARCHAR AS n_finite_frames, coalesce(mean_e::VARCHAR, '') AS mean_apparent_e, coalesce(median_e::VARCHAR, '') AS median_apparent_e FROM s LEFT JOIN g ON g.molecule_id = s.molecule_id""")
def k3_molecule_table(spark, sf):
    """All 25 columns as text, numbers of all magnitudes among them."""
    f = proxy.frames(spark, sf)
    i = F.col("molecule_id")
    m = proxy.molecules(f).withColumns({"molecule_key": F.concat(F.lit("k"), i), "alpha": F.when(i % 3 == 0, float("nan")).otherwise(i * 0.0001), "gamma": i * 1e15, "delta": F.lit(0.0)})
    return tables.molecule_table(rounded(tables.efficiency_summary(m, f), "mean_apparent_e", "median_apparent_e"))


_MATRIX = BASE + """, mx AS (SELECT f.molecule_id, frame, donor, acceptor FROM f JOIN (SELECT molecule_id FROM m WHERE n >= 20 AND molecule_id % 3 = 0) k ON k.molecule_id = f.molecule_id WHERE frame < 20)"""


def _matrix(spark, sf):
    """Every third molecule of at least 20 frames, its first 20 frames."""
    f = proxy.frames(spark, sf).filter("frame < 20")
    m = proxy.molecules(proxy.frames(spark, sf)).filter("n >= 20 AND molecule_id % 3 = 0").select("molecule_id", F.lit(20).alias("n"))
    return tables.trace_matrix(m, f)


@query(_MATRIX + " SELECT frame::INTEGER AS frame, string_agg(printf('%.5f', donor) || ' ' || printf('%.5f', acceptor), ' ' ORDER BY molecule_id) AS line FROM mx GROUP BY 1")
def k4_trace_matrix(spark, sf):
    return _matrix(spark, sf).select(F.col("frame").cast("int").alias("frame"), "line")


@query(_MATRIX + " SELECT (dense_rank() OVER (ORDER BY molecule_id) - 1)::INTEGER AS molecule, frame::INTEGER AS frame, round(donor, 5) AS donor, round(acceptor, 5) AS acceptor FROM mx")
def s12_read_matrix(spark, sf):
    """The matrix written as text and read again."""
    path = f"{shared_dir(spark)}/traceforge-matrix-{uuid.uuid4().hex}"
    tables.write_trace_matrix(_matrix(spark, sf).coalesce(1), path)  # a file is a movie
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return rounded(tables.read_trace_matrix(spark, path).select("molecule", F.col("frame").cast("int").alias("frame"), "donor", "acceptor"), "donor", "acceptor", digits=5)


@query(BASE + "SELECT p.molecule_id, frame, state FROM p JOIN (SELECT molecule_id, min(frame) FILTER (state <> -1) AS a, max(frame) FILTER (state <> -1) AS b FROM p GROUP BY 1) g ON g.molecule_id = p.molecule_id WHERE frame BETWEEN a AND b")
def p3_trimmed_frames(spark, sf):
    return select.trimmed(proxy.paths(spark, sf)).select("molecule_id", F.col("frame").cast("long").alias("frame"), "state")


@query(BASE + "SELECT molecule_id, CASE molecule_id % 7 WHEN 5 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 END::INTEGER AS ord, label FROM m WHERE molecule_id % 7 IN (1, 3, 5)")
def p6_in_callers_order(spark, sf):
    """All rows of three keys, each many molecules', with the caller's place of the key."""
    m = proxy.molecules(proxy.frames(spark, sf)).withColumn("molecule_key", (F.col("molecule_id") % 7).cast("string"))
    return stored.chosen(m, ["5", "3", "5", "1"], include_rejected=True).select("molecule_id", "ord", "label")


@query("""SELECT p_partkey, 'c' || p_size AS construct_variant, CASE WHEN p_partkey % 3 = 0 THEN 'Mg' ELSE '' END AS ligand, CASE WHEN p_partkey % 3 = 0 THEN (p_partkey % 50) / 4.0::DOUBLE END AS ligand_concentration, CASE WHEN p_partkey % 3 = 0 THEN 'nM' ELSE '' END AS ligand_concentration_unit,
 CASE WHEN p_partkey % 5 = 0 THEN 'Cy3' ELSE '' END AS dye, CASE WHEN p_partkey % 2 = 0 THEN '2024-03-0' || (1 + p_partkey % 9) ELSE '' END AS date, CASE WHEN p_partkey % 4 = 1 THEN (p_partkey % 9)::VARCHAR ELSE '' END AS replicate, lpad((p_partkey % 100)::VARCHAR, 3, '0') AS video_index FROM part""")
def f6_parsed_names(spark, sf):
    k = F.col("p_partkey")
    part = lambda c, *t: F.when(c, F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in t])).otherwise("")
    amount = (k % 50 / 4.0).cast("string")
    name = F.concat(part(k % 2 == 0, "2024030", 1 + k % 9, "_"), F.lit("c"), F.col("p_size"), part(k % 5 == 0, "_Cy3 only"), part(k % 3 == 0, "_Mg_", amount, "nM"), part(k % 4 == 1, "_", k % 9, "th-replicate"), F.lit("_"), F.lpad((k % 100).cast("string"), 3, "0"), F.lit(".tif"))
    got = names.parsed_names(proxy.table(spark, sf, "part").select("p_partkey", name.alias("name")))
    return got.select("p_partkey", "construct_variant", "ligand", "ligand_concentration", "ligand_concentration_unit", "dye", "date", "replicate", "video_index")
