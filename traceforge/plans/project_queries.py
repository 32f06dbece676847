"""Queries on a stored project that is built from the event tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import state_of
from ..operators import digests, drift, population, ranking, select, stored
from ..operators._tables import shared_dir
from ..sources import project as store
from . import proxy
from .queries import BASE, BIN, query, rounded

MEANS = (0.2, 0.55, 0.85)
#: Leakage and gamma of molecules with an even and an odd id.
ALPHAS, GAMMA = (0.05, 0.1), 1.25
#: Frames for which the project gets a bucket.
ROWS_PER_BUCKET = 500_000
#: Layers are stored with single precision.
SINGLE = BASE.replace("AS DOUBLE) END AS donor", "AS FLOAT)::DOUBLE END AS donor").replace("ELSE value END AS acceptor", "ELSE value::FLOAT::DOUBLE END AS acceptor")
_built: dict[tuple[str, str], store.Project] = {}


def project(spark: SparkSession, sf: str) -> store.Project:
    """The events' project, built once a session: two batches of movies, a model of the corrected layers, features."""
    key = (spark.sparkContext.applicationId, sf)
    if key in _built:
        return _built[key]
    path = f"{shared_dir(spark)}/traceforge-project-{uuid.uuid4().hex}"
    rows = proxy.table(spark, sf, "events").count()
    made = store.create_project(spark, path, buckets=max(4, -(-rows // ROWS_PER_BUCKET)))
    made.files.fs.deleteOnExit(made.files.at())
    f = proxy.frames(spark, sf)
    m = proxy.molecules(f)
    odd = F.col("molecule_id") % 2
    molecules = m.select(
        F.col("molecule_id").alias("store_ord"), F.col("molecule_id").cast("string").alias("molecule_id"), F.concat(F.lit("k"), (F.col("molecule_id") % 97).cast("string")).alias("molecule_key"), F.col("movie_id").cast("string").alias("movie_id"), "n", "w0", "w1",
        F.when(odd == 0, ALPHAS[0]).otherwise(ALPHAS[1]).alias("alpha"), F.lit(GAMMA).alias("gamma"), F.when(F.col("molecule_id") % 6 == 0, "apparent-E (user toggle)").otherwise("corrected").alias("correction_method"), "label", F.col("condition_id").cast("string").alias("condition_id"),
    )
    frames = f.select(F.col("molecule_id").cast("string").alias("molecule_id"), "frame", F.col("donor").alias("donor_corrected"), F.col("acceptor").alias("acceptor_corrected"), (F.col("donor") + 1).alias("donor_raw"), (F.col("acceptor") + 1).alias("acceptor_raw"))
    movies = molecules.groupBy("movie_id").agg(F.max("n").alias("n_frames"))
    for batch in (0, 1):
        own = lambda c: F.col(c).cast("long") % 2 == batch  # noqa: B023, E731
        # molecules of even ids are in movies of even ids
        made.append_movies(movies.filter(own("movie_id")), molecules.filter(own("molecule_id")), frames.filter(own("molecule_id")), settings={"disk_radius": 3.0}, batch=f"part {batch}")
    e = select.with_efficiency(made.windowed())
    now = current_digests(made)
    keys = made.table("molecules").select("molecule_id", "molecule_key")
    paths = e.join(now, "molecule_id").join(keys, "molecule_id").select("molecule_id", "molecule_key", F.col("hash").alias("input_hash"), "frame", state_of(F.col("e"), *proxy.CUTS).alias("state"))
    spread = {r["state"]: r for r in e.select(state_of(F.col("e"), *proxy.CUTS).alias("state"), "e").filter("state >= 0").groupBy("state").agg(F.var_pop("e").alias("v"), F.count("*").alias("n")).collect()}
    seen = [spread[k] for k in range(len(MEANS))]
    made.write_model("threshold", paths, MEANS, quantity="corrected", variances=[r["v"] for r in seen], frac=[r["n"] / sum(x["n"] for x in seen) for r in seen])
    features = population.trace_features(e).join(keys, "molecule_id")
    made.write_features(features, ["total_intensity", "fret_mean"])
    _built[key] = made
    return made


def current_digests(p: store.Project, molecules: DataFrame | None = None) -> DataFrame:
    m = p.table("molecules") if molecules is None else molecules
    unset = F.col("w1") <= F.col("w0")
    m = m.select("molecule_id", F.when(unset, 0).otherwise(F.col("w0")).alias("lo"), F.when(unset, F.col("n")).otherwise(F.col("w1")).alias("hi"), "alpha", "gamma", "correction_method", "label")
    return digests.input_digest(p.windowed(), m.filter("label <> -1"))


@query(SINGLE + f"""SELECT CAST(g.bin AS INTEGER) AS bin, coalesce(c.n, 0)::DOUBLE AS n, round(coalesce(c.n, 0) / ((sum(coalesce(c.n, 0)) OVER ()) * (1.5 / 151)), 9) AS density
FROM range(151) g(bin) LEFT JOIN (SELECT {BIN} AS bin, count(*) AS n FROM e WHERE e BETWEEN -0.25 AND 1.25 GROUP BY 1) c ON g.bin = c.bin""")
def s3_stored_histogram(spark, sf):
    """A2 on the stored frames: read bucket by bucket, without a shuffle of frames."""
    return rounded(population.histogram(select.with_efficiency(project(spark, sf).windowed())), "density")


@query("SELECT user_id::VARCHAR AS molecule_id, (user_id % 10)::VARCHAR AS movie_id, count(*)::INTEGER AS n, 'part ' || (user_id % 2) AS batch FROM events GROUP BY 1, 2, 4")
def k1_appended_molecules(spark, sf):
    return project(spark, sf).table("molecules").select("molecule_id", "movie_id", "n", "batch")


_HEX = "h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2]"
_DIGEST = SINGLE + f""", hx AS (SELECT molecule_id, frame, hex(CAST(CAST(donor AS BIT) AS BLOB)) AS d, hex(CAST(CAST(acceptor AS BIT) AS BLOB)) AS a FROM e),
tr AS (SELECT molecule_id, count(*) AS n, string_agg({_HEX.replace('h[', 'd[')}, '' ORDER BY frame) AS d, string_agg({_HEX.replace('h[', 'a[')}, '' ORDER BY frame) AS a FROM hx GROUP BY 1),
dg AS (SELECT b.molecule_id, lo, hi, sha256(encode('corrected|' || coalesce(n, 0) || '|') || unhex(coalesce(d, '') || coalesce(a, ''))) AS t FROM b LEFT JOIN tr ON tr.molecule_id = b.molecule_id),
dig AS (SELECT molecule_id, sha256('{digests.TAG.strip()}' || chr(10) || t || '|window=' || lo || ',' || hi || '|alpha=' || CASE WHEN molecule_id % 6 = 0 THEN '{0.0.hex()}' WHEN molecule_id % 2 = 0 THEN '{ALPHAS[0].hex()}' ELSE '{ALPHAS[1].hex()}' END
 || '|gamma=' || CASE WHEN molecule_id % 6 = 0 THEN '{1.0.hex()}' ELSE '{GAMMA.hex()}' END) AS hash FROM dg)"""


@query(_DIGEST + " SELECT molecule_id::VARCHAR AS molecule_id, hash FROM dig")
def f5_input_digests(spark, sf):
    return current_digests(project(spark, sf))


def _changed(p: store.Project) -> DataFrame:
    """Molecules as a later session finds them: every eleventh has another leakage, every thirteenth another gamma, which matters
    only where it's applied."""
    k = F.col("store_ord")
    m = p.table("molecules")
    return m.withColumn("alpha", F.when(k % 11 == 0, F.col("alpha") * 2).otherwise(F.col("alpha"))).withColumn("gamma", F.when(k % 13 == 0, 2.0).otherwise(F.col("gamma")))


@query(SINGLE + """, fit AS (SELECT molecule_id, frame, CASE state WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.55::DOUBLE WHEN 2 THEN 0.85::DOUBLE END AS v FROM p WHERE molecule_id % 6 = 0 OR (molecule_id % 11 <> 0 AND molecule_id % 13 <> 0))
SELECT molecule_id::VARCHAR AS molecule_id, count(*) AS frames, count(v) AS assigned, round(sum(v), 9) AS total FROM fit GROUP BY 1""")
def j1_stored_levels(spark, sf):
    """Fitted levels of a stored model; rows whose digest has changed since are stale and left out."""
    p = project(spark, sf)
    row, paths = p.model("threshold")
    got = stored.fitted_levels(paths.withColumnRenamed("input_hash", "hash"), p.table("molecules"), row["means"], current_digests(p, _changed(p)))
    return rounded(got.groupBy("molecule_id").agg(F.count("*").alias("frames"), F.count("level").alias("assigned"), F.sum("level").alias("total")), "total")


@query(_DIGEST + """, km AS (SELECT 'k' || (molecule_id % 97) AS molecule_key, bool_or(molecule_id % 6 <> 0 AND (molecule_id % 11 = 0 OR molecule_id % 13 = 0)) AS stale FROM dig GROUP BY 1)
SELECT molecule_key FROM km WHERE NOT stale""")
def j2_stored_live_keys(spark, sf):
    p = project(spark, sf)
    fitted = p.model("threshold")[1].select("molecule_id", "molecule_key", F.col("input_hash").alias("hash")).distinct()
    return select.live_keys(fitted, current_digests(p, _changed(p)))


@query(SINGLE + "SELECT molecule_id::VARCHAR AS molecule_id, round(avg(donor + acceptor), 6) AS total_intensity, round(avg(e), 9) AS fret_mean FROM e GROUP BY 1")
def s7_stored_features(spark, sf):
    return rounded(rounded(project(spark, sf).features().drop("molecule_key"), "total_intensity", digits=6), "fret_mean")


@query(SINGLE + """, c AS (SELECT *, sum(ch) OVER (PARTITION BY molecule_id ORDER BY frame) AS run FROM (SELECT *, CASE WHEN s0 IS NULL OR s0 <> state THEN 1 ELSE 0 END AS ch FROM nx))
SELECT molecule_id::VARCHAR AS molecule_id, state, min(frame) AS start, count(*) AS length FROM c GROUP BY molecule_id, run, state HAVING state <> -1""")
def w2_stored_runs(spark, sf):
    return population.runs(project(spark, sf).model("threshold")[1]).select("molecule_id", "state", F.col("start").cast("long").alias("start"), "length")


@query(SINGLE + """, t AS (SELECT condition_id, molecule_id, avg(donor + acceptor) AS total_intensity, avg(e) AS fret_mean FROM e WHERE condition_id IN (1, 2) GROUP BY 1, 2),
l AS (SELECT condition_id, 'total_intensity' AS feature, total_intensity AS x FROM t UNION ALL SELECT condition_id, 'fret_mean', fret_mean FROM t), sz AS (SELECT feature, count(x) FILTER (condition_id = 1) AS a, count(x) FILTER (condition_id = 2) AS z FROM l GROUP BY 1),
g AS (SELECT l.feature, x, count(*) FILTER (condition_id = 1)::DOUBLE / any_value(a) AS u, count(*) FILTER (condition_id = 2)::DOUBLE / any_value(z) AS v FROM l JOIN sz ON sz.feature = l.feature WHERE x IS NOT NULL GROUP BY 1, 2),
c AS (SELECT feature, sum(u - v) OVER (PARTITION BY feature ORDER BY x) AS d FROM g) SELECT sz.feature, round(max(abs(d)), 9) AS statistic, any_value(a) AS n_source, any_value(z) AS n_target FROM c JOIN sz ON sz.feature = c.feature GROUP BY 1""")
def j17_condition_drift(spark, sf):
    p = project(spark, sf)
    got = drift.between_conditions(p.features(), p.table("molecules"), p.feature_names(), "1", "2")
    return rounded(got, "statistic").select("feature", "statistic", "n_source", "n_target")


def _training(spark, sf):
    """Features of the molecules, and those with a label: people's on the rows, seeds' in a log of keys."""
    p = project(spark, sf)
    features = population.trace_features(select.with_efficiency(p.windowed()))
    i = F.col("event_id")
    source = F.when(i % 10 == 0, "model").when(i % 10 == 5, stored.SEED_SOURCES[0]).when(i % 10 == 3, stored.SEED_SOURCES[1]).otherwise("human")
    log = proxy.table(spark, sf, "events").select(i.alias("event_seq"), F.concat(F.lit("k"), (F.col("user_id") % 97).cast("string")).alias("molecule_key"), source.alias("source"), (i % 3 - 1).cast("int").alias("label_value"))
    return features, ranking.training_set(features, p.table("molecules"), log)


@query(SINGLE + """, km AS (SELECT molecule_id, 'k' || (molecule_id % 97) AS key, condition_id AS c, label FROM m), hc AS (SELECT c, count(*) FILTER (label <> 0) AS n FROM km GROUP BY 1), kc AS (SELECT key, arg_max(c, molecule_id) AS c FROM km GROUP BY 1),
sd AS (SELECT 'k' || (user_id % 97) AS key, arg_max(event_id % 3 - 1, event_id) AS v FROM events WHERE event_id % 10 IN (3, 5) GROUP BY 1)
SELECT km.molecule_id::VARCHAR AS molecule_id, CASE WHEN label <> 0 THEN label = 1 ELSE v = 1 END AS good, round(CASE WHEN label <> 0 THEN 1.0 ELSE 0.3 / (1 + hc.n) END, 9)::DOUBLE AS weight
FROM km JOIN kc ON kc.key = km.key JOIN hc ON hc.c = kc.c LEFT JOIN sd ON sd.key = km.key WHERE km.molecule_id IN (SELECT molecule_id FROM e) AND (label <> 0 OR (v IS NOT NULL AND v <> 0))""")
def j7_training_weights(spark, sf):
    return rounded(_training(spark, sf)[1].select("molecule_id", "good", "weight"), "weight")


# trees have no SQL; tests hold them against a plain booster that looks at every row
@query()
def i9_learned_ranking(spark, sf):
    features, training = _training(spark, sf)
    return rounded(ranking.learned_ranking(features, training, ["n_frames", "total_intensity", "snr", "fret_mean", "fret_var", "anticorr_lag0"]), "score", digits=6)


@query()
def i10_prequential(spark, sf):
    """Labelled rows in eight parts, each ranked by a model of the parts before it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    share = lambda p: F.try_divide(F.regexp_count(text, F.lit(p)), F.length(text))
    d = proxy.table(spark, sf, "documents").select("doc_id", F.length(text).cast("double").alias("length"), share(r"\s").alias("blank"), share(r"\d").alias("digits"), share(r"[A-Z]").alias("capitals"), share(r"[^\w\s]").alias("signs"))
    i = F.col("doc_id")
    rows = proxy.table(spark, sf, "labels").join(d, "doc_id").select(i.alias("id"), i.alias("store_ord"), (i % 8).alias("movie"), (i % 8).alias("movie_ord"), (F.col("quality") == 1).alias("good"), "length", "blank", "digits", "capitals", "signs")
    return rounded(ranking.prequential(rows, ["length", "blank", "digits", "capitals", "signs"], 20), "precision", "baseline", "uplift")


@query(SINGLE + """, st AS (SELECT state, var_pop(e) AS v, count(*)::DOUBLE / sum(count(*)) OVER () AS f, CASE state WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.55::DOUBLE ELSE 0.85::DOUBLE END AS m FROM p WHERE state <> -1 GROUP BY 1)
SELECT k, round(sum(f / sqrt(2 * pi() * v) * exp(-(-0.25 + k * 0.0015 - m) * (-0.25 + k * 0.0015 - m) / (2 * v))), 7) AS y FROM range(1001) g(k) CROSS JOIN st GROUP BY 1""")
def a7_stored_overlay(spark, sf):
    """The overlay of the stored model: its means, and the variances and shares of its states' frames."""
    row, _ = project(spark, sf).model("threshold")
    return rounded(population.gaussian_overlay(spark, row["means"], row["variances"], row["frac"]), "y", digits=7)
