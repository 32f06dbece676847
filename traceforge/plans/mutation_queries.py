"""Queries of keyed changes and model-ready windows on the event tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import batch, corrections, curation, mutations, select, windows
from ..sources.project import TABLES
from . import proxy
from .queries import BASE, query, rounded

_IDS = """'cond-' || substr(sha256('{"construct":"' || p_brand || '","dye":"' || p_type || '","ligand":"","ligand_conc":null,"ligand_unit":"","buffer":"","temp_c":' || CAST((p_size % 3) / 4.0::DOUBLE AS VARCHAR) || ',"laser":null}'), 1, 12)"""


@query(f"""WITH g AS (SELECT p_partkey AS ord, {_IDS} AS condition_id, CASE WHEN p_partkey % 4 = 0 THEN p_name END AS tags, CASE WHEN p_partkey % 6 = 0 THEN p_retailprice END AS alpha FROM part),
o AS (SELECT condition_id, arg_max(tags, ord) FILTER (tags IS NOT NULL AND ord % 2 = 0) AS t0, arg_max(alpha, ord) FILTER (alpha IS NOT NULL AND ord % 2 = 0) AS a0, arg_max(tags, ord) FILTER (tags IS NOT NULL AND ord % 2 = 1) AS t1, arg_max(alpha, ord) FILTER (alpha IS NOT NULL AND ord % 2 = 1) AS a1 FROM g GROUP BY 1)
SELECT condition_id, coalesce(t1, t0, '') AS tags, coalesce(a1, a0) AS leakage_alpha FROM o""")
def m2_registered_conditions(spark, sf):
    """Conditions registered from the parts of even keys and then again from those of odd keys."""
    p = proxy.table(spark, sf, "part")
    k = F.col("p_partkey")
    given = p.select(k.alias("ord"), F.col("p_brand").alias("construct_variant"), F.col("p_type").alias("dye"), (F.col("p_size") % 3 / 4.0).alias("temperature_c"), F.when(k % 4 == 0, F.col("p_name")).alias("tags"), F.when(k % 6 == 0, F.col("p_retailprice")).alias("leakage_alpha"))
    none = spark.createDataFrame([], TABLES["conditions"])
    got = mutations.registered(mutations.registered(none, given.filter("ord % 2 = 0")), given.filter("ord % 2 = 1"))
    return got.select("condition_id", "tags", F.nanvl("leakage_alpha", F.lit(None).cast("double")).alias("leakage_alpha"))


_VOCAB = """WITH v AS (SELECT DISTINCT 'b' || (p_size % 7) AS condition_id, p_type AS name FROM part), c AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY name) - 1 AS code FROM v),
t AS (SELECT condition_id, name FROM c WHERE code = 1), e AS (SELECT c.*, t.name AS pick, substr(c.condition_id, 2)::INTEGER AS n FROM c JOIN t ON t.condition_id = c.condition_id),
r AS (SELECT condition_id, code, CASE WHEN n % 3 = 1 AND name = pick THEN 'renamed' ELSE name END AS name FROM e WHERE NOT (n % 3 = 0 AND name = pick) UNION ALL SELECT condition_id, 1000000, 'added' FROM t WHERE substr(condition_id, 2)::INTEGER % 3 = 2),
f AS (SELECT condition_id, row_number() OVER (PARTITION BY condition_id ORDER BY code) - 1 AS code, name FROM r)
"""


def _edited(spark, sf):
    """Vocabularies of types by size, of which the second name is removed or renamed, or one is added."""
    p = proxy.table(spark, sf, "part")
    have = p.groupBy(F.concat(F.lit("b"), F.col("p_size") % 7).alias("condition_id")).agg(F.array_sort(F.collect_set("p_type")).alias("v")).select("condition_id", F.posexplode("v").alias("code", "name"))
    n = F.substring("condition_id", 2, 9).cast("int") % 3
    edits = have.filter("code = 1").select("condition_id", F.when(n == 0, "remove").when(n == 1, "rename").otherwise("add").alias("action"), F.when(n == 2, "added").otherwise(F.col("name")).alias("name"), F.lit("renamed").alias("new"), F.lit(None).cast("array<string>").alias("names"))
    return mutations.edited_categories(have, have.select("condition_id").distinct(), edits)


@query(_VOCAB + "SELECT condition_id, code::INTEGER AS code, name FROM f")
def m4_edited_categories(spark, sf):
    return _edited(spark, sf)


@query(_VOCAB + "SELECT p_partkey, f.code::INTEGER AS category_code FROM part LEFT JOIN f ON f.condition_id = 'b' || (p_size % 7) AND f.name = p_type")
def m4_category_codes(spark, sf):
    p = proxy.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("b"), F.col("p_size") % 7).alias("condition_id"), F.col("p_type").alias("category"))
    return mutations.category_codes(p, _edited(spark, sf)).select("p_partkey", "category_code")


@query(BASE + """, ev AS (SELECT row_number() OVER (ORDER BY event_id) + 4 AS event_seq, user_id, CASE WHEN event_id % 3 = 0 THEN 'model' ELSE 'human' END AS source, CAST(event_id % 3 - 1 AS INTEGER) AS v, event_id FROM events WHERE event_type = 'click'),
la AS (SELECT user_id, arg_max(v, event_id) AS v FROM ev WHERE source = 'human' GROUP BY 1)
SELECT m.molecule_id, coalesce(la.v, m.label)::INTEGER AS label, (SELECT max(event_seq) FROM ev) AS last_event FROM m LEFT JOIN la ON la.user_id = m.molecule_id""")
def m1_mirrored_labels(spark, sf):
    m = proxy.molecules(proxy.frames(spark, sf)).withColumn("molecule_key", F.col("molecule_id").cast("string"))
    i = F.col("event_id")
    events = proxy.table(spark, sf, "events").filter("event_type = 'click'").select(i.alias("ord"), F.col("user_id").cast("string").alias("molecule_key"), F.when(i % 3 == 0, "model").otherwise("human").alias("source"), (i % 3 - 1).cast("int").alias("label_value"))
    log = spark.range(1, 5).select(F.col("id").alias("event_seq"), F.lit("0").alias("molecule_key"), F.lit("human").alias("source"), F.lit(1).alias("label_value"))
    new, rows = mutations.labelled(log, m, events)
    return rows.select("molecule_id", F.col("label").cast("int").alias("label")).crossJoin(new.agg(F.max("event_seq").alias("last_event")))


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY sha256('0:' || doc_id)) AS k, count(*) OVER (PARTITION BY quality) AS m FROM labels)
SELECT doc_id, quality, k <= CASE WHEN m < 2 THEN 0 ELSE greatest(1, least(round_even(m * 0.2::DOUBLE, 0), m - 1)) END AS validation FROM r""")
def i12_stratified_split(spark, sf):
    return windows.split(proxy.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query(BASE + """, g AS (SELECT molecule_id, row_number() OVER (PARTITION BY molecule_id ORDER BY frame) - 1 AS k, donor, acceptor, max(donor + acceptor) OVER (PARTITION BY molecule_id) AS top FROM e),
h AS (SELECT molecule_id, round(sum((donor / CASE WHEN top > 0 THEN top ELSE 1 END)::FLOAT::DOUBLE), 5) AS donor, round(sum((acceptor / CASE WHEN top > 0 THEN top ELSE 1 END)::FLOAT::DOUBLE), 5) AS acceptor, count(*) AS valid FROM g WHERE k < 40 GROUP BY 1)
SELECT h.molecule_id, donor, acceptor, valid::INTEGER AS valid, 40 AS slots, (label > 0)::INTEGER AS y FROM h JOIN m ON m.molecule_id = h.molecule_id""")
def i12_model_windows(spark, sf):
    e = proxy.efficiencies(spark, sf)
    labels = e.select("molecule_id", "label").distinct().withColumn("weight", F.lit(1.0))
    got = windows.model_windows(e, labels, 40)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")).alias(c)
    return rounded(got.select("molecule_id", total("donor"), total("acceptor"), "valid", F.size("mask").alias("slots"), "y"), "donor", "acceptor", digits=5)


_RUN = """WITH ev AS (SELECT event_id AS seq, 'm' || (user_id % 23) AS movie, CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'correct' WHEN 'purchase' THEN 'idealize' ELSE event_type END AS stage, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM events),
ls AS (SELECT movie, stage, arg_max(status, seq) AS status, min(seq) AS seq FROM ev GROUP BY 1, 2), mv AS (SELECT movie, min(seq) AS queued, count(*) FILTER (status = 'failed') = 0 AS ok FROM ls GROUP BY 1)
"""


def _run(spark, sf):
    """Stage events of movies made of the events' users and types."""
    i, t = F.col("event_id"), F.col("event_type")
    stage = F.when(t == "view", "extract").when(t == "click", "correct").when(t == "purchase", "idealize").otherwise(t)
    return proxy.table(spark, sf, "events").select(i.alias("seq"), F.concat(F.lit("m"), (F.col("user_id") % 23).cast("string")).alias("movie"), stage.alias("stage"), F.when(i % 3 == 0, "failed").otherwise("ok").alias("status"), F.when(i % 9 == 0, F.concat(F.lit("e"), i % 5)).alias("error"))


@query(_RUN + "SELECT count(*) AS n_movies, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed FROM mv")
def a34_run_summary(spark, sf):
    return batch.batch_summary(batch.movie_results(_run(spark, sf)))


@query(_RUN + """, er AS (SELECT ls.*, CASE WHEN (SELECT max(seq) FROM ev WHERE ev.movie = ls.movie AND ev.stage = ls.stage) % 9 = 0 THEN 'e' || ((SELECT max(seq) FROM ev WHERE ev.movie = ls.movie AND ev.stage = ls.stage) % 5) END AS error FROM ls)
SELECT mv.movie, queued, CASE WHEN ok THEN 'ok  ' ELSE 'FAIL' END || '  ' || mv.movie || '  ' || string_agg(stage || '=' || status || CASE WHEN status = 'failed' AND error IS NOT NULL THEN '(' || error || ')' ELSE '' END, ' ' ORDER BY CASE stage WHEN 'extract' THEN 1 WHEN 'correct' THEN 2 WHEN 'idealize' THEN 3 ELSE 4 END, stage) AS line
FROM mv JOIN er ON er.movie = mv.movie GROUP BY mv.movie, queued, ok""")
def a34_report_lines(spark, sf):
    return batch.report_lines(batch.movie_results(_run(spark, sf)))


@query("SELECT p_partkey FROM part WHERE p_partkey % 11 <> 0 AND p_brand || '-' || (p_size % 5) IN (SELECT DISTINCT p_brand || '-' || (p_size % 5) FROM part WHERE p_size % 5 = 3 AND p_brand = 'Brand#12')")
def p5_molecules_of_key(spark, sf):
    p = proxy.table(spark, sf, "part")
    cond = F.concat("p_brand", F.lit("-"), F.col("p_size") % 5)
    conditions = p.select(cond.alias("condition_id"), F.col("p_brand").alias("construct_variant"), (F.col("p_size") % 5).cast("double").alias("temperature_c"), F.lit("").alias("dye")).distinct()
    m = p.select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, cond).alias("condition_id"))
    return select.molecules_of_key(m, conditions, {"construct_variant": "Brand#12", "temperature_c": 3.0, "dye": None}).select("p_partkey")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS rank FROM customer")
def t2_store_order(spark, sf):
    return curation.store_order(proxy.table(spark, sf, "customer"), "c_custkey", "c_nationkey").select("id", "rank")


@query("SELECT c_mktsegment, round(mad(c_acctbal), 6) AS mad FROM customer GROUP BY 1")
def f16_median_deviation(spark, sf):
    return rounded(corrections.median_deviation(proxy.table(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"]), "mad", digits=6)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'movie_absent' ELSE 'no_reference' END AS status FROM part")
def s20_movie_references(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    movie = F.when(k % 4 != 2, F.concat(F.lit("/a/"), F.upper(name), F.lit(".tif")))
    reference = F.when(k % 4 == 0, F.concat(F.lit("D:\\x\\"), name, F.lit(".TIF"))).when(k % 4 == 1, F.concat(name, F.lit("2.tif"))).when(k % 4 == 2, name)
    return proxy.table(spark, sf, "part").select("p_partkey", scalar.reference_status(movie, reference).alias("status"))
