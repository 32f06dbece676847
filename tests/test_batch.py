"""Batch summaries, selections by key, lookups, small functions."""

import pytest
from pyspark.sql import functions as F

from traceforge.functions import scalar
from traceforge.operators import batch, corrections, curation, kinetics, select


def test_results_and_report(spark):
    rows = [(1, "m1", "extract", "ok", None), (2, "m2", "extract", "failed", "no file"), (3, "m1", "idealize", "failed", "x"), (4, "m1", "correct", "ok", None), (5, "m1", "idealize", "ok", None), (6, "m3", "check", "skipped", None), (7, "m3", "extract", "failed", None)]
    got = batch.movie_results(spark.createDataFrame(rows, "seq long, movie string, stage string, status string, error string").repartition(3))
    assert {r.movie: (r.queued, r.ok, [tuple(s) for s in r.stages]) for r in got.collect()} == {
        "m1": (1, True, [("extract", "ok", None), ("correct", "ok", None), ("idealize", "ok", None)]), "m2": (2, False, [("extract", "failed", "no file")]), "m3": (6, False, [("extract", "failed", None), ("check", "skipped", None)]),
    }
    assert tuple(batch.batch_summary(got).first()) == (3, 1, 2)
    assert [r.line for r in batch.report_lines(got).orderBy("queued").collect()] == ["ok    m1  extract=ok correct=ok idealize=ok", "FAIL  m2  extract=failed(no file)", "FAIL  m3  extract=failed check=skipped"]
    assert tuple(batch.batch_summary(got.filter("false")).first()) == (0, 0, 0)


def test_layout_differences(spark):
    schema = "table string, column string, type string"
    a, b = spark.createDataFrame([("t", "x", "int"), ("t", "y", "int"), ("t", "z", "int")], schema), spark.createDataFrame([("t", "x", "int"), ("t", "y", "long"), ("u", "x", "int")], schema)
    assert {(r.table, r.column): r.difference for r in batch.layout_differences(a, b).collect()} == {("t", "y"): "int to long", ("t", "z"): "missing", ("u", "x"): "added"}


def test_queries_by_key_and_order(spark):
    conditions = spark.createDataFrame([("a", "v", "Mg", 1.0), ("b", "v", "", float("nan")), ("c", "w", None, None)], "condition_id string, construct_variant string, ligand string, ligand_concentration double")
    ids = lambda key: sorted(r.condition_id for r in select.conditions_by_key(conditions, key).collect())
    assert ids({"construct_variant": "v"}) == ["a", "b"] and ids({"ligand": None}) == ["b", "c"] and ids({"ligand_concentration": None, "construct_variant": "w"}) == ["c"] and ids({"ligand_concentration": 1.0}) == ["a"]
    with pytest.raises(ValueError):
        select.conditions_by_key(conditions, {"colour": 1})
    m = spark.createDataFrame([(3, "k", "a", 0, "x", ["p", "q"]), (1, "l", "b", -1, "y", ["p"]), (2, "k", None, 0, "x", ["p", "q"]), (0, "n", "c", 1, "x", [])], "store_ord long, molecule_key string, condition_id string, label int, category string, tags array<string>")
    of = lambda df: [r.store_ord for r in df.collect()]
    assert sorted(of(select.molecules_of_key(m, conditions, {"construct_variant": "v"}))) == [1, 3] and of(select.molecules_of_key(m, conditions, {}, tags=["p", "q"])) == [3]
    assert sorted(of(select.molecules_of_key(m, conditions, None, tags=["q", "z"], match_all_tags=False, categories=["x"]))) == [3]
    assert of(select.in_store_order(m, ["k", "l"])) == [2, 3] and of(select.in_store_order(m, include_rejected=True)) == [0, 1, 2, 3]
    with pytest.raises(KeyError):
        select.in_store_order(m, ["z"])
    fit = spark.createDataFrame([(1, "u", "h"), (2, "v", "h"), (3, "w", "old")], "molecule_id long, molecule_key string, hash string")
    now = spark.createDataFrame([(1, "h"), (2, "h"), (3, "new")], "molecule_id long, hash string")
    assert [r.molecule_key for r in select.chosen_live_keys(fit, now, ["w", "v", "u", "v", "q"]).collect()] == ["v", "u"]


def test_lookups(spark):
    log = spark.createDataFrame([(1, "a", "human", 1), (2, "a", "human", -1), (3, "b", "human", 1), (4, "b", "human", 0)], "event_seq long, molecule_key string, source string, label_value int")
    assert [curation.label_of(log, k) for k in "abc"] == [-1, 0, 0]
    m = spark.createDataFrame([(f"m{k}", (k * 7) % 20) for k in range(20)], "molecule_id string, store_ord long")
    rank = curation.store_order(m)
    assert {r.id: r["rank"] for r in rank.collect()} == {f"m{k}": (k * 7) % 20 + 1 for k in range(20)}
    assert [r.id for r in curation.first_ranked(rank, 2).collect()] == ["m0", "m3"] and curation.rank_of(rank, "m3") == 2 and curation.first_ranked(rank, 0).count() == 0
    with pytest.raises(KeyError):
        curation.rank_of(rank, "q")


def test_small_functions(spark):
    df = spark.createDataFrame([("C:\\\\d\\\\Ab.TIF", "/x/ab.tif"), ("a.tif", "b.tif"), ("", "b.tif"), (None, None), ("a.tif", "")], "movie string, reference string")
    assert [r[0] for r in df.select(scalar.reference_status(F.col("movie"), F.col("reference"))).collect()] == ["confirmed", "mismatch", "movie_absent", "no_reference", "no_reference"]
    assert [r[0] for r in spark.range(3).select(scalar.active(F.col("id"), F.lit(2))).collect()] == [True, True, False]
    got = corrections.remapped_factors(spark.createDataFrame([(0.3, 0.05, 1.2)], "legacy_alpha double, legacy_beta double, legacy_gamma double")).first()
    assert (got.alpha, got.gamma, got.delta, got.direct_excitation) == (0.05, 1.2, 0.0, 0.3)
    x = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 9, 9)] + [("b", 5.0), ("b", None)], "g string, v double")
    assert {r.g: r.mad for r in corrections.median_deviation(x, "v", ["g"]).collect()} == {"a": 3.0, "b": 0.0} and corrections.median_deviation(x, "v").first().mad == 3.0
    rates, truth = spark.createDataFrame([(0, 0.16), (1, 0.3)], "state int, k double"), spark.createDataFrame([(0, 0.15), (1, 0.22), (2, 1.0)], "state int, truth double")
    assert {r.state: r.within for r in kinetics.within_band(rates, truth, 0.12).collect()} == {0: True, 1: False, 2: False}
    assert kinetics.active_levels(spark.createDataFrame([("l1", "active"), ("l2", "none"), ("l3", None)], "level string, oracle string")).count() == 1
