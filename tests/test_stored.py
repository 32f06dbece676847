"""Operators of stored tables on small hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from traceforge.operators import agreement, curation, kinetics, population, stored

NAN = float("nan")


def test_levels_transitions_and_gaps(spark):
    rows = [(1, k, s, "a") for k, s in enumerate([0, 0, 1, 1, -1, 2, 0, 0])] + [(2, 0, 1, "a"), (3, 0, 0, "old"), (3, 1, 1, "old"), (4, 0, 0, "a")]
    paths = spark.createDataFrame(rows, "molecule_id long, frame int, state int, hash string")
    molecules = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, -1)], "molecule_id long, label int")
    now = spark.createDataFrame([(1, "a"), (2, "a"), (3, "new"), (4, "a")], "molecule_id long, hash string")
    levels = stored.fitted_levels(paths, molecules, [0.1, 0.5, 1.3], now)
    assert sorted({r.molecule_id for r in levels.collect()}) == [1, 2]
    pairs = stored.level_transitions(levels)
    assert sorted((r.initial, r.final) for r in pairs.collect()) == [(0.1, 0.5), (1.3, 0.1)]
    assert stored.transition_totals(pairs).first() == (2, 1, 1)
    assert [(r.initial_bin, r.final_bin, r.n) for r in stored.transition_bins(pairs, 61, -0.2, 1.2, dense=False).collect()] == [(13, 30, 1)]
    dense = stored.transition_bins(pairs).collect()
    assert len(dense) == 101 * 101 and [(r.initial_bin, r.final_bin) for r in dense if r.n] == [(23, 50)]
    assert round(sum(r.density for r in dense) * (1.5 / 101) ** 2, 9) == 1.0
    assert {r.density for r in stored.transition_bins(pairs.filter("false"), 3).collect()} == {0.0}
    with pytest.raises(ValueError):
        stored.level_transitions(levels, 0)


def test_nearest_state_and_tally(spark):
    e = spark.createDataFrame([(0.3,), (0.5,), (NAN,), (None,)], "x double")
    assert [r[0] for r in e.select(stored.nearest_state(F.col("x"), [0.1, 0.5])).collect()] == [0, 1, -1, -1]
    paths = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, -1), (4, 0), (4, 1), (4, 2)], "molecule_id long, state int")
    assert sorted(map(tuple, stored.state_tally(paths, 1, 2).collect())) == [(1, 1, 1), (2, 1, 1)]
    assert sorted(map(tuple, stored.state_tally(paths, 2).collect())) == [(2, 1, 1), (3, 1, 1)]


LOG = "event_seq long, molecule_key string, labeler string, timestamp string, source_file string, source string, label_value int, condition_id long"


def test_label_merge_and_verdicts(spark):
    own = spark.createDataFrame([(1, "a", "x", "t", "f", "human", 1, 5)], LOG)
    other = spark.createDataFrame([(1, "a", "x", "t", "f", "human", 1, None), (2, "b", "x", "t", "f", "human", -1, None), (3, "b", "x", "t", "f", "human", -1, None), (4, "c", "x", "t", "f", "human", 1, None), (5, "d", "x", "t", "f", "human", 1, None), (6, "b", "x", "t", "f", "model", 1, None)], LOG)
    molecules = spark.createDataFrame([("a", 5, 1, 9), ("a", 5, 0, 2), ("b", 6, 1, 0), ("c", 5, 0, 0), ("c", 6, 0, 0), ("e", 7, 1, 0)], "molecule_key string, condition_id long, label int, store_ord int")
    got = stored.label_merge(own, other, molecules)
    assert [(r.event_seq, r.outcome, r.condition_id) for r in got.orderBy("event_seq").collect()] == [(1, "duplicate", None), (2, "appended", 6), (3, "duplicate", None), (4, "ambiguous", None), (5, "unmatched", None), (6, "skipped", None)]
    assert sorted(map(tuple, stored.label_verdicts(got, molecules).collect())) == [("a", 1, "adopted"), ("b", -1, "conflict")]
    assert stored.label_merge(own, other.filter("false"), molecules).count() == 0
    # the last decision of e was withdrawn; a repeated event without a file is one event
    more = spark.createDataFrame([(1, "e", "x", "t", None, "human", -1, None), (2, "e", "x", "t", None, "human", -1, None), (3, "e", "x", "u", "f", "human", 0, None)], LOG)
    got = stored.label_merge(own, more, molecules)
    assert [r.outcome for r in got.orderBy("event_seq").collect()] == ["appended", "duplicate", "appended"]
    assert stored.label_verdicts(got, molecules).count() == 0
    again = stored.label_merge(own.unionByName(more), more, molecules)
    assert {r.outcome for r in again.collect()} == {"duplicate"}


def test_only_seeds_are_provisional(spark):
    seeds = list(stored.SEED_SOURCES)
    log = spark.createDataFrame([(1, "a", seeds[0], 1), (2, "a", seeds[1], -1), (3, "a", "human", 1), (4, "b", "model", 1), (5, "c", seeds[0], 1), (6, "c", seeds[0], 0), (7, "d", "human", 1)], "event_seq long, molecule_key string, source string, label_value int")
    assert [tuple(r) for r in stored.provisional_labels(log).collect()] == [("a", -1)]


def test_canonical_by_the_models_means(spark):
    paths = spark.createDataFrame([(1, t, s, e) for t, (s, e) in enumerate([(0, 0.1), (1, 0.9), (2, 0.5), (-1, None)])], "molecule_id long, frame int, state int, e double")
    states = lambda df: [r.state for r in df.orderBy("frame").collect()]
    assert states(agreement.canonical(paths)) == [0, 2, 1, -1]
    assert states(agreement.canonical(paths, [0.8, 0.2, 0.2])) == [2, 0, 1, -1]


def test_condition_text_quotes_and_ids(spark):
    one = spark.createDataFrame([('a"b', 600.0)], "buffer string, laser_power double")
    text = one.select(stored.canonical_condition({"buffer": F.col("buffer"), "laser_power": F.col("laser_power")}).alias("t")).first().t
    assert text == '{"construct":"","dye":"","ligand":"","ligand_conc":null,"ligand_unit":"","buffer":"a\\"b","temp_c":null,"laser":600.0}'


def test_model_choice_parity_and_bounds(spark):
    fits = spark.createDataFrame([(1, None), (2, -5.0), (3, -5.0), (4, -9.0)], "nstates int, elbo double")
    assert stored.best_by_elbo(fits).first() == (2, -5.0)
    paths = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, -1, -1), (3, 0, 1)], "molecule_id long, ref int, test int")
    got = stored.model_parity(paths, [0.2, 0.8], [0.8, 0.21], -10.0, None).first()
    assert (got.state_count_fraction, round(got.viterbi_agreement, 9), round(got.state_mean_abs_delta, 9), got.relative_elbo, got.passes) == (1.0, round(2 / 3, 9), 0.01, math.inf, False)
    assert stored.model_parity(paths, [0.2], [0.2, 0.8], 1.0, 1.0).first().viterbi_agreement == 0.0
    runs = spark.createDataFrame([(1.0, 0.1, 0.9, 0.0), (0.9, 0.0, None, 0.0)], "state_count_fraction double, state_mean_abs_delta double, viterbi_agreement double, relative_elbo double")
    assert tuple(stored.frozen_bounds(runs).first()) == (0.85, 0.15, 0.0, 0.01)


def test_rankings(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5), (5, NAN)], "id long, score double")
    assert [(r.id, r["rank"]) for r in curation.ranked(scores).orderBy("rank").collect()] == [(3, 1), (1, 2), (4, 3), (2, 4), (5, 5)]
    assert [r.id for r in curation.ranked(scores, descending=False).orderBy("rank").collect()] == [1, 4, 3, 2, 5]
    assert curation.ranked(scores.filter("false")).count() == 0
    with pytest.raises(Exception, match="infinite"):
        curation.ranked(scores.unionByName(spark.createDataFrame([(9, math.inf)], "id long, score double"))).collect()
    assert kinetics.elbow([1, 2, 3, 4], [0.5] * 4) is None and kinetics.elbow([1, 2, 3], [1.0, 0.1, 0.0]) == 2
    d = spark.createDataFrame([(0, 2), (0, 2), (0, 4), (1, 1)], "state int, length long")
    assert sorted((r.state, r.tau, round(r.s, 6)) for r in population.survival(d).collect()) == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 0.333333), (0, 3, 0.333333), (1, 0, 1.0)]


def test_selection_and_shapes(spark):
    rows = spark.createDataFrame([("a", 0), ("b", -1), ("b", 1), ("c", 0)], "molecule_key string, label int")
    assert [(r.molecule_key, r.ord) for r in stored.chosen(rows, ["c", "b", "c"]).orderBy("ord").collect()] == [("c", 0), ("b", 1)]
    assert stored.chosen(rows, ["b"], include_rejected=True).count() == 2
    with pytest.raises(KeyError):
        stored.chosen(rows, ["z"])
    assert stored.resolve_quantity("raw") == ("donor_raw", "acceptor_raw")
    with pytest.raises(ValueError):
        stored.resolve_quantity("odd")
    line = spark.range(1).select(stored.circumradius(*[F.lit(float(x)) for x in (0, 0, 1, 1, 2, 2)]).alias("a"), stored.circumradius(*[F.lit(float(x)) for x in (0, 0, 4, 0, 0, 3)]).alias("b")).first()
    assert (line.a, line.b) == (math.inf, 2.5)
    frames = spark.createDataFrame([(1, 0, 3.0, 1.0), (1, 1, 1.0, 1.0), (2, 0, 0.0, 0.0)], "molecule_id long, frame int, donor double, acceptor double")
    assert sorted(map(tuple, stored.normalised(frames, 2).collect())) == [(1, 0, 0.75, 0.25, True), (1, 1, 0.25, 0.25, True), (2, 0, 0.0, 0.0, True), (2, 1, 0.0, 0.0, False)]
