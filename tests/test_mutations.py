"""Keyed changes and model-ready windows: what stays, what moves, what is refused."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from traceforge.operators import mutations, stored, windows

FIELDS = {n: ("double" if n in ("ligand_concentration", "temperature_c", "laser_power") else "string") for n, _ in stored.CONDITION_FIELDS}
CONDITIONS = "condition_id string, " + ", ".join(f"{n} {k}" for n, k in FIELDS.items()) + ", date string, replicate string, leakage_alpha double, leakage_alpha_source string, tags string"


def test_register_upserts_field_by_field(spark):
    none = spark.createDataFrame([], CONDITIONS)
    given = spark.createDataFrame([(1, "ab", "Mg", 0.0005, "2024-01-01", None, None), (2, "ab", "Mg", 0.0005, None, 0.07, "t"), (3, "cd", None, None, None, None, None)], "ord int, construct_variant string, ligand string, ligand_concentration double, date string, leakage_alpha double, tags string")
    first = mutations.registered(none, given)
    rows = {r.construct_variant: r for r in first.collect()}
    assert set(rows) == {"ab", "cd"} and (rows["ab"].date, rows["ab"].leakage_alpha, rows["ab"].tags, rows["ab"].replicate, rows["ab"].dye) == ("2024-01-01", 0.07, "t", "", "")
    assert math.isnan(rows["cd"].leakage_alpha) and math.isnan(rows["cd"].laser_power) and rows["cd"].ligand == ""
    text = '{"construct":"ab","dye":"","ligand":"Mg","ligand_conc":0.0005,"ligand_unit":"","buffer":"","temp_c":null,"laser":null}'
    assert rows["ab"].condition_id == "cond-" + hashlib.sha256(text.encode()).hexdigest()[:12]
    # what isn't given stays; the same again changes nothing
    later = spark.createDataFrame([(1, "ab", "Mg", 0.0005, "r2")], "ord int, construct_variant string, ligand string, ligand_concentration double, replicate string")
    second = mutations.registered(first, later)
    again = {r.construct_variant: r for r in mutations.registered(second, later).collect()}
    assert (again["ab"].date, again["ab"].replicate, again["ab"].leakage_alpha) == ("2024-01-01", "r2", 0.07) and len(again) == 2
    assert mutations.registered(first, later.filter("false")).count() == 2


def edit(spark, *rows):
    return spark.createDataFrame(list(rows), "condition_id string, action string, name string, new string, names array<string>")


def test_vocabularies(spark):
    have = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "k")], "condition_id string, code int, name string")
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d/e",)], "condition_id string")
    of = lambda df: {c: [n for _, n in sorted((r.code, r.name) for r in df.collect() if r.condition_id == c)] for c in ("a", "b", "c")}
    got = mutations.edited_categories(have, known, edit(spark, ("a", "remove", "y", None, None), ("b", "add", " m ", None, None), ("c", "set", None, None, [" q", "p"])))
    assert of(got) == {"a": ["x", "z"], "b": ["k", "m"], "c": ["q", "p"]}
    got = mutations.edited_categories(have, known, edit(spark, ("a", "rename", "y", " w", None), ("b", "set", None, None, [])))
    assert of(got) == {"a": ["x", "w", "z"], "b": [], "c": []}
    assert of(mutations.edited_categories(have, known, edit(spark, ("a", "rename", "y", "y", None)))) == {"a": ["x", "y", "z"], "b": ["k"], "c": []}
    for bad, said in (
        (("a", "add", "x", None, None), "already there"), (("a", "add", "  ", None, None), "empty"), (("a", "remove", "w", None, None), "not there"), (("a", "rename", "x", "z", None), "already there"), (("a", "rename", "q", "r", None), "not there"),
        (("z", "add", "x", None, None), "unknown condition"), (("a", "set", None, None, ["u", "u "]), "twice"), (("a", "shuffle", "x", None, None), "unknown action"), (("d/e", "add", "x", None, None), "plain"),
    ):
        with pytest.raises(Exception, match=said):
            mutations.edited_categories(have, known, edit(spark, bad)).collect()
    with pytest.raises(Exception, match="several"):
        mutations.edited_categories(have, known, edit(spark, ("a", "add", "u", None, None), ("a", "add", "v", None, None))).collect()
    m = spark.createDataFrame([(1, "a", "z"), (2, "a", "k"), (3, "b", "k"), (4, None, "k")], "molecule_id long, condition_id string, category string")
    assert {r.molecule_id: r.category_code for r in mutations.category_codes(m, have).collect()} == {1: 2, 2: None, 3: 0, 4: None}


def test_moving_conditions(spark):
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "molecule_id long, condition_id string")
    c = spark.createDataFrame([("a",), ("b",)], "condition_id string")
    rows, audit = mutations.moved_condition(m, c, "a", "n", actor="me")
    assert {r.molecule_id: r.condition_id for r in rows.collect()} == {1: "n", 2: "n", 3: "b", 4: None}
    assert tuple(audit.first()) == ("rekey", "n", "a to n, 2 molecules, by me")
    with pytest.raises(ValueError):
        mutations.moved_condition(m, c, "a", "b")
    assert mutations.moved_condition(m, c, "a", "b", merge=True)[1].first().action == "merge"
    with pytest.raises(KeyError):
        mutations.moved_condition(m, c, "q", "n")
    with pytest.raises(ValueError):
        mutations.moved_condition(m, c, "a", "a")


def test_labels_reach_all_rows_of_a_key(spark):
    schema = "event_seq long, molecule_key string, source string, label_value int"
    log = spark.createDataFrame([(4, "a", "human", -1)], schema)
    m = spark.createDataFrame([(1, "a", -1), (2, "a", 0), (3, "b", 1)], "molecule_id long, molecule_key string, label int")
    events = spark.createDataFrame([(7, "a", "human", 1), (9, "a", "human", 0), (8, "b", "model", -1)], "ord long, molecule_key string, source string, label_value int")
    new, rows = mutations.labelled(log, m, events)
    assert [tuple(r) for r in new.orderBy("event_seq").collect()] == [(4, "a", "human", -1), (5, "a", "human", 1), (6, "b", "model", -1), (7, "a", "human", 0)]
    assert {r.molecule_id: r.label for r in rows.collect()} == {1: 0, 2: 0, 3: 1}
    assert mutations.labelled(log.filter("false"), m, events)[0].agg(F.min("event_seq")).first()[0] == 1
    with pytest.raises(KeyError):
        mutations.labelled(log, m, events.withColumn("molecule_key", F.lit("q")))


def test_accepted_changes(spark):
    m = spark.createDataFrame([(1, 0, 9, "good"), (2, 0, 9, ""), (3, 1, 5, "odd"), (4, 0, 9, "x")], "molecule_id long, w0 int, w1 int, category string")
    matches = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, None)], "r long, s long")
    back = spark.createDataFrame([(10, 2, 9, 0), (11, 0, 9, 0), (12, 0, 5, 2), (13, 5, 6, 0)], "r long, w0 int, w1 int, class int")
    changes = mutations.returned_changes(matches, back, m)
    assert {r.molecule_id: (r.window_changed, r.class_changed) for r in changes.collect()} == {1: (True, True), 2: (False, False), 3: (True, True)}
    rows, told = mutations.accepted_changes(m, changes, windows=[1], classes=True)
    assert {r.molecule_id: (r.w0, r.w1, r.category) for r in rows.collect()} == {1: (2, 9, ""), 2: (0, 9, ""), 3: (1, 5, "odd"), 4: (0, 9, "x")}
    assert {r.molecule_id: tuple(r)[1:] for r in told.collect()} == {1: (True, True, False), 3: (False, False, True)}
    assert mutations.accepted_changes(m, changes)[1].count() == 0


def test_windows_of_one_length(spark):
    frames = spark.createDataFrame([(1, 5, 2.0, 2.0), (1, 4, 1.0, 0.0), (1, 6, 0.0, 1.0), (2, 0, 0.0, 0.0), (9, 0, 1.0, 1.0)], "molecule_id long, frame int, donor double, acceptor double")
    labels = spark.createDataFrame([(1, 1, 1.0), (2, -1, 0.3), (3, 0, 1.0)], "molecule_id long, label int, weight double")
    got = {r.molecule_id: r for r in windows.model_windows(frames, labels, 2).collect()}
    assert (got[1].donor, got[1].acceptor, got[1].mask, got[1].valid, got[1].y) == ([0.25, 0.5], [0.0, 0.5], [True, True], 2, 1)
    assert (got[2].donor, got[2].mask, got[2].valid, got[2].y, got[2].weight) == ([0.0, 0.0], [True, False], 1, 0, 0.3)
    assert (got[3].donor, got[3].mask, got[3].valid) == ([0.0, 0.0], [False, False], 0) and len(got) == 3
    for bad in ((frames, labels.filter("false"), 2), (frames, labels, 0)):
        with pytest.raises(ValueError):
            windows.model_windows(*bad)


def test_split_in_exact_shares(spark):
    rows = [(k, "hot" if k % 3 else "b" if k % 2 else None) for k in range(600)] + [(1000, "lone"), (1001, "two"), (1002, "two")]
    df = spark.createDataFrame(rows, "id long, c string").repartition(5)
    got = windows.split(df, "id", "c", 0.25, seed=3)
    by = {r.c: (r.n, r.v) for r in got.groupBy("c").agg(F.count("*").alias("n"), F.count_if("validation").alias("v")).collect()}
    assert by == {"hot": (400, 100), "b": (100, 25), None: (100, 25), "lone": (1, 0), "two": (2, 1)}
    rank = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    assert {r.id for r in got.filter("validation AND c = 'b'").collect()} == set(sorted((i for i, c in rows if c == "b"), key=rank)[:25])
    assert windows.split(df.repartition(2), "id", "c", 0.25, seed=3).filter("validation").exceptAll(got.filter("validation")).isEmpty()
    assert windows.split(df, "id", share=0.5).filter("validation").count() == 302  # 301.5, half to even
    with pytest.raises(ValueError):
        windows.split(df, "id", share=1.0)
