"""Number text and digests against Python's own."""

import hashlib
import random
import struct

from pyspark.sql import functions as F

from traceforge.functions import numbers
from traceforge.operators import digests, stored


def doubles(n=1500):
    rng = random.Random(5)
    some = [0.0005, 1e7, 1e16, 1e22, -0.0, 0.0, 5e-324, -2.2250738585072014e-308, 1e15, 9999999999999998.0, 1e-5, 1e-4, 0.002, 2.0**-44, 1e23, 9007199254740993.0, 1.7976931348623157e308, 600.0, 123456.789, -1.5]
    some += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(n)]
    some += [round(rng.uniform(-1e6, 1e6), rng.randint(0, 9)) for _ in range(n)]
    return some + [k / 10**e for k in range(1, 40) for e in range(8)]


def test_number_text(spark):
    given = doubles()
    df = spark.createDataFrame(list(enumerate(given)), "i long, x double").unionByName(spark.createDataFrame([(-1, None), (-2, float("nan")), (-3, float("inf")), (-4, float("-inf"))], "i long, x double"))
    got = df.select("i", numbers.decimal_text(F.col("x")).alias("d"), numbers.hexadecimal_text(F.col("x")).alias("h"), numbers.little_endian_hex(F.col("x")).alias("b")).collect()
    by = {r.i: r for r in got}
    for i, x in enumerate(given):
        if x == x:
            assert (by[i].d, by[i].h, by[i].b.lower()) == (repr(x), x.hex(), struct.pack("<d", x).hex()), x
    assert [by[i].d for i in (-1, -2, -3, -4)] == [None, "nan", "inf", "-inf"]
    assert [by[i].h for i in (-2, -3, -4)] == ["nan", "inf", "-inf"]


def plain_digest(d, a, quantity, lo, hi, alpha, gamma, tag=digests.TAG):
    inner = hashlib.sha256(f"{quantity}|{len(d)}|".encode() + struct.pack(f"<{len(d)}d", *d) + struct.pack(f"<{len(a)}d", *a)).hexdigest()
    return hashlib.sha256(f"{tag}{inner}|window={lo},{hi}|alpha={alpha.hex()}|gamma={gamma.hex()}".encode()).hexdigest()


def test_input_digest(spark):
    traces = {1: ([0.1, 1e7, -0.0], [3.0, 2.5, 1e-300]), 2: ([7.0], [8.25])}
    frames = spark.createDataFrame([(m, t, d[t], a[t]) for m, (d, a) in traces.items() for t in range(len(d))], "molecule_id long, frame int, donor double, acceptor double").repartition(3)
    m = spark.createDataFrame([(1, 0, 3, 0.05, 1.2, "corrected"), (2, 4, 5, 0.05, 1.2, "apparent-E (user toggle)"), (3, 0, 0, 0.0, 1.0, None)], "molecule_id long, lo int, hi int, alpha double, gamma double, correction_method string")
    got = {r.molecule_id: r.hash for r in digests.input_digest(frames, m, "raw").collect()}
    assert got == {1: plain_digest(*traces[1], "raw", 0, 3, 0.05, 1.2), 2: plain_digest(*traces[2], "raw", 4, 5, 0.0, 1.0), 3: plain_digest([], [], "raw", 0, 0, 0.0, 1.0)}
    # a change of what isn't applied leaves the digest, of what is applied changes it
    other = m.withColumn("alpha", F.col("alpha") + 1)
    again = {r.molecule_id: r.hash for r in digests.input_digest(frames, other, "raw").collect()}
    assert again[2] == got[2] and again[1] != got[1]
    assert digests.input_digest(frames.filter("false"), m.filter("false")).count() == 0


def test_conditions_by_faithful_files(spark):
    ident = lambda **f: stored.condition_id(stored.canonical_condition({k: F.lit(v) for k, v in f.items()}))
    one = spark.range(1).select(ident(construct_variant="ab", ligand="Mg", ligand_concentration=0.0005, ligand_concentration_unit="nM").alias("a"), ident(construct_variant="zz").alias("b")).first()
    text = '{"construct":"ab","dye":"","ligand":"Mg","ligand_conc":0.0005,"ligand_unit":"nM","buffer":"","temp_c":null,"laser":null}'
    assert one.a == "cond-" + hashlib.sha256(text.encode()).hexdigest()[:12]
    rows = [(0, one.a, "other.tif"), (1, one.a, "ab_Mg_0.0005nM.tif"), (2, one.a, "ab_Mg_0.0005nM_07.tif"), (3, one.b, "yy.tif"), (4, "", "ab.tif"), (5, None, "ab.tif"), (6, "known", "ab.tif")]
    m = spark.createDataFrame(rows, "store_ord long, condition_id string, source_filename string")
    got = {r.condition_id: r for r in stored.new_conditions(m, spark.createDataFrame([("known",)], "condition_id string")).collect()}
    assert set(got) == {one.a, one.b}
    assert (got[one.a].source_filename, got[one.a].construct_variant, got[one.a].ligand_concentration) == ("ab_Mg_0.0005nM.tif", "ab", 0.0005)
    assert got[one.b].source_filename is None  # unresolved
    back = spark.createDataFrame([(text,)], "t string").select(stored.condition_key(F.col("t")).alias("k")).first().k
    assert (back.construct_variant, back.ligand_concentration, back.temperature_c, back.buffer) == ("ab", 0.0005, None, "")


def test_a_condition_is_read_once_for_all_fields(spark):
    from traceforge.plans import stored_queries

    plan = stored_queries.f7_condition_fields(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
    assert plan.count("format_string(") <= 3 * 4  # the text of its three numbers is made once, too


def test_bounds_and_choice_of_models(spark):
    none = spark.createDataFrame([], "state_count_fraction double, state_mean_abs_delta double, viterbi_agreement double, relative_elbo double")
    assert tuple(stored.frozen_bounds(none).first()) == (0.0, float("inf"), 0.0, float("inf"))
    fits = spark.createDataFrame([(2, float("nan")), (3, -3.0), (4, float("inf")), (5, None), (1, -3.5)], "nstates int, elbo double")
    assert tuple(stored.best_by_elbo(fits).first()) == (3, -3.0)
    assert stored.best_by_elbo(fits.filter("nstates IN (2, 4, 5)")).first().nstates == 2
