"""Range joins, file names and text tables on small rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from traceforge.functions import names
from traceforge.operators import matching, population
from traceforge.sources import tables

POINT = "group_id long, id long, x double, y double"
NAN = float("nan")


def scattered(seed, n, first):
    r = random.Random(seed)
    return [(k % 2, first + k, r.randrange(80) / 4, r.randrange(80) / 4) for k in range(n)]


def one_by_one(left, right, tol):
    pairs = sorted((math.sqrt((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2), a[1], b[1]) for a in left for b in right if a[0] == b[0])
    out, gone = [], set()
    for d, a, b in pairs:
        if d <= tol and not {a, b} & gone:
            gone |= {a, b}
            out.append((a, b, d))
    return sorted(out)


def test_near_and_one_to_one_pairs_equal_brute_force(spark):
    left, right = scattered(1, 60, 0), scattered(2, 70, 1000)
    a = spark.createDataFrame(left + [(0, 900, None, 1.0), (1, 901, NAN, 1.0), (None, 902, 1.0, 1.0)], POINT)
    near = matching.near_pairs(a, spark.createDataFrame(right, POINT), 2.0)
    want = {(p[1], q[1]) for p in left for q in right if p[0] == q[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 4}
    assert sorted((r.a, r.b) for r in near.collect()) == sorted(want)
    got = sorted((r.a, r.b, r.distance) for r in matching.one_to_one(near).collect())
    assert got == one_by_one(left, right, 2.0)
    assert matching.one_to_one(near.filter("false")).count() == 0
    score = matching.detection_scores(a, a.limit(0), near.filter("false")).first()
    assert (score.n_known, score.recall, score.precision, score.rms) == (63, 0.0, None, None)
    with pytest.raises(ValueError):
        matching.near_pairs(a, a, 0.0)


def test_matched_correlations(spark):
    pairs = spark.createDataFrame([(1, 11), (2, 12)], "a long, b long")
    known = spark.createDataFrame([(1, k, float(k)) for k in range(4)] + [(2, k, 1.0) for k in range(4)], "id long, frame long, value double")
    found = spark.createDataFrame([(11, k, -2.0 * k) for k in range(3)] + [(11, 3, NAN)] + [(12, k, float(k)) for k in range(4)], "id long, frame long, value double")
    got = {r.a: (r.frames, r.r) for r in matching.matched_correlations(pairs, known, found).collect()}
    assert got[1] == (3, pytest.approx(-1.0)) and got[2] == (4, None)
    assert matching.matched_correlations(pairs, known, found, by=()).first().frames == 7


def test_flat_traces_have_no_correlation(spark):
    rows = [(1, k, 1.0, float(k), 0.5) for k in range(3)] + [(2, k, float(k), -float(k), 0.5) for k in range(3)]
    got = {r.molecule_id: r.anticorr_lag0 for r in population.trace_features(spark.createDataFrame(rows, "molecule_id long, frame long, donor double, acceptor double, e double")).collect()}
    assert got == {1: None, 2: pytest.approx(-1.0)}


def test_colocalised(spark):
    donors = spark.createDataFrame([(0, 1, 20.0, 20.0), (0, 2, 9.4, 20.0), (0, 3, 40.0, 30.0), (0, 4, 9.5, 20.0)], POINT)
    acceptors = spark.createDataFrame([(0, 7, 22.0, 20.0), (0, 8, 18.0, 20.0), (0, 9, 43.0, 30.0)], POINT)
    same = ([0, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0])
    got = {r.id: (r.acceptor_x, r.acceptor) for r in matching.colocalised(donors, acceptors, same, same, (64, 64), (64, 64)).collect()}
    assert got == {1: (20.0, 7), 3: (40.0, None), 4: (9.5, None)}  # 3 apart is not less than the gate; 9.5 rounds to 10
    with pytest.raises(ValueError):
        matching.window_fits(F.lit(1.0), F.lit(1.0), (9, 9), 4)


def test_lag1(spark):
    rows = [(1, 0, 1.0, 2.0), (1, 1, 2.0, 5.0), (1, 2, 4.0, 1.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 2.0), (3, 0, 1.0, 1.0)]
    got = {r[0]: r[1] for r in matching.lag1_magnitude(spark.createDataFrame(rows, "molecule_id long, frame long, donor double, acceptor double")).collect()}
    d, a = [-4 / 3, -1 / 3, 5 / 3], [-2 / 3, 7 / 3, -5 / 3]
    sd = lambda v: math.sqrt(sum(x * x for x in v) / 3)
    assert got[1] == pytest.approx(abs(d[1] * a[0] + d[2] * a[1]) / (3 * sd(d) * sd(a))) and got[2] is None and got[3] is None


@pytest.mark.parametrize(
    "name, want",
    [
        ("/d/DeepLASI_MAT_export_HJ_tRNA_600nM_35pM_2ndreplicate_20250721_010.tif2025-07-21_00-00.tdat", ("HJ", "", "tRNA", 600.0, "nM", 35.0, "pM", "2025-07-21", "2", "010")),
        ("HJ_x7_Cy3 only_1.5uM_2uM_001-donc-accc-w.txt", ("HJ x7", "Cy3", "", None, "", 1.5, "uM", "", "", "001")),
        ("Cy5only_100_12.tif", ("100", "Cy5", "", None, "", None, "", "", "", "12")),
        ("a_2024-01-02_03-04-05.mat", ("a", "", "", None, "", None, "", "2024-01-02", "", "")),
        ("", ("", "", "", None, "", None, "", "", "", "")),
        (None, ("", "", "", None, "", None, "", "", "", "")),
    ],
)
def test_names(spark, name, want):
    got = names.parsed_names(spark.createDataFrame([(name, 1)], "name string, other int"))
    fields = ("construct_variant", "dye", "ligand", "ligand_concentration", "ligand_concentration_unit", "sample_concentration", "sample_concentration_unit", "date", "replicate", "video_index")
    assert got.columns == ["name", "other", *fields]
    assert tuple(got.select(*fields).first()) == want


def test_trace_matrix_comes_back(spark, tmp_path):
    frames = spark.createDataFrame([(m, f, m + f / 8, -f / 4) for m in (3, 1) for f in range(5)], "molecule_id long, frame long, donor double, acceptor double")
    molecules = spark.createDataFrame([(1, 5), (3, 5)], "molecule_id long, n long")
    tables.write_trace_matrix(tables.trace_matrix(molecules, frames).coalesce(1), str(tmp_path / "m"))
    back = tables.read_trace_matrix(spark, str(tmp_path / "m")).groupBy("molecule", "frame").agg(F.first("donor").alias("d"), F.first("acceptor").alias("a"))
    assert {(r.molecule, r.frame): (r.d, r.a) for r in back.collect()} == {(k, f): (m + f / 8, -f / 4) for k, m in enumerate((1, 3)) for f in range(5)}
    with pytest.raises(ValueError):
        tables.trace_matrix(spark.createDataFrame([(1, 5), (3, 4)], "molecule_id long, n long"), frames)
    (tmp_path / "odd.txt").write_text("1 2 3\n")
    (tmp_path / "ragged.txt").write_text("1 2\n1 2 3 4\n")
    for bad in ("odd.txt", "ragged.txt"):
        with pytest.raises(Exception, match="odd number|unequal"):
            tables.read_trace_matrix(spark, str(tmp_path / bad)).collect()


def test_level_traces(spark, tmp_path):
    (tmp_path / "a.txt").write_text("%t (s)\tIdd\tIda\tIaa\tE\n+0.0\t1\t2\t3\t+5.0e-1\n0.1\t1\t2\t3\t0.25\n")
    rows = tables.read_level_traces(spark, str(tmp_path / "a.txt")).orderBy("frame").collect()
    assert [(r.frame, r.t, r.e, r.frame_time) for r in rows] == [(0, 0.0, 0.5, 0.1), (1, 0.1, 0.25, 0.1)]
    (tmp_path / "short.txt").write_text("0.0\t1\t2\t3\t0.5\n")
    (tmp_path / "narrow.txt").write_text("0.0\t1\n0.1\t1\n")
    for bad in ("short.txt", "narrow.txt"):
        with pytest.raises(Exception):
            tables.read_level_traces(spark, str(tmp_path / bad)).collect()


def test_molecule_table(spark, tmp_path):
    molecules = spark.createDataFrame([(1, 1, 4, 0, 0, 0.5), (2, -1, 4, 1, 3, NAN), (3, 0, 0, 0, 0, None)], "molecule_id long, label int, n int, w0 int, w1 int, alpha double")
    frames = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 3.0, 1.0), (1, 2, 0.0, 0.0), (1, 3, 1.0, 3.0), (2, 0, 9.0, 9.0), (2, 1, 1.0, 0.0)], "molecule_id long, frame long, donor double, acceptor double")
    t = tables.molecule_table(tables.efficiency_summary(molecules, frames))
    assert tuple(t.columns) == tables.MOLECULE_COLUMNS
    got = {r.molecule_id: (r.curation_label, r.alpha, r.window_start, r.window_end, r.n_finite_frames, r.mean_apparent_e, r.median_apparent_e) for r in t.collect()}
    assert got == {"1": ("accept", "0.5", "0", "4", "3", "0.5", "0.5"), "2": ("reject", "", "1", "3", "1", "0.0", "0.0"), "3": ("uncurated", "", "0", "0", "0", "", "")}
    assert tables.efficiency_summary(molecules, frames, include_rejected=False).count() == 2
    to = tables.write_provenance(spark, str(tmp_path / "t.csv"), "molecule-table", "1", "p", {"b": 1, "a": 2}, "2025-01-01T00:00:00+00:00")
    assert spark.read.json(to).first().parameters.asDict() == {"a": 2, "b": 1}


def test_extraction_verdict(spark):
    points = lambda rows: spark.createDataFrame(rows, "group_id int, id int, x double, y double")
    known = points([(0, k, 10.0 * k, 0.0) for k in range(20)])
    found = points([(0, 100 + k, 10.0 * k + 0.5, 0.0) for k in range(20)] + [(0, 999, 5000.0, 0.0)])
    wave = lambda k, t: float((k * 7 + t * t) % 11)
    trace = lambda first, of: spark.createDataFrame([(first + k, t, of(k, t)) for k in range(20) for t in range(6)], "id int, frame int, value double")
    flat = lambda k, t: 1.0 if k < 12 else wave(k, t)
    pairs = matching.one_to_one(matching.near_pairs(known, found, 2.0))
    given = (trace(0, wave), trace(100, lambda k, t: 3 * wave(k, t) + 1))
    got = matching.extraction_verdict(known, found, pairs, given, (trace(0, flat), trace(100, flat)), 0.4).first()
    assert (got.n_matched, got.recall, round(got.donor_median, 12), got.acceptor_median, got.residual, got.passes) == (20, 1.0, 1.0, 0.0, 0.4, True)
    assert got.acceptor_pooled > 0.99 and got.rms == 0.5
    for residual in (None, 0.6, float("nan")):
        assert not matching.extraction_verdict(known, found, pairs, given, given, residual).first().passes
    none = matching.extraction_verdict(known, found.filter("id = 999"), pairs.filter("false"), given, given, 0.1).first()
    assert (none.n_matched, none.recall, none.donor_median, none.passes) == (0, 0.0, None, False)
