"""Stored projects: refusals, idempotent appends, models, features, and plans without a shuffle."""

import json

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from traceforge.operators import digests
from traceforge.sources import project as store


def extraction(spark, movie, n=6, first=0, dark=None):
    movies = spark.createDataFrame([(movie, n)], "movie_id string, n_frames int")
    ids = [f"{movie}-{k}" for k in range(first, first + 3)]
    molecules = spark.createDataFrame([(k, i, f"key {i}", movie, n, 1, 5, 0, "c1", 0.1, 1.5, "corrected") for k, i in enumerate(ids)], "store_ord long, molecule_id string, molecule_key string, movie_id string, n int, w0 int, w1 int, label int, condition_id string, alpha double, gamma double, correction_method string")
    rows = [(i, t, 0.0 if i == dark else 10.0 + t, 0.0 if i == dark else 2.0 * k + t) for k, i in enumerate(ids) for t in range(n)]
    frames = spark.createDataFrame([(i, t, d, a, d, a) for i, t, d, a in rows], "molecule_id string, frame int, donor_raw double, acceptor_raw double, donor_corrected double, acceptor_corrected double")
    return movies, molecules, frames


@pytest.fixture
def project(spark, tmp_path):
    return store.create_project(spark, f"file://{tmp_path}/a project", buckets=3)


def test_create_and_open(spark, tmp_path, project):
    with pytest.raises(FileExistsError):
        store.create_project(spark, project.path)
    assert store.open_project(spark, project.path) == project
    for name in store.TABLES:
        assert project.table(name).count() == 0
    with pytest.raises(KeyError):
        project.table("other")
    head = tmp_path / "a project" / "project.json"
    good = json.loads(head.read_text())
    for change, said in (({"format": "x"}, "marker"), ({"schema_version": None}, "no schema version"), ({"schema_version": 2}, "newer")):
        head.write_text(json.dumps(good | change))
        (head.parent / ".project.json.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match=said):
            store.open_project(spark, project.path)
    # a missing table is told before a version that is too new
    head.write_text(json.dumps(good | {"schema_version": 2}))
    (head.parent / "frames" / "_columns").unlink()
    with pytest.raises(ValueError, match="missing: frames"):
        store.open_project(spark, project.path)
    head.write_text("{")
    with pytest.raises(ValueError, match="readable"):
        store.open_project(spark, project.path)
    with pytest.raises(ValueError, match="readable"):
        store.open_project(spark, f"file://{tmp_path}/nothing")
    assert store.create_project(spark, project.path, overwrite=True).buckets == 64


def test_movies_are_written_once_and_whole(spark, project):
    one = extraction(spark, "m/1 =ü")
    assert project.append_movies(*one, settings={"radius": 3.0}) == "m/1 =ü"
    with pytest.raises(ValueError, match="already stored"):
        project.append_movies(*one)
    movies, molecules, frames = extraction(spark, "m2")
    refused = [
        ((movies, molecules.unionByName(molecules.limit(1)), frames), "twice"), ((movies, molecules.withColumn("movie_id", F.lit("m9")), frames), "no movie"), ((movies, molecules, frames.filter("molecule_id <> 'm2-1'")), "without frames"),
        ((movies, molecules.filter("store_ord > 0"), frames), "without a molecule"), ((movies, molecules, frames.unionByName(frames.limit(1))), "frames that are there twice"),
        ((movies.withColumn("n_frames", F.lit(5)), molecules, frames), "out of the movie"), (extraction(spark, "m2", dark="m2-2"), "zero"), ((movies, molecules.withColumn("molecule_id", F.concat(F.lit("m/1 =ü-"), "store_ord")), frames), "stored already"),
    ]
    for given, said in refused:
        with pytest.raises(ValueError, match=said):
            project.append_movies(*given)
    with pytest.raises(ValueError, match="settings differ"):
        project.append_movies(movies, molecules, frames, settings={"radius": 4.0})
    assert project.batches("frames") == ["m/1 =ü"]
    # an append that failed before its movie was moved isn't read, and a new try replaces what it left
    project._commit([("frames", frames.limit(4)), ("molecules", molecules)], "m2")
    assert project.table("frames").count() == 18 and project.table("molecules").count() == 3
    project.append_movies(movies, molecules, frames, settings={"radius": 3.0})
    assert project.table("frames").count() == 36 and project.table("molecules").count() == 6 and project.settings() == {"radius": "3.0"}
    got = project.windowed("raw").groupBy("molecule_id").agg(F.count("*").alias("n"), F.min("t").alias("t")).collect()
    assert len(got) == 6 and {(r.n, r.t) for r in got} == {(4, 0)}


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_windows_and_joins_by_molecule_need_no_shuffle(spark, project):
    for k in range(2):
        project.append_movies(*extraction(spark, f"m{k}"))
    again = store.open_project(spark, project.path)
    frames = again.table("frames")
    by = W.partitionBy("molecule_id").orderBy("frame")
    step = frames.select("molecule_id", (F.lead("donor_raw").over(by) - F.col("donor_raw")).alias("d"))
    assert exchanges(step) == 0 and {r.d for r in step.collect()} == {1.0, None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = again.windowed().groupBy("molecule_id").agg(F.sum("acceptor").alias("a"))
        assert exchanges(joined) == 0 and joined.count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges(frames.groupBy("frame").count()) == 1


def test_models_features_and_logs(spark, project):
    project.append_movies(*extraction(spark, "m"))
    m = project.table("molecules").select("molecule_id", "molecule_key", F.col("w0").alias("lo"), F.col("w1").alias("hi"), "alpha", "gamma", "correction_method")
    now = digests.input_digest(project.windowed(), m)
    paths = project.windowed().join(now, "molecule_id").join(m.select("molecule_id", "molecule_key"), "molecule_id").select("molecule_id", "molecule_key", F.col("hash").alias("input_hash"), "frame", (F.col("frame") % 2).alias("state"))
    project.write_model("b", paths, [0.2, 0.8], elbo=float("nan"), attrs={"note": 1}, quantity="corrected")
    project.write_model("a", paths, [0.2, 0.8], elbo=-3.5)
    assert project.models() == ["a", "b"]
    row, stored = project.model("b")
    assert (row.nstates, row.means, row.elbo, row.attrs, row.quantity, stored.count()) == (2, [0.2, 0.8], None, {"note": "1"}, "corrected", 12)
    assert stored.join(now, "molecule_id").filter("hash <> input_hash").isEmpty()
    with pytest.raises(FileExistsError):
        project.write_model("a", paths, [0.1, 0.9])
    project.write_model("a", paths.filter("frame > 1"), [0.1, 0.9], overwrite=True)
    assert project.model("a")[0].means == [0.1, 0.9] and project.model("a")[1].count() == 9
    with pytest.raises(KeyError):
        project.model("c")
    for bad in (paths.withColumn("input_hash", F.when(F.col("frame") > 1, F.col("input_hash"))), paths.unionByName(paths.limit(1)), paths.withColumn("state", F.lit(2))):
        with pytest.raises(ValueError, match="nothing was written"):
            project.write_model("c", bad, [0.2, 0.8])
    with pytest.raises(ValueError, match="override"):
        project.write_model("c", paths, [0.2, 0.8], attrs={"means": 1})
    assert project.models() == ["a", "b"]
    with pytest.raises(KeyError):
        project.features()
    project.write_features(m.select("molecule_id", "molecule_key", "gamma", "alpha"), ["gamma", "alpha"])
    assert project.feature_names() == ["gamma", "alpha"] and {(r.gamma, r.alpha) for r in project.features().collect()} == {(1.5, 0.1)}
    with pytest.raises(FileExistsError):
        project.write_features(m, ["alpha"])
    project.write_features(m, ["alpha"], overwrite=True)
    assert project.features().columns == ["molecule_id", "molecule_key", "alpha"]
    log = spark.createDataFrame([(1, "k", "human", 1)], "event_seq long, molecule_key string, source string, label_value int")
    assert project.append("labels", log, "first") and not project.append("labels", log, "first") and project.table("labels").count() == 1
    project.append("conditions", spark.createDataFrame([("x", "ab", float("nan")), ("y", "cd", 600.0)], "condition_id string, construct_variant string, laser_power double"), "first")
    assert {r.condition_id: (r.key.construct_variant, r.key.laser_power) for r in project.condition_keys().collect()} == {"x": ("ab", None), "y": ("cd", 600.0)}
    with pytest.raises(ValueError):
        project.append("frames", log, "x")


def test_subsets(spark, project, tmp_path):
    for k in range(2):
        project.append_movies(*extraction(spark, f"m{k}"), settings={"radius": 3.0})
    rejected = project.table("molecules").filter("molecule_id = 'm0-1'")
    assert rejected.count() == 1
    m = project.table("molecules")
    paths = project.windowed().join(m.select("molecule_id", "molecule_key"), "molecule_id").select("molecule_id", "molecule_key", F.lit("h").alias("input_hash"), "frame", F.lit(0).alias("state"))
    project.write_model("fine", paths, [0.5], quantity="corrected")
    project.write_model("of raw", paths, [0.5], quantity="raw")
    project.write_features(m.select("molecule_id", "molecule_key", "alpha"), ["alpha"])
    project.append("labels", spark.createDataFrame([(1, "key m0-0", 1), (2, "key m1-2", 1)], "event_seq long, molecule_key string, label_value int"), "log")
    project.append("conditions", spark.createDataFrame([("c1",)], "condition_id string"), "log")
    got = store.export_subset(project, f"file://{tmp_path}/part", ["key m0-0", "key m0-1"])
    got = store.open_project(spark, got.path)
    assert sorted(r.molecule_id for r in got.table("molecules").collect()) == ["m0-0", "m0-1"]
    assert [r.movie_id for r in got.table("movies").collect()] == ["m0"]
    f = got.table("frames").agg(F.count("*").alias("n"), F.count("donor_raw").alias("raw"), F.count("donor_corrected").alias("c")).first()
    assert tuple(f) == (12, 0, 12) and got.models() == ["fine"] and got.model("fine")[1].count() == 8
    assert [r.molecule_key for r in got.table("labels").collect()] == ["key m0-0"] and got.table("conditions").count() == 1 and got.settings() == {"radius": "3.0"}
    assert got.features().count() == 2
    whole = store.export_subset(project, f"file://{tmp_path}/whole", include_raw=True)
    assert whole.table("molecules").count() == 6 and whole.models() == ["fine", "of raw"] and whole.table("frames").filter("donor_raw IS NULL").isEmpty()
    with pytest.raises(KeyError):
        store.export_subset(project, f"file://{tmp_path}/none", ["key z"])
    with pytest.raises(FileExistsError):
        store.export_subset(project, whole.path)


def test_traces_without_a_movie_and_rebuilt_movies(spark, project):
    traces = spark.createDataFrame([(m, t, 1.0 + m, 2.0) for m in range(3) for t in range(5)], "molecule long, frame int, donor double, acceptor double")
    windows = spark.createDataFrame([(0, -2, 3), (1, 4, 99), (2, 4, 2)], "molecule long, w0 int, w1 int")
    assert store.import_traces(project, traces, "a.txt", "c9", windows) == "a.txt"
    got = {r.store_ord: r for r in project.table("molecules").collect()}
    assert {k: (r.w0, r.w1) for k, r in got.items()} == {0: (0, 3), 1: (4, 5), 2: (0, 5)}
    assert (got[0].movie_id, got[0].tags, got[0].condition_id, got[0].correction_confidence) == ("", [store.NO_COORDINATES], "c9", 0.0) and got[0].donor_x != got[0].donor_x
    assert project.table("frames").filter("donor_raw IS NOT NULL").isEmpty() and project.windowed().count() == 9
    for bad in ((traces, "a.txt"), (traces.filter("false"), "b.txt")):
        with pytest.raises(ValueError):
            store.import_traces(project, *bad)
    xy = spark.createDataFrame([(m, 10.0 * m, 5.0, 10.0 * m + 1, 6.0) for m in range(3)], "molecule long, donor_x double, donor_y double, acceptor_x double, acceptor_y double")
    movie = store.Row(movie_id="mov", sha256="ff", n_frames=5)
    store.with_coordinates(project, traces, xy, movie, (0.1, 1.2), "c1")
    rows = {r.molecule_id: r for r in project.table("molecules").filter("movie_id = 'mov'").collect()}
    assert len(rows) == 3 and (rows["mov#1"].store_ord, rows["mov#1"].alpha, rows["mov#1"].correction_method, rows["mov#1"].acceptor_x) == (4, 0.1, "corrected", 11.0)
    assert len({r.molecule_key for r in rows.values()}) == 3
    other = store.Row(movie_id="two", sha256="fe", n_frames=5)
    store.with_coordinates(project, traces, xy, other, (0.1, -1.0))
    assert {r.correction_method for r in project.table("molecules").filter("movie_id = 'two'").collect()} == {"apparent-E (corrections unavailable)"}
    for t, c, m in ((traces, xy.filter("molecule > 0"), store.Row(movie_id="x", sha256="", n_frames=5)), (traces, xy, store.Row(movie_id="x", sha256="", n_frames=6))):
        with pytest.raises(ValueError):
            store.with_coordinates(project, t, c, m)
