"""Projects as stored tables: traces, molecules, fits, features, labels and conditions in Parquet, bucketed by molecule.

Tables that are keyed by molecule lie in the same number of buckets of the molecule's id, so a window over a molecule's frames
and a join of frames, molecules and fits read bucket by bucket and need no shuffle, whatever the number of appends.

Rows come in batches (a movie, a model, a part of a log), each a folder of every table it has rows in. A batch is written to a
staging folder and moved into place; the table that names the batch comes last and commits it, and what a failed append has
left is not read and goes with the next try. Moving a folder is one step on file systems that can rename.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import NO_STATE

#: The marker and the version of the layout.
FORMAT, VERSION = "traceforge-project", 1
APP_VERSION = "0.3"
_KEY = "molecule_id string, molecule_key string"
LAYERS = ("donor_raw", "acceptor_raw", "donor_corrected", "acceptor_corrected", "donor_background", "acceptor_background")
#: The tables and their columns. Those of BUCKETED lie in buckets of molecule_id, sorted by what is named there.
TABLES = {
    "movies": "movie_id string, uri string, sha256 string, n_frames int, height int, width int, frame_time double, calibration_id string",
    "molecules": f"store_ord long, {_KEY}, movie_id string, donor_x double, donor_y double, acceptor_x double, acceptor_y double, n int, w0 int, w1 int, donor_bleach int, acceptor_bleach int, "
    "alpha double, gamma double, delta double, correction_method string, correction_confidence double, label int, category string, quality_class double, condition_id string, source_filename string, tags array<string>",
    "frames": "molecule_id string, frame int, " + ", ".join(f"{x} float" for x in LAYERS),
    "patches": "molecule_id string, channel string, patch array<double>",
    "models": "model_name string, type string, nstates int, means array<double>, variances array<double>, frac array<double>, tmatrix array<array<double>>, elbo double, quantity string, selected_by string, app_version string, attrs map<string, string>",
    "state_paths": f"model_name string, {_KEY}, input_hash string, frame int, state int",
    "features": f"{_KEY}, feature_values array<double>",
    "labels": "event_seq long, molecule_key string, labeler string, timestamp string, source_file string, source string, weight double, label_value int, condition_id string",
    "conditions": "condition_id string, construct_variant string, dye string, ligand string, ligand_concentration double, ligand_concentration_unit string, buffer string, temperature_c double, laser_power double, date string, replicate string, leakage_alpha double, leakage_alpha_source string, tags string",
    "settings": "name string, value string",
    "audit": "event_seq long, action string, subject string, detail string",
}
BUCKETED = {"molecules": ("molecule_id",), "frames": ("molecule_id", "frame"), "patches": ("molecule_id",), "state_paths": ("molecule_id", "frame"), "features": ("molecule_id",)}
#: Columns of a model's row that its attrs can't name.
RESERVED = {c.split()[0] for c in TABLES["models"].split(", ") if not c.startswith("string>")} - {"attrs"}


class _Files:
    """Files of the store, by the file system of its path."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(*parts))) if self.exists(*parts) else []

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.at(*parts), True)

    def write(self, text: str, *parts: str) -> None:
        out = self.fs.create(self.at(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.at(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def move(self, source, target) -> None:
        if not self.fs.rename(source, target):
            raise OSError(f"cannot move {source} to {target}")


def _unescaped(folder: str) -> str:
    from urllib.parse import unquote

    return unquote(folder.removeprefix("batch="))


@dataclass(frozen=True)
class Project:
    """An open project. ``table`` reads, the other methods append; nothing is read before it is asked for."""

    spark: SparkSession
    path: str
    buckets: int
    version: int

    @property
    def files(self) -> _Files:
        return _Files(self.spark, self.path)

    # reading

    def batches(self, name: str) -> list[str]:
        """Names of the batches of a table, sorted."""
        return sorted(_unescaped(x) for x in self.files.names(name) if x.startswith("batch="))

    def _catalog_name(self, name: str) -> str:
        import hashlib

        return f"traceforge_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_{name}"

    def table(self, name: str) -> DataFrame:
        """All committed rows of a table, with the column batch.

        Tables keyed by molecule keep their buckets, so neither a window nor a join by molecule_id shuffles them."""
        if name not in TABLES:
            raise KeyError(name)
        if not self.batches(name):
            return self.spark.createDataFrame([], f"{TABLES[name]}, batch string")
        own = self._catalog_name(name)
        layout = f"CLUSTERED BY (molecule_id) SORTED BY ({', '.join(BUCKETED[name])}) INTO {self.buckets} BUCKETS" if name in BUCKETED else ""
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {own} ({TABLES[name]}, batch string) USING parquet PARTITIONED BY (batch) {layout} LOCATION '{self.path}/{name}'")
        self.spark.sql(f"MSCK REPAIR TABLE {own} SYNC PARTITIONS")
        rows = self.spark.table(own)
        head = {"molecules": "movies", "frames": "movies", "patches": "movies", "state_paths": "models"}.get(name)
        if head:
            open_ = sorted(set(self.batches(name)) - set(self.batches(head)))
            rows = rows.filter(~F.col("batch").isin(open_)) if open_ else rows  # left by an append that failed
        return rows

    def windowed(self, quantity: str = "corrected", include_rejected: bool = False) -> DataFrame:
        """The frames of each molecule's window with donor and acceptor of ``quantity``, and condition_id, label, movie_id, t."""
        from ..operators.select import windowed
        from ..operators.stored import resolve_quantity

        donor, acceptor = resolve_quantity(quantity)
        frames = self.table("frames").select("molecule_id", "frame", F.col(donor).cast("double").alias("donor"), F.col(acceptor).cast("double").alias("acceptor"))
        return windowed(frames, self.table("molecules").select("molecule_id", "movie_id", "condition_id", "label", "n", "w0", "w1"), include_rejected)

    def condition_keys(self) -> DataFrame:
        """condition_id, key: a struct of the identity fields; NaN numbers are null."""
        from ..operators.stored import CONDITION_FIELDS

        c = self.table("conditions")
        field = lambda n: F.when(~F.isnan(n), F.col(n)) if dict(c.dtypes)[n] == "double" else F.col(n)
        return c.select("condition_id", F.struct(*[field(n).alias(n) for n, _ in CONDITION_FIELDS]).alias("key"))

    def models(self) -> list[str]:
        """Names of the models, sorted."""
        return self.batches("models")

    def model(self, name: str) -> tuple[Row, DataFrame]:
        """A model's row and its state paths; KeyError without it."""
        if name not in self.models():
            raise KeyError(name)
        own = F.col("batch") == name
        return self.table("models").filter(own).drop("batch").first(), self.table("state_paths").filter(own).drop("batch")

    def feature_names(self) -> list[str]:
        """Names of the stored features in the order of their values; KeyError if none were stored."""
        if "features" not in self.batches("settings"):
            raise KeyError("features")
        got = self.table("settings").filter("batch = 'features' AND name = 'names'").first()
        return json.loads(got["value"])

    def features(self) -> DataFrame:
        """molecule_id, molecule_key and a column for each stored feature."""
        names = self.feature_names()
        return self.table("features").select("molecule_id", "molecule_key", *[F.col("feature_values")[k].alias(n) for k, n in enumerate(names)])

    def settings(self) -> dict[str, str]:
        """The extraction's settings, those of the first movie; all others had the same."""
        if "extraction" not in self.batches("settings"):
            return {}
        return {r["name"]: r["value"] for r in self.table("settings").filter("batch = 'extraction'").collect()}

    # writing

    def _staged(self, stage: str, name: str, rows: DataFrame, batch: str) -> None:
        wanted = [c.split()[0] for c in self.spark.createDataFrame([], TABLES[name]).columns]
        kinds = dict(self.spark.createDataFrame([], TABLES[name]).dtypes)
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in wanted], F.lit(batch).alias("batch"))
        to = f"{self.path}/_staging/{stage}/{name}"
        if name not in BUCKETED:
            rows.coalesce(1).write.partitionBy("batch").parquet(to)
            return
        own = f"traceforge_stage_{stage}_{name}"
        rows = rows.repartition(self.buckets, "molecule_id")
        rows.write.format("parquet").option("path", to).partitionBy("batch").bucketBy(self.buckets, "molecule_id").sortBy(*BUCKETED[name]).saveAsTable(own)
        self.spark.sql(f"DROP TABLE {own}")  # the files stay, they have a path of their own

    def _commit(self, parts: Sequence[tuple[str, DataFrame]], batch: str) -> None:
        """Stages all parts, then moves them into place in the given order; the last commits."""
        files, stage = self.files, uuid.uuid4().hex
        try:
            for name, rows in parts:
                self._staged(stage, name, rows, batch)
            for name, _ in parts:
                for folder in files.names("_staging", stage, name):
                    if folder.startswith("batch="):
                        files.delete(name, folder)  # of an append that failed, or of what is replaced
                        files.move(files.at("_staging", stage, name, folder), files.at(name, folder))
        finally:
            files.delete("_staging", stage)

    def append(self, name: str, rows: DataFrame, batch: str) -> bool:
        """Appends a batch of a table that stands alone (labels, conditions, audit, settings); false, and nothing is written, if
        the batch is there already: the same call can be made again."""
        if name in ("movies", "models", "features") or name in BUCKETED:
            raise ValueError(f"{name} is written with what belongs to it")
        if batch in self.batches(name):
            return False
        self._commit([(name, rows)], batch)
        return True

    def append_movies(self, movies: DataFrame, molecules: DataFrame, frames: DataFrame, patches: DataFrame | None = None, settings: dict | None = None, batch: str | None = None) -> str:
        """Appends extracted movies, all or none; the batch's name is that of the one movie unless given.

        ValueError, before anything is written, if a movie or a molecule is there already, if molecules and frames don't belong
        together (a molecule of no movie, without frames or twice; frames without a molecule, twice or beyond the movie's
        length; a trace that is zero in all frames) or if settings differ from those of the first extraction."""
        ids = [r["movie_id"] for r in movies.select("movie_id").collect()]
        batch = batch or (ids[0] if len(ids) == 1 else None)
        if not batch or len(set(ids)) != len(ids):
            raise ValueError("a batch needs a name and distinct movies")
        known = self.table("movies").filter(F.col("movie_id").isin(ids)).first() if self.batches("movies") else None
        if known or batch in self.batches("movies"):
            raise ValueError(f"movie already stored: {known['movie_id'] if known else batch}")
        self._check_settings(settings)
        self._check_rows(movies, molecules, frames)
        parts = [("frames", frames), *([("patches", patches)] if patches is not None else []), ("molecules", molecules), ("movies", movies)]
        if settings and "extraction" not in self.batches("settings"):
            self.append("settings", self.spark.createDataFrame([(k, str(v)) for k, v in settings.items()], TABLES["settings"]), "extraction")
        self._commit(parts, batch)
        return batch

    def _check_settings(self, settings: dict | None) -> None:
        first = self.settings()
        apart = {k: (first[k], v) for k, v in (settings or {}).items() if k in first and not math.isclose(float(first[k]), float(v), rel_tol=1e-5, abs_tol=1e-8)}
        if apart:
            raise ValueError(f"settings differ from the first extraction's: {apart}")

    def _check_rows(self, movies: DataFrame, molecules: DataFrame, frames: DataFrame) -> None:
        m = molecules.select("molecule_id", "movie_id").join(movies.select("movie_id", F.col("n_frames").alias("__most"), F.lit(True).alias("__in")), "movie_id", "left")
        m = m.groupBy("molecule_id").agg(F.count("*").alias("rows"), F.first("__in").alias("in_movie"), F.first("__most").alias("most"))
        dark = F.lit(True)
        for layer in ("donor", "acceptor"):
            dark = dark & (F.coalesce(F.col(f"{layer}_raw"), F.lit(0.0)) == 0)
        t = frames.groupBy("molecule_id").agg(F.count("*").alias("n"), F.countDistinct("frame").alias("d"), F.min("frame").alias("lo"), F.max("frame").alias("hi"), F.min(dark.cast("int")).alias("dark"))
        both = m.join(t, "molecule_id", "full")
        faults = {
            "molecules that are there twice": F.col("rows") > 1, "molecules of no movie": F.col("rows").isNotNull() & F.col("in_movie").isNull(), "molecules without frames": F.col("n").isNull(),
            "frames without a molecule": F.col("rows").isNull(), "frames that are there twice": F.col("n") > F.col("d"), "frames out of the movie": (F.col("lo") < 0) | (F.col("hi") >= F.col("most")), "traces that are zero": F.col("dark") == 1,
        }
        got = both.agg(*[F.count_if(c).alias(k) for k, c in faults.items()]).first().asDict()
        if self.batches("molecules"):
            got["molecules that are stored already"] = molecules.select("molecule_id").join(self.table("molecules").select("molecule_id"), "molecule_id", "left_semi").count()
        found = {k: v for k, v in got.items() if v}
        if found:
            raise ValueError(f"refused, nothing was written: {found}")

    def write_model(self, name: str, paths: DataFrame, means: Sequence[float], kind: str = "threshold", overwrite: bool = False, attrs: dict | None = None, **fields) -> None:
        """Stores a fit: its row and the state paths (molecule_id, molecule_key, input_hash, frame, state) it gave.

        FileExistsError if there is one of that name and ``overwrite`` is false. ValueError if a molecule has several keys or
        hashes or none, or a frame twice, or a state isn't one of the model's, or attrs name a column. A bound that isn't
        finite is stored as missing."""
        if name in self.models() and not overwrite:
            raise FileExistsError(name)
        clash = sorted(RESERVED & set(attrs or {}))
        if clash:
            raise ValueError(f"attrs can't override {clash}")
        one = lambda c: (F.count_distinct(c) != 1) | (F.count(c) != F.count("*"))
        state = F.col("state")
        per = paths.groupBy("molecule_id").agg((one("molecule_key") | one("input_hash") | (F.count_distinct("frame") != F.count("*"))).alias("odd"), F.count_if((state != NO_STATE) & ((state < 0) | (state >= len(means)))).alias("out"))
        odd = per.agg(F.count_if("odd").alias("odd"), F.count_if(F.col("out") > 0).alias("out")).first()
        if odd["odd"] or odd["out"]:
            raise ValueError(f"refused, nothing was written: {odd['odd']} molecules that aren't aligned, {odd['out']} with states of no mean")
        elbo = fields.pop("elbo", None)
        row = {"model_name": name, "type": kind, "nstates": len(means), "means": [float(x) for x in means], "elbo": elbo if elbo is not None and math.isfinite(elbo) else None, "app_version": APP_VERSION, "attrs": {k: str(v) for k, v in (attrs or {}).items()}, **fields}
        unknown = sorted(set(row) - RESERVED - {"attrs"})
        if unknown:
            raise ValueError(f"no such columns: {unknown}")
        head = self.spark.createDataFrame([Row(**{c: row.get(c) for c in self.spark.createDataFrame([], TABLES["models"]).columns})], TABLES["models"])
        files = self.files
        # until the new row is in place the name has no model: never a model with the paths of another
        parts = [("state_paths", paths.withColumn("model_name", F.lit(name))), ("models", head)]
        if name in self.models():
            for folder in files.names("models"):
                if folder.startswith("batch=") and _unescaped(folder) == name:
                    files.delete("models", folder)
        self._commit(parts, name)

    def write_features(self, rows: DataFrame, names: Sequence[str], overwrite: bool = False) -> None:
        """Stores columns ``names`` of rows (molecule_id, molecule_key, ...) as doubles, in that order; FileExistsError if features
        are stored and ``overwrite`` is false."""
        if "features" in self.batches("settings") and not overwrite:
            raise FileExistsError("features")
        self.files.delete("settings", "batch=features")
        listed = self.spark.createDataFrame([("names", json.dumps(list(names)))], TABLES["settings"])
        values = F.array(*[F.col(n).cast("double") for n in names])
        self._commit([("features", rows.select("molecule_id", "molecule_key", values.alias("feature_values"))), ("settings", listed)], "features")


def create_project(spark: SparkSession, path: str, buckets: int = 64, overwrite: bool = False) -> Project:
    """A new project without rows. FileExistsError if something is there and ``overwrite`` is false.

    ``buckets``: parts of the tables keyed by molecule; a window over them runs in as many tasks, so take it for the size the
    project is to have."""
    if buckets < 1:
        raise ValueError("buckets must be positive")
    files = _Files(spark, path)
    if files.exists():
        if not overwrite:
            raise FileExistsError(path)
        files.delete()
    for name, columns in TABLES.items():
        files.write(columns, name, "_columns")
    files.write(json.dumps({"format": FORMAT, "schema_version": VERSION, "app_version": APP_VERSION, "buckets": buckets}), "project.json")
    return Project(spark, path.rstrip("/"), buckets, VERSION)


def open_project(spark: SparkSession, path: str) -> Project:
    """The project in ``path``. ValueError, in this order: if it can't be read, hasn't our marker, has no version, lacks a table, or
    is newer than this library."""
    files = _Files(spark, path)
    try:
        head = json.loads(files.read("project.json"))
    except Exception as e:  # whatever the file system says
        raise ValueError(f"{path} is not a readable project") from e
    if not isinstance(head, dict) or head.get("format") != FORMAT:
        raise ValueError(f"{path} is not a project (marker {head.get('format') if isinstance(head, dict) else None!r})")
    if head.get("schema_version") is None:
        raise ValueError(f"{path} has no schema version")
    missing = [n for n in TABLES if not files.exists(n, "_columns")]
    if missing:
        raise ValueError(f"{path} is not complete; missing: {', '.join(missing)}")
    if int(head["schema_version"]) > VERSION:
        raise ValueError(f"{path} has version {head['schema_version']}, newer than {VERSION}")
    return Project(spark, path.rstrip("/"), int(head["buckets"]), int(head["schema_version"]))


#: Tag of molecules that came without positions.
NO_COORDINATES = "no-coordinates"


def export_subset(project: Project, path: str, molecule_keys: Sequence[str] | None = None, include_rejected: bool = False, include_raw: bool = False, overwrite: bool = False) -> Project:
    """A new project of the chosen molecules with their corrected (and raw) layers, patches, features, the models' paths of them and the
    labels of their keys; conditions, settings and the audit come whole. Movies come without their files' place: a subset has none.

    ``molecule_keys``: all rows of these keys; KeyError if one is unknown (a key of rejected rows only is known). Models whose layers
    aren't exported are left out. One join per table by molecule, bucket by bucket."""
    own = project.table("molecules")
    if molecule_keys is not None:
        keys = project.spark.createDataFrame([(k,) for k in dict.fromkeys(map(str, molecule_keys))], "molecule_key string")
        lost = sorted(r["molecule_key"] for r in keys.join(own.select("molecule_key"), "molecule_key", "left_anti").collect())
        if lost:
            raise KeyError(f"no molecule with these keys: {lost}")
        own = own.join(F.broadcast(keys), "molecule_key", "left_semi")  # the caller's list
    if not include_rejected:
        own = own.filter("label <> -1")
    ids, of_keys = own.select("molecule_id"), own.select("molecule_key").distinct()
    made = create_project(project.spark, path, project.buckets, overwrite)
    chosen = lambda name: project.table(name).drop("batch").join(ids, "molecule_id", "left_semi")
    frames = chosen("frames")
    if not include_raw:
        frames = frames.withColumns({x: F.lit(None).cast("float") for x in LAYERS if not x.endswith("_corrected")})
    movies = project.table("movies").drop("batch").join(own.select("movie_id").distinct(), "movie_id", "left_semi").withColumn("uri", F.lit(None).cast("string"))
    parts = [("frames", frames), ("patches", chosen("patches")), ("molecules", own.drop("batch")), ("movies", movies)]
    made._commit(parts, "subset")
    for name in project.models():
        row, paths = project.model(name)
        if row["quantity"] == "raw" and not include_raw:
            continue
        made._commit([("state_paths", paths.join(ids, "molecule_id", "left_semi")), ("models", project.table("models").filter(F.col("batch") == name).drop("batch"))], name)
    if "features" in project.batches("settings"):
        names = project.feature_names()
        made.write_features(project.features().join(ids, "molecule_id", "left_semi"), names)
    made.append("labels", project.table("labels").drop("batch").join(of_keys, "molecule_key", "left_semi"), "subset")
    for name in ("conditions", "audit"):
        made.append(name, project.table(name).drop("batch"), "subset")
    first = project.settings()
    if first:
        made.append("settings", project.spark.createDataFrame(list(first.items()), TABLES["settings"]), "extraction")
    return made


def import_traces(project: Project, traces: DataFrame, source: str, condition_id: str = "", windows: DataFrame | None = None) -> str:
    """Appends traces that came without a movie (molecule, frame, donor, acceptor; molecule counts from 0) as one batch named ``source``:
    corrected layers only, no positions, an empty movie_id, the tag NO_COORDINATES, apparent efficiencies.

    Windows (molecule, w0, w1) are cut to the trace; one that is empty then is the whole trace. ValueError if the batch is there already
    or holds no frame. Keys are digests of the source and the molecule's number."""
    if source in project.batches("movies"):
        raise ValueError(f"already stored: {source}")
    n = traces.groupBy("molecule").agg((F.max("frame") + 1).cast("int").alias("n"))
    if n.isEmpty():
        raise ValueError("no frames")
    ident = F.concat(F.lit(f"{source}#"), F.col("molecule").cast("string"))
    rows = n.withColumns({"w0": F.lit(0), "w1": F.col("n")}) if windows is None else n.join(windows.select("molecule", F.greatest(F.lit(0), "w0").cast("int").alias("w0"), F.col("w1").cast("int").alias("w1")), "molecule", "left")
    end = F.least("n", "w1")
    fine = F.coalesce(end > F.col("w0"), F.lit(False))
    offset = project.table("molecules").agg(F.coalesce(F.max("store_ord") + 1, F.lit(0)).alias("n")).first()["n"]
    molecules = rows.select(
        (F.col("molecule") + offset).cast("long").alias("store_ord"), ident.alias("molecule_id"), F.sha2(ident, 256).alias("molecule_key"), F.lit("").alias("movie_id"), "n", F.when(fine, F.col("w0")).otherwise(0).alias("w0"), F.when(fine, end).otherwise(F.col("n")).alias("w1"),
        *[F.lit(float("nan")).alias(c) for c in ("donor_x", "donor_y", "acceptor_x", "acceptor_y")], F.lit("apparent-E (corrections unavailable)").alias("correction_method"), F.lit(0.0).alias("correction_confidence"), F.lit(0).alias("label"),
        F.lit(condition_id).alias("condition_id"), F.lit(source).alias("source_filename"), F.array(F.lit(NO_COORDINATES)).alias("tags"),
    )
    frames = traces.select(ident.alias("molecule_id"), "frame", F.col("donor").alias("donor_corrected"), F.col("acceptor").alias("acceptor_corrected"))
    movie = project.spark.createDataFrame([("",)], "movie_id string").withColumn("n_frames", F.lit(n.agg(F.max("n").alias("n")).first()["n"]))
    project._commit([("frames", frames), ("molecules", molecules), ("movies", movie)], source)
    return source


def with_coordinates(project: Project, traces: DataFrame, coordinates: DataFrame, movie: Row, factors: tuple[float, float] | None = None, condition_id: str = "") -> str:
    """Appends a movie rebuilt from an analysis: traces (molecule, frame, donor, acceptor) and coordinates (molecule, donor_x, donor_y,
    acceptor_x, acceptor_y) joined by the molecule's number, which both must have alike; ``movie`` has movie_id, sha256, n_frames.

    Leakage and gamma are taken over if both are finite and gamma is positive, and the molecules are corrected then. ValueError if the
    numbers differ or a trace hasn't the movie's length."""
    from ..functions.scalar import molecule_key

    n = traces.groupBy("molecule").agg(F.count("*").alias("n"))
    both = n.join(coordinates.select("molecule", F.lit(True).alias("at")), "molecule", "full")
    odd = both.agg(F.count_if(F.col("n").isNull() | F.col("at").isNull()).alias("apart"), F.count_if(F.col("n") != movie["n_frames"]).alias("length")).first()
    if odd["apart"] or odd["length"]:
        raise ValueError(f"{odd['apart']} molecules have no partner, {odd['length']} traces another length than the movie")
    good = factors is not None and all(map(math.isfinite, factors)) and factors[1] > 0
    alpha, gamma = (F.lit(float(x)) for x in factors) if good else (F.lit(float("nan")), F.lit(float("nan")))
    ident = F.concat(F.lit(f"{movie['movie_id']}#"), F.col("molecule").cast("string"))
    offset = project.table("molecules").agg(F.coalesce(F.max("store_ord") + 1, F.lit(0)).alias("n")).first()["n"]
    molecules = coordinates.select(
        (F.col("molecule") + offset).cast("long").alias("store_ord"), ident.alias("molecule_id"), molecule_key(F.lit(movie["sha256"]), F.col("donor_x"), F.col("donor_y")).alias("molecule_key"), F.lit(movie["movie_id"]).alias("movie_id"), "donor_x", "donor_y", "acceptor_x", "acceptor_y",
        F.lit(movie["n_frames"]).alias("n"), F.lit(0).alias("w0"), F.lit(movie["n_frames"]).alias("w1"), alpha.alias("alpha"), gamma.alias("gamma"), F.lit(0.0).alias("delta"), F.lit("corrected" if good else "apparent-E (corrections unavailable)").alias("correction_method"),
        F.lit(1.0 if good else 0.0).alias("correction_confidence"), F.lit(0).alias("label"), F.lit(condition_id).alias("condition_id"), F.lit(movie["movie_id"]).alias("source_filename"),
    )
    frames = traces.select(ident.alias("molecule_id"), "frame", *[F.col(c).alias(f"{c}_{q}") for q in ("raw", "corrected") for c in ("donor", "acceptor")])
    head = project.spark.createDataFrame([(movie["movie_id"], movie["sha256"], movie["n_frames"])], "movie_id string, sha256 string, n_frames int")
    return project.append_movies(head, molecules, frames)
