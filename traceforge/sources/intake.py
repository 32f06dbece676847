"""Which files of a folder belong together, by their names alone: nothing is opened."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import parsed_names
from ..operators.stored import CONDITION_FIELDS, canonical_condition, condition_id

#: What a file is by its last extension, without case.
ROLES = {"tif": "movie", "tiff": "movie", "tdat": "tdat", "tmap": "tmap", "mat": "mat", "txt": "txt", "hdf5": "smd", "h5": "smd"}
#: Roles of which an acquisition has one file each, found by the stem they share.
OWN = ("movie", "tdat", "mat", "txt")


def listed(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path of all files in a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")


@dataclass
class Discovery:
    """acquisitions: key, condition_id, video_index, movie, tdat, mat, txt, smd (paths), shared_maps, warnings. others: path, kind (map,
    ignored, unpaired)."""

    acquisitions: DataFrame
    others: DataFrame


def classified(files: DataFrame) -> DataFrame:
    """path, role (unknown for other extensions), stem, condition_id, video_index."""
    named = parsed_names(files.select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name")), with_stem=True)
    fields = {n: F.col(n) if n in named.columns else F.lit(None).cast("double") for n, _ in CONDITION_FIELDS}
    ext = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), ext), F.lit("unknown"))
    return named.select("path", role.alias("role"), "stem", condition_id(canonical_condition(fields)).alias("condition_id"), "video_index")


def discover(files: DataFrame) -> Discovery:
    """Acquisitions of ``files`` (path): movies, coordinate sources and text files of one stem. Of several files of one role the first by
    path counts, with a warning. Maps belong to all acquisitions of their condition; a model file to that of its stem, else to the
    only one with its video index, else to none; the first by path counts, others are unpaired. Unknown files are listed."""
    f = classified(files)
    own = f.filter(F.col("role").isin(*OWN))
    of = lambda r: F.when(F.col("role") == r, F.col("path"))
    groups = own.groupBy(F.col("stem").alias("key")).agg(
        F.min_by("condition_id", "path").alias("condition_id"), F.min_by("video_index", "path").alias("video_index"), *[F.min(of(r)).alias(r) for r in OWN], *[F.array_sort(F.collect_list(of(r))).alias(f"__{r}") for r in OWN]
    )
    name = lambda p: F.regexp_extract(p, r"[^/]*$", 0)
    several = lambda r: F.when(F.size(f"__{r}") > 1, F.concat(F.lit(f"several {r} files: "), F.concat_ws(", ", F.transform(f"__{r}", name)), F.lit("; using "), name(F.col(r))))
    sources = F.col("tdat").isNotNull() | F.col("mat").isNotNull()
    told = [*map(several, OWN), F.when(F.col("movie").isNull() & sources, "no movie: no way back from traces to it"), F.when(F.col("movie").isNotNull() & ~sources, "no source of coordinates: traces only")]
    groups = groups.withColumn("warnings", F.filter(F.array(*told), lambda w: w.isNotNull())).drop(*[f"__{r}" for r in OWN])
    maps = f.filter("role = 'tmap'")
    groups = groups.join(maps.groupBy("condition_id").agg(F.array_sort(F.collect_list("path")).alias("shared_maps")), "condition_id", "left")
    smd = f.filter("role = 'smd'").select("path", F.col("stem"), "video_index")
    alone = groups.filter("video_index <> ''").groupBy("video_index").agg(F.count("*").alias("n"), F.first("key").alias("by_video")).filter("n = 1").drop("n")
    placed = smd.join(groups.select(F.col("key").alias("by_stem")), F.col("stem") == F.col("by_stem"), "left").join(alone, "video_index", "left").select("path", F.coalesce("by_stem", "by_video").alias("key"))
    first = placed.filter("key IS NOT NULL").groupBy("key").agg(F.min("path").alias("smd"))
    got = groups.join(first, "key", "left").select("key", "condition_id", "video_index", *OWN, "smd", F.coalesce("shared_maps", F.array().cast("array<string>")).alias("shared_maps"), "warnings")
    others = maps.select("path", F.lit("map").alias("kind")).unionByName(f.filter("role = 'unknown'").select("path", F.lit("ignored").alias("kind")))
    lone = placed.join(first.select(F.col("smd").alias("path")), "path", "left_anti").select("path", F.lit("unpaired").alias("kind"))
    return Discovery(got, others.unionByName(lone))
