"""Trace tables as text: readers of trace matrices and level traces, the molecule table and the trace matrix to write."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import decimal_text
from ..functions.scalar import ACCEPT, REJECT, UNCURATED, apparent_efficiency

#: The columns of the molecule table.
MOLECULE_COLUMNS = (
    "molecule_id", "molecule_key", "movie_id", "source_filename", "condition_id", "condition_id_provisional", "curation_label", "category", "quality_class", "aperture_id",
    "alpha", "gamma", "delta", "correction_method", "correction_confidence", "donor_bleach_frame", "acceptor_bleach_frame", "frame_start", "frame_end", "window_start", "window_end",
    "tags", "n_finite_frames", "mean_apparent_e", "median_apparent_e",
)
_FLOATS = ("quality_class", "alpha", "gamma", "delta", "correction_confidence", "mean_apparent_e", "median_apparent_e")
_PLACE = ("_metadata.file_path AS file", "_metadata.file_block_start AS __at")
_LEVEL_SCHEMA = "t double, idd double, ida double, iaa double, e double"


def _in_order():
    """Rows of a file in the file's order: blocks lie in order, and within a block ids rise from row to row."""
    return W.partitionBy("file").orderBy("__at", "__id")


def read_trace_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, molecule, frame, donor, acceptor of text files of a row a frame and two columns (donor, acceptor) a molecule.

    Blank lines and what follows # don't count. An odd number of columns, rows of unequal length and text that isn't a
    number are errors. One file is one movie and is numbered in one task."""
    words = F.split(F.btrim(F.regexp_replace("value", "#.*", "")), r"\s+")
    rows = spark.read.text(path).select(*map(F.expr, _PLACE), F.monotonically_increasing_id().alias("__id"), words.alias("c")).filter("c[0] <> ''")
    whole = W.partitionBy("file")
    rows = rows.withColumn("frame", F.row_number().over(_in_order()) - 1).withColumn("most", F.max(F.size("c")).over(whole))
    fault = F.when(F.size("c") != F.col("most"), F.raise_error(F.concat(F.lit("rows of unequal length in "), "file"))).when(F.size("c") % 2 == 1, F.raise_error(F.concat(F.lit("odd number of columns in "), "file"))).otherwise(F.size("c"))
    rows = rows.withColumn("n", fault.cast("int"))
    each = rows.select("file", "frame", "c", F.explode(F.sequence(F.lit(0), (F.col("n") / 2).cast("int") - 1)).alias("molecule"))
    value = lambda k: F.get(F.col("c"), 2 * F.col("molecule") + k).cast("double")
    return each.select("file", "molecule", "frame", value(0).alias("donor"), value(1).alias("acceptor"))


def read_level_traces(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, t, idd, ida, iaa, e, frame_time of tab-separated files of five columns, one trace a file; lines that
    begin with % don't count. Other numbers of columns and files of fewer than two frames are errors."""
    rows = spark.read.csv(path, sep="\t", comment="%", schema=_LEVEL_SCHEMA, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=True)
    rows = rows.select(*map(F.expr, _PLACE), F.monotonically_increasing_id().alias("__id"), "*")
    whole = _in_order().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    step = F.when(F.count("*").over(whole) < 2, F.raise_error(F.concat(F.lit("fewer than two frames in "), "file"))).otherwise(F.nth_value("t", 2).over(whole) - F.first("t").over(whole))
    return rows.select("file", (F.row_number().over(_in_order()) - 1).alias("frame"), "t", "idd", "ida", "iaa", "e", step.cast("double").alias("frame_time"))


def float_cell(x: Column) -> Column:
    """A number as the shortest text that reads back as the same double, empty for null and what isn't finite."""
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(fine, decimal_text(x)).otherwise("")


def label_text(label: Column) -> Column:
    return F.when(label == ACCEPT, "accept").when(label == UNCURATED, "uncurated").when(label == REJECT, "reject").otherwise(label.cast("string"))


def efficiency_summary(molecules: DataFrame, frames: DataFrame, include_rejected: bool = True) -> DataFrame:
    """Molecules with window_start, window_end (the analysis window w0, w1; where it's empty the range frame_start, frame_end, or
    all n frames without such columns) and n_finite_frames, mean_apparent_e, median_apparent_e over it; null where no frame is
    defined. The median is exact and taken within a molecule."""
    m = molecules.filter(F.lit(include_rejected) | (F.col("label") != REJECT))
    unset = F.col("w1") <= F.col("w0")
    start, end = (F.col("frame_start"), F.col("frame_end")) if {"frame_start", "frame_end"} <= set(m.columns) else (F.lit(0), F.col("n"))
    m = m.withColumn("window_start", F.when(unset, start).otherwise(F.col("w0"))).withColumn("window_end", F.when(unset, end).otherwise(F.col("w1")))
    inside = frames.join(m.select("molecule_id", "window_start", "window_end"), "molecule_id").filter("frame >= window_start AND frame < window_end")
    e = apparent_efficiency(F.col("donor"), F.col("acceptor"))
    per = inside.select("molecule_id", F.when(~F.isnan(e), e).alias("e")).groupBy("molecule_id").agg(F.count("e").alias("n_finite_frames"), F.avg("e").alias("mean_apparent_e"), F.median("e").alias("median_apparent_e"))
    return m.join(per, "molecule_id", "left").fillna(0, ["n_finite_frames"])


def molecule_table(summary: DataFrame) -> DataFrame:
    """The 25 columns of the molecule table as text, one row a molecule of efficiency_summary; columns it lacks are empty."""

    def cell(name: str) -> Column:
        if name == "curation_label":
            return label_text(F.col("label")).alias(name)
        if name not in summary.columns:
            return F.lit("").alias(name)
        return (float_cell(F.col(name).cast("double")) if name in _FLOATS else F.coalesce(F.col(name).cast("string"), F.lit(""))).alias(name)

    return summary.select(*[cell(n) for n in MOLECULE_COLUMNS])


def trace_matrix(molecules: DataFrame, frames: DataFrame, order: str = "molecule_id") -> DataFrame:
    """frame, line: one line a frame with donor and acceptor of each molecule in turn, five decimals, in the order of
    ``order``. All molecules must have the same number of frames; a line holds one movie's molecules."""
    n = molecules.agg(F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if n["lo"] is None or n["lo"] != n["hi"]:
        raise ValueError("the molecules must be some and share one range of frames")
    pair = F.struct(F.col(order).alias("o"), F.format_string("%.5f %.5f", "donor", "acceptor").alias("v"))
    keys = ["molecule_id"] if order == "molecule_id" else ["molecule_id", order]
    rows = frames.join(molecules.select(*keys), "molecule_id").filter(F.col("frame") < n["lo"])
    return rows.groupBy("frame").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(pair)), lambda s: s["v"])).alias("line"))


def write_trace_matrix(matrix: DataFrame, path: str) -> None:
    """Part files whose names, in order, hold the lines in the order of frames."""
    matrix.orderBy("frame").select("line").write.text(path)


def write_provenance(spark: SparkSession, path: str, kind: str, version: str, source: str, parameters: dict, created_utc: str | None = None) -> str:
    """One JSON line with sorted keys in ``path``.provenance.json (a folder, as Spark writes), which says how ``path`` came to be."""
    row = {"export": kind, "app_version": version, "created_utc": created_utc or datetime.now(timezone.utc).isoformat(), "source_project": source, "parameters": parameters}
    to = f"{path}.provenance.json"
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.text(to)
    return to
