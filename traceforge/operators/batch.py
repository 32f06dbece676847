"""Summaries of batch runs from their stage events, and differences of layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The stages of a run, in order.
STAGES = ("extract", "correct", "idealize")
FAILED = "failed"


def movie_results(events: DataFrame) -> DataFrame:
    """movie, queued (its first event), ok, stages: the last status of each stage of each movie (events: seq, movie, stage, status, error),
    as an array of (stage, status, error) in the order of STAGES, others behind them by name. ok: no stage failed last."""
    last = events.groupBy("movie", "stage").agg(F.max_by(F.struct("status", "error"), "seq").alias("l"), F.min("seq").alias("seq"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")), F.lit(0)), F.lit(len(STAGES) + 1))
    each = F.struct(place.alias("p"), "stage", F.col("l.status").alias("status"), F.col("l.error").alias("error"))
    got = last.groupBy("movie").agg(F.min("seq").alias("queued"), (F.count_if(F.col("l.status") == FAILED) == 0).alias("ok"), F.array_sort(F.collect_list(each)).alias("s"))
    return got.select("movie", "queued", "ok", F.transform("s", lambda x: F.struct(x["stage"].alias("stage"), x["status"].alias("status"), x["error"].alias("error"))).alias("stages"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: n_movies, n_ok, n_failed."""
    return results.agg(F.count("*").alias("n_movies"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))


def report_lines(results: DataFrame) -> DataFrame:
    """movie, queued, line: a line of the report for each movie; read in the order of ``queued``."""
    bits = F.transform("stages", lambda s: F.concat(s["stage"], F.lit("="), s["status"], F.when((s["status"] == FAILED) & (F.coalesce(s["error"], F.lit("")) != ""), F.concat(F.lit("("), s["error"], F.lit(")"))).otherwise("")))
    flag = F.when(F.col("ok"), "ok  ").otherwise("FAIL")
    return results.select("movie", "queued", F.concat(flag, F.lit("  "), F.col("movie").cast("string"), F.lit("  "), F.concat_ws(" ", bits)).alias("line"))


def layout_differences(golden: DataFrame, current: DataFrame, keys: Sequence[str] = ("table", "column")) -> DataFrame:
    """``keys``, difference: entries of a layout (keys, type) that are missing now, were added, or have another type."""
    both = golden.select(*keys, F.col("type").alias("was")).join(current.select(*keys, F.col("type").alias("now")), list(keys), "full")
    what = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").otherwise(F.concat(F.col("was"), F.lit(" to "), F.col("now")))
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select(*keys, what.alias("difference"))
