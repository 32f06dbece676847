"""Project tables as views of general event tables: frames, molecules, windows, efficiencies, state paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import state_of
from ..operators.select import with_efficiency, windowed

CUTS = (0.25, 0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    dark = F.col("event_type") == "error"
    return e.select(
        F.col("user_id").alias("molecule_id"), (F.row_number().over(order) - 1).alias("frame"),
        F.when(dark, 0.0).otherwise(F.get_json_object("props", "$.k").cast("double")).alias("donor"), F.when(dark, 0.0).otherwise(F.col("value")).alias("acceptor"),
    )


def molecules(f: DataFrame) -> DataFrame:
    i = F.col("molecule_id")
    return f.groupBy("molecule_id").agg(F.count("*").cast("int").alias("n")).select(
        "molecule_id", (i % 10).alias("movie_id"), (i % 5).alias("condition_id"), F.when(i % 7 == 0, -1).when(i % 3 == 0, 1).otherwise(0).alias("label"), "n",
        F.when(i % 4 == 0, 0).otherwise(5).alias("w0"), F.when(i % 4 == 0, 0).otherwise(F.col("n") - 5).alias("w1"),
    )


def efficiencies(spark: SparkSession, sf_dir: str, include_rejected: bool = False) -> DataFrame:
    f = frames(spark, sf_dir)
    return with_efficiency(windowed(f, molecules(f), include_rejected))


def paths(spark: SparkSession, sf_dir: str, *cuts: float) -> DataFrame:
    """molecule_id, condition_id, frame, t, e, state: a state path fitted inside the window, NO_STATE in gaps."""
    return efficiencies(spark, sf_dir).withColumn("state", state_of(F.col("e"), *(cuts or CUTS)))
