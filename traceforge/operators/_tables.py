"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"file://{tempfile.gettempdir()}/traceforge-tables").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df``, checkpointed in the folder that spark.checkpoint.dir names; in one of our own only where none is named and all
    runs on one machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="traceforge-"))
    return df.checkpoint()


def numbered_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in the order of the columns, from 0.

    Ranges of about equal size are sorted by themselves; only their numbers of rows meet in one task."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = cut(sorted_).withColumn("__part", F.shiftright("__at", 33))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = kept.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), "__part").withColumn(name, place).drop("__part", "__start", "__at")  # a row a range
