"""Model-ready windows: arrays of one length for every labelled trace, and exact stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def model_windows(frames: DataFrame, labels: DataFrame, length: int = 500) -> DataFrame:
    """molecule_id, donor, acceptor (arrays of ``length`` floats), mask, valid (real frames), y (1 for a label over 0), weight.

    ``frames`` holds each molecule's window; both channels are divided by the largest total of the trace (by 1 if that isn't positive
    or not finite), then cut or filled with zeros. ``labels``: molecule_id, label, weight. ValueError without a row or with a length
    that isn't positive."""
    if length < 1:
        raise ValueError("length must be positive")
    if labels.isEmpty():
        raise ValueError("no molecules")
    pair = F.struct("frame", F.col("donor").cast("double").alias("d"), F.col("acceptor").cast("double").alias("a"))
    v = frames.join(labels.select("molecule_id"), "molecule_id", "left_semi").groupBy("molecule_id").agg(F.array_sort(F.collect_list(pair)).alias("v"))
    top = F.array_max(F.transform("v", lambda s: s["d"] + s["a"]))
    v = v.withColumn("top", F.when((top > 0) & (top < float("inf")), top).otherwise(1.0)).withColumn("v", F.slice("v", 1, length))

    def filled(c: str) -> Column:
        own = F.transform("v", lambda s: (s[c] / F.col("top")).cast("float"))
        return F.concat(own, F.array_repeat(F.lit(0.0).cast("float"), length - F.size("v")))

    mask = F.concat(F.array_repeat(F.lit(True), F.size("v")), F.array_repeat(F.lit(False), length - F.size("v")))
    rows = labels.select("molecule_id", (F.col("label").cast("int") > 0).cast("int").alias("y"), F.col("weight").cast("double").alias("weight"))
    empty = F.array_repeat(F.lit(0.0).cast("float"), length)
    got = rows.join(v.select("molecule_id", filled("d").alias("donor"), filled("a").alias("acceptor"), mask.alias("mask"), F.size("v").alias("valid")), "molecule_id", "left")
    return got.select("molecule_id", F.coalesce("donor", empty).alias("donor"), F.coalesce("acceptor", empty).alias("acceptor"), F.coalesce("mask", F.array_repeat(F.lit(False), length)).alias("mask"), F.coalesce("valid", F.lit(0)).alias("valid"), "y", "weight")


def split(rows: DataFrame, id_col: str, class_col: str | None = None, share: float = 0.2, seed: int = 0) -> DataFrame:
    """``rows`` with validation: in each class (or in all rows) round(n * share) rows, half to even, at least one and all but one at most;
    a lone row stays out. Which ones depends on ``seed`` and the id alone: those with the smallest sha256.

    Rows are counted by the first four digits of their hash, so only those with equal digits are ranked together, and a class
    that holds most rows is spread over tasks."""
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    of = F.col(class_col) if class_col else F.lit(0)
    r = rows.withColumn("__c", F.coalesce(of.cast("string"), F.lit("\0"))).withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)).withColumn("__b", F.substring("__h", 1, 4))
    counts = r.groupBy("__c", "__b").agg(F.count("*").alias("__n"))
    upto, whole = W.partitionBy("__c").orderBy("__b").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("__c")
    counts = counts.select("__c", "__b", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__m"))
    m = F.col("__m")
    want = F.when(m < 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.bround(m * F.lit(share)), m - 1)))
    rank = F.row_number().over(W.partitionBy("__c", "__b").orderBy("__h"))
    got = r.withColumn("__k", rank).join(counts, ["__c", "__b"]).withColumn("validation", F.col("__before") + F.col("__k") <= want)
    return got.select(*rows.columns, "validation")
