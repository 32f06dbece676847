"""Curation: label log, merges, weights, roll-ups, conditions, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import informativeness, label_weight
from ._tables import numbered_rows
from .drift import ks_by_feature

IDENTITY = ["molecule_key", "labeler", "timestamp", "source_file", "source", "label_value"]


def current_labels(log: DataFrame, source: str = "human") -> DataFrame:
    """molecule_key, label_value: the last event of the log for each key; an unset label (0) is no label."""
    last = log.filter(F.col("source") == source).groupBy("molecule_key").agg(F.max_by("label_value", "event_seq").alias("label_value"))
    return last.filter("label_value <> 0")


def label_of(log: DataFrame, key: str, source: str = "human") -> int:
    """The current label of one key, 0 without any."""
    got = current_labels(log.filter(F.col("molecule_key") == key), source).first()
    return got["label_value"] if got else 0


def store_order(molecules: DataFrame, id_col: str = "molecule_id", order: str = "store_ord") -> DataFrame:
    """id, score, rank: the order of the store as a ranking without scores."""
    got = numbered_rows(molecules.select(F.col(id_col).alias("id"), order), [order, "id"], "__k")
    return got.select("id", F.lit(None).cast("double").alias("score"), (F.col("__k") + 1).alias("rank"))


def first_ranked(rank: DataFrame, k: int) -> DataFrame:
    """The first k of a ranking, in order."""
    if k < 0:
        raise ValueError("k must not be negative")
    return rank.filter(F.col("rank") <= k).orderBy("rank")


def rank_of(rank: DataFrame, id_) -> int:
    """The rank of one id, from 1; KeyError without it."""
    got = rank.filter(F.col("id") == id_).select("rank").first()
    if not got:
        raise KeyError(id_)
    return got["rank"]


def merge_labels(owner: DataFrame, other: DataFrame) -> DataFrame:
    """The owner's log and the other's events that it lacks (by six-field identity), each once: merging again adds nothing."""
    new = other.dropDuplicates(IDENTITY).join(owner.select(*IDENTITY), IDENTITY, "left_anti")
    return owner.unionByName(new.select(*owner.columns))


def human_counts(molecules: DataFrame) -> DataFrame:
    return molecules.groupBy("condition_id").agg(F.sum(F.when(F.col("label") != 0, 1).otherwise(0)).alias("n_human"))


def weights(molecules: DataFrame, w0: float = 0.3) -> DataFrame:
    """molecule_id, weight: 1 for a human label, w0 / (1 + human labels in its condition) for others."""
    return molecules.join(human_counts(molecules), "condition_id").select("molecule_id", label_weight(F.col("label") != 0, F.col("n_human"), w0).alias("weight"))


def roll_up(molecules: DataFrame, by: str) -> DataFrame:
    """``by``, n, keys: the keys in store order."""
    return molecules.groupBy(by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("molecule_id")).alias("keys"))


def dangling(molecules: DataFrame, conditions: DataFrame) -> DataFrame:
    return molecules.filter("condition_id IS NOT NULL").join(conditions.select("condition_id"), "condition_id", "left_anti")


def rekeyed(molecules: DataFrame, source, target) -> DataFrame:
    return molecules.withColumn("condition_id", F.when(F.col("condition_id") == source, F.lit(target)).otherwise(F.col("condition_id")))


def ranked(scores: DataFrame, descending: bool = True) -> DataFrame:
    """rank from 1: missing scores last, ties by id. No row is dropped; infinite scores are refused. Ranks are places in a range
    shuffle by score and id, so neither a common score nor an uneven spread of them meets in one task."""
    bad = F.abs(F.col("score")) == float("inf")
    s = scores.select("id", F.when(bad, F.raise_error(F.lit("infinite score"))).when(~F.isnan("score"), F.col("score")).alias("score"))
    s = s.withColumn("__none", F.col("score").isNull()).withColumn("__key", -F.col("score") if descending else F.col("score"))
    return numbered_rows(s, ["__none", "__key", "id"], "__k").select("id", "score", (F.col("__k") + 1).alias("rank"))


def precision_at_k(rank: DataFrame, good: DataFrame, k: int) -> DataFrame:
    """One row: share of good ones among the first min(k, n) labelled."""
    if k < 1:
        raise ValueError("k must be positive")
    top = rank.join(good, "id").orderBy("rank").limit(k)
    return top.agg(F.avg(F.col("good").cast("double")).alias("precision"))


def next_to_label(scores: DataFrame, curated: DataFrame) -> DataFrame:
    """The one uncurated row with the least certain score (ties: smaller id), none if all are curated."""
    left = scores.join(curated.select("id"), "id", "left_anti")
    return left.withColumn("info", informativeness(F.col("score"))).orderBy(F.desc("info"), "id").limit(1)


def ks_statistic(samples: DataFrame) -> DataFrame:
    """One row, d: largest gap of the distributions of side 0 and side 1 (columns side, x)."""
    return ks_by_feature(samples.withColumn("feature", F.lit("x"))).select(F.col("statistic").alias("d"))
