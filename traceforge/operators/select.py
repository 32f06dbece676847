"""Selections: analysis windows, curation, condition queries, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import NO_STATE, REJECT, apparent_efficiency


def kept(label: Column, include_rejected: bool = False) -> Column:
    return F.lit(True) if include_rejected else label != REJECT


def windowed(frames: DataFrame, molecules: DataFrame, include_rejected: bool = False) -> DataFrame:
    """Frames inside each molecule's half-open window (its whole range if the window is empty), t from 0."""
    m = molecules.filter(kept(F.col("label"), include_rejected))
    unset = F.col("w1") <= F.col("w0")
    m = m.select("molecule_id", "movie_id", "condition_id", "label", F.when(unset, 0).otherwise(F.col("w0")).alias("lo"), F.when(unset, F.col("n")).otherwise(F.col("w1")).alias("hi"))
    return frames.join(m, "molecule_id").filter("frame >= lo AND frame < hi").withColumn("t", F.col("frame") - F.col("lo")).drop("lo", "hi")


def with_efficiency(frames: DataFrame) -> DataFrame:
    return frames.withColumn("e", apparent_efficiency(F.col("donor"), F.col("acceptor")))


def trimmed(paths: DataFrame) -> DataFrame:
    """State paths from their first to their last assigned frame; gaps inside stay."""
    m = W.partitionBy("molecule_id")
    real = F.when(F.col("state") != NO_STATE, F.col("frame"))
    return paths.withColumn("a", F.min(real).over(m)).withColumn("b", F.max(real).over(m)).filter("frame BETWEEN a AND b").drop("a", "b")


def query_molecules(molecules: DataFrame, condition_ids: Sequence | None = None, categories: Sequence[str] | None = None, tags: Sequence[str] | None = None, match_all_tags: bool = True) -> DataFrame:
    """All given predicates hold; an empty collection is inactive; molecules without a condition are never returned."""
    for given in (condition_ids, categories, tags):
        if isinstance(given, str):
            raise TypeError("a collection is expected, not a string")
    out = molecules.filter(F.col("condition_id").isNotNull())
    if condition_ids:
        out = out.filter(F.col("condition_id").isin(list(condition_ids)))
    if categories:
        out = out.filter(F.col("category").isin(list(categories)))
    if tags:
        wanted = F.array(*map(F.lit, tags))
        out = out.filter(F.size(F.array_except(wanted, "tags")) == 0 if match_all_tags else F.arrays_overlap(wanted, "tags"))
    return out


def conditions_by_key(conditions: DataFrame, key: dict) -> DataFrame:
    """condition_id of the ``conditions`` that agree with every given field of the identity; None asks for a missing one (null, NaN or
    empty). ValueError for a field that the identity hasn't."""
    from .stored import CONDITION_FIELDS

    unknown = sorted(set(key) - {n for n, _ in CONDITION_FIELDS})
    if unknown:
        raise ValueError(f"no such fields: {unknown}")
    kinds, out = dict(conditions.dtypes), conditions
    for name, value in key.items():
        c = F.col(name)
        missing = c.isNull() | (F.isnan(name) if kinds[name] == "double" else c == "")
        out = out.filter(missing if value is None else c == F.lit(value))
    return out.select("condition_id")


def molecules_of_key(molecules: DataFrame, conditions: DataFrame, key: dict | None = None, **others) -> DataFrame:
    """query_molecules with a partial ``key`` of conditions as a further predicate; an empty key is inactive."""
    got = query_molecules(molecules, **others)
    return got.join(conditions_by_key(conditions, key), "condition_id", "left_semi") if key else got


def in_store_order(rows: DataFrame, keys: Sequence[str] | None = None, include_rejected: bool = False) -> DataFrame:
    """All rows of the given keys (all keys, if none are given) sorted by store_ord; KeyError if a key has no row at all."""
    if keys is not None:
        want = rows.sparkSession.createDataFrame([(k,) for k in dict.fromkeys(keys)], "molecule_key string")
        lost = want.join(rows.select("molecule_key"), "molecule_key", "left_anti").limit(1).collect()
        if lost:
            raise KeyError(lost[0]["molecule_key"])
        rows = rows.join(F.broadcast(want), "molecule_key", "left_semi")  # the caller's list
    return rows.filter(kept(F.col("label"), include_rejected)).orderBy("store_ord")


def stale_keys(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Keys of which any fitted row's hash is gone or has changed: ``stored`` (molecule_id, molecule_key, hash) against ``current`` (molecule_id, hash)."""
    now = current.select("molecule_id", F.col("hash").alias("now"))
    bad = F.col("now").isNull() | (F.col("now") != F.col("hash"))
    return stored.join(now, "molecule_id", "left").filter(bad).select("molecule_key").distinct()


def chosen_live_keys(stored: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """molecule_key, ord: the caller's keys that are live, in the caller's order (a repeated one counts once)."""
    want = stored.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(keys))], "molecule_key string, ord int")
    return live_keys(stored, current).join(F.broadcast(want), "molecule_key").select("molecule_key", "ord").orderBy("ord")


def live_keys(stored: DataFrame, current: DataFrame) -> DataFrame:
    return stored.select("molecule_key").distinct().join(stale_keys(stored, current), "molecule_key", "left_anti")
