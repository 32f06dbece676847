"""Shards that all have the mixture of the whole, by DataFrame functions only.

Proportional stratified interleaving: rows are shuffled by a seeded hash and ranked within their source; the rank over the
source's number of rows is a row's fraction, and the order of all fractions interleaves the sources in proportion to their
sizes. Equal cuts of that order are the shards.

Ranks and places come from range shuffles with ranges of about equal size, so a source that holds most of the rows is split
over tasks; what one task sums up is a row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import col, saved, without

#: Fixed value: bytes that every row counts besides its text.
ROW_BYTES = 8
NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the place of each row in the order of the given columns, from 0."""
    at = F.col("__at")
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept = saved(sorted_, "ordered").withColumn("__part", F.shiftright(at, 33))
    counts = kept.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # as many rows as there are ranges
    return kept.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + at.bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__start", "__at")


def fractions(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Adds __fraction: (rank - 1/2) / number of rows within ``source`` (null is a source, too), ranks by ``order``."""
    placed = numbered(rows, [source, *order], "__place")
    each = placed.groupBy(F.col(source).alias("__of")).agg(F.min("__place").alias("__first"), F.count("*").alias("__rows"))
    rank = F.col("__place") - F.col("__first")
    joined = placed.join(each, F.col(source).eqNullSafe(F.col("__of")))
    return joined.withColumn("__fraction", (2 * rank + 1) / (2 * F.col("__rows"))).drop("__place", "__of", "__first", "__rows")


def shuffle_key(seed: int, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, keep=None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with size, text_crc32, law, shard, slot and grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8. law is ``rows``: the shards' numbers of rows are at most one apart, and the
    rows of a source in a shard differ from its share by about one. slot: the row's place in its shard, gapless from 0. grown_shard
    is null under this law. The order within a source is that of sha256 of the seed and the id; rows with equal or null ids
    follow the checksum and size of their texts, equal rows the place at which they were read. A null source is a source of its own. With fewer rows than
    shards some shards are empty; an empty table gives no rows. Columns named like the new ones are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    taken = without(docs.select(*[col(c) for c in keep]) if keep is not None else docs, NEW).columns
    text = col(text_col)
    base = docs.select(
        *[col(c) for c in taken], (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        col(source_col).alias("__source"), shuffle_key(seed, col(id_col)).alias("__key"), F.monotonically_increasing_id().alias("__row"),
    )
    order = ["__key", "text_crc32", "size", "__row"]
    # written once: a row's number must stay what it is if a task is run again
    spread = fractions(saved(base, "rows"), "__source", order)
    placed = numbered(spread, ["__fraction", *order], "__place")
    total = placed.agg(F.count("*").alias("__total"))
    got = placed.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"CAST(__place * {shards} DIV __total AS INT)"))
    slot = F.expr(f"__place - (shard * __total + {shards - 1}) DIV {shards}")
    return got.select(*[col(c) for c in taken], "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(assigned: DataFrame, path: str, shards: int, files_per_shard: int = 1) -> None:
    """Writes what ``assign`` returned as Parquet in folders shard=k, each shard in ``files_per_shard`` files that follow its order."""
    last = assigned.groupBy("shard").agg((F.max("slot") + 1).alias("__rows"))
    file = F.expr(f"CAST(slot * {files_per_shard} DIV __rows AS INT)")
    dealt = assigned.join(F.broadcast(last), "shard").withColumn("__file", file).drop("__rows")
    dealt.repartitionByRange(shards * files_per_shard, "shard", "__file").sortWithinPartitions("shard", "slot").drop("__file").write.partitionBy("shard").parquet(path)
