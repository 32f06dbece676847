"""SimHash fingerprints of documents, by DataFrame expressions only.

Each term (white-space separated word, lower-cased) is hashed to 128 bits; every bit is a signed vote with the term's
weight, which grows with the term's length: long words tell documents apart, short ones are in all of them.
Likeness is the share of equal bits. Permuted block tables find all fingerprints within a Hamming radius.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import col

#: Longest length that adds weight.
LONG = 12
BITS = 128
_PAIR = (1 << 32) | 1


def terms(text: Column) -> Column:
    return F.split(F.lower(text), r"[ \t\n\x0B\f\r]+")


def weight(term: Column) -> Column:
    """0 for no term, 1 up to three characters, then the length (LONG at most) less 2."""
    n = F.length(term)
    return F.when(n.isNull() | (n == 0), F.lit(0)).when(n <= 3, F.lit(1)).otherwise(F.least(n, F.lit(LONG)) - 2).cast("long")


def votes(term: Column) -> list[Column]:
    """Aggregates that count the weight of terms with each bit set: bits i and i + 32 of a hash in the two halves of one
    long, so 32 sums serve 64 bits (each half holds up to 2**31, some two hundred million of the longest terms)."""
    w = weight(term)
    return [F.sum(w).alias("w")] + [
        F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR)) * w).alias(f"{n}{i}")
        for n, h in (("a", F.xxhash64(term)), ("b", F.xxhash64(term, F.lit(7)))) for i in range(32)
    ]


def word_of(name: str) -> Column:
    """64 bits of the fingerprint from the sums: a bit is set if more than half of the weight has it."""
    out = F.lit(0).cast("long")
    for i in range(32):
        s = F.col(f"{name}{i}")
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        out = out.bitwiseOR(F.when(low * 2 > F.col("w"), F.lit(1 << i)).otherwise(F.lit(0)))
        top = 1 << (i + 32)
        out = out.bitwiseOR(F.when(high * 2 > F.col("w"), F.lit(top if top < 1 << 63 else top - (1 << 64))).otherwise(F.lit(0)))
    return out


def hex_of(a: Column, b: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    return F.lit(1.0) - (F.bit_count(a1.bitwiseXOR(a2)) + F.bit_count(b1.bitwiseXOR(b2))) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """doc_id, fa, fb (the two words) and fingerprint (hexadecimal), one row per distinct row of id, text and ``keep``.

    Null and empty texts have no term and the fingerprint 0. Equal texts have equal fingerprints.
    """
    base = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("__text"), *[col(c) for c in keep])
    keys = ["doc_id", "__h", *keep]
    rows = base.select("doc_id", F.xxhash64("__text").alias("__h"), *keep, F.explode(terms(F.col("__text"))).alias("__term"))
    got = rows.groupBy(*keys).agg(*votes(F.col("__term"))).select(*keys, word_of("a").alias("fa"), word_of("b").alias("fb"))
    return got.select("doc_id", *keep, "fa", "fb", hex_of(F.col("fa"), F.col("fb")).alias("fingerprint"))


def block_tables(fps: DataFrame, blocks: int, radius: int, id_cols: list[str]) -> DataFrame:
    """One row per fingerprint and table t: k is a hash of the table's key, all blocks but ``radius`` of them, moved to the front."""
    width = BITS // blocks
    both = F.concat(F.lpad(F.bin("fa"), 64, "0"), F.lpad(F.bin("fb"), 64, "0"))
    cuts = [F.substring("__bits", 1 + k * width, width if k + 1 < blocks else BITS) for k in range(blocks)]
    keys = [F.struct(F.lit(n).alias("t"), F.xxhash64(*[cuts[k] for k in own]).alias("k")) for n, own in enumerate(combinations(range(blocks), blocks - radius))]
    return fps.select(*id_cols, "fa", "fb", both.alias("__bits")).select(*id_cols, "fa", "fb", F.inline(F.array(*keys)))


def classes_within(fps: DataFrame, queries: DataFrame, radius: int, blocks: int) -> DataFrame:
    """qa, qb, fa, fb, distance: distinct fingerprints of ``queries`` and those of ``fps`` at most ``radius`` bits away."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("radius must be at least 0 and less than blocks")
    left = block_tables(queries.select("fa", "fb").distinct(), blocks, radius, []).withColumnsRenamed({"fa": "qa", "fb": "qb"})
    pairs = left.join(block_tables(fps.select("fa", "fb").distinct(), blocks, radius, []), ["t", "k"])
    gap = (F.bit_count(F.col("qa").bitwiseXOR(F.col("fa"))) + F.bit_count(F.col("qb").bitwiseXOR(F.col("fb")))).alias("distance")
    return pairs.select("qa", "qb", "fa", "fb", gap).filter(F.col("distance") <= radius).distinct()


def within(fps: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """query_id, doc_id, distance: all fingerprints within ``radius`` bits of each query's (itself excluded).

    ``fps`` and ``queries`` have doc_id, fa, fb. Two fingerprints that differ in at most ``radius`` bits agree in at
    least blocks - radius whole blocks, so they share the key of one of the permuted tables: nothing is missed. Equal
    fingerprints are one class while tables are joined, and are told apart again at the end.
    """
    pairs = classes_within(fps, queries, radius, blocks)
    found = pairs.join(queries.select(F.col("doc_id").alias("query_id"), F.col("fa").alias("qa"), F.col("fb").alias("qb")), ["qa", "qb"]).join(fps.select("doc_id", "fa", "fb"), ["fa", "fb"])
    return found.filter("query_id <> doc_id").select("query_id", "doc_id", "distance")


def count_within(fps: DataFrame, asked: Column, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``fps`` (fa, fb, ...) with n_within: how many other rows have a fingerprint at most ``radius`` bits away, for the rows that
    ``asked`` picks; null for others. Found by the permuted tables as in ``within``; rows are counted by fingerprint, never paired."""
    size = fps.groupBy("fa", "fb").agg(F.count("*").alias("__n"))
    pairs = classes_within(fps, fps.filter(asked), radius, blocks)
    near = pairs.join(size, ["fa", "fb"]).groupBy(F.col("qa").alias("fa"), F.col("qb").alias("fb")).agg((F.sum("__n") - 1).alias("__within"))
    return fps.join(near, ["fa", "fb"], "left").withColumn("n_within", F.when(asked, F.col("__within"))).drop("__within")


def ranges(docs: DataFrame, key: Column, rows_per_range: int, most: int = 4096) -> list[int]:
    """First keys of consecutive ranges, at most ``most`` of them; each is a key of the table, the first its smallest."""
    n = docs.count()
    count = max(1, min(most, n // rows_per_range))
    shares = [k / count for k in range(1, count)] or [0.5]
    r = docs.agg(F.min(key).alias("m"), F.percentile_approx(key, shares, 20_000).alias("q")).first()
    return sorted({r["m"], *(r["q"] if count > 1 else [])}) if r["m"] is not None else []


def range_of(bounds: list[int], key: Column) -> Column:
    """Index of the last bound that isn't over the key: found in two steps, so each row compares with 2 * sqrt(n) bounds."""
    step = max(1, int(len(bounds) ** 0.5))
    heads = F.lit(bounds[::step])
    parts = F.array(*[F.lit(bounds[k : k + step]) for k in range(0, len(bounds), step)])
    coarse = F.size(F.filter(heads, lambda b: b <= key))
    return ((coarse - 1) * step + F.size(F.filter(F.element_at(parts, coarse), lambda b: b <= key)) - 1).cast("int")


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 256) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fa, fb (the fingerprint's words), fingerprint, edited_fingerprint, near_edited, near_next for
    every document.

    The edited text replaces the last floor(n / 2) of the n code points by as many first ones (or all) of the next
    document: ascending id (a null id first), equal ids by their text's hash, after the last the first. Texts are
    shuffled once, by ranges of ids; each range also gets the first row of the next, so no window spans the table.
    Null text is empty (fingerprint 0); an empty table gives an empty result; other columns are not read. A document
    that is alone is its own next one.
    """
    key = F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63)))
    base = docs.select(key.alias("k"), col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    bounds = ranges(base.select("k"), F.col("k"), rows_per_range) or [0]
    last = len(bounds) - 1
    r = range_of(bounds, F.col("k"))
    base = base.withColumn("r", r)
    first = F.element_at(F.lit(bounds), F.col("r") + 1) == F.col("k")
    before = F.when(F.col("r") == 0, F.lit(last)).otherwise(F.col("r") - 1)
    places = F.filter(F.array(F.struct(F.col("r").alias("range"), F.lit(0).alias("copy")), F.struct(F.when(first, before).alias("range"), F.lit(1).alias("copy"))), lambda p: p["range"].isNotNull())
    own = ["range", "copy", "k", "row"]
    order = W.partitionBy("range").orderBy("copy", "k", F.xxhash64("text"))
    dealt = base.withColumn("place", F.explode(places)).select("doc_id", "k", "text", "place.range", "place.copy")
    ordered = dealt.withColumn("row", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(F.col("copy") == 0, F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    made = ordered.select("doc_id", *own, "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = made.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    sides = made.withColumn("side", F.explode(F.when(F.col("copy") == 0, F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t"))))))
    keys = [*own, "doc_id", "n_chars", "edited_sha256"]
    rows = sides.select(*keys, F.col("side.e").alias("e"), F.explode(terms(F.col("side.t"))).alias("term"))
    fps = rows.groupBy(*keys, "e").agg(*votes(F.col("term"))).select(*keys, "e", word_of("a").alias("fa"), word_of("b").alias("fb"))
    pick = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c)))
    both = fps.groupBy(*keys).agg(pick("fa", 0).alias("fa"), pick("fb", 0).alias("fb"), pick("fa", 1).alias("ea"), pick("fb", 1).alias("eb"))
    after = W.partitionBy("range").orderBy("copy", "k", "row")
    done = both.withColumn("na", F.lead("fa").over(after)).withColumn("nb", F.lead("fb").over(after)).filter("copy = 0")
    c = F.col
    return done.select(
        "doc_id", "n_chars", "edited_sha256", "fa", "fb", hex_of(c("fa"), c("fb")).alias("fingerprint"), hex_of(c("ea"), c("eb")).alias("edited_fingerprint"),
        likeness(c("fa"), c("fb"), c("ea"), c("eb")).alias("near_edited"), likeness(c("fa"), c("fb"), c("na"), c("nb")).alias("near_next"),
    )
