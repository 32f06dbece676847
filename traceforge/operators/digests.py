"""What a fit was made from, as a digest: when it changes, the fit is stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hexadecimal_text, little_endian_hex

#: The methods under which no correction is applied.
APPARENT_METHODS = ("", "apparent", "apparent-E (user toggle)", "apparent-E (corrections unavailable)")
#: First line of the digested text.
TAG = "fit-inputs-v2\n"


def trace_digest(windowed: DataFrame, quantity: str = "corrected", donor: str = "donor", acceptor: str = "acceptor") -> DataFrame:
    """molecule_id, n, trace_hash: sha256 over ``quantity``, the number of frames and the donor's and then the acceptor's values
    as little-endian doubles, in the order of ``frame``. What a molecule's group holds is its own window."""
    bits = lambda c: little_endian_hex(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
    texts = windowed.select("molecule_id", "frame", bits(donor).alias("d"), bits(acceptor).alias("a"))
    per = texts.groupBy("molecule_id").agg(F.array_sort(F.collect_list(F.struct("frame", "d", "a"))).alias("v"))
    head = F.encode(F.concat(F.lit(f"{quantity}|"), F.size("v").cast("string"), F.lit("|")), "utf-8")
    body = F.unhex(F.concat(F.concat_ws("", F.transform("v", lambda s: s["d"])), F.concat_ws("", F.transform("v", lambda s: s["a"]))))
    return per.select("molecule_id", F.size("v").alias("n"), F.sha2(F.concat(head, body), 256).alias("trace_hash"))


def effective_factors(alpha: Column, gamma: Column, method: Column) -> tuple[Column, Column]:
    """The leakage and gamma that were applied: none (0 and 1) under the apparent methods, whatever is stored."""
    apparent = F.coalesce(method, F.lit("")).isin(*APPARENT_METHODS)
    return F.when(apparent, 0.0).otherwise(alpha.cast("double")), F.when(apparent, 1.0).otherwise(gamma.cast("double"))


def input_digest(windowed: DataFrame, molecules: DataFrame, quantity: str = "corrected", tag: str = TAG) -> DataFrame:
    """molecule_id, hash: the digest of what a fit reads: trace digest, window bounds, applied leakage and gamma.

    ``molecules`` has molecule_id, lo, hi (the window), alpha, gamma, correction_method. Molecules without a frame in their
    window have the digest of an empty trace. With the ``tag`` of another program the digests are those it stores."""
    empty = F.sha2(F.lit(f"{quantity}|0|"), 256)
    a, g = effective_factors(F.col("alpha"), F.col("gamma"), F.col("correction_method"))
    nan = lambda c: F.coalesce(hexadecimal_text(c), F.lit("nan"))
    text = F.concat(
        F.lit(tag), F.coalesce("trace_hash", empty), F.lit("|window="), F.col("lo").cast("string"), F.lit(","), F.col("hi").cast("string"), F.lit("|alpha="), nan(a), F.lit("|gamma="), nan(g)
    )
    return molecules.join(trace_digest(windowed, quantity), "molecule_id", "left").select("molecule_id", F.sha2(text, 256).alias("hash"))
