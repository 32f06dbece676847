"""Range joins of positions on a grid: near pairs, one-to-one pairs, colocalisation, scores against known positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import cut


def near_pairs(left: DataFrame, right: DataFrame, tol: float) -> DataFrame:
    """a, b, distance of the points of ``left`` and ``right`` (group_id, id, x, y) of one group at most ``tol`` apart.

    Points meet only in neighbouring cells of a grid as wide as ``tol``, so the work follows how densely they lie, not the
    size of a group. Null and NaN positions meet nothing."""
    if not tol > 0:
        raise ValueError("tol must be positive")
    cell = lambda c: F.floor(F.col(c) / tol)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1)).alias(f"c{c}")
    known = lambda d: d.filter(~F.isnan("x") & ~F.isnan("y"))  # noqa: E731  null positions go, too
    a = known(left).select("group_id", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = known(right).select("group_id", "id", "x", "y", around("x")).select("group_id", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", around("y"))
    square = lambda c: F.pow(F.col(f"a{c}") - F.col(f"b{c}"), F.lit(2.0))
    return a.join(b, ["group_id", "cx", "cy"]).select("a", "b", F.sqrt(square("x") + square("y")).alias("distance")).filter(F.col("distance") <= tol)


def one_to_one(pairs: DataFrame) -> DataFrame:
    """a, b, distance: pairs taken from the nearest on (ties by a, then b), each point at most once.

    A round takes all pairs that come first for both of their points; that gives what taking them one by one gives, as no
    other pair can come before them. Rounds go on while a pair is left that has both of its points free."""
    key = F.struct("distance", "a", "b")
    left, taken = cut(pairs.select("a", "b", "distance")), None
    while taken is None or not left.isEmpty():
        first_of = lambda c: F.min(key).over(W.partitionBy(c))
        now = cut(left.withColumn("ka", first_of("a")).withColumn("kb", first_of("b")).filter((F.col("ka") == key) & (F.col("kb") == key)).select("a", "b", "distance"))
        taken = now if taken is None else taken.unionByName(now)
        left = cut(left.join(now.select("a"), "a", "left_anti").join(now.select("b"), "b", "left_anti").select("a", "b", "distance"))
    return taken


def detection_scores(known: DataFrame, found: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: n_known, n_found, n_matched, recall, precision, rms of the matched distances; null where nothing divides."""
    count = lambda d, name: d.agg(F.count("*").alias(name))
    matched = pairs.agg(F.count("*").alias("n_matched"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("rms"))
    one = count(known, "n_known").crossJoin(count(found, "n_found")).crossJoin(matched)
    share = lambda n: F.when(F.col(n) > 0, F.col("n_matched") / F.col(n))
    return one.select("n_known", "n_found", "n_matched", share("n_known").alias("recall"), share("n_found").alias("precision"), "rms")


def matched_correlations(pairs: DataFrame, known: DataFrame, found: DataFrame, by: Sequence[str] = ("a", "b")) -> DataFrame:
    """a, b, frames, r: Pearson correlation of ``value`` over the frames (id, frame, value) that both traces of a pair have;
    null for flat traces and for fewer than two frames. With ``by`` empty, one row over all pairs."""
    fine = lambda d, name: d.filter(~F.isnan("value")).select(F.col("id").alias(name), "frame", F.col("value").alias(f"v{name}"))
    both = pairs.select("a", "b").join(fine(known, "a"), "a").join(fine(found, "b"), ["b", "frame"])
    varies = lambda c: F.max(c) > F.min(c)
    return both.groupBy(*by).agg(F.count("*").alias("frames"), F.when(varies("va") & varies("vb"), F.try_divide(F.covar_pop("va", "vb"), F.stddev_pop("va") * F.stddev_pop("vb"))).alias("r"))


#: What an extraction has to reach: recall, the donors' median correlation, and at most this registration residual.
RECALL, PEARSON, RESIDUAL = 0.95, 0.95, 0.5


def extraction_verdict(known: DataFrame, found: DataFrame, pairs: DataFrame, donors: tuple[DataFrame, DataFrame], acceptors: tuple[DataFrame, DataFrame], residual: float | None = None) -> DataFrame:
    """One row: detection_scores with <channel>_pooled and <channel>_median, the correlations of matched traces (known, found: id, frame,
    value), residual, and passes.

    A pair whose correlation isn't defined counts as 0 in the median. It passes with enough recall, a high enough median of the
    donors, and a residual that is known and small enough; acceptors are reported only."""
    one = detection_scores(known, found, pairs)
    for name, (a, b) in (("donor", donors), ("acceptor", acceptors)):
        own = pairs.select("a", "b").join(matched_correlations(pairs, a, b).select("a", "b", "r"), ["a", "b"], "left")
        one = one.crossJoin(own.agg(F.median(F.coalesce("r", F.lit(0.0))).alias(f"{name}_median")))
        one = one.crossJoin(matched_correlations(pairs, a, b, by=()).select(F.col("r").alias(f"{name}_pooled")))
    ok = (F.col("recall") >= RECALL) & (F.col("donor_median") >= PEARSON) & (F.col("residual") <= RESIDUAL)
    return one.withColumn("residual", F.lit(residual).cast("double")).withColumn("passes", F.coalesce(ok, F.lit(False)))


def quadratic(x: Column, y: Column, c: Sequence[float]) -> Column:
    """Polynomial of degree two with its six coefficients in the order 1, x, y, xy, x², y²."""
    if len(c) != 6:
        raise ValueError("six coefficients are needed")
    return F.lit(c[0]) + c[1] * x + c[2] * y + c[3] * x * y + c[4] * x * x + c[5] * y * y


def window_fits(x: Column, y: Column, shape: tuple[int, int], window: int = 21) -> Column:
    """Whether an odd window around the position, rounded half away from zero, lies inside (height, width)."""
    if window < 1 or window % 2 == 0:
        raise ValueError("window must be odd and positive")
    half = window // 2
    inside = lambda c, n: (F.round(c) >= half) & (F.round(c) < n - half)
    return inside(x, shape[1]) & inside(y, shape[0])


def colocalised(donors: DataFrame, acceptors: DataFrame, forward: Sequence[Sequence[float]], back: Sequence[Sequence[float]], donor_shape: tuple[int, int], acceptor_shape: tuple[int, int], window: int = 21, gate: float = 3.0) -> DataFrame:
    """id, x, y, acceptor_x, acceptor_y, acceptor of each donor spot (group_id, id, x, y) whose window fits at its own place
    and at its place in the other channel.

    ``forward`` and ``back`` are the coefficients of x and of y (see quadratic) from donor to acceptor positions and back.
    ``acceptor`` is the nearest acceptor spot, brought back to the donor's channel, that is less than ``gate`` away (ties:
    smaller id), else null; it never takes a donor away, and several donors may have the same."""
    at = lambda c: quadratic(F.col("x"), F.col("y"), c)
    kept = donors.withColumn("acceptor_x", at(forward[0])).withColumn("acceptor_y", at(forward[1]))
    kept = kept.filter(window_fits(F.col("x"), F.col("y"), donor_shape, window) & window_fits(F.col("acceptor_x"), F.col("acceptor_y"), acceptor_shape, window))
    own = acceptors.select("group_id", "id", at(back[0]).alias("x"), at(back[1]).alias("y"))
    best = near_pairs(kept, own, gate).filter(F.col("distance") < gate).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m"))
    return kept.join(best.select(F.col("a").alias("id"), F.col("m.b").alias("acceptor")), "id", "left").select("id", "x", "y", "acceptor_x", "acceptor_y", "acceptor")


def lag1_magnitude(frames: DataFrame) -> DataFrame:
    """molecule_id, anticorr_lag1: size of the biased correlation of the donor with the acceptor one frame before; null for
    fewer than two frames, a flat channel or a value that isn't finite."""
    m = W.partitionBy("molecule_id")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    x = frames.select("molecule_id", "frame", "donor", "acceptor", (bad("donor") | bad("acceptor")).alias("bad"), (F.col("donor") - F.avg("donor").over(m)).alias("d0"), (F.col("acceptor") - F.avg("acceptor").over(m)).alias("a0"))
    x = x.withColumn("before", F.lag("a0").over(m.orderBy("frame")))
    fine = (F.count("*") > 1) & ~F.bool_or("bad") & (F.max("donor") > F.min("donor")) & (F.max("acceptor") > F.min("acceptor"))
    r = F.abs(F.sum(F.col("d0") * F.col("before"))) / (F.count("*") * F.stddev_pop("donor") * F.stddev_pop("acceptor"))
    return x.groupBy("molecule_id").agg(F.when(fine, r).alias("anticorr_lag1"))
