"""Distance joins: nearest neighbours, mutual pairs, colocalization, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import cut
from .matching import near_pairs


#: Points beyond which a cell is cut into smaller ones, and halvings of its side in one step.
CROWD, STEP = 4, 2
#: Cells narrower than this share of a group's extent aren't cut further.
FINEST = 40


def _finite(points: DataFrame) -> DataFrame:
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return points.filter(fine("x") & fine("y") & F.col("group_id").isNotNull())


def _cell(c: str, level: Column) -> Column:
    return F.floor((F.col(c) - F.col(f"{c}0")) / F.col("extent") * F.pow(F.lit(2.0), level)).cast("long")


_CELL = ["group_id", "level", "cx", "cy"]


def _around(seeking: DataFrame, targets: DataFrame, levels: list[int]) -> DataFrame:
    """id, other, d: each seeking place with all others of its own and the eight cells around it, at its level."""
    each = targets.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    each = each.withColumnsRenamed({"tx": "x", "ty": "y"}).withColumn("cx", _cell("x", F.col("level"))).withColumn("cy", _cell("y", F.col("level"))).select(*_CELL, F.col("x").alias("tx"), F.col("y").alias("ty"), "other")
    three = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    look = seeking.select("group_id", "level", "id", "x", "y", three("cx"), "cy").select("group_id", "level", "id", "x", "y", "cx", three("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ty"), F.lit(2.0)))
    return look.join(each, _CELL).filter("other <> id").select("id", "other", d.alias("d"))


def nearest(points: DataFrame, radius: float = 3.0) -> DataFrame:
    """id, neighbour, distance, overlaps of each point (group_id, id, x, y; ids are unique): the nearest other one of its group,
    ties by id; ``overlaps``: nearer than twice ``radius``. A point that is alone, or whose group or position is null or not
    finite, has none of them.

    Points at one place are settled by counting. Every other place looks into the nine cells around it on a grid of its own
    density: cells hold up to CROWD places, or are cut smaller. What is found within a cell's width is the nearest; only places
    that found nothing so near look again, on a grid twice as wide. Such a place has no other within the width before, so
    few of them can see the same cell, and the pairs that are made grow with the number of points, not with its square."""
    fine = _finite(points)
    place = cut(fine.groupBy("group_id", "x", "y").agg(F.min("id").alias("first"), F.count("*").alias("n")))
    # several at one place: the smallest other id, at distance 0
    crowd = fine.join(place.filter("n > 1"), ["group_id", "x", "y"])
    second = crowd.filter("id > first").groupBy("group_id", "x", "y").agg(F.min("id").alias("second"))
    same = crowd.join(second, ["group_id", "x", "y"]).select("id", F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("neighbour"), F.lit(0.0).alias("distance"))
    box = place.groupBy("group_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"), F.count("*").alias("places")).filter("extent > 0")
    # about four places a cell if they lie evenly
    at = place.join(box, "group_id").withColumn("level", F.greatest(F.lit(0), F.floor(F.log2(F.sqrt(F.col("places"))) - 1)).cast("int")).drop("places")
    at = cut(at.withColumn("cx", _cell("x", F.col("level"))).withColumn("cy", _cell("y", F.col("level"))))
    while True:
        dense = cut(at.groupBy(*_CELL).agg(F.count("*").alias("held")).filter((F.col("held") > CROWD) & (F.col("level") < FINEST)).drop("held"))
        if dense.isEmpty():
            break
        finer = at.join(dense, _CELL, "left_semi").withColumn("level", F.col("level") + STEP)
        finer = finer.withColumn("cx", _cell("x", F.col("level"))).withColumn("cy", _cell("y", F.col("level")))
        at = cut(at.join(dense, _CELL, "left_anti").unionByName(finer))
    targets = at.select("group_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("first").alias("other"), F.col("x0"), F.col("y0"), F.col("extent"))
    seeking, found = at.filter("n = 1").drop("n").withColumnRenamed("first", "id"), same
    while True:
        levels = sorted(r["level"] for r in seeking.select("level").distinct().collect())  # at most FINEST
        if not levels:
            break
        met = _around(seeking, targets, levels).groupBy("id").agg(F.min(F.struct("d", "other")).alias("m"))
        width = F.col("extent") * F.pow(F.lit(2.0), -F.col("level")) * (1 - 1e-9)  # less what rounding may move over a border
        told = cut(seeking.join(met, "id", "left").withColumn("done", (F.col("level") == 0) | F.coalesce(F.col("m.d") <= width, F.lit(False))))
        found = found.unionByName(told.filter("done").select("id", F.col("m.other").alias("neighbour"), F.col("m.d").alias("distance")))
        seeking = told.filter("NOT done").drop("m", "done").withColumn("level", F.greatest(F.lit(0), F.col("level") - 1))
        seeking = cut(seeking.withColumn("cx", _cell("x", F.col("level"))).withColumn("cy", _cell("y", F.col("level"))))
    return points.select("id").join(found, "id", "left").select("id", "neighbour", "distance", F.coalesce(F.col("distance") < 2 * radius, F.lit(False)).alias("overlaps"))


def spatial_features(points: DataFrame, aperture_radius: float = 3.0) -> DataFrame:
    """id, neighbor_distance, aperture_overlap (1 if two apertures overlap, else 0) of each point (group_id, id, x, y). A lone point
    has no distance and overlap 0; one whose position isn't finite has neither; no point is left out."""
    if not 0 < aperture_radius < float("inf"):
        raise ValueError("aperture_radius must be finite and positive")
    placed = _finite(points).select("id", F.lit(True).alias("placed"))
    got = nearest(points, aperture_radius).join(placed, "id", "left")
    return got.select("id", F.col("distance").alias("neighbor_distance"), F.when(F.col("placed"), F.col("overlaps").cast("double")).alias("aperture_overlap"))


def suppressed(points: DataFrame, min_separation: float) -> DataFrame:
    """The points (group_id, id, x, y, brightness) that stay if they are taken from the brightest on (ties: the larger id first; no
    brightness last) and one that is less than ``min_separation`` from any taken before is left out.

    A round takes every undecided point that no undecided nearer one goes before, and drops those near it: the same as one by
    one. Rounds go on until all are decided; their number is that of the longest run of neighbours of falling brightness."""
    fine = _finite(points)
    dark = F.when(~F.isnan("brightness"), F.col("brightness"))
    rank = F.struct(dark.isNotNull().alias("told"), dark.alias("b"), F.col("id").alias("i"))
    p = fine.select("group_id", "id", "x", "y")
    of = fine.select("id", rank.alias("rank"))
    near = near_pairs(p, p, min_separation).filter((F.col("a") != F.col("b")) & (F.col("distance") < min_separation))
    both = near.join(of.withColumnsRenamed({"id": "a", "rank": "ra"}), "a").join(of.withColumnsRenamed({"id": "b", "rank": "rb"}), "b")
    before = cut(both.filter("ra > rb").select(F.col("a").alias("hi"), F.col("b").alias("lo")))
    left, taken = cut(fine.select("id")), None
    while taken is None or not left.isEmpty():
        held = left.join(before.select(F.col("lo").alias("id")), "id", "left_semi")
        now = cut(left.join(before.select(F.col("lo").alias("id")), "id", "left_anti"))
        taken = now if taken is None else taken.unionByName(now)
        gone = before.join(now.select(F.col("id").alias("hi")), "hi", "left_semi").select(F.col("lo").alias("id"))
        left = cut(held.join(gone, "id", "left_anti"))
        still = left.select(F.col("id").alias("hi"))
        before = cut(before.join(still, "hi", "left_semi").join(still.withColumnRenamed("hi", "lo"), "lo", "left_semi"))
    return points.join(taken, "id", "left_semi")


def mutual_pairs(left: DataFrame, right: DataFrame, tol: float = 2.0) -> DataFrame:
    """a, b, distance: each the other's nearest in the group, at most ``tol`` apart."""
    j = near_pairs(left, right, tol).withColumnRenamed("distance", "d")  # the nearest of all is the nearest of those within reach
    to_b = j.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", "m.b", F.col("m.d").alias("distance"))
    to_a = j.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("b", "m.a")
    return to_b.join(to_a, ["a", "b"])


def similar(features: DataFrame, names: list[str], seeds: list, k: int | None = None) -> DataFrame:
    """id, distance: z-scored (population) Euclidean distance to the nearest of a few ``seeds``, which are left out;
    rows with a missing feature aren't indexed; order (distance, id)."""
    f = features.dropna(subset=names)
    stats = f.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).first()
    z = f.select("id", *[((F.col(n) - F.lit(stats[f"m_{n}"])) / F.lit(stats[f"s_{n}"] or 1.0)).alias(n) for n in names])
    rows = z.filter(F.col("id").isin(seeds)).collect()
    if not rows:
        raise KeyError(seeds)
    d = F.least(*[F.sqrt(sum((F.pow(F.col(n) - r[n], F.lit(2.0)) for n in names), F.lit(0.0))) for r in rows], F.lit(float("inf")))
    out = z.filter(~F.col("id").isin(seeds)).select("id", d.alias("distance")).orderBy("distance", "id")
    return out if k is None else out.limit(k)
