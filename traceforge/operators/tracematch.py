"""Traces that come back matched to stored ones by their values, and what is attached through the match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._tables import cut

#: Cells of a key are so many times as wide as the widest tolerance, so that most values lie in one cell only.
WIDE = 16


def _arrays(traces: DataFrame, name: str) -> DataFrame:
    """``name`` (id), d, a: the values of a trace in the order of its frames, from frame 0 on and without gaps."""
    pair = F.struct("frame", F.col("donor").cast("double").alias("d"), F.col("acceptor").cast("double").alias("a"))
    got = traces.groupBy(F.col("id").alias(name)).agg(F.array_sort(F.collect_list(pair)).alias("v"))
    return got.select(name, F.transform("v", lambda s: s["d"]).alias(f"d{name}"), F.transform("v", lambda s: s["a"]).alias(f"a{name}"))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def candidates(returned: DataFrame, stored: DataFrame, atol: float = 1e-6, rtol: float = 0.0) -> DataFrame:
    """r, s, deviation (the largest) of all traces (id, frame, donor, acceptor) of ``returned`` and ``stored`` that are the same: in the
    frames that both sides can have, |returned - stored| <= atol + rtol |stored| everywhere, and only zeros after them.

    Pairs come from an equality join: the first frame's values and the sum of all are cut into cells wider than their tolerance; a
    stored trace is posted in every cell that its tolerance reaches, a returned one in its own. Then all values are compared.
    A trace is one row; missing values never match. Traces that are all the same meet each other in all pairs."""
    if atol < 0 or rtol < 0:
        raise ValueError("tolerances must not be negative")
    r, s = _arrays(returned, "r"), _arrays(stored, "s")
    most = lambda df, c: df.agg(F.max(F.size(c)).alias("n"))
    t = F.broadcast(most(r, "dr").crossJoin(most(s, "ds").withColumnRenamed("n", "m")).select(F.least("n", "m").alias("t")))  # one row

    def headed(df: DataFrame, k: str) -> DataFrame:
        head = lambda c: F.when(F.size(c) >= F.col("t"), F.slice(c, F.lit(1), F.col("t"))).otherwise(F.concat(F.col(c), F.array_repeat(F.lit(0.0), F.col("t") - F.size(c))))
        rest = lambda c: F.forall(F.slice(F.col(c), F.col("t") + 1, F.greatest(F.lit(0), F.size(c) - F.col("t"))), lambda v: v == 0)
        fine = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        own = df.crossJoin(t).filter((F.col("t") > 0) & fine(f"d{k}") & fine(f"a{k}") & rest(f"d{k}") & rest(f"a{k}"))
        return own.select(k, head(f"d{k}").alias(f"d{k}"), head(f"a{k}").alias(f"a{k}"))

    r, s = headed(r, "r"), headed(s, "s")
    # what a value, or the sum of all, may be off by; a little more for rounding
    slack = lambda v: (atol + rtol * F.abs(v)) * (1 + 1e-9) + 1e-12 * F.abs(v) + 1e-300
    size = lambda k: _total(F.transform(F.concat(f"d{k}", f"a{k}"), lambda v: F.abs(v)))
    whole = lambda k: _total(F.concat(f"d{k}", f"a{k}"))
    keyed = lambda df, k: df.withColumns({"k0": F.get(f"d{k}", 0), "k1": F.get(f"a{k}", 0), "k2": whole(k)})
    r = cut(keyed(r, "r"))
    s = cut(keyed(s, "s").withColumns({"w0": slack(F.col("k0")), "w1": slack(F.col("k1")), "w2": 2 * F.size("ds") * atol * (1 + 1e-9) + (rtol + 1e-9) * size("s") + 1e-300}))
    widths = s.agg(*[(WIDE * F.max(f"w{i}")).alias(f"c{i}") for i in range(3)]).first()
    if widths["c0"] is None:
        return r.join(s, F.lit(False)).select("r", "s", F.lit(0.0).alias("deviation"))
    cell = lambda x, i: F.floor(x / F.lit(widths[f"c{i}"]))
    posted = s
    for i in range(3):
        k, w = F.col(f"k{i}"), F.col(f"w{i}")
        posted = posted.withColumn(f"g{i}", F.explode(F.sequence(cell(k - w, i).cast("decimal(38,0)").cast("long"), cell(k + w, i).cast("decimal(38,0)").cast("long"))))
    own = r.withColumns({f"g{i}": cell(F.col(f"k{i}"), i).cast("decimal(38,0)").cast("long") for i in range(3)})
    both = own.select("r", "dr", "ar", "g0", "g1", "g2").join(posted.select("s", "ds", "as", "g0", "g1", "g2"), ["g0", "g1", "g2"])
    off = lambda x, y: F.zip_with(x, y, lambda a, b: F.struct(F.abs(a - b).alias("off"), (F.abs(b - a) <= atol + rtol * F.abs(b)).alias("near")))
    both = both.withColumn("off", F.concat(off("dr", "ds"), off("ar", "as"))).filter(F.forall("off", lambda o: o["near"]))
    return both.select("r", "s", F.array_max(F.transform("off", lambda o: o["off"])).alias("deviation")).distinct()


def matched(returned: DataFrame, stored: DataFrame, atol: float = 1e-6, rtol: float = 0.0, hints: DataFrame | None = None) -> DataFrame:
    """r, s for every trace of ``returned``: the stored trace that it is, null if there is none left. Each stored trace is taken once.

    Returned traces choose in the order of their ids: the hinted one (``hints``: r, s) if it's a match and free, else the free match of
    the smallest deviation, ties by id. A round settles all whose choice no earlier undecided trace could take, which gives what
    one by one gives; rounds are as many as the longest chain of traces that want the same."""
    c = candidates(returned, stored, atol, rtol)
    if hints is not None:
        c = c.join(hints.select("r", "s").distinct().withColumn("hinted", F.lit(0)), ["r", "s"], "left").withColumn("hinted", F.coalesce("hinted", F.lit(1)))
    else:
        c = c.withColumn("hinted", F.lit(1))
    left, taken = cut(c), None
    while taken is None or not left.isEmpty():
        choice = F.struct("hinted", "deviation", "s")
        best = left.withColumn("best", F.min(choice).over(W.partitionBy("r"))).withColumn("first", F.min("r").over(W.partitionBy("s")))
        now = cut(best.filter((F.col("s") == F.col("best.s")) & (F.col("r") == F.col("first"))).select("r", "s"))
        taken = now if taken is None else taken.unionByName(now)
        left = cut(left.join(now.select("r"), "r", "left_anti").join(now.select("s"), "s", "left_anti"))
    return returned.select(F.col("id").alias("r")).distinct().join(taken, "r", "left")


def recovered(preferred: DataFrame | None, other: DataFrame | None) -> DataFrame:
    """Coordinates (id, donor_x, donor_y, acceptor_x, acceptor_y) of one acquisition from the preferred source, from the other only where
    there is no preferred one at all; with the column source. ValueError without any."""
    for source, rows in (("preferred", preferred), ("other", other)):
        if rows is not None and not rows.isEmpty():
            return rows.withColumn("source", F.lit(source))
    raise ValueError("no source of coordinates")


def with_coordinates(matches: DataFrame, coordinates: DataFrame) -> DataFrame:
    """r, s and the coordinates of s; null where nothing matched."""
    return matches.join(coordinates.withColumnRenamed("id", "s"), "s", "left").select("r", "s", "donor_x", "donor_y", "acceptor_x", "acceptor_y")
