"""Joins and roll-ups of stored tables: fitted levels, label merges, conditions, model comparison, ranking uplift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import parsed_names
from ..functions.numbers import decimal_text, let
from ..functions.scalar import NO_STATE, bin_index
from .curation import IDENTITY
from .population import by_frame

#: Bounds of the model comparison before any were measured (the first and the third are floors).
BOUNDS = {"state_count_fraction": 0.95, "state_mean_abs_delta": 0.02, "viterbi_agreement": 0.95, "relative_elbo": 0.01}
FLOORS = ("state_count_fraction", "viterbi_agreement")
#: The fields of a condition's identity and their names in its canonical text.
CONDITION_FIELDS = (("construct_variant", "construct"), ("dye", "dye"), ("ligand", "ligand"), ("ligand_concentration", "ligand_conc"), ("ligand_concentration_unit", "ligand_unit"), ("buffer", "buffer"), ("temperature_c", "temp_c"), ("laser_power", "laser"))


def fitted_levels(paths: DataFrame, molecules: DataFrame, means: Sequence[float], current: DataFrame | None = None, include_rejected: bool = False) -> DataFrame:
    """Fitted state paths joined to their molecules, with ``level`` (mean of the state; null at NO_STATE).

    Rejected molecules go unless asked for. With ``current`` (molecule_id, hash), rows of ``paths`` whose column hash differs
    from it, or whose molecule is gone from it, are stale and go."""
    if current is not None:
        paths = paths.join(current.select("molecule_id", F.col("hash").alias("__now")), "molecule_id").filter(F.col("hash") == F.col("__now")).drop("__now")
    own = molecules.select("molecule_id", "label").filter(F.lit(include_rejected) | (F.col("label") != -1))
    return paths.drop("label").join(own, "molecule_id").withColumn("level", level_of(F.col("state"), means))


def level_of(state: Column, means: Sequence[float]) -> Column:
    return F.when(state != NO_STATE, F.element_at(F.array(*map(F.lit, means)), state.cast("int") + 1))


def nearest_state(level: Column, means: Sequence[float]) -> Column:
    """Index of the nearest mean, the first of equal ones; NO_STATE for null and NaN."""
    gaps = F.array(*[F.abs(level - m) for m in means])
    return F.when(level.isNull() | F.isnan(level), F.lit(NO_STATE)).otherwise((F.array_position(gaps, F.array_min(gaps)) - 1).cast("int"))


def level_transitions(levels: DataFrame, nskip: int = 2) -> DataFrame:
    """molecule_id, initial, final: (v[t], v[t + nskip]) where the level changes from t to t + 1; gaps have no pair."""
    if nskip < 1:
        raise ValueError("nskip must be positive")
    p = levels.select("molecule_id", F.col("level").alias("initial"), F.lead("level").over(by_frame()).alias("__b"), F.lead("level", nskip).over(by_frame()).alias("final"))
    return p.filter(F.col("initial").isNotNull() & F.col("final").isNotNull() & (F.col("__b") != F.col("initial"))).drop("__b")


def transition_bins(pairs: DataFrame, bins: int = 101, low: float = -0.25, high: float = 1.25, dense: bool = True) -> DataFrame:
    """initial_bin, final_bin, n, density; the last bins are closed, pairs out of range have no bin. All bins are there unless
    ``dense`` is false, of density 0 if no pair has any bin."""
    b = lambda c: bin_index(F.col(c), low, high, bins).alias(f"{c}_bin")
    got = pairs.select(b("initial"), b("final")).dropna().groupBy("initial_bin", "final_bin").agg(F.count("*").alias("n"))
    total = got.agg(F.sum("n").alias("__t"))
    area = ((high - low) / bins) ** 2
    if dense:
        each = pairs.sparkSession.range(bins * bins).select(F.floor(F.col("id") / bins).cast("int").alias("initial_bin"), (F.col("id") % bins).cast("int").alias("final_bin"))
        got = each.join(got, ["initial_bin", "final_bin"], "left").fillna(0, ["n"])
    return got.crossJoin(F.broadcast(total)).select("initial_bin", "final_bin", "n", F.coalesce(F.col("n") / (F.col("__t") * area), F.lit(0.0)).alias("density"))


def transition_totals(pairs: DataFrame, low: float = -0.25, high: float = 1.25) -> DataFrame:
    """One row: n_transitions and n_molecules over all pairs, n_outside of the range."""
    inside = F.col("initial").between(low, high) & F.col("final").between(low, high)
    return pairs.agg(F.count("*").alias("n_transitions"), F.countDistinct("molecule_id").alias("n_molecules"), F.count_if(~inside).alias("n_outside"))


def state_tally(paths: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """states, n, outside: molecules by their number of occupied states, dense from ``low`` to ``high`` (the largest met, if
    none is given); ``outside`` repeats the number of molecules beyond the bounds."""
    per = paths.filter(F.col("state") != NO_STATE).groupBy("molecule_id").agg(F.countDistinct("state").alias("states"))
    met = per.groupBy("states").agg(F.count("*").alias("n"))
    stats = met.agg(F.coalesce(F.lit(high), F.greatest(F.lit(low), F.max("states"))).cast("long").alias("top"))
    grid = F.broadcast(stats).select(F.explode(F.sequence(F.lit(low).cast("long"), "top")).alias("states"))
    joined = grid.join(met, "states", "full").select("states", F.coalesce("n", F.lit(0)).alias("n"))
    top = F.coalesce(F.lit(high), F.lit(1 << 62))
    bounds = (F.col("states") >= low) & (F.col("states") <= top)
    out = met.agg(F.coalesce(F.sum(F.when(~bounds, F.col("n"))), F.lit(0)).alias("outside"))
    return joined.filter(bounds).crossJoin(F.broadcast(out))


def probability_histogram(p: DataFrame, bins: int = 20) -> DataFrame:
    """bin, n, density of per-molecule probabilities (column p, nulls left out) over [0, 1], dense."""
    got = p.select(bin_index(F.col("p"), 0.0, 1.0, bins).alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("n"))
    dense = p.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").fillna(0, ["n"])
    total = F.broadcast(got.agg(F.sum("n").alias("__t")))
    return dense.crossJoin(total).select("bin", "n", F.coalesce(F.col("n") * bins / F.col("__t"), F.lit(0.0)).alias("density"))


def keys_by(molecules: DataFrame, by: str, key: str, order: str) -> DataFrame:
    """``by``, keys: the keys of each group in store order."""
    return molecules.filter(F.col(by).isNotNull()).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda x: x[key]).alias("keys"))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """``value``, first: distinct values with the smallest order they were met at."""
    return rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("first"))


#: The sources of labels that a first model starts from.
SEED_SOURCES = ("deeplasi-provisional", "cross-condition-seed")


def provisional_labels(log: DataFrame) -> DataFrame:
    """molecule_key, label_value: the latest event of a seed source for each key; 0 takes the label away. Events of people and of
    any other source don't count."""
    last = log.filter(F.col("source").isin(*SEED_SOURCES)).groupBy("molecule_key").agg(F.max_by("label_value", "event_seq").alias("label_value"))
    return last.filter("label_value <> 0")


def label_merge(owner: DataFrame, other: DataFrame, molecules: DataFrame) -> DataFrame:
    """One row for each event of ``other`` with its outcome: skipped (not human), unmatched (no such key among the owner's
    ``molecules``), ambiguous (the key's rows have several conditions), duplicate (in the owner's log, or met before in
    ``other``, by six-field identity in which null equals null) or appended, then with the owner's condition_id."""
    keys = molecules.groupBy("molecule_key").agg(F.countDistinct(F.coalesce(F.col("condition_id").cast("string"), F.lit(""))).alias("__n"), F.min("condition_id").alias("condition_id"))
    # a field's text behind its presence, so that null is a value of its own
    identity = F.struct(*[F.struct(F.col(c).isNull().alias("a"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("b")).alias(c) for c in IDENTITY])
    had = owner.select(identity.alias("__id")).distinct().withColumn("__had", F.lit(True))
    nth = F.row_number().over(W.partitionBy("__id").orderBy("event_seq"))
    at = other.drop("condition_id").withColumn("__id", identity).join(keys, "molecule_key", "left")
    told = F.when(F.col("source") != "human", "skipped").when(F.col("__n").isNull(), "unmatched").when(F.col("__n") > 1, "ambiguous")
    at = at.withColumn("__told", told).withColumn("__k", nth).join(had, "__id", "left")
    outcome = F.coalesce("__told", F.when(F.col("__had") | (F.col("__k") > 1), "duplicate").otherwise("appended"))
    return at.withColumn("outcome", outcome).withColumn("condition_id", F.when(F.col("outcome") == "appended", F.col("condition_id"))).drop("__n", "__had", "__k", "__id", "__told")


def label_verdicts(merged: DataFrame, molecules: DataFrame, order: str = "store_ord") -> DataFrame:
    """molecule_key, decision, verdict: the latest decision of the merged events that have a place, against the owner's label, that
    of the key's first row in store order: adopted (the owner has none), agreement or conflict (the owner's stays). A key whose
    latest decision is 0 was withdrawn and has no verdict."""
    own = molecules.groupBy("molecule_key").agg(F.min_by("label", order).alias("__own"))
    last = merged.filter("outcome IN ('appended', 'duplicate')").groupBy("molecule_key").agg(F.max_by("label_value", "event_seq").alias("decision")).filter("decision <> 0")
    verdict = F.when(F.col("__own") == 0, "adopted").when(F.col("__own") == F.col("decision"), "agreement").otherwise("conflict")
    return last.join(own, "molecule_key").select("molecule_key", "decision", verdict.alias("verdict"))


def canonical_condition(fields: dict[str, Column]) -> Column:
    """The text that names a condition: its fields in fixed order as JSON; absent numbers are null, absent texts empty."""
    parts = []
    for name, short in CONDITION_FIELDS:
        c = fields.get(name, F.lit(None))
        if name in ("ligand_concentration", "temperature_c", "laser_power"):
            text = F.coalesce(decimal_text(c, "NaN", "Infinity"), F.lit("null"))
        else:
            quoted = F.to_json(F.struct(F.coalesce(c.cast("string"), F.lit("")).alias("a")))
            text = let(quoted, lambda q: F.substring(q, F.lit(6), F.length(q) - 6))
        parts.append(F.concat(F.lit(f'"{short}":'), text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def condition_id(canonical: Column) -> Column:
    return F.concat(F.lit("cond-"), F.substring(F.sha2(canonical, 256), 1, 12))


def inconsistent_conditions(conditions: DataFrame) -> DataFrame:
    """Rows whose id isn't that of their own fields."""
    return conditions.filter(F.col("condition_id") != condition_id(canonical_condition({n: F.col(n) for n, _ in CONDITION_FIELDS if n in conditions.columns})))


def condition_key(canonical: Column) -> Column:
    """A struct of the fields of a condition from its canonical text; what is null there is null."""
    numbers = ("ligand_concentration", "temperature_c", "laser_power")
    kinds = ", ".join(f"{short} {'double' if name in numbers else 'string'}" for name, short in CONDITION_FIELDS)
    # the text is read once, not for each field that is asked for
    return let(F.from_json(canonical, kinds), lambda got: F.struct(*[got[short].alias(name) for name, short in CONDITION_FIELDS]))


def new_conditions(molecules: DataFrame, conditions: DataFrame) -> DataFrame:
    """condition_id, source_filename and the fields of a condition: ids of molecules that no condition has yet, each with its first
    faithful file in store order, whose name says the condition of that id. An id without one is unresolved: its file and fields
    are null. Empty and null ids don't count."""
    lone = molecules.filter("condition_id <> ''").join(conditions.select("condition_id"), "condition_id", "left_anti")
    files = lone.groupBy("condition_id", "source_filename").agg(F.min("store_ord").alias("store_ord"))
    parsed = parsed_names(files, "source_filename")
    names = [n for n, _ in CONDITION_FIELDS]
    fields = {n: F.col(n) if n in parsed.columns else F.lit(None).cast("double" if n in ("temperature_c", "laser_power") else "string") for n in names}
    faithful = F.col("condition_id") == condition_id(canonical_condition(fields))
    witness = F.struct("source_filename", *[c.alias(n) for n, c in fields.items()])
    best = parsed.groupBy("condition_id").agg(F.min_by(F.when(faithful, witness), F.when(faithful, F.col("store_ord"))).alias("w"))
    return best.select("condition_id", "w.*")


def best_by_elbo(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """nstates, elbo of the fit with the largest bound; one that is missing or not finite counts as minus infinity (and comes back
    as it is), ties go to fewer states."""
    fine = F.col("elbo").isNotNull() & ~F.isnan("elbo") & (F.abs("elbo") != float("inf"))
    score = F.when(fine, F.col("elbo")).otherwise(float("-inf"))
    best = F.max_by(F.struct("nstates", "elbo"), F.struct(score, -F.col("nstates")))
    return fits.groupBy(*by).agg(best.alias("b")).select(*by, "b.nstates", "b.elbo")


def model_parity(paths: DataFrame, ref_means: Sequence[float], test_means: Sequence[float], ref_elbo: float | None, test_elbo: float | None, bounds: dict[str, float] | None = None) -> DataFrame:
    """One row: the four measures of how far a fit is from a reference fit, and whether it passes.

    ``paths`` has molecule_id, ref, test (states by rank of mean, NO_STATE in gaps). Missing values never pass."""
    bounds = BOUNDS | (bounds or {})
    n = lambda c: F.count_distinct(F.when(F.col(c) != NO_STATE, F.col(c)))
    both = (F.col("ref") != NO_STATE) & (F.col("test") != NO_STATE)
    per = paths.groupBy("molecule_id").agg(n("ref").alias("r"), n("test").alias("t"), F.count_if(both).alias("f"), F.count_if(both & (F.col("ref") == F.col("test"))).alias("s"))
    told = (F.col("r") > 0) | (F.col("t") > 0)
    same = len(ref_means) == len(test_means)
    delta = max((abs(a - b) for a, b in zip(sorted(ref_means), sorted(test_means))), default=float("inf")) if same else float("inf")
    elbo = abs(test_elbo - ref_elbo) / abs(ref_elbo) if ref_elbo and test_elbo is not None else float("inf")
    got = per.agg(
        F.coalesce(F.count_if(told & (F.col("r") == F.col("t"))) / F.count_if(told), F.lit(1.0)).alias("state_count_fraction"), F.lit(delta).alias("state_mean_abs_delta"),
        (F.coalesce(F.sum("s") / F.sum("f"), F.lit(0.0)) if same else F.lit(0.0)).alias("viterbi_agreement"), F.lit(elbo).alias("relative_elbo"),
    )
    ok = F.lit(True)
    for name, bound in bounds.items():
        ok = ok & (F.col(name) >= bound if name in FLOORS else F.col(name) <= bound)
    return got.withColumn("passes", ok)


def frozen_bounds(runs: DataFrame, margin: float = 0.5, percentile: float | None = None) -> DataFrame:
    """One row: for each measure the more permissive of the bound before and the worst of the ``runs``, widened by ``margin``; a
    run with a missing or infinite value is the worst there is, and so are no runs at all (floors 0, ceilings infinite). Four
    digits. With ``percentile`` (0 to 100) that percentile of the finite values follows, as <measure>_p; null without any."""
    out = []
    for name, bound in BOUNDS.items():
        c = F.col(name)
        fine = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        bad = (F.count(F.lit(1)) == 0) | (F.count_if(~fine) > 0)
        if name in FLOORS:
            worst = F.when(bad, 0.0).otherwise(F.min(c))
            out.append(F.round(F.least(F.lit(bound), F.greatest(F.lit(0.0), worst - margin * (1 - worst))), 4).alias(name))
        else:
            worst = F.greatest(F.lit(bound), F.when(~bad, F.max(c)) * (1 + margin))
            out.append(F.when(bad, float("inf")).otherwise(F.round(worst, 4)).alias(name))
        if percentile is not None:
            out.append(F.percentile(F.when(fine, c), percentile / 100).alias(f"{name}_p"))
    return runs.agg(*out)


def uplift(rank: DataFrame, order: DataFrame, good: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """precision, baseline, uplift by ``by``: precision at k of ``rank`` (id, rank) less that of the store order (id, store_ord),
    both over the labelled ids of ``good`` (id, good)."""
    if k < 1:
        raise ValueError("k must be positive")
    at = rank.select("id", "rank").join(order.select("id", "store_ord", *by), "id").join(good.select("id", "good"), "id")
    place = lambda c: F.row_number().over(W.partitionBy(*by, F.lit(0)).orderBy(c))
    at = at.withColumn("a", place("rank")).withColumn("b", place("store_ord")).filter((F.col("a") <= k) | (F.col("b") <= k))
    share = lambda c: F.avg(F.when(F.col(c) <= k, F.col("good").cast("double")))
    return at.groupBy(*by).agg(share("a").alias("precision"), share("b").alias("baseline"), (share("a") - share("b")).alias("uplift"))


def ship_gate(uplifts: DataFrame, bar: float) -> DataFrame:
    """One row: videos, median_points (percentage points) and whether it reaches the ``bar``; one value per video."""
    m = F.median("uplift") * 100
    return uplifts.agg(F.count("*").alias("videos"), m.alias("median_points"), (m >= bar).alias("shipped"))


def point_rms(pairs: DataFrame) -> DataFrame:
    """One row, rms: root of the mean squared distance of (ax, ay) and (bx, by)."""
    d = lambda c: F.pow(F.col(f"a{c}") - F.col(f"b{c}"), F.lit(2.0))
    return pairs.agg(F.sqrt(F.avg(d("x") + d("y"))).alias("rms"))


def circumradius(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Radius of the circle through three points; infinite if they lie on a line."""
    side = lambda x1, y1, x2, y2: F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
    area = F.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2
    return F.when(area > 0, side(ax, ay, bx, by) * side(bx, by, cx, cy) * side(cx, cy, ax, ay) / (4 * area)).otherwise(F.lit(float("inf")))


def normalised(frames: DataFrame, length: int = 500) -> DataFrame:
    """molecule_id, slot, donor, acceptor, real: each trace over its largest total (1 if that isn't positive), cut or filled with
    zeros to ``length`` frames."""
    top = F.max(F.col("donor") + F.col("acceptor")).over(W.partitionBy("molecule_id"))
    scale = F.when(top > 0, top).otherwise(1.0)
    nth = F.row_number().over(by_frame()) - 1
    x = frames.select("molecule_id", nth.alias("slot"), (F.col("donor") / scale).alias("donor"), (F.col("acceptor") / scale).alias("acceptor")).filter(F.col("slot") < length)
    grid = frames.select("molecule_id").distinct().select("molecule_id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("slot"))
    return grid.join(x.withColumn("real", F.lit(True)), ["molecule_id", "slot"], "left").fillna(0.0, ["donor", "acceptor"]).fillna(False, ["real"])


def resolve_quantity(quantity: str) -> tuple[str, str]:
    """Columns of the donor and the acceptor layer of a quantity."""
    if quantity not in ("corrected", "raw"):
        raise ValueError(f"unknown quantity: {quantity}")
    return f"donor_{quantity}", f"acceptor_{quantity}"


def chosen(rows: DataFrame, keys: Sequence[str], key: str = "molecule_key", include_rejected: bool = False) -> DataFrame:
    """All rows of the given keys in the caller's order (column ``ord``; a repeated key counts once); KeyError if one is missing."""
    want = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(keys))], f"{key} string, ord int")
    lost = want.join(rows.select(key), key, "left_anti").limit(1).collect()
    if lost:
        raise KeyError(lost[0][key])
    got = rows.join(F.broadcast(want), key)
    return got if include_rejected else got.filter(F.col("label") != -1)
