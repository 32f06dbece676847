"""Keyed changes of stored tables, each in one job: upserts, vocabularies, moves, labels and accepted edits. Every function returns the
new rows; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import numbered_rows
from .stored import CONDITION_FIELDS, canonical_condition, condition_id

#: What a condition carries besides its identity, and its value in a new row where nothing is given.
PROVENANCE = {"date": "", "replicate": "", "tags": "", "leakage_alpha": float("nan"), "leakage_alpha_source": ""}
SAFE_ID = r"^[A-Za-z0-9._-]+$"


def registered(conditions: DataFrame, given: DataFrame) -> DataFrame:
    """``conditions`` with the conditions of ``given`` (fields of the identity, those of PROVENANCE, ord): new ones are inserted, of
    those that are there only what is given, not null, is replaced. The identity's fields are never touched; several rows of one
    condition are applied in the order of ``ord``. The same call again changes nothing."""
    ident = {n: F.col(n) if n in given.columns else F.lit(None) for n, _ in CONDITION_FIELDS}
    kinds = dict(conditions.dtypes)
    extra = {n: (F.col(n) if n in given.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in PROVENANCE}
    rows = given.select("ord", condition_id(canonical_condition(ident)).alias("condition_id"), *[c.cast(kinds[n]).alias(n) for n, c in ident.items()], *extra.values())
    last = lambda n: F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.col("ord"))).alias(n)
    want = rows.groupBy("condition_id").agg(*[F.first(n).alias(n) for n, _ in CONDITION_FIELDS], *[last(n) for n in PROVENANCE])
    blank = lambda n: F.lit("") if kinds[n] == "string" else F.lit(float("nan"))
    there = F.col("old.__there").isNotNull()
    both = conditions.withColumn("__there", F.lit(True)).alias("old").join(want.alias("new"), "condition_id", "full")
    out = []
    for c in conditions.columns:
        if c == "condition_id":
            out.append(F.col(c))
        elif c in PROVENANCE:
            out.append(F.coalesce(F.col(f"new.{c}"), F.when(there, F.col(f"old.{c}")).otherwise(F.lit(PROVENANCE[c]))).alias(c))
        elif c in dict(CONDITION_FIELDS):
            fresh = F.coalesce(F.col(f"new.{c}"), blank(c))
            out.append(F.when(there, F.col(f"old.{c}")).otherwise(fresh).alias(c))
        else:
            out.append(F.col(f"old.{c}").alias(c))
    return both.select(*out)


def edited_categories(categories: DataFrame, conditions: DataFrame, edits: DataFrame) -> DataFrame:
    """condition_id, code, name: the vocabularies after one edit (condition_id, action, name, new, names) for each of some conditions.

    set takes ``names`` as the whole ordered list, add puts ``name`` at its end, rename puts ``new`` where ``name`` stood, remove takes
    it out and moves all later codes down by one. Names are stripped. A job with any fault fails, and nothing is returned: an
    unknown condition or one that isn't a plain id, two edits of one condition, an unknown action, an empty, repeated or absent
    name. Codes are positions, from 0; molecules keep the names they have."""
    fault = lambda *text: F.raise_error(F.concat(*[t if not isinstance(t, str) else F.lit(t) for t in text]))
    now = categories.groupBy("condition_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "name"))), lambda s: s["name"]).alias("own"))
    one = edits.groupBy("condition_id").agg(F.count("*").alias("edits"), F.first("action").alias("action"), F.first(F.btrim("name")).alias("name"), F.first("name").alias("as_given"), F.first(F.btrim("new")).alias("new"), F.first("names").alias("names"))
    one = one.join(conditions.select("condition_id", F.lit(True).alias("known")), "condition_id", "left")
    both = now.join(one, "condition_id", "full").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))
    has = lambda c: F.array_contains("own", c)
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    name, new, who = F.col("name"), F.col("new"), F.col("condition_id")
    listed = F.transform("names", lambda n: F.btrim(n))
    put = F.when(empty(name), fault("an empty name in ", who)).when(has(name), fault("already there in ", who, ": ", name)).otherwise(F.concat("own", F.array(name)))
    whole = F.when(F.exists(listed, lambda n: empty(n)), fault("an empty name in ", who)).when(F.size(F.array_distinct(listed)) < F.size(listed), fault("a name twice in ", who)).otherwise(listed)
    given = F.col("as_given")
    moved = F.when(~has(given), fault("not there in ", who, ": ", given)).when(empty(new), fault("an empty name in ", who)).when((new != given) & has(new), fault("already there in ", who, ": ", new))
    moved = moved.otherwise(F.transform("own", lambda c: F.when(c == given, new).otherwise(c)))
    gone = F.when(~has(given), fault("not there in ", who, ": ", given)).otherwise(F.filter("own", lambda c: c != given))
    checked = F.when(F.col("edits").isNull(), F.col("own")).when(~who.rlike(SAFE_ID), fault("not a plain id: ", who)).when(F.col("known").isNull(), fault("unknown condition: ", who)).when(F.col("edits") > 1, fault("several edits of ", who))
    action = F.col("action")
    after = checked.when(action == "set", whole).when(action == "add", put).when(action == "rename", moved).when(action == "remove", gone).otherwise(fault("unknown action: ", F.coalesce(action, F.lit(""))))
    return both.select("condition_id", F.posexplode(after).alias("code", "name"))


def category_codes(molecules: DataFrame, categories: DataFrame) -> DataFrame:
    """``molecules`` with category_code: the place of their category in the vocabulary of their condition; null if it isn't in it."""
    codes = categories.select("condition_id", F.col("name").alias("category"), F.col("code").alias("category_code"))
    return molecules.drop("category_code").join(codes, ["condition_id", "category"], "left").select(*molecules.drop("category_code").columns, "category_code")


def moved_condition(molecules: DataFrame, conditions: DataFrame, source: str, target: str, merge: bool = False, actor: str = "") -> tuple[DataFrame, DataFrame]:
    """All molecules of condition ``source`` under ``target``, and one row for the audit (action, subject, detail).

    KeyError if ``source`` has neither a row nor a molecule; ValueError if ``target`` is there already (a merge of the two) and ``merge``
    is false, or both are the same."""
    if source == target:
        raise ValueError("source and target are the same")
    at = lambda df, c: not df.filter(F.col("condition_id") == c).isEmpty()
    if not at(conditions, source) and not at(molecules, source):
        raise KeyError(source)
    merging = at(conditions, target)
    if merging and not merge:
        raise ValueError(f"{target} is a condition already: moving merges the two")
    n = molecules.filter(F.col("condition_id") == source).count()
    got = molecules.withColumn("condition_id", F.when(F.col("condition_id") == source, F.lit(target)).otherwise(F.col("condition_id")))
    detail = f"{source} to {target}, {n} molecules" + (f", by {actor}" if actor else "")
    return got, molecules.sparkSession.createDataFrame([("merge" if merging else "rekey", target, detail)], "action string, subject string, detail string")


def labelled(log: DataFrame, molecules: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with ``events`` (its columns but event_seq, and ord) behind it, and the molecules with the labels that people gave: all
    rows of a key get the last human label of the events; other sources leave the rows as they are.

    KeyError if an event names a key that no molecule has; then nothing is returned."""
    lost = events.join(molecules.select("molecule_key"), "molecule_key", "left_anti").select("molecule_key").first()
    if lost:
        raise KeyError(lost["molecule_key"])
    last = log.agg(F.coalesce(F.max("event_seq"), F.lit(0)).cast("long").alias("n")).first()["n"]
    new = numbered_rows(events, ["ord"], "__place").withColumn("event_seq", F.col("__place") + F.lit(last + 1)).drop("__place", "ord")
    told = events.filter("source = 'human'").groupBy("molecule_key").agg(F.max_by("label_value", "ord").alias("__new"))
    rows = molecules.join(told, "molecule_key", "left").withColumn("label", F.coalesce("__new", "label")).select(*molecules.columns)
    return log.unionByName(new.select(*log.columns)), rows


def returned_changes(matches: DataFrame, returned: DataFrame, molecules: DataFrame) -> DataFrame:
    """molecule_id, w0, w1, new_w0, new_w1, window_changed, new_class, class_changed: what came back (r, w0, w1, class) differs in from the
    stored molecules, by matches (r, s = molecule_id). A class is changed if it is 0 and the molecule has a category, or not 0."""
    got = matches.filter(F.col("s").isNotNull()).join(returned.select("r", F.col("w0").alias("new_w0"), F.col("w1").alias("new_w1"), F.col("class").alias("new_class")), "r")
    both = got.join(molecules.select(F.col("molecule_id").alias("s"), "w0", "w1", "category"), "s")
    moved = (F.col("w0") != F.col("new_w0")) | (F.col("w1") != F.col("new_w1"))
    classed = F.when(F.col("new_class") == 0, F.coalesce(F.col("category"), F.lit("")) != "").otherwise(True)
    return both.select(F.col("s").alias("molecule_id"), "w0", "w1", "new_w0", "new_w1", moved.alias("window_changed"), "new_class", classed.alias("class_changed"))


def accepted_changes(molecules: DataFrame, changes: DataFrame, windows: bool | list = False, classes: bool | list = False) -> tuple[DataFrame, DataFrame]:
    """The molecules after the accepted ones of ``changes`` (true: all of them, or a list of ids), and molecule_id, window_applied,
    class_applied, class_deferred for those that were accepted. Class 0 takes the category away; another class waits for a
    vocabulary and is deferred."""

    def chosen(accept) -> Column:
        return F.lit(accept) if isinstance(accept, bool) else F.col("molecule_id").isin(list(accept))

    told = changes.select("molecule_id", "new_w0", "new_w1", (F.col("window_changed") & chosen(windows)).alias("window_applied"), (F.col("class_changed") & chosen(classes) & (F.col("new_class") == 0)).alias("class_applied"), (F.col("class_changed") & chosen(classes) & (F.col("new_class") != 0)).alias("class_deferred"))
    both = molecules.join(told, "molecule_id", "left")
    new = {c: F.when(F.coalesce("window_applied", F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("w0", "w1")}
    new["category"] = F.when(F.coalesce("class_applied", F.lit(False)), "").otherwise(F.col("category"))
    rows = both.withColumns(new).select(*molecules.columns)
    return rows, told.filter("window_applied OR class_applied OR class_deferred").select("molecule_id", "window_applied", "class_applied", "class_deferred")
