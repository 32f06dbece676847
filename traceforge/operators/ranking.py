"""Learned rankings: weighted training sets, models of P(good), and their evaluation on molecules that come later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ACCEPT, UNCURATED, label_weight
from . import boosting
from ._tables import cut
from .curation import current_labels, ranked
from .stored import provisional_labels, uplift


def ranking_data(features: DataFrame, log: DataFrame, key: str = "molecule_id") -> DataFrame:
    """All columns of ``features`` with label_value, for the molecules that have a label of a person now."""
    now = current_labels(log).select(F.col("molecule_key").alias("__key"), "label_value")
    return features.join(now, F.col(key).cast("string") == F.col("__key")).drop("__key")


def training_set(features: DataFrame, molecules: DataFrame, log: DataFrame, w0: float = 0.3) -> DataFrame:
    """All columns of ``features`` (molecule_id, ...) with good and weight, for the molecules that have a label.

    A person's label on the molecule's row counts fully; without one the latest seed label of its key counts w0 / (1 + n), n the
    labels of people in the key's condition (that of the key's last row in store order). ``molecules``: store_ord, molecule_id,
    molecule_key, condition_id, label."""
    blank = F.coalesce(F.col("condition_id").cast("string"), F.lit(""))
    human = molecules.groupBy(blank.alias("__c")).agg(F.count_if(F.col("label") != UNCURATED).alias("__n"))
    key = molecules.groupBy("molecule_key").agg(F.max_by(blank, "store_ord").alias("__c"))
    own = molecules.select("molecule_id", "molecule_key", F.col("label").alias("__label"))
    rows = features.drop("molecule_key").join(own, "molecule_id").join(provisional_labels(log).withColumnRenamed("label_value", "__seed"), "molecule_key", "left")
    rows = rows.join(key, "molecule_key").join(human, "__c", "left")
    told = F.col("__label") != UNCURATED
    good = F.when(told, F.col("__label") == ACCEPT).otherwise(F.col("__seed") == ACCEPT)
    return rows.filter(told | F.col("__seed").isNotNull()).select(*features.columns, good.alias("good"), label_weight(told, F.coalesce("__n", F.lit(0)), w0).alias("weight"))


def learned_ranking(features: DataFrame, training: DataFrame, names: Sequence[str], params: boosting.Params | None = None) -> DataFrame:
    """id, score, rank of every molecule of ``features``, the likeliest good first (ties by id): nothing is left out."""
    model = boosting.fit(training, names, "good", "weight", params)
    return ranked(boosting.scored(features, model, ["molecule_id"]).withColumnRenamed("molecule_id", "id"))


def prequential(rows: DataFrame, names: Sequence[str], k: int, params: boosting.Params | None = None) -> DataFrame:
    """movie, n_labeled, precision, baseline, uplift, skipped: each movie is ranked by a model of the movies before it, then joins them.

    ``rows``: labelled molecules with movie, movie_ord (the order of curation), id, store_ord, good and the features. precision and
    baseline are those of the first min(k, n) by score and in store order. Movies before which not both classes were met are
    skipped. ValueError if all are. A model is trained on no row of its movie or of a later one; only the bins of the features,
    which know no label, are common to all."""
    if k < 1:
        raise ValueError("k must be positive")
    rows = cut(rows.filter(F.col("good").isNotNull()))
    movies = sorted((r["movie_ord"], r["movie"], r["n"]) for r in rows.groupBy("movie_ord", "movie").agg(F.count("*").alias("n")).collect())  # a row a movie
    models = boosting.fit_prefixes(rows, names, "good", "movie_ord", [o for o, _, _ in movies], params=params)
    if not models:
        raise ValueError("no movie has a model before it: movies with both classes must come first")
    scores = boosting.scored(rows, models, ["id", "movie"], "movie_ord")
    rank = ranked(scores.select("id", "score"))
    got = uplift(rank, rows.select("id", "store_ord", "movie"), rows.select("id", "good"), k, ["movie"])
    kind = dict(rows.dtypes)["movie"]
    listed = rows.sparkSession.createDataFrame([(m, n, o not in models) for o, m, n in movies], f"movie {kind}, n_labeled long, skipped boolean")
    return listed.join(got, "movie", "left").select("movie", "n_labeled", "precision", "baseline", "uplift", "skipped")
