"""Scalar functions on traces: efficiencies, corrections, windows, bins, keys and weights. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STATE = -1
REJECT, UNCURATED, ACCEPT = -1, 0, 1


def corrected_efficiency(donor: Column, acceptor: Column, alpha=0.0, gamma=1.0) -> Column:
    """(A - alpha D) / ((A - alpha D) + gamma D); null only where the denominator is exactly 0."""
    signal = acceptor - F.lit(alpha) * donor
    whole = signal + F.lit(gamma) * donor
    return F.when(whole != 0, signal / whole)


def apparent_efficiency(donor: Column, acceptor: Column) -> Column:
    return corrected_efficiency(donor, acceptor)


def without_leakage(donor: Column, acceptor: Column, alpha) -> Column:
    return acceptor - F.lit(alpha) * donor


def bin_index(x: Column, low: float, high: float, bins: int, closed: bool = True) -> Column:
    """Half-open bins over [low, high]; the last is closed unless ``closed`` is false; null outside and for null."""
    inside = (x >= low) & ((x <= high) if closed else (x < high))
    return F.when(inside, F.least(F.floor((x - low) * bins / (high - low)), F.lit(bins - 1)).cast("int"))


def state_of(e: Column, *cuts: float) -> Column:
    """Number of cuts at or below the value; NO_STATE for null."""
    return F.when(e.isNull(), F.lit(NO_STATE)).otherwise(sum((F.when(e >= c, 1).otherwise(0) for c in cuts), F.lit(0)))


def molecule_key(movie_sha: Column, x: Column, y: Column, quantum: float = 0.1) -> Column:
    """SHA-256 of the movie's hash and the quantised position (half away from zero), parted by bars."""
    q = lambda c: F.round(c / quantum).cast("long").cast("string")
    return F.sha2(F.concat_ws("|", movie_sha, q(x), q(y)), 256)


def label_weight(is_human: Column, n_human: Column, w0: float = 0.3) -> Column:
    return F.when(is_human, F.lit(1.0)).otherwise(F.lit(w0) / (1 + n_human))


def informativeness(p: Column) -> Column:
    return 1 - F.abs(2 * p - 1)


def survival(model: str, tau: Column, *p: float) -> Column:
    """Closed forms: single (k, a), double (k1, k2, a, b), triple (k1, k2, k3, a, b, c), stretched (k, beta, a)."""
    n = {"single": 1, "double": 2, "triple": 3}
    if model == "stretched":
        k, beta, a = p
        return F.lit(a) * F.exp(-F.pow(F.lit(k) * tau, F.lit(beta)))
    if model not in n:
        raise ValueError(f"unknown survival model: {model}")
    return sum((F.lit(a) * F.exp(-F.lit(k) * tau) for k, a in zip(p[: n[model]], p[n[model] :])), F.lit(0.0))


def tail_window(acceptor_bleach: Column, donor_bleach: Column, n: Column) -> tuple[Column, Column]:
    return acceptor_bleach, F.least(donor_bleach, n)


def active(frame: Column, bleach: Column) -> Column:
    """Whether a frame lies before the bleach."""
    return frame < bleach


def basename(path: Column) -> Column:
    """What stands behind the last slash or backslash."""
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def reference_status(movie: Column, reference: Column) -> Column:
    """Whether a movie's file is the one that an export names, by the file's name without case: confirmed, mismatch, movie_absent (there
    is no movie) or no_reference (nothing is named)."""
    named = F.coalesce(reference, F.lit("")) != ""
    same = F.lower(basename(movie)) == F.lower(basename(reference))
    return F.when(~named, "no_reference").when(F.coalesce(movie, F.lit("")) == "", "movie_absent").when(same, "confirmed").otherwise("mismatch")


def gamma_windows(step: Column, half: int, n: Column) -> tuple[Column, Column, Column, Column]:
    """Half-open frames before and after the step."""
    at = F.least(step, n)
    return F.greatest(step - half, F.lit(0)), at, at, F.least(step + half, n)
