"""Hierarchical language identification: a linear machine for the family, then one-versus-one machines inside it.

Features are hashed character n-grams (bytes of lower-cased UTF-8, orders 1 to 3) as relative frequencies, so a
machine's margin is the mean of its weights over all n-gram positions of the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, col

#: Language to family (ISO 639-1 codes). A language not named here is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
}
UNDETERMINED = "und"
BITS = 12
_LETTER = regex.compile(r"\p{L}")


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed n-gram ids (orders 1 to 3) of a byte array, 2**BITS buckets for each order."""
    b = data.astype(np.uint32)
    size = 1 << BITS
    out = [b & (size - 1)]
    for n in (2, 3):
        if len(b) >= n:
            key = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                key = key * np.uint32(257) + b[k : len(b) - n + 1 + k]
            out.append(((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)) + np.uint32((n - 1) * size))
    return np.concatenate(out)


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(" ".join(text.lower().split()).encode(), np.uint8)


def features(text: str, scale: np.ndarray | None = None) -> np.ndarray:
    g = grams(text_bytes(text))
    x = np.bincount(g, minlength=3 << BITS).astype(np.float32) / np.float32(max(1, len(g)))
    return x if scale is None else x * scale


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 12, seed: int = 0) -> np.ndarray:
    """Linear support vector machine, y in {-1, 1}, by dual coordinate descent on the squared hinge loss; classes weigh
    alike. The last weight is the bias."""
    n = len(y)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    d = 1 / (2 * c * weight)
    q = np.einsum("ij,ij->i", x, x) + 1 + d
    a, w, bias, rng = np.zeros(n), np.zeros(x.shape[1]), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(n):
            step = max(a[i] - (y[i] * (x[i] @ w + bias) - 1 + d[i] * a[i]) / q[i], 0.0) - a[i]
            if step:
                a[i] += step
                w += step * y[i] * x[i]
                bias += step * y[i]
    return np.append(w, bias)


@dataclass
class Machine:
    """sign(weights . frequencies + bias) > 0 says ``yes``, else ``no``."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float
    slope: float

    def chance(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin, -30, 30))))


@dataclass
class LanguageModel:
    families: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str, str], Machine] = field(default_factory=dict)

    def vote(self, names: list[str], margins: dict[tuple[str, str], float]) -> tuple[str, float]:
        """One-versus-one votes; ties go to the larger sum of chances, then to the smaller name."""
        if len(names) == 1:
            return names[0], 1.0
        votes: dict[str, int] = dict.fromkeys(names, 0)
        chances = dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            m = self.machines[a, b]
            p = m.chance(margins[a, b])
            votes[a if p >= 0.5 else b] += 1
            chances[a] += p
            chances[b] += 1 - p
        best = min(names, key=lambda n: (-votes[n], -chances[n], n))
        return best, chances[best] / (len(names) - 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); the score is the family's mean chance times the language's inside it."""
        if not text or not self.families or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        g = grams(text_bytes(text))
        counts = np.bincount(g, minlength=3 << BITS)
        at = np.flatnonzero(counts)
        freq = counts[at] / len(g)
        margins = {k: float(m.weights[at] @ freq + m.bias) for k, m in self.machines.items()}
        family, p = self.vote(sorted(self.families), margins)
        lang, q = self.vote(self.families[family], margins)
        return lang, p * q


def fit(texts: list[str], langs: list[str], family_of: dict[str, str] | None = None) -> LanguageModel:
    """Family machines (one-versus-one between families) and language machines inside each family."""
    family_of = FAMILIES if family_of is None else family_of
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of.get(lang, lang), []).append(lang)
    model = LanguageModel(families)
    if not texts:
        return model
    x = np.array([features(t) for t in texts])
    spread = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x))
    scale = np.where(spread > 0, 1 / np.sqrt(np.maximum(spread, 1e-9)), 0.0).astype(np.float32)
    x *= scale
    norm = np.float32(1 / max(1e-12, np.sqrt(np.einsum("ij,ij->i", x, x)).mean()))
    x *= norm
    scale *= norm
    langs_of = np.array(langs)
    family = np.array([family_of.get(v, v) for v in langs])

    def machine(groups: np.ndarray, a: str, b: str) -> None:
        on = (groups == a) | (groups == b)
        y = np.where(groups[on] == a, 1.0, -1.0)
        own = x if on.all() else x[on]
        w = fit_svm(own, y)
        margins = own @ w[:-1].astype(np.float32) + w[-1]
        slope = 4.0 / max(1e-9, float(np.median(np.abs(margins))))
        model.machines[a, b] = Machine(a, b, w[:-1] * scale, float(w[-1]), slope)

    for a, b in combinations(sorted(families), 2):
        machine(family, a, b)
    for members in families.values():
        for a, b in combinations(members, 2):
            machine(langs_of, a, b)
    return model


def train(docs: DataFrame, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", family_of=None) -> LanguageModel:
    """Fit on at most about ``per_language`` documents of each language, those with the smallest hashes of their ids.

    The bound keeps the driver's share fixed at any size. Rows with a null language or without letters don't count.
    """
    ok = docs.filter(col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}")).select(col(id_col).alias("i"), col(text_col).alias("t"), col(lang_col).alias("g"))
    known = {r["g"]: r["n"] for r in ok.groupBy("g").agg(F.count("*").alias("n")).collect()}
    if not known:
        return LanguageModel()
    # a hash below the language's share of 2**31 picks the sample in one scan, without a sort of any group
    share = F.coalesce(*[F.when(col("g") == g, F.lit(min(1.0, 1.2 * per_language / n))) for g, n in known.items()])
    drawn = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(17)), F.lit(1 << 31)) / float(1 << 31)
    rows = ok.filter(drawn < share).select("i", "t", "g").collect()
    rows.sort(key=lambda r: (r["g"], str(r["i"]), r["t"]))
    taken: dict[str, int] = {}
    kept = []
    for r in rows:
        taken[r["g"]] = taken.get(r["g"], 0) + 1
        if taken[r["g"]] <= 2 * per_language:
            kept.append(r)
    return fit([r["t"] for r in kept], [r["g"] for r in kept], family_of)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep=None) -> DataFrame:
    """Append lang_pred and score; no shuffle.

    ``und`` with score 0 where the text is null or has no letter (or nothing was learned). The whole text counts;
    equal texts give equal results; columns of the added names are replaced.
    """

    def make():
        def run(texts):
            got = [model.predict(t) for t in texts]
            return {"lang_pred": [g for g, _ in got], "score": [p for _, p in got]}

        return run

    return append_columns(docs, text_col, make, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)
