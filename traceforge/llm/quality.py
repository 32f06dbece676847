"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention weights, learned from document labels only,
say how much each passage counts; a logistic unit scores the weighted passage representation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, col

#: Bytes of a passage.
PASSAGE = 512

_FINE = np.full(256, 40, np.int64)  # bytes of letters beyond ASCII
for _k, _c in enumerate(range(33, 127)):
    ch = chr(_c)
    _FINE[_c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 3
_marks = [c for c in range(33, 127) if not chr(c).isalnum()]
for _k, _c in enumerate(_marks):
    _FINE[_c] = 6 + _k
_FINE[:32], _FINE[32], _FINE[10], _FINE[127] = 39, 4, 5, 39
FINE = 41
_COARSE = np.array([0, 1, 2, 3, 3, 4] + [5] * 33 + [6, 7])
for _c in ".,":
    _COARSE[_FINE[ord(_c)]] = 8
COARSE = 9
SIZE = FINE + COARSE * COARSE + 4


def passages(text: str) -> np.ndarray:
    """Features of each passage, one row per PASSAGE bytes of the whole text (one row of zeros for an empty text).

    Shares of byte classes, shares of neighbouring coarse classes, mean word length, share of distinct words, and how far
    the passage's byte histogram is from the document's.
    """
    b = np.frombuffer(text.encode(), np.uint8)
    if not len(b):
        return np.zeros((1, SIZE))
    rows = -(-len(b) // PASSAGE)
    of = np.arange(len(b)) // PASSAGE
    fine = _FINE[b]
    x = np.zeros((rows, SIZE))
    n = np.bincount(of, minlength=rows)[:, None].astype(float)
    one = np.bincount(of * FINE + fine, minlength=rows * FINE).reshape(rows, FINE) / n
    x[:, :FINE] = one
    coarse = _COARSE[fine]
    two = np.bincount((of * COARSE * COARSE)[1:] + coarse[:-1] * COARSE + coarse[1:], minlength=rows * COARSE * COARSE)
    x[:, FINE : FINE + COARSE * COARSE] = two.reshape(rows, -1) / n
    gaps = one[:, 4] + one[:, 5]
    x[:, -4] = np.minimum(2.0, (1 - gaps) / np.maximum(gaps, 0.02) / 10)
    x[:, -3] = np.abs(one - one.mean(0)).sum(1)
    x[:, -2] = np.minimum(1.0, n[:, 0] / PASSAGE)
    words = text.split()
    x[:, -1] = len(set(words)) / len(words) if words else 0.0
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class AttentionModel:
    mean: np.ndarray
    spread: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int):
        """Document logits; ``bag`` (ascending) is each passage's document."""
        p = self.p
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(z @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (v * u) @ p["w"]
        top = np.full(bags, -np.inf)
        np.maximum.at(top, bag, a)
        k = np.exp(a - top[bag])
        k /= np.bincount(bag, k, bags)[bag]
        s = np.zeros((bags, h.shape[1]))
        np.add.at(s, bag, k[:, None] * h)
        return s @ p["c"] + p["d"][0], (z, h, v, u, k, s)

    def scores(self, texts: list[str]) -> list[float]:
        if not self.p:
            return [0.5] * len(texts)
        x = [passages(t) for t in texts]
        bag = np.repeat(np.arange(len(x)), [len(r) for r in x])
        return _sigmoid(self.forward(np.vstack(x), bag, len(x))[0]).tolist()


def fit(bags: list[np.ndarray], labels: list[int], hidden: int = 24, gate: int = 12, epochs: int = 40, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 0) -> AttentionModel:
    """Gradient descent (Adam) on the documents' log loss; the labels' shares are kept, so scores are chances."""
    if not bags or len(set(labels)) < 2:
        m = AttentionModel(np.zeros(SIZE), np.ones(SIZE), {})
        return m
    rng = np.random.default_rng(seed)
    every = np.vstack(bags)
    model = AttentionModel(every.mean(0), every.std(0) + 1e-3, {
        "E": rng.normal(0, SIZE**-0.5, (SIZE, hidden)), "e": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)),
        "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1),
    })
    p, y = model.p, np.array(labels, float)
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        step = rate * (1 - epoch / epochs) + rate * 0.02
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            x = np.vstack([bags[k] for k in own])
            bag = np.repeat(np.arange(len(own)), [len(bags[k]) for k in own])
            logit, (z, h, v, u, k, s) = model.forward(x, bag, len(own))
            g = (_sigmoid(logit) - y[own]) / len(own)
            gs = g[:, None] * p["c"]
            ga = k * ((gs[bag] * h).sum(1) - (gs * s).sum(1)[bag])
            gvu = ga[:, None] * p["w"]
            gv, gu = gvu * u * (1 - v * v), gvu * v * u * (1 - u)
            gh = (k[:, None] * gs[bag] + gv @ p["V"].T + gu @ p["U"].T) * (1 - h * h)
            grads = {"E": z.T @ gh, "e": gh.sum(0), "V": h.T @ gv, "U": h.T @ gu, "w": (v * u).T @ ga, "c": s.T @ g, "d": np.array([g.sum()])}
            t += 1
            for n, q in grads.items():
                m1[n] = 0.9 * m1[n] + 0.1 * q
                m2[n] = 0.999 * m2[n] + 0.001 * q * q
                p[n] -= step * (m1[n] / (1 - 0.9**t) / (np.sqrt(m2[n] / (1 - 0.999**t)) + 1e-8) + decay * p[n])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel:
    """Fit on at most about ``most`` labelled documents, those with the smallest hashes of their ids; a document with
    contradicting labels counts once for each. Null labels and ids don't count. Passages are encoded on the executors."""
    own = labels.select(col(id_col).alias("i"), col(label_col).cast("int").alias("y")).filter("i IS NOT NULL AND y IN (0, 1)").distinct()
    n = own.count()
    if not n:
        return fit([], [])
    drawn = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(23)), F.lit(1 << 31)) / float(1 << 31)
    own = own.filter(drawn < min(1.0, most / n))
    rows = docs.select(col(id_col).alias("i"), col(text_col).alias("t")).join(F.broadcast(own), "i")
    blob = [T.StructField("bag", T.BinaryType())]
    bags = append_columns(rows, "t", lambda: lambda texts: {"bag": [passages(t or "").astype(np.float32).tobytes() for t in texts]}, blob, keep=["i", "y"])
    got = sorted((str(r["i"]), r["y"], bytes(r["bag"])) for r in bags.collect())
    return fit([np.frombuffer(b, np.float32).reshape(-1, SIZE).astype(float) for _, _, b in got], [y for _, y, _ in got])


def score(docs: DataFrame, model: AttentionModel, threshold: float = 0.3, text_col: str = "text", keep=None) -> DataFrame:
    """Append score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= ``threshold``, else 0); no shuffle.

    Null is the empty text, which has one empty passage and gets a score like any other; without any two labels to learn
    from all scores are 0.5. Equal texts give equal scores; columns of the added names are replaced.
    """

    def make():
        def run(texts):
            s = model.scores([t or "" for t in texts])
            return {"score": s, "predicted": [int(v >= threshold) for v in s]}

        return run

    return append_columns(docs, text_col, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep, most=1 << 20)
