"""Gradient boosting by aggregates: trees for P(good) are grown from sums over (node, feature, bin), never from collected rows.

Rows are cut to one byte a feature once. A pass over them adds up gradients of all open nodes within each task; a shuffle of
these sums by node finds each node's best split where they meet, so the driver gets a row per node. Below a bounded number of
rows a node's rows meet in one task, which goes on to split them in the same way. Several models, each trained on the rows
before a place in an order, are grown by the same passes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut

#: Bins of a feature, besides that of missing values.
BINS, MISSING = 255, 255
#: Least sum of second derivatives of a child.
LEAST_HESSIAN = 1e-3
#: Trees after which the rows' scores are written, so that no pass goes through more of them.
KEEP = 10
#: Models grown by the same passes.
TOGETHER = 16
#: A node of at most so many rows is grown whole in one task (its rows take some 20 bytes and a byte a feature each).
WHOLE = 65_536


@dataclass(frozen=True)
class Params:
    learning_rate: float = 0.1
    trees: int = 100
    leaves: int = 15
    least_rows: int = 5
    l2: float = 1.0


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[float, float, int]  # sums of first and second derivatives, rows
    right: tuple[float, float, int]


@dataclass
class Tree:
    """Nodes by number; node 0 is the root, an inner node's children are in ``child``."""

    split: dict[int, Split] = field(default_factory=dict)
    child: dict[int, tuple[int, int]] = field(default_factory=dict)
    value: dict[int, float] = field(default_factory=dict)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        todo = [0] if 0 in self.child else []
        while todo:
            k = todo.pop()
            s, (a, b) = self.split[k], self.child[k]
            here = np.flatnonzero(at == k)
            x = bins[here, s.feature]
            at[here] = np.where((x <= s.bin) & (x != MISSING) | (x == MISSING) & s.missing_left, a, b)
            todo += [c for c in (a, b) if c in self.child]
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        table = np.zeros(max(self.value) + 1)
        for k, v in self.value.items():
            table[k] = v
        return table[self.leaves(bins)]


@dataclass
class Model:
    """``edges`` of each feature, the log odds of the training rows, the trees; n_train rows, n_good of them good."""

    names: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    n_train: int
    n_good: int


def bin_edges(rows: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Edges of at most BINS bins for each feature, half-way between neighbours of its BINS + 1 quantiles that differ (approximate
    ones, exact up to some 10,000 rows); none for a feature without two values."""
    parts = [k / BINS for k in range(BINS + 1)]
    got = rows.agg(*[F.percentile_approx(F.when(~F.isnan(n), F.col(n)), parts, 10_000).alias(f"q{i}") for i, n in enumerate(names)]).first()
    values = [np.unique(np.array(got[f"q{i}"] or [], float)) for i in range(len(names))]
    return [v[:-1] + (v[1:] - v[:-1]) / 2 for v in values]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.full(x.shape, MISSING, np.uint8)
    for j, e in enumerate(edges):
        known = ~np.isnan(x[:, j])
        out[known, j] = np.searchsorted(e, x[known, j], "left")
    return out


def _matrix(batch: pa.RecordBatch, first: int, count: int) -> np.ndarray:
    return np.stack([batch.column(first + j).to_numpy(zero_copy_only=False).astype(float) for j in range(count)], 1) if count else np.zeros((batch.num_rows, 0))


def best_split(g: np.ndarray, h: np.ndarray, c: np.ndarray, p: Params) -> Split | None:
    """The best split of a node from its sums (features x bins): missing values try both sides; ties go to the first feature and
    the lowest bin, missing values on the right first. None if no split gains."""
    score = lambda a, b: a * a / (b + p.l2)
    whole = (g[0].sum(), h[0].sum(), int(c[0].sum()))
    best = None
    for j in range(len(g)):
        missing = (g[j, MISSING], h[j, MISSING], int(c[j, MISSING]))
        for left in (False, True) if missing[2] else (False,):
            gl, hl, cl = (np.cumsum(v[j, :MISSING]) + (m if left else 0) for v, m in zip((g, h, c), missing))
            gr, hr, cr = whole[0] - gl, whole[1] - hl, whole[2] - cl
            fine = (cl >= p.least_rows) & (cr >= p.least_rows) & (hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN)
            if not fine.any():
                continue
            gain = np.where(fine, score(gl, np.where(fine, hl, 1)) + score(gr, np.where(fine, hr, 1)) - score(whole[0], whole[1]), -np.inf)
            k = int(np.argmax(gain))
            if gain[k] > (best.gain if best else 0.0):
                best = Split(float(gain[k]), j, k, left if missing[2] else int(cl[k]) > int(cr[k]), (float(gl[k]), float(hl[k]), int(cl[k])), (float(gr[k]), float(hr[k]), int(cr[k])))
    return best


def grow_whole(bins: np.ndarray, g: np.ndarray, h: np.ndarray, p: Params) -> dict[int, Split]:
    """The splits of a node whose rows are all here, best first, as many as a tree may have. The node is 1, the children of k are
    2k and 2k + 1."""
    n = bins.shape[1]
    offset, size = np.arange(n) * (BINS + 1), n * (BINS + 1)
    rows, heap, out = {1: np.arange(len(g))}, [], {}

    def look(k: int) -> None:
        own = rows[k]
        if len(own) >= 2 * p.least_rows:
            cells = (bins[own] + offset).ravel()
            g_, h_, c_ = (np.bincount(cells, w, size).reshape(n, -1) for w in (np.repeat(g[own], n), np.repeat(h[own], n), None))
            s = best_split(g_, h_, c_, p)
            if s:
                heapq.heappush(heap, (-s.gain, k, s))

    look(1)
    while heap and len(out) < p.leaves - 1:
        _, k, s = heapq.heappop(heap)
        out[k] = s
        x = bins[rows[k], s.feature]
        left = (x <= s.bin) & (x != MISSING) | (x == MISSING) & s.missing_left
        rows[2 * k], rows[2 * k + 1] = rows[k][left], rows[k][~left]
        del rows[k]
        look(2 * k), look(2 * k + 1)
    return out


class _Grower:
    """One tree, best split first up to a number of leaves. Splits of nodes that may be reached are asked for ahead of need, so a
    tree takes about as many passes as it is deep above the nodes that are grown whole; those that aren't taken are dropped."""

    def __init__(self, p: Params, rows: int):
        self.p, self.tree, self.known, self.size = p, Tree(), {}, {0: (0.0, 0.0, rows)}
        self.next, self.asked = 1, [0]

    def whole(self) -> set[int]:
        return {k for k in self.asked if self.size[k][2] <= WHOLE}

    def told(self, found: dict[int, dict[int, Split]]) -> None:
        whole = self.whole()
        for k in self.asked:
            self._add(k, 1, found.get(k, {}), k in whole)
        self.asked = []

    def _add(self, k: int, at: int, splits: dict[int, Split], whole: bool) -> None:
        s = self.known[k] = splits.get(at)
        if s is None:
            return
        a, b, self.next = self.next, self.next + 1, self.next + 2
        self.tree.split[k], self.tree.child[k], self.size[a], self.size[b] = s, (a, b), s.left, s.right
        for c, to in ((a, 2 * at), (b, 2 * at + 1)):
            if self.size[c][2] < 2 * self.p.least_rows:
                self.known[c] = None  # too few rows to split
            elif whole:
                self._add(c, to, splits, whole)

    def done(self) -> bool:
        """Whether the tree is settled; if not, ``asked`` has the nodes of the next pass."""
        if 0 not in self.known:
            self.asked = [0]
            return False
        heap, taken, ahead = [], [], []
        if self.known[0] is not None:
            heap = [(-self.known[0].gain, 0)]
        while heap and len(taken) < self.p.leaves - 1:
            _, k = heapq.heappop(heap)
            taken.append(k)
            for c in self.tree.child[k]:
                if c not in self.known:
                    ahead.append(c)
                elif self.known[c] is not None:
                    heapq.heappush(heap, (-self.known[c].gain, c))
        if ahead:
            # what was taken may change with what the unknown nodes gain
            self.asked = ahead
            return False
        t, own = self.tree, set(taken)
        t.split, t.child = {k: t.split[k] for k in own}, {k: t.child[k] for k in own}
        for c in [c for k in own for c in t.child[k] if c not in own]:
            g, h, _ = self.size[c]
            t.value[c] = -self.p.learning_rate * g / (h + self.p.l2)
        t.value = t.value or {0: 0.0}  # no split gains
        return True


def _pass(packed: DataFrame, n_features: int, limits: list[int], recent: list[list[Tree]], growing: list[_Grower], p: Params) -> list[dict[int, dict[int, Split]]]:
    """Best splits of the asked nodes of all models: of the node alone, as number 1, or of all that is below it."""
    asked, whole, trees = [g.asked for g in growing], [g.whole() for g in growing], [g.tree for g in growing]
    size = n_features * (BINS + 1)
    offset = np.arange(n_features) * (BINS + 1)
    schema = "model int, node int, of_rows boolean, data binary"

    def row(*values) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds)], names=["model", "node", "of_rows", "data"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            order, y, w = (b.column(k).to_numpy() for k in range(3))
            bins = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, n_features)
            raw = b.column(4).flatten().to_numpy().reshape(len(order), -1)
            for v, limit in enumerate(limits):
                rows = np.flatnonzero(order < limit)
                if not asked[v] or not len(rows):
                    continue
                x = bins[rows]
                f = raw[rows, v].copy()
                for t in recent[v]:
                    f += t.values(x)
                prob = 1 / (1 + np.exp(-f))
                g, h = (prob - y[rows]) * w[rows], prob * (1 - prob) * w[rows]
                at = trees[v].leaves(x)
                for node in asked[v]:
                    own = np.flatnonzero(at == node)
                    if not len(own):
                        continue
                    if node in whole[v]:
                        yield row(v, node, True, g[own].tobytes() + h[own].tobytes() + x[own].tobytes())
                        continue
                    cells = (x[own] + offset).ravel()
                    add = [np.bincount(cells, np.repeat(a[own], n_features), size) for a in (g, h)] + [np.bincount(cells, minlength=size).astype(float)]
                    held[v, node] = held.get((v, node), 0) + np.stack(add)
        for (v, node), s in held.items():
            yield row(v, node, False, s.tobytes())

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        parts: dict[tuple[int, int], list[bytes]] = {}
        for b in batches:
            for v, node, of_rows, data in zip(*(c.to_pylist() for c in b.columns)):
                if of_rows:
                    parts.setdefault((v, node), []).append(data)
                else:
                    held[v, node] = held.get((v, node), 0) + np.frombuffer(data).reshape(3, n_features, BINS + 1)
        found = {k: {1: s} for k, v in held.items() if (s := best_split(*v, p))}
        for k, chunks in parts.items():
            cuts = [(c, len(c) // (16 + n_features)) for c in chunks]
            g, h = (np.concatenate([np.frombuffer(c, count=n, offset=8 * n * i) for c, n in cuts]) for i in (0, 1))
            found[k] = grow_whole(np.concatenate([np.frombuffer(c, np.uint8, offset=16 * n).reshape(n, n_features) for c, n in cuts]), g, h, p)
        for (v, node), got in found.items():
            flat = [x for at, s in got.items() for x in (at, s.gain, s.feature, s.bin, s.missing_left, *s.left, *s.right)]
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()), pa.array([node], pa.int32()), pa.array([list(map(float, flat))], pa.list_(pa.float64()))], names=["model", "node", "splits"])

    got = packed.mapInArrow(sums, schema).repartition("model", "node").mapInArrow(splits, "model int, node int, splits array<double>")
    out: list[dict[int, dict[int, Split]]] = [{} for _ in limits]
    for r in got.collect():
        each = [r["splits"][i : i + 11] for i in range(0, len(r["splits"]), 11)]
        out[r["model"]][r["node"]] = {int(s[0]): Split(s[1], int(s[2]), int(s[3]), bool(s[4]), (s[5], s[6], int(s[7])), (s[8], s[9], int(s[10]))) for s in each}
    return out


def _checked(rows: DataFrame, label: str, weight: str | None) -> DataFrame:
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    bad = w.isNull() | F.isnan(w) | (w < 0) | (w == float("inf"))
    return rows.withColumn("__y", F.col(label).cast("boolean").cast("double")).withColumn("__w", F.when(bad, F.raise_error(F.lit("weights must be finite and not negative"))).otherwise(w))


def fit_prefixes(rows: DataFrame, names: Sequence[str], label: str, order: str, limits: Sequence[int], weight: str | None = None, params: Params | None = None, edges: list[np.ndarray] | None = None) -> dict[int, Model]:
    """A model for each of ``limits``, trained on the rows whose ``order`` is less; a limit before which not both classes are met
    has none. ``rows`` has a boolean ``label``, the features ``names`` (null and NaN are missing) and maybe a weight.

    Bins are the same for all models (features only, no label); log loss; leaf-wise trees with the defaults of Params."""
    p, names = params or Params(), list(names)
    edges = edges if edges is not None else bin_edges(rows, names)
    known = _checked(rows, label, weight).filter(F.col("__y").isNotNull())
    per = known.groupBy(F.col(order).cast("long").alias("o")).agg(F.count("*").alias("n"), F.sum("__y").alias("good"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__y")).alias("wy")).collect()
    out: dict[int, Model] = {}
    for limit in sorted(set(limits)):
        n, good, w, wy = (sum(r[c] for r in per if r["o"] < limit) for c in ("n", "good", "w", "wy"))
        if 0 < good < n and 0 < wy < w:
            out[limit] = Model(names, edges, float(np.log(wy / (w - wy))), [], int(n), int(good))
    todo = sorted(out)
    for i in range(0, len(todo), TOGETHER):
        _grow(known, names, order, todo[i : i + TOGETHER], out, p)
    return out


def _grow(known: DataFrame, names: list[str], order: str, limits: list[int], models: dict[int, Model], p: Params) -> None:
    edges, n = models[limits[0]].edges, len(names)
    starts = [models[v].base for v in limits]
    packed_schema = "o long, y double, w double, bins binary, raw array<double>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r.tobytes() for r in binned(_matrix(b, 3, n), edges)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, pa.binary()), pa.array([starts] * b.num_rows, pa.list_(pa.float64()))], names=["o", "y", "w", "bins", "raw"])

    given = known.filter(F.col(order) < limits[-1]).select(F.col(order).cast("long").alias("o"), F.col("__y").alias("y"), F.col("__w").alias("w"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in names])
    packed = cut(given.mapInArrow(pack, packed_schema))
    recent: list[list[Tree]] = [[] for _ in limits]
    for k in range(p.trees):
        growing = [_Grower(p, models[v].n_train) for v in limits]
        while not all([g.done() for g in growing]):
            for g, found in zip(growing, _pass(packed, n, limits, recent, growing, p)):
                if g.asked:
                    g.told(found)
        for v, g in enumerate(growing):
            recent[v].append(g.tree)
            models[limits[v]].trees.append(g.tree)
        if (k + 1) % KEEP == 0 and k + 1 < p.trees:
            done = recent

            def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    bins = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, n)
                    raw = b.column(4).flatten().to_numpy().reshape(b.num_rows, -1) + np.stack([sum((t.values(bins) for t in own), np.zeros(b.num_rows)) for own in done], 1)  # noqa: B023
                    yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(list(raw), pa.list_(pa.float64()))], names=["o", "y", "w", "bins", "raw"])

            packed = cut(packed.mapInArrow(add, packed_schema))
            recent = [[] for _ in limits]


def fit(rows: DataFrame, names: Sequence[str], label: str, weight: str | None = None, params: Params | None = None, edges: list[np.ndarray] | None = None) -> Model:
    """One model of all labelled rows; ValueError without rows of both classes."""
    got = fit_prefixes(rows.withColumn("__o", F.lit(0)), names, label, "__o", [1], weight, params, edges)
    if not got:
        raise ValueError("good and bad rows are needed")
    return got[1]


def scored(rows: DataFrame, models: dict[int, Model] | Model, keep: Sequence[str], order: str | None = None) -> DataFrame:
    """``keep`` and score, P(good), of every row; with several models that of the row's ``order`` (rows without one are left out)."""
    by = {0: models} if isinstance(models, Model) else models
    if not by:
        return rows.select(*keep, F.lit(None).cast("double").alias("score")).filter("false")
    names = next(iter(by.values())).names
    n, first = len(names), len(keep) + 1
    place = F.col(order).cast("long") if order else F.lit(0).cast("long")
    given = rows.select(*keep, place.alias("__o"), *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"__{k}") for k, c in enumerate(names)]).filter(F.col("__o").isin(sorted(by)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            o, x = b.column(first - 1).to_numpy(), _matrix(b, first, n)
            f = np.zeros(len(o))
            for v in np.unique(o).tolist():
                own, m = np.flatnonzero(o == v), by[v]
                bins = binned(x[own], m.edges)
                f[own] = m.base + sum((t.values(bins) for t in m.trees), np.zeros(len(own)))
            yield pa.RecordBatch.from_arrays([*b.columns[: first - 1], pa.array(1 / (1 + np.exp(-f)))], names=[*keep, "score"])

    kinds = dict(rows.dtypes)
    return given.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "score double"]))
