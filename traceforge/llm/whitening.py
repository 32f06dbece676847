"""Whitening of embeddings from a tiled covariance.

Vectors are quantised to integers and each distinct one is fitted once. Rows are cut into row-blocks and each row-block into
column blocks; the column blocks are shuffled by row-block, each pair of them is multiplied under the key of its tile of the
covariance, products are summed per tile, first within a task, and the assembled matrix is eigendecomposed on the driver.

What reaches the driver are the covariance and the sums: dimensions squared, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import col, saved, tune

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries beyond this are held there: all whole numbers up to it are exact doubles.
FAR = 1 << 52
#: Rows of a row-block and columns of a column block.
ROWS, WIDTH = 256, 32


@dataclass
class Whitening:
    """n distinct vectors with sums S; ``components`` has a unit eigenvector a row, ``values`` their eigenvalues, falling."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) squared of each row, exact; None where it has more than 38 digits."""
        d = centred(x, self.n, self.sums)
        if d.dtype != object and d.size and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
            d = d.astype(object)
        return [v if v < 10**38 else None for v in map(int, (d * d).sum(1))]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.n, self.sums) / self.n).astype(float) @ (self.components / np.sqrt(self.values)[:, None]).T


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S in whole numbers: 64-bit ones if they hold them, else Python's."""
    top = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    if n * top < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return n * x.astype(np.int64) - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def quantise(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * entries), -FAR, FAR).astype(np.int64) + SHIFT


def pack(x: np.ndarray) -> list[bytes]:
    """One text of bytes a vector: 32-bit entries if all fit, else 64-bit ones; equal vectors have equal bytes."""
    small = (np.abs(x) < 1 << 31).all(1)
    return [(row.astype("<i4") if s else row.astype("<i8")).tobytes() for row, s in zip(x, small)]


def unpack(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    for k, b in enumerate(rows):
        out[k] = np.frombuffer(b, "<i4" if len(b) == 4 * dims else "<i8")
    return out


def dimensions(vectors: DataFrame, vec_col: str = "embedding") -> int:
    """The commonest length of a vector, the smallest of several; 0 without vectors."""
    lengths = vectors.select(F.size(col(vec_col)).alias("d")).filter("d > 0").groupBy("d").agg(F.count("*").alias("n"))
    return lengths.agg(F.max(F.struct("n", -F.col("d"))).alias("b")).select((-F.col("b.col2")).alias("d")).first()["d"] or 0


def packed(vectors: DataFrame, dims: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, the packed whole numbers, of the rows whose vector has ``dims`` entries, all finite."""
    tune(vectors.sparkSession)
    usable = (F.size(col(vec_col)) == dims) & F.forall(col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(col(vec_col).isNotNull() & usable).select(col(id_col).alias("vec_id"), col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(quantise(x)), pa.binary())], names=["vec_id", "v"])

    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, v binary")


def sums_of(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            x = unpack(b.column(0).to_pylist(), dims)
            n += len(x)
            total = total + (x.sum(0).astype(object) if not x.size or int(np.abs(x).max()) < 1 << 40 else x.astype(object).sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(dims)], pa.int32()), pa.array([n, *map(int, total)], pa.decimal128(38, 0))], names=["dim", "s"])

    got = fit.select("v").mapInArrow(run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    by = {r["dim"]: int(r["s"]) for r in got}
    return by.get(-1, 0), [by.get(k, 0) for k in range(dims)]


def column_blocks(fit: DataFrame, dims: int, width: int, rows: int) -> DataFrame:
    """block (number of its first row), k (column block), cells: the whole numbers of one row-block and column block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_numpy()
            for i in range(0, len(names), rows):
                x = unpack(b.column(1).slice(i, rows).to_pylist(), dims)
                parts = [np.ascontiguousarray(x[:, c : c + width]).tobytes() for c in range(0, dims, width)]
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "k", "cells"])

    return fit.select("row", "v").mapInArrow(run, "block long, k int, cells binary")


def covariance(fit: DataFrame, n: int, sums: list[int], width: int = WIDTH, rows: int = ROWS) -> np.ndarray:
    """The covariance of ``fit`` (row, v), divisor n, of centred values, by tiles of ``width`` dimensions squared."""
    dims = len(sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        held: dict[int, np.ndarray] = {}
        now = None

        def multiply() -> None:
            for i, a in held.items():
                for j, b in held.items():
                    if i <= j:
                        tiles[i, j] = tiles.get((i, j), 0.0) + a.T @ b
            held.clear()

        for batch in batches:
            for block, k, cells in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    multiply()
                    now = block
                own = sums[k * width : (k + 1) * width]
                held[k] = (centred(np.frombuffer(cells, np.int64).reshape(-1, len(own)), n, own) / n).astype(float)
        multiply()
        for (i, j), t in tiles.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([t.ravel()], pa.list_(pa.float64()))], names=["i", "j", "cells"])

    blocks = column_blocks(fit, dims, width, rows).repartition("block").sortWithinPartitions("block", "k")
    cells = blocks.mapInArrow(products, "i int, j int, cells array<double>").select("i", "j", F.posexplode("cells").alias("pos", "c"))
    out = np.zeros((dims, dims))
    for r in cells.groupBy("i", "j", "pos").agg(F.sum("c").alias("c")).collect():
        across = min(width, dims - r["j"] * width)
        a, b = r["i"] * width + r["pos"] // across, r["j"] * width + r["pos"] % across
        out[a, b] = out[b, a] = r["c"] / n
    return out


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, from all its rows."""
    dims, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, p = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = model.whiten(unpack(b.column(0).to_pylist(), dims))
            s += y.sum(0)
            p += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k + k), pa.int32()), pa.array(np.concatenate([s, p.ravel()]))], names=["at", "x"])

    got = {r["at"]: r["x"] for r in fit.select("v").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()}
    if not got:
        return 0.0
    flat = np.array([got[i] for i in range(k * k + k)]) / model.n
    mean, second = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_whitening(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16, width: int = WIDTH, rows: int = ROWS) -> Whitening | None:
    """The whitening of all usable vectors, each distinct one once; None without any.

    Components whose eigenvalue is zero up to rounding can't be whitened and are left out, so fewer than ``most`` may come.
    """
    dims = dimensions(vectors, vec_col)
    if not dims:
        return None
    distinct = packed(vectors, dims, id_col, vec_col).select("v").distinct().select(F.monotonically_increasing_id().alias("row"), "v")
    fit = saved(distinct, "whitening-fit")
    n, sums = sums_of(fit, dims)
    if not n:
        return None
    v = covariance(fit, n, sums, width, rows)
    values, vectors_ = np.linalg.eigh(v)
    order = [i for i in np.argsort(-values, kind="stable")[:most] if values[i] > values[-1] * dims * np.finfo(float).eps]
    comps = np.ascontiguousarray(vectors_[:, order].T)
    model = Whitening(n, sums, values[order], comps, float(np.trace(v)))
    model.identity_error = identity_error(fit, model)
    return model


def whitened(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, values (array, a whitened value per component), deviation (decimal, sum of (n * x - S) squared) for each row whose
    vector has the model's length and only finite entries; no rows without a model. No shuffle."""
    kind = dict(vectors.dtypes).get(id_col, "long")
    schema = f"vec_id {kind}, values array<double>, deviation decimal(38,0)"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column(1).to_pylist(), dims)
            y = model.whiten(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(model.deviations(x), pa.decimal128(38, 0))], names=["vec_id", "values", "deviation"])

    return packed(vectors, dims, id_col, vec_col).mapInArrow(run, schema)


def components_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Rows whose vector is null, empty, of another length than the commonest, or has null or non-finite entries take no part. Entries
    are quantised by SCALE and SHIFT; scaled ones beyond 2**52 are held there. Repeated vectors are fitted once, each of their rows is
    returned. A single distinct vector has no variance, so no component and no row; an empty table gives no rows. ``deviation`` is
    null where it is beyond 64 bits (``whitened`` has it with up to 38 digits). Null ids stay null; other columns are not read.
    """
    model = fit_whitening(vectors, id_col, vec_col, most)
    shares = [] if model is None else (model.values / model.trace).tolist()
    got = whitened(vectors, model, id_col, vec_col).select("vec_id", "deviation", F.posexplode("values").alias("__at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>"), F.col("__at") + 1)
    return got.select(
        "vec_id", (F.col("__at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        explained.alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
