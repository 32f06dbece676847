"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional code word from each of several codebooks, chosen by beam search on the
residual. A query is scored against codes by looking up its products with all code words, divided by the stored norm of
the decoded vector; the best are ranked again by exact cosine on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, saved, tune

CODE_BLOCK, QUERY_BLOCK = 16_384, 512
#: Query blocks that are broadcast together: 4 MB of queries with 64 dimensions.
GROUP = 16
#: Vectors up to which the rerank depth is as given.
RERANK_ROWS = 50_000


@dataclass
class AdditiveQuantiser:
    books: np.ndarray  # (codebooks, words, dimensions)

    def encode(self, x: np.ndarray, beam: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, codebooks) by beam search, and the norms of the decoded vectors."""
        rows, (m, k, _) = len(x), self.books.shape
        res = x[:, None, :]  # residuals of the hypotheses
        codes = np.zeros((rows, 1, 0), np.uint8 if k <= 256 else np.uint16)
        for j in range(m):
            book = self.books[j]
            # squared distance of each hypothesis' residual to each code word
            cost = (res * res).sum(2)[:, :, None] - 2 * res @ book.T + (book * book).sum(1)
            flat = cost.reshape(rows, -1)
            width = min(beam if j + 1 < m else 1, flat.shape[1])
            top = np.argpartition(flat, width - 1, 1)[:, :width]
            parent, word = top // k, top % k
            res = np.take_along_axis(res, parent[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(codes.dtype)], 2)
        return codes[:, 0], np.linalg.norm(x - res[:, 0], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query with every code word: (queries, codebooks, words)."""
        return np.einsum("qd,mkd->qmk", q, self.books)


def fit(x: np.ndarray, books: int = 16, words: int = 256, rounds: int = 8, seed: int = 0) -> AdditiveQuantiser:
    """Residual k-means, then least squares of all code words together for the codes that the beam search finds."""
    rng = np.random.default_rng(seed)
    words = max(1, min(words, len(x)))
    out, res = [], x.copy()
    for _ in range(books):
        c = res[rng.choice(len(res), words, replace=False)].copy()
        for _ in range(rounds):
            a = np.argmin((c * c).sum(1) - 2 * res @ c.T, 1)
            n = np.bincount(a, minlength=words)
            s = np.zeros_like(c)
            np.add.at(s, a, res)
            c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
        out.append(c)
        res = res - c[np.argmin((c * c).sum(1) - 2 * res @ c.T, 1)]
    q = AdditiveQuantiser(np.array(out))
    codes = np.concatenate([q.encode(x[i : i + 1024])[0] for i in range(0, len(x), 1024)])
    at = codes.astype(int) + np.arange(books) * words
    g = np.zeros((books * words, books * words), np.float32)
    b = np.zeros((books * words, x.shape[1]), np.float32)
    for j in range(books):
        np.add.at(b, at[:, j], x)
        for i in range(books):
            np.add.at(g, (at[:, i], at[:, j]), 1.0)
    ridge = np.float32(0.1)
    b += ridge * np.concatenate(out)
    g[np.diag_indices(len(g))] += ridge
    q.books = np.linalg.solve(g, b).astype(float).reshape(books, words, -1)
    return q


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of double) and the vector's key of rows that take part: neither null nor empty, all components
    finite numbers, not all zero, and of the commonest length (the smaller one if two are as common)."""
    v = vectors.select(col(id_col).cast("long").alias("id"), col(vec_col).cast("array<double>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return v.filter(F.size("v") == (sizes[0]["d"] if sizes else -1))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = 8192, books: int = 16, words: int = 256, beam: int = 8, rerank: int = 300) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found to each row of ``queries`` among ``vectors``.

    Nearness is cosine, exact in the result; ties go to the smaller id; a row with the query's own id is no candidate.
    Codebooks are fitted on at most about ``sample`` distinct vectors (those with the smallest hashes); every distinct
    vector is encoded and scored against every query, in blocks of queries that are broadcast while the codes stay where
    they are; the ``rerank`` best by table (up to 50,000 vectors; with the root of the number beyond) are ranked exactly.
    Equal vectors are one class, of which the k + 1 smallest ids can be results, so copies don't crowd others out. Repeated
    ids count once. Null, zero, non-finite and odd-sized vectors take no part; an empty side gives an empty result.
    """
    spark = vectors.sparkSession
    tune(spark)
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = usable(vectors, id_col, vec_col).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2"))
    order = W.partitionBy("h1", "h2").orderBy("id")
    members = saved(rows.select("h1", "h2", "id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1), "ann-members")
    reps = members.filter("n = 1").select("id", "h1", "h2")
    classes = saved(rows.select("id", "v").join(reps, "id").dropDuplicates(["h1", "h2"]), "ann-classes")
    n = classes.count()
    if not n:
        return spark.createDataFrame([], schema)
    drawn = F.pmod(F.xxhash64("h1", F.lit(5)), F.lit(1 << 31)) / float(1 << 31)
    got = classes.filter(drawn < min(1.0, sample / n)).select("h1", "v").toPandas().sort_values("h1")
    if not len(got):
        got = classes.limit(sample).select("h1", "v").toPandas()
    x = np.array(got["v"].tolist())
    model = fit(x / np.linalg.norm(x, axis=1, keepdims=True), books, words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of codes: one row holds the ids, codes and norms of up to CODE_BLOCK vectors."""
        ids, codes, norms = [], [], []

        def block():
            i, c, s = np.concatenate(ids), np.concatenate(codes), np.concatenate(norms)
            ids.clear(), codes.clear(), norms.clear()
            return pa.RecordBatch.from_pydict({"ids": [i.astype("<i8").tobytes()], "codes": [c.astype("<u2").tobytes()], "norms": [s.astype("<f8").tobytes()]})

        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            for i in range(0, len(v), 256):
                c, s = model.encode(v[i : i + 256], beam)
                codes.append(c), norms.append(s)
            ids.append(b.column(0).to_numpy())
            if sum(map(len, ids)) >= CODE_BLOCK:
                yield block()
        if ids:
            yield block()

    asked = usable(queries, id_col, vec_col).dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    asked = saved(asked, "ann-queries")
    nq = asked.count()
    if not nq:
        return spark.createDataFrame([], schema)
    blocks = -(-nq // QUERY_BLOCK)
    packed = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).groupBy("qb").agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
    coded = saved(classes.select("id", "v").mapInArrow(encode, "ids binary, codes binary, norms binary"), "ann-codes")
    packed = saved(packed, "ann-query-blocks")
    m = model.books.shape[0]
    depth = rerank * max(1, math.ceil((n / RERANK_ROWS) ** 0.5))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``depth`` best of the task for each query, in one row."""
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r in b.to_pylist():
                ids, codes, norms = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["codes"], "<u2").reshape(-1, m).astype(np.int64), np.frombuffer(r["norms"], "<f8")
                q = np.array([a["q"] for a in r["asked"]])
                lut = model.tables(q / np.linalg.norm(q, axis=1, keepdims=True))
                for a, t in zip(r["asked"], lut):
                    s = t[0][codes[:, 0]]
                    for j in range(1, m):
                        s = s + t[j][codes[:, j]]
                    s = s / np.maximum(norms, 1e-12)
                    vs, had = ids, best.get(a["query_id"])
                    if had:
                        vs, s = np.concatenate((had[0], vs)), np.concatenate((had[1], s))
                    top = np.argpartition(-s, depth - 1)[:depth] if len(s) > depth else slice(None)
                    best[a["query_id"]] = vs[top], s[top]
        for k, (vs, s) in best.items():
            yield pa.RecordBatch.from_pydict({"query_id": [k], "ids": [vs.astype("<i8").tobytes()], "scores": [s.astype("<f8").tobytes()]})

    def merge(t: pa.Table) -> pa.Table:
        """The ``depth`` best of a query over all tasks; ties go to the smaller id."""
        ids, s = (np.concatenate([np.frombuffer(x.as_py(), kind) for x in t.column(n)]) for n, kind in (("ids", "<i8"), ("scores", "<f8")))
        top = np.lexsort((ids, -s))[:depth]
        return pa.table({"query_id": np.full(len(top), t.column("query_id")[0].as_py()), "id": ids[top]})

    found = None
    for lo in range(0, blocks, GROUP):
        own = packed.filter((F.col("qb") >= lo) & (F.col("qb") < lo + GROUP)).select("asked")
        part = coded.crossJoin(F.broadcast(own)).mapInArrow(scan, "query_id long, ids binary, scores binary")
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("query_id").applyInArrow(merge, "query_id long, id long")
    # the query's own class is always among the candidates; exact scores on the original vectors
    own = asked.select("query_id", F.xxhash64("q").alias("h1"), F.xxhash64("q", F.lit(1)).alias("h2")).join(members.filter("n = 1").select("h1", "h2", "id"), ["h1", "h2"]).select("query_id", "id")
    best = best.unionByName(own).distinct().join(asked, "query_id").join(classes.select("id", "v", "h1", "h2"), "id")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q, v = _matrix(b.column(3)), _matrix(b.column(4))
            s = (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s)], names=["query_id", "h1", "h2", "score"])

    scored = best.select("query_id", "h1", "h2", "q", "v").mapInArrow(exact, "query_id long, h1 long, h2 long, score double")
    each = scored.join(members.select("h1", "h2", F.col("id").alias("vec_id")), ["h1", "h2"]).filter("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
