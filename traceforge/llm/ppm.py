"""Language-model scores by prediction by partial matching (PPM).

A trie of byte contexts up to order ORDER is counted over all training documents; a byte's probability falls back from the
longest context by escape estimation (method C), with the symbols of longer contexts excluded. Texts end with an end
symbol; contexts before the start are filled up. Beside it stands an add-one word model.

No table grows into one task: texts are dealt into blocks, a block asks for the grams and words it has, the counts are
summed and the probabilities computed once for each distinct gram, and each block gets back what it asked for. What a
block asks for travels in packed columns, one row for each of the buckets into which all grams are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import col, saved, slices, tune

#: Bytes that UTF-8 never has: the end symbol, and what stands before the start.
END, START = 0xFF, 0xFE
ORDER = 5
SYMBOLS = 256
#: Text bytes of a block (a longer single text is one block).
BLOCK_BYTES = 16 << 20
#: Grams that are sorted at once.
SLICE = 1 << 20
#: What log10 probabilities are rounded to.
UNIT = 2.0**-34
#: Tables of contexts of at most this order are broadcast: 256 ** 2 rows at most.
SMALL = 2
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_grams(text: str) -> np.ndarray:
    """For each byte of the text and the end symbol: the ORDER bytes before it and itself, as one number."""
    b = np.frombuffer(bytes([START] * ORDER) + text.encode() + bytes([END]), np.uint8).astype(np.int64)
    n = len(b) - ORDER
    out = b[:n].copy()
    for k in range(1, ORDER + 1):
        out <<= 8
        out |= b[k : k + n]
    return out


def word_hashes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words of the text with A-Z lower-cased; white space is \\x20 and \\x09-\\x0D."""
    words = text.encode().translate(_LOWER).split()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w) - (1 << 63)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


class Counts:
    """Distinct keys of one block with their training counts, in ascending order; merged slice by slice."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size = 0

    def add(self, keys: np.ndarray, train: bool) -> None:
        for i in range(0, len(keys), SLICE):
            part = keys[i : i + SLICE]
            self.held[train].append(part)
            self.size += len(part)
            if self.size >= SLICE:
                self.merge()

    def merge(self) -> None:
        for train, parts in self.held.items():
            if parts:
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                self.keys, self.counts = summed(np.concatenate((self.keys, k)), np.concatenate((self.counts, n if train else np.zeros(len(n), np.int64))))
                parts.clear()
        self.size = 0


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    return keys[first], np.add.reduceat(counts, first)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def shut(x: np.ndarray) -> bytes:
    """Whole numbers as bytes: small ones and ascending ones (give their differences) take little room."""
    return len(x).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def opened(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:4], "little")
    raw = pa.decompress(b[4:], 8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").ravel()


def opened_keys(b: bytes) -> np.ndarray:
    return np.cumsum(opened(b))


def gram_chances(grams: DataFrame) -> DataFrame:
    """gram, lp: log10 probability of a gram's last byte after those before it, for every row of ``grams`` (gram, c, perhaps
    others, which stay).

    c is the training count, 0 for grams that are only asked for. With n and d the total and the distinct symbols of a
    context, a symbol met there has c / (n + d) and the escape d / (n + d); after an escape the symbols of the longer
    context are taken out of both. A context never met passes on; the last resort is uniform over what is left of 256.
    """
    rest = [n for n in grams.columns if n not in ("gram", "c")]
    met = grams.filter("c > 0")
    # contexts as numbers: of order k the last k bytes before the symbol
    level = {ORDER: met.select(F.col("gram").alias("g"), "c")}
    for k in range(ORDER - 1, -1, -1):
        level[k] = level[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("g")).agg(F.sum("c").alias("c"))
        level[k] = saved(level[k], f"ppm-{k}")
    # what was met in training needs its longest context only, which has 256 grams at most
    around = W.partitionBy(F.shiftright("gram", 8))
    done = [met.select("gram", *rest, F.log10(F.col("c") / (F.sum("c").over(around) + F.count("*").over(around))).alias("lp"))]
    zero = F.lit(0).cast("long")
    left = saved(grams.filter("c = 0").select("gram", *rest, F.lit(0.0).alias("passed"), zero.alias("out"), zero.alias("mass")), "ppm-left")
    for k in range(ORDER, -1, -1):
        small = (lambda t: F.broadcast(t)) if k <= SMALL else (lambda t: t)
        x = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * k) - 1)) if k else zero
        need = left.select(x.alias("x")).distinct()
        own = level[k].withColumn("x", F.shiftright("g", 8)).join(small(need), "x", "left_semi")
        if k:  # how often the context's symbols were met in the shorter one
            low = level[k - 1].select(F.col("g").alias("s"), F.col("c").alias("m"))
            own = own.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(small(low), "s")
        else:
            own = own.withColumn("m", zero)
        totals = own.groupBy("x").agg(F.sum("c").alias("n"), F.count("*").alias("d"), F.sum("m").alias("m"))
        at = left.withColumn("x", x).join(small(totals), "x", "left").drop("x")
        if k < ORDER:
            here = level[k].select("g", F.col("c").alias("c"))
            at = at.withColumn("g", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))).join(F.broadcast(here) if k < SMALL else here, "g", "left").drop("g")
        else:
            at = at.withColumn("c", zero)
        at = at.fillna(0, ["n", "d", "m", "c"])
        # less what the longer context has taken out (nothing, if it was never met)
        n, d = F.col("n") - F.col("mass"), F.col("d") - F.col("out")
        lp = F.when(F.col("c") > 0, F.col("passed") + F.log10(F.col("c") / (n + d)))
        passed = F.col("passed") + F.when(d > 0, F.log10(d / (n + d))).otherwise(0.0)
        at = saved(at.select("gram", *rest, lp.alias("lp"), passed.alias("passed"), F.col("d").alias("out"), F.col("m").alias("mass")), "ppm-left")
        done.append(at.filter("lp IS NOT NULL").select("gram", *rest, "lp"))
        left = at.filter("lp IS NULL").drop("lp")
    done.append(left.select("gram", *rest, (F.col("passed") - F.log10((F.lit(SYMBOLS) - F.col("out")).cast("double"))).alias("lp")))
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out


def packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return sink.getvalue().to_pybytes()


def blocks_of(base: DataFrame, block_bytes: int, buckets: int) -> DataFrame:
    """Blocks of the rows of ``base`` (doc_id, train, text), dealt within a task: their texts in packed slices (kind 2, in
    ``keys``), and what the block asks for, one row per kind and bucket: kind (0 gram, 1 word), keys (ascending, as
    differences) and training counts."""
    schema = "block long, kind int, bucket int, keys binary, counts binary"
    names = ["block", "kind", "bucket", "keys", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]

    def batch(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    def asked(block: int, found: list[Counts]) -> Iterator[pa.RecordBatch]:
        for kind, own in enumerate(found):
            own.merge()
            at = bucket_of(own.keys, buckets)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(buckets + 1))
            met = [(q, order[i:j]) for q, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if j > i]
            for i in range(0, len(met), 64):
                part = met[i : i + 64]
                yield batch([block] * len(part), [kind] * len(part), [q for q, _ in part], [shut(np.diff(own.keys[k], prepend=np.int64(0))) for _, k in part], [shut(own.counts[k]) for _, k in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, size = TaskContext.get().partitionId() << 32, 0, 0
        found, known = [Counts(), Counts()], {}
        for b in batches:
            texts, train = b.column(2).to_pylist(), b.column(1).to_pylist()
            for i, j in slices([len(t) for t in texts], SLICE):
                yield batch([first | n], [2], [None], [packed(b.slice(i, j - i))], [None])
                for t, own in zip(texts[i:j], train[i:j]):
                    found[0].add(text_grams(t), own)
                    found[1].add(word_hashes(t, known), own)
                    size += len(t) + 1
                if len(known) > 400_000:
                    known.clear()
                if size >= block_bytes:
                    yield from asked(first | n, found)
                    found, n, size = [Counts(), Counts()], n + 1, 0
        if size:
            yield from asked(first | n, found)

    return base.select("doc_id", "train", "text").mapInArrow(run, schema)


def score(docs: DataFrame, train_flag, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, trained, n_tokens, n_known, train_tokens, base_score, score for every document.

    ``train_flag``: a boolean Column; rows where it is true are learned from (null counts as false). ``score`` is the
    log10 probability of the whole text and its end by the PPM model; ``base_score`` that of its words and one end token
    under add-one counts. Null text is empty: it has the end only. Repeated rows count each time; without any training
    row the words' probability is 1 / (0 + 1 * (0 + 1)) and the bytes' 1 / 256. Other columns are not read; an empty table
    gives an empty result.
    """
    tune(docs.sparkSession)
    base = docs.select(col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"), F.coalesce(train_flag, F.lit(False)).alias("train"))
    size = base.agg(F.sum(F.octet_length("text")).alias("b"), F.sum(F.col("train").cast("long")).alias("t")).first()
    train_docs = size["t"] or 0
    # a bucket's keys of all blocks meet in one task: some 64 MB of text to a bucket
    buckets = max(16, -(-(size["b"] or 0) // (64 << 20)))
    both = saved(blocks_of(base, block_bytes, buckets), "ppm-blocks")
    texts, asked = both.filter("kind = 2").select("block", F.col("keys").alias("rows")), both.filter("kind < 2")

    def merge(t: pa.Table) -> pa.Table:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, size = [], 0

        def put() -> None:
            nonlocal keys, counts, size
            if held:
                keys, counts = summed(np.concatenate([keys, *[k for k, _ in held]]), np.concatenate([counts, *[c for _, c in held]]))
                held.clear()
            size = 0

        for k, c in zip(t.column("keys"), t.column("counts")):
            held.append((opened_keys(k.as_py()), opened(c.as_py())))
            size += len(held[-1][0])
            if size >= SLICE:
                put()
        put()
        n = len(keys)
        return pa.table({"kind": np.full(n, t.column("kind")[0].as_py(), np.int32), "bucket": np.full(n, t.column("bucket")[0].as_py(), np.int32), "key": keys, "c": counts})

    counted = asked.select("kind", "bucket", "keys", "counts").groupBy("kind", "bucket").applyInArrow(merge, "kind int, bucket int, key long, c long")
    counted = saved(counted, "ppm-asked")
    words = counted.filter("kind = 1 AND c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, distinct = (words["n"] or 0) + train_docs, words["v"] + (train_docs > 0)
    grams = counted.filter("kind = 0").select(F.col("key").alias("gram"), "c", "bucket")
    # log10 probabilities in units of UNIT, counts of words
    chances = gram_chances(grams).select(F.lit(0).alias("kind"), "bucket", F.col("gram").alias("key"), F.round(F.col("lp") / UNIT).cast("long").alias("value"))
    values = chances.unionByName(counted.filter("kind = 1").select("kind", "bucket", "key", F.col("c").alias("value")))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """What each block has asked for in this bucket, in the order of its keys."""
        key, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        found = [shut(value[np.searchsorted(key, opened_keys(k.as_py()))]) for k in left.column("keys")]
        return pa.table({"block": left.column("block"), "kind": left.column("kind"), "keys": left.column("keys"), "found": pa.array(found, pa.binary())})

    answers = asked.select("block", "kind", "bucket", "keys").groupBy("kind", "bucket").cogroup(values.groupBy("kind", "bucket")).applyInArrow(answer, "block long, kind int, keys binary, found binary")
    unit = math.log10(total + 1 * (distinct + 1))
    end = math.log10(train_docs + 1)

    def give(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for kind in (0, 1):
            own = right.filter(pc.equal(right.column("kind"), kind))
            key = np.concatenate([np.zeros(0, np.int64), *[opened_keys(k.as_py()) for k in own.column("keys")]])
            value = np.concatenate([np.zeros(0, np.int64), *[opened(v.as_py()) for v in own.column("found")]])
            order = np.argsort(key)
            tables.append((key[order], value[order]))
        (gk, gv), (wk, wc) = tables
        wv, wc = np.log10(wc + 1), wc > 0
        seen: dict[bytes, int] = {}
        out: dict[str, list] = {n: [] for n in ("n_tokens", "n_known", "base_score", "score")}
        docs = pa.concat_tables([pa.ipc.open_stream(r.as_py()).read_all() for r in left.column("rows")])
        for text in docs.column("text"):
            text = text.as_py()
            grams, total_lp = text_grams(text), 0
            for i in range(0, len(grams), SLICE):
                u, n = np.unique(grams[i : i + SLICE], return_counts=True)
                total_lp += int(n @ gv[np.searchsorted(gk, u)])
            out["score"].append(total_lp * UNIT)
            u, n = np.unique(word_hashes(text, seen), return_counts=True)
            at = np.searchsorted(wk, u)
            words = int(n.sum()) + 1
            out["n_tokens"].append(words)
            out["n_known"].append(int(n @ wc[at]) + (train_docs > 0))
            out["base_score"].append(float(n @ wv[at]) + end - words * unit)
        rows = docs.num_rows
        return pa.table({
            "doc_id": docs.column("doc_id"), "trained": docs.column("train"), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
            "train_tokens": pa.array([total] * rows, pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64()),
        })

    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(give, "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
