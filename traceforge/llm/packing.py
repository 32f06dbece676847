"""Hierarchical residual packing of token pieces into sequences.

Each partition packs its pieces by best fit, largest first, and emits the sequences that are nearly full. The underfull
ones become items of fewer, larger groups and are packed again, level by level, until one group is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import col, saved, slices, tune
from ._tokens import library_encoder

PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])
_BIN = T.StructType([
    T.StructField("sequence_id", T.LongType()),
    T.StructField("fill", T.IntegerType()),
    T.StructField("closed", T.BooleanType()),
    T.StructField("members", T.ArrayType(T.StructType([*PIECE.fields, T.StructField("offset", T.LongType())]))),
])
_MEMBERS = pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]))


def cut(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole if they fit, else full pieces, the first one shorter."""
    if n <= cap:
        return [(0, n)]
    first = n % cap
    return [(0, first)] * (first > 0) + [(s, cap) for s in range(first, n, cap)]


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Best fit in the given order (largest first packs best): indices by bin. No two bins fit together afterwards
    if the sizes came in descending order and one of the bins is at most half full."""
    bins: list[list[int]] = []
    left: list[list[int]] = [[] for _ in range(cap + 1)]  # bins by free room
    room = 0  # bit r: some bin has r free
    for k, n in enumerate(sizes):
        m = room >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            b = left[r].pop()
            if not left[r]:
                room &= ~(1 << r)
        else:
            r, b = cap, len(bins)
            bins.append([])
        bins[b].append(k)
        left[r - n].append(b)
        if r > n:
            room |= 1 << (r - n)
    return bins


def token_pieces(docs: DataFrame, json_path: str, cap: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, with ``with_ids``, the ids themselves.

    A document's ids are those of the tokenizer without special tokens, then ``end_id``; null text is empty, so every row
    gives at least one piece of at least one token. Repeated rows give repeated pieces; other columns are not read.
    """
    tune(docs.sparkSession)
    schema = T.StructType(PIECE.fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(json_path)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for i, j in slices([len(t) for t in texts]):
                rows: list[list] = [[] for _ in schema.fields]
                for key, ids in zip(keys[i:j], enc.encode(texts[i:j])):
                    ids += end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, cap)):
                        own = ids[4 * s : 4 * (s + n)]
                        for to, x in zip(rows, (key, k, s, n, zlib.crc32(own), memoryview(own).cast("i").tolist() if with_ids else None)):
                            to.append(x)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(rows, kinds)], names=schema.names)

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)


def _level(level: int, cap: int, slack: int, last: bool):
    """A mapInArrow function that packs all bins of its partition; those with less than ``slack`` free are closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [m for b in batches for m in b.column(0).to_pylist()]
        fills = [sum(p["length"] for p in m) for m in rows]
        # a total order, so that a task that runs again gives the same sequences whatever order its rows come in
        key = lambda k: (-fills[k], rows[k][0]["doc_id"] is None, rows[k][0]["doc_id"] or 0, rows[k][0]["piece"], rows[k][0]["ids_crc32"])
        order = sorted(range(len(rows)), key=key)
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        out: list[list] = [[], [], [], []]
        for n, b in enumerate(best_fit([fills[k] for k in order], cap)):
            at, members = 0, []
            for k in b:
                for p in rows[order[k]]:
                    members.append(p | {"offset": at})
                    at += p["length"]
            for to, x in zip(out, (base | n, at, last or cap - at < slack, members)):
                to.append(x)
            if len(out[0]) >= 4096:
                yield _bins(out)
                out = [[], [], [], []]
        if out[0]:
            yield _bins(out)

    return run


def _bins(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.bool_(), _MEMBERS]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, kinds)], names=_BIN.names)


def pack(pieces: DataFrame, cap: int = 2048, rows_per_task: int = 50_000, fan_in: int = 8, slack: float = 1 / 32) -> DataFrame:
    """Add sequence_id and offset (gapless from 0 in each sequence) to pieces of at most ``cap`` tokens.

    Level 1 packs partitions of about ``rows_per_task`` pieces; a sequence with less than ``slack`` of its room free is
    emitted. Each next level has ``fan_in`` times fewer groups, but no group of more than about ``rows_per_task`` sequences,
    and four times the slack, up to one half: as best fit leaves at most one bin per group that is at most half full, what
    goes further up is bounded by the number of groups then. The last level, one group, emits everything. Pieces of length 0
    or over ``cap`` are not allowed.
    """
    if rows_per_task < 2 or fan_in < 2:
        raise ValueError("rows_per_task and fan_in must be at least 2")
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    flat = pieces.select(*names)
    groups = max(1, -(-flat.count() // rows_per_task))
    item = F.array(F.struct(*names, F.lit(0).cast("long").alias("offset"))).alias("members")
    open_ = flat.select(item, F.xxhash64(*names).alias("__at"))  # all of a row: ids may be null or repeat
    done: list[DataFrame] = []
    level, free = 1, max(1, int(cap * slack))
    while True:
        last = groups == 1
        dealt = open_.repartition(1) if last else open_.repartition(groups, "__at")
        packed = dealt.select("members").mapInArrow(_level(level, cap, free, last), _BIN)
        if last:
            done.append(packed)
            break
        packed, before = saved(packed, f"packing-{level}"), groups
        done.append(packed.filter("closed"))
        left = packed.filter("NOT closed")
        groups = max(-(-groups // fan_in), -(-left.count() // rows_per_task))
        # a group's open sequences stay together while there are fewer groups than before; where many are left they spread
        open_ = left.select("members", (F.expr("sequence_id >> 32") if groups < before else F.col("sequence_id")).alias("__at"))
        level, free = level + 1, min((cap + 1) // 2, free * 4)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, json_path: str, cap: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document into pieces of at most ``cap`` tokens and pack them all: see token_pieces and pack.

    An empty table gives an empty table; null ids are packed like others; repeated rows take their place each.
    """
    return pack(saved(token_pieces(docs, json_path, cap, 0, id_col, text_col), "pieces"), cap)
