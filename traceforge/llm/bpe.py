"""Byte-level BPE by corpus-level merge replay.

The distinct words of a block of texts lie side by side in one array of symbols. An inverted index takes each mergeable
pair (by the rank of what it makes) to its positions; ranks are replayed in order over the whole block, and a merge
updates only the pairs with its two neighbours.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import append_columns
from ._tokens import _UNSAFE, SPLIT_PATTERN, read_ranks

_NONE = np.int64(1) << 40


class MergeReplay:
    """Encodes many words at once by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = np.int64(max(ranks.values()) + 1)
        pairs: dict[int, int] = {}
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a * int(self.width) + b] = r
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.made = np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of what each pair makes; _NONE where it can't be merged."""
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def one(self, word: bytes) -> list[int]:
        """The plain greedy loop for one word, for words in which a merge makes a lower rank than its own."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            r, k = min((self.ranks.get(parts[k] + parts[k + 1], int(_NONE)), k) for k in range(len(parts) - 1))
            if r == int(_NONE):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty) as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [np.uint32(r).tobytes() if (r := self.ranks.get(w)) is not None else None for w in words]
        todo = [k for k, x in enumerate(out) if x is None]
        if not todo:
            return out
        sizes = np.array([len(words[k]) for k in todo], np.int64)
        sym = self.bytes_id[np.frombuffer(b"".join(words[k] for k in todo), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(todo)), sizes)
        nxt = np.arange(1, n + 1)
        prv = np.arange(-1, n - 1)
        ends = np.cumsum(sizes) - 1
        nxt[ends] = -1
        prv[ends - sizes + 1] = -1
        pair = np.full(n, _NONE)
        inner = np.flatnonzero(nxt >= 0)
        pair[inner] = self.rank(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        odd: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}

        def post(at: np.ndarray, r: np.ndarray) -> None:
            """Add positions to the inverted index under their pair's rank."""
            ok = r < _NONE
            at, r = at[ok], r[ok]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, group in zip(r[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts)):
                if k in index:
                    index[k].append(group)
                else:
                    index[k] = [group]
                    heapq.heappush(heap, k)

        heap: list[int] = []
        post(inner, pair[inner])
        while heap:
            r = heapq.heappop(heap)
            groups = index.pop(r)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            at = at[alive[at] & (pair[at] == r)]
            if not len(at):
                continue
            right = nxt[at]
            if len(at) > 1 and len(shared := np.intersect1d(at, right, assume_unique=True)):
                chosen, used = [], set()
                for p in np.sort(at).tolist():  # equal neighbours: from the left, without overlap
                    if p not in used:
                        chosen.append(p)
                        used.add(int(nxt[p]))
                del shared
                at = np.array(chosen)
                right = nxt[at]
            after = nxt[right]
            sym[at] = r
            alive[right] = False
            nxt[at] = after
            has = after >= 0
            prv[after[has]] = at[has]
            new = np.full(len(at), _NONE)
            # neighbours may themselves have been merged in this step: all symbols are in place before ranks are taken
            new[has] = self.rank(sym[at[has]], sym[after[has]])
            pair[at] = new
            before = prv[at]
            lefts, at2 = before[before >= 0], at[before >= 0]
            back = self.rank(sym[lefts], sym[at2])
            pair[lefts] = back
            low = np.concatenate((at[new < r], lefts[back < r]))
            if len(low):
                odd.update(word[low].tolist())
            post(at, new)
            post(lefts, back)
        ids = sym[alive].astype("<u4").tobytes()
        stops = np.cumsum(np.bincount(word[alive], minlength=len(todo))) * 4
        begin = 0
        for k, stop in zip(todo, stops.tolist()):
            out[k] = ids[begin:stop]
            begin = stop
        for k in odd:
            out[todo[k]] = np.array(self.one(words[todo[k]]), "<u4").tobytes()
        return out


class ReplayEncoder:
    """Encodes blocks of texts: the distinct words that aren't known yet are replayed together.

    Cuts before spaces as CachedEncoder does; at most ``limit`` pieces between spaces stay known.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN, limit: int = 500_000):
        import regex

        self.replay, self.split, self.limit = MergeReplay(ranks), regex.compile(pattern).findall, limit
        self.token = {i: t for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.cuts = pattern == SPLIT_PATTERN

    def words(self, piece: str) -> list[str]:
        """The pattern's matches; a space and letters, perhaps with one mark behind, are known without it."""
        if self.cuts and piece[:1] == " ":
            if piece[1:].isalpha():
                return [piece]
            if piece[-1] in ",.;:!?" and piece[1:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self.split(piece)

    def pieces(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        ids: dict[str, bytes | None] = {w: self.known.get(w[1:]) if self.cuts and w[0] == " " else None for s in split for w in s}
        new = [w for w, x in ids.items() if x is None]
        ids.update(zip(new, self.replay.encode([w.encode() for w in new])))
        return [ids[s[0]] if len(s) == 1 else b"".join([ids[w] for w in s]) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        get, found, todo = self.known.get, [], {}
        for t in texts:
            if not self.cuts or _UNSAFE.search(t):
                got, holes, lack = [None], [0], [t]
            else:
                parts = t.split(" ")
                got = list(map(get, parts))
                got[0] = None  # no space before it
                holes = [k for k, g in enumerate(got) if g is None]
                lack = [" " + parts[k] if k else parts[0] for k in holes]
            todo.update(dict.fromkeys(lack))
            found.append((got, holes, lack))
        todo = dict(zip(todo, self.pieces(list(todo))))
        out = []
        for got, holes, lack in found:
            for k, p in zip(holes, lack):
                got[k] = todo[p]
            out.append(b"".join(got))
        if self.cuts and len(self.known) < self.limit:
            self.known.update((p[1:], x) for p, x in todo.items() if p[:1] == " " and " " not in p[1:] and len(p) < 64)
        return out

    def decode(self, ids: bytes) -> bytes:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_decode(docs: DataFrame, ranks_path: str, text_col: str = "text", pattern: str = SPLIT_PATTERN, with_ids: bool = True, keep=None) -> DataFrame:
    """Append ids (array of int, unless ``with_ids`` is false), n_tokens, ids_sha256 and decoded_sha256; no shuffle.

    Null is the empty text: no ids, and the hash of no bytes. Equal texts give equal ids; columns of the added names are
    replaced. A long word costs in proportion to its merges, so texts without any space are safe.
    """

    def make():
        enc = ReplayEncoder(read_ranks(ranks_path), pattern)

        def run(texts):
            ids = enc.encode([t or "" for t in texts])
            out = {"n_tokens": [len(b) // 4 for b in ids], "ids_sha256": [hashlib.sha256(b).hexdigest() for b in ids], "decoded_sha256": [hashlib.sha256(enc.decode(b)).hexdigest() for b in ids]}
            return out | ({"ids": [np.frombuffer(b, "<u4").astype(np.int32) for b in ids]} if with_ids else {})

        return run

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append_columns(docs, text_col, make, fields, keep, most=24 << 20)
