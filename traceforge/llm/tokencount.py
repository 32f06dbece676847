"""Token counts by overlap resynchronisation.

Short texts are counted piece by piece. A long text, of more than a chunk, is encoded in overlapping chunks, each by the same
pieces or, where its cuts aren't safe for them, by the library with offsets; two neighbouring chunks are spliced at a boundary that both share and that is proven stable, and the overlap is widened
while there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import append_columns
from ._tokens import CachedEncoder, library_encoder


@dataclass
class Chunk:
    """Encoding of text[start:end]: ids (little-endian unsigned 32-bit), absolute offsets where splits begin, and the first token of each."""

    start: int
    end: int
    ids: bytes
    at: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.ids) // 4

    def behind(self, at: int, token: int) -> Chunk:
        """What begins with the split at offset ``at``, whose first token is ``token``."""
        k = np.searchsorted(self.at, at)
        return Chunk(at, self.end, self.ids[4 * token :], self.at[k:], self.first[k:] - token)


def encode_chunk(library, text: str, start: int, end: int, pieces: CachedEncoder | None = None) -> Chunk:
    """By ``pieces`` where given and safe for this stretch (the splits before spaces are told then), else by the library."""
    part = text[start:end]
    if pieces and pieces.plain(part):
        found = pieces.pieces(part)
        sizes = np.fromiter(map(len, part.split(" ")), np.int64, len(found))
        tokens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = start + np.cumsum(sizes + 1) - sizes - 2  # the space before each piece but the first
        at[0] = start
        return Chunk(start, end, b"".join(found), at, np.cumsum(tokens) - tokens)
    e = library.encode(part, add_special_tokens=False)
    starts: dict[int, int] = {}
    before = None
    # offsets of byte-level tokens inside one character repeat its span; words tell where the splits are
    for k, ((a, _), w) in enumerate(zip(e.offsets, e.word_ids)):
        w = w if w is not None else -1 - k
        if w != before:
            starts.setdefault(start + a, k)
        before = w
    return Chunk(start, end, np.array(e.ids, "<u4").tobytes(), np.fromiter(starts, np.int64, len(starts)), np.fromiter(starts.values(), np.int64, len(starts)))


def common_boundary(left: Chunk, right: Chunk, margin: int) -> tuple[int, int, int] | None:
    """Offset and token indices (in left, in right) of the first shared split start that is stable, or None.

    Splitting goes from left to right and looks no further back than a split's start, so from a start that both have, the
    right chunk's tokens are those of the whole text; the left chunk's tokens before it are, too, if it lies ``margin``
    characters before the left chunk's end (what follows the end can't reach further back than one look-ahead or one
    added token's string). Starts behind the right chunk's first split only: that one may be a part.
    """
    i = slice(np.searchsorted(left.at, right.start, "right"), np.searchsorted(left.at, left.end - margin, "right"))
    both = np.intersect1d(left.at[i], right.at[right.first > 0])
    if not len(both):
        return None
    at = int(both[0])
    return at, int(left.first[np.searchsorted(left.at, at)]), int(right.first[np.searchsorted(right.at, at)])


def count_by_chunks(library, text: str, chunk: int = 1 << 13, overlap: int = 1 << 8, margin: int = 64, collect: bool = False, pieces: CachedEncoder | None = None):
    """Tokens of ``text`` as the library gives them whole: a count, or with ``collect`` the ids.

    ``chunk`` and ``overlap`` are in characters; the overlap is doubled, up to the chunk before it, until a stable
    boundary is found; if there is none at all, the chunk grows to twice its size (a stretch without any boundary, one
    word for the tokenizer, has to be encoded as one). ``pieces``, an encoder with the library's ids, encodes chunks that
    haven't grown and that are plain for it; the others go to the library.
    """
    ids = bytearray()
    count = 0
    n = len(text)
    left = encode_chunk(library, text, 0, min(n, chunk), pieces)
    while left.end < n:
        wide = overlap
        while True:
            start = max(left.start, left.end - wide)
            if start == left.start:  # no boundary in the whole chunk: join it with as much again, so that the work stays linear
                left = encode_chunk(library, text, left.start, min(n, left.end + max(chunk, left.end - left.start)))
                break
            right = encode_chunk(library, text, start, min(n, left.end + chunk), pieces)
            found = common_boundary(left, right, margin)
            if found:
                at, i, j = found
                count += i
                if collect:
                    ids += left.ids[: 4 * i]
                # what is left begins at the boundary, so that the next splice can't reach before it
                left = right.behind(at, j)
                break
            wide *= 2
    return np.frombuffer(bytes(ids) + left.ids, "<u4").tolist() if collect else count + len(left)


def token_counts(docs: DataFrame, json_path: str, text_col: str = "text", limit: int = 1024, huge: int = 1 << 13, chunk: int = 1 << 13, overlap: int = 1 << 8, keep=None) -> DataFrame:
    """Append n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) for each text; no shuffle.

    Null counts as the empty text: 0 bytes, 0 tokens. Equal rows give equal results; columns of the added names are
    replaced. Texts of over ``huge`` characters go through overlapping chunks (see count_by_chunks), which bounds the
    memory of one encoding; the counts are those of the library either way.
    """

    def make():
        from tokenizers import Tokenizer

        enc = library_encoder(json_path)
        library = Tokenizer.from_file(json_path)

        def run(texts):
            texts = [t or "" for t in texts]
            small = enc.encode([t if len(t) <= huge else "" for t in texts])
            n = [len(b) // 4 if len(t) <= huge else count_by_chunks(library, t, chunk, overlap, pieces=enc) for t, b in zip(texts, small)]
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]}

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(docs, text_col, make, fields, keep)
