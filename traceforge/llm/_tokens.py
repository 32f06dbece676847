"""Byte-level BPE vocabularies and the cached encoder that the token operators share."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Callable

#: Fixed value: the split pattern of the byte-level vocabularies (as public_tokenizers.PATTERN states it).
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space with white space before and white space or the end behind: there a cut before the space is not a cut of SPLIT_PATTERN.
_UNSAFE = re.compile(r"\s (?=\s|\Z)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level JSON vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


def ranks_of_json(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ranks and added tokens of a byte-level BPE JSON file, or None where its ids aren't merge ranks."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    model, pre = j["model"], j.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or j.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("ignore_merges"):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    added = {a["content"]: a["id"] for a in j.get("added_tokens", [])}
    for k, m in enumerate(model["merges"]):
        if vocab.get("".join(m if isinstance(m, list) else m.split(" "))) != 256 + k:
            return None
    return {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in added}, added


class _Known(dict):
    """Ids of pieces that follow a space; a piece met for the first time is encoded, and kept while there is room."""

    def __init__(self, encode: Callable[[str], bytes], limit: int):
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(self) < self.limit:
            self[piece] = ids
        return ids


class CachedEncoder:
    """Encodes texts by the pieces between spaces, remembering distinct pieces.

    A cut before a space is a cut of SPLIT_PATTERN unless the space stands between white space (or before the end),
    so a text is the sum of its pieces; other texts, and those that hold a ``special`` string, go to ``whole``.
    Ids are little-endian unsigned 32-bit bytes. At most ``limit`` pieces stay known.
    """

    def __init__(self, piece: Callable[[str], bytes], whole: Callable[[str], bytes], special: tuple[str, ...] = (), limit: int = 150_000):
        self.piece, self.whole, self.special = piece, whole, special
        self.known = _Known(piece, limit)

    def plain(self, text: str) -> bool:
        return not _UNSAFE.search(text) and not any(s in text for s in self.special)

    def pieces(self, text: str) -> list[bytes]:
        """Ids of the pieces of a plain text."""
        head, *rest = text.split(" ")
        return [self.piece(head), *map(self.known.__getitem__, rest)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self.pieces(t)) if self.plain(t) else self.whole(t) for t in texts]


def library_encoder(json_path: str, limit: int = 150_000) -> CachedEncoder:
    """A CachedEncoder with the ids that the tokenizers library gives for ``json_path`` (no special tokens added).

    Where the file is a plain byte-level BPE, unknown pieces are encoded by tiktoken with the file's own ranks; texts
    that hold an added token's string, and every text of other kinds of file, go to the library itself.
    """
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(json_path)

    def whole(text: str) -> bytes:
        return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()

    found = ranks_of_json(json_path)
    if found is None:
        enc = CachedEncoder(whole, whole, limit=limit)
        enc.plain = lambda text: False
        return enc
    import tiktoken

    ranks, added = found
    ordinary = tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return CachedEncoder(lambda p: array("I", ordinary(p)).tobytes(), lambda t: whole(t) if any(s in t for s in added) else array("I", ordinary(t)).tobytes(), tuple(added), limit)
