"""Fill-in-middle transformation by a constant-memory matcher of two passes.

The first pass over a text counts its units, the second advances a lazy match iterator to both cuts; no list of units is
ever made, so a text needs no more than itself and its output.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import append_columns, col

#: A unit, the marks of prefix, suffix and middle, and the chances in percent of being cut and of the form spm.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT, SPM = 50, 80


def draws(seed: int, key: str) -> list[int]:
    """Four whole numbers below 2**32 that depend on the seed and the row's key only."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def units(text: str, pattern: re.Pattern) -> int:
    """First pass."""
    n = 0
    for _ in pattern.finditer(text):
        n += 1
    return n


def ends(text: str, pattern: re.Pattern, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the ``first`` and the ``second`` units end, in code points (0 for no unit); first <= second."""
    found = pattern.finditer(text)
    last = None
    for last in islice(found, first):
        pass
    a = last.end() if last else 0
    for last in islice(found, second - first):
        pass
    return a, last.end() if last else 0


def cut(text: str, n: int, h: list[int], pattern: re.Pattern, share: int = CUT, spm: int = SPM) -> tuple[str, int | None, int | None]:
    """The form (plain, spm, psm) and the lengths of prefix and middle (None if plain)."""
    if not text or h[2] % 100 >= share or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = ends(text, pattern, a, b)
    return "spm" if h[3] % 100 < spm else "psm", i, j - i


def written(text: str, form: str, prefix: int | None, middle: int | None) -> str:
    if form == "plain":
        return text
    p, m, s = text[:prefix], text[prefix : prefix + middle], text[prefix + middle :]
    return f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}" if form == "spm" else f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"


def restored(output: Column, form: Column) -> Column:
    """The text before the transformation, from the output and its form alone.

    Marks don't occur in cut texts and can't arise where a part meets a mark, so each is found at its first place."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        a, b = F.locate(two, output), F.locate(MIDDLE, output)
        skip = len(one) + 1
        return F.substring(output, F.lit(skip), a - skip), F.substring(output, a + len(two), b - a - len(two)), F.substring(output, b + len(MIDDLE), F.length(output))

    s1, p1, m1 = parts(SUFFIX, PREFIX)
    p2, s2, m2 = parts(PREFIX, SUFFIX)
    return F.when(form == "spm", F.concat(p1, m1, s1)).when(form == "psm", F.concat(p2, m2, s2)).otherwise(output)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, cut_percent: int = CUT, spm_percent: int = SPM, keep=None) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars (code points; null if plain) and output (the transformed text).

    A row's draws come from ``seed`` and its id, so the result doesn't depend on how rows are dealt; equal ids are cut at places
    drawn from equal numbers. Null texts are empty, empty texts and those that hold a mark stay plain; null ids draw from an
    empty key. Columns named like the new ones are replaced, others are kept (``keep``: which). No shuffle; a text needs memory
    for itself and its output, whatever its number of units.
    """
    key = F.coalesce(col(id_col).cast("string"), F.lit(""))
    columns = list(keep) if keep is not None else docs.columns
    fields = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    taken = {c.lower() for c in columns}
    own = next(c for c in (f"__key{i}" for i in range(len(taken) + 1)) if c not in taken)
    # the key travels before the text: a number of characters, a colon, the key, the text
    paired = F.concat(F.length(key).cast("string"), F.lit(":"), key, F.coalesce(col(text_col), F.lit("")))

    def make():
        pattern = re.compile(UNIT)

        def run(rows: list[str]) -> dict[str, list]:
            out: dict[str, list] = {f.name: [] for f in fields}
            for row in rows:
                size, _, rest = row.partition(":")
                k, text = rest[: int(size)], rest[int(size) :]
                n = units(text, pattern)
                form, prefix, middle = cut(text, n, draws(seed, k), pattern, cut_percent, spm_percent)
                for name, value in zip(out, (n, form, prefix, middle, written(text, form, prefix, middle))):
                    out[name].append(value)
            return out

        return run

    return append_columns(docs.select(*[col(c) for c in columns], paired.alias(own)), own, make, fields, keep=columns)
