"""Doubles as exact text and bytes, inside the JVM: shortest decimals that read back as the same double, hexadecimal
floats, little-endian bytes. Identifiers and digests are made of them, so they must not depend on an engine's own notation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: No double needs more significant digits than this.
MOST_DIGITS = 17
#: All decimals of so many digits are different doubles, and so read back, down to the least normal double.
SURE_DIGITS = 15
LEAST_NORMAL = 2.2250738585072014e-308


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), 0)


def double_bits(x: Column) -> Column:
    """The 64 bits of a double as a long; all NaNs are one."""
    held = F.coalesce(x.cast("double"), F.lit(0.0))  # the method takes no null
    return F.when(x.isNotNull(), F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), held).cast("long"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once."""
    return F.call_function("java_method", F.lit("java.lang.Math"), F.lit("fma"), a, b, c).cast("double")


def little_endian_hex(x: Column) -> Column:
    """The eight bytes of a double, lowest first, as hexadecimal text."""
    return let(F.lpad(F.hex(double_bits(x)), 16, "0"), lambda h: F.concat(*[F.substring(h, i, 2) for i in range(15, 0, -2)]))


def shortest(x: Column) -> Column:
    """A finite double with the fewest digits that read back as ``x``, zeros at the end apart, as text with or without an exponent.

    The cast's text reads back, but may be longer than need be. Up to SURE_DIGITS no two decimals are one double, so then it isn't;
    only below the normal doubles, where fewer digits differ, all lengths are tried."""
    written = lambda p: F.call_function("format_string", F.concat(F.lit("%."), p.cast("string"), F.lit("E")), x)
    reads_back = lambda t: t.try_cast("double") == x
    digits = lambda t: F.length(F.regexp_replace(F.substring_index(t, "E", 1), "^-?[0.]*|[.]", ""))

    def of(plain: Column) -> Column:
        tries = [let(written(F.lit(n - 1)), lambda t: F.when(reads_back(t), t)) for n in range(SURE_DIGITS, MOST_DIGITS + 1)]
        small = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(MOST_DIGITS)), written), reads_back), 0)
        return F.when((x != 0) & (F.abs(x) < LEAST_NORMAL), small).when(digits(plain) <= SURE_DIGITS, plain).otherwise(F.coalesce(*tries, plain))

    return let(x.cast("string"), of)


def _parts(text: Column) -> Column:
    """sign, digits (without zeros at either end, but for 0 itself) and exponent of the first one."""
    held = lambda t: F.struct(
        F.when(t.startswith("-"), "-").otherwise("").alias("sign"), F.regexp_replace(F.regexp_replace(F.substring_index(t, "E", 1), "^-", ""), "[.]", "").alias("all"),
        F.length(F.regexp_extract(t, "^-?([0-9]+)", 1)).alias("point"), F.when(t.contains("E"), F.substring_index(t, "E", -1)).otherwise("0").cast("int").alias("power"),
    )
    own = lambda h: F.struct(h["sign"].alias("sign"), F.regexp_replace(h["all"], "^0+|0+$", "").alias("digits"), (h["power"] + h["point"] - 1 - F.length(F.regexp_extract(h["all"], "^(0*)", 1))).alias("exponent"))
    fine = lambda p: F.struct(p["sign"].alias("sign"), F.when(p["digits"] == "", "0").otherwise(p["digits"]).alias("digits"), F.when(p["digits"] == "", 0).otherwise(p["exponent"]).alias("exponent"))
    return let(let(let(text, held), own), fine)


def _decimal(sign: Column, digits: Column, exponent: Column) -> Column:
    whole, rest = F.substring(F.rpad(digits, exponent + 1, "0"), F.lit(1), exponent + 1), F.substring(digits, exponent + 2, F.lit(MOST_DIGITS + 1))
    large = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    tail = F.substring(digits, 2, MOST_DIGITS + 1)
    far = F.concat(F.substring(digits, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    return F.concat(sign, F.when((exponent >= 0) & (exponent < 16), large).when((exponent >= -4) & (exponent < 0), small).otherwise(far))


def decimal_text(x: Column, nan: str = "nan", infinity: str = "inf") -> Column:
    """The shortest decimal that reads back as the same double: positional from 0.0001 up to below 1e16 and always with a
    point, else d.ddde+XX with two digits of exponent at least; -0.0 keeps its sign. Null stays null."""

    def of(x: Column) -> Column:
        text = let(_parts(shortest(x)), lambda p: _decimal(p["sign"], p["digits"], p["exponent"]))
        return F.when(F.isnan(x), nan).when(x == float("inf"), infinity).when(x == float("-inf"), f"-{infinity}").when(x.isNotNull(), text)

    return let(x.cast("double"), of)


def hexadecimal_text(x: Column) -> Column:
    """A double as [-]0x1.hhhhhhhhhhhhhp+E (0x0.0p+0 for zero, 0x0.hhhhhhhhhhhhhp-1022 below the normal ones); nan, inf, -inf."""
    x = x.cast("double")

    def of(bits: Column) -> Column:
        biased = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF))
        part = F.lower(F.lpad(F.hex(bits.bitwiseAND(F.lit((1 << 52) - 1))), 13, "0"))
        exponent = biased - 1023
        normal = F.concat(F.lit("0x1."), part, F.lit("p"), F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"))
        body = F.when(x == 0, "0x0.0p+0").when(biased == 0, F.concat(F.lit("0x0."), part, F.lit("p-1022"))).otherwise(normal)
        return F.concat(F.when(bits < 0, "-").otherwise(""), body)

    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(let(double_bits(x), of))
