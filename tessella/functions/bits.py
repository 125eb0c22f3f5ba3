"""Bit operations on 64-bit integers, bit-flag and IPv4 columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.math import col


def popcount(x) -> Column:
    return F.bit_count(col(x))


def parity(x) -> Column:
    return F.bit_count(col(x)) % 2


def clz(x) -> Column:
    """Leading zeros of the 64-bit pattern."""
    return 64 - F.length(F.regexp_replace(F.bin(col(x).cast("long")), "^0+", ""))


def ctz(x) -> Column:
    """Trailing zeros; 64 for 0."""
    x = col(x).cast("long")
    lowest = x.bitwiseAND(-x)
    return F.when(x == 0, 64).otherwise(F.length(F.bin(lowest)) - 1)


def left_shift(x, n) -> Column:
    """0 for shifts outside 0..63."""
    n = col(n).cast("int")
    return F.when((n < 0) | (n > 63), F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", col(x).cast("long"), n))


def right_shift(x, n) -> Column:
    n = col(n).cast("int")
    return F.when((n < 0) | (n > 63), F.lit(0).cast("long")).otherwise(F.call_function("shiftright", col(x).cast("long"), n))


def rotl(x, n) -> Column:
    x, n = col(x).cast("long"), F.pmod(col(n).cast("int"), F.lit(64))
    return F.when(n == 0, x).otherwise(F.call_function("shiftleft", x, n).bitwiseOR(F.call_function("shiftrightunsigned", x, 64 - n)))


def rotr(x, n) -> Column:
    return rotl(x, 64 - F.pmod(col(n).cast("int"), F.lit(64)))


def bit_and(a, b) -> Column:
    return col(a).bitwiseAND(col(b))


def bit_or(a, b) -> Column:
    return col(a).bitwiseOR(col(b))


def bit_xor(a, b) -> Column:
    return col(a).bitwiseXOR(col(b))


def invert(x) -> Column:
    return F.bitwise_not(col(x))


def slice_bits(x, low: int, high: int) -> Column:
    """Bits low..high, both included, moved to the bottom."""
    width = high - low + 1
    moved = F.call_function("shiftrightunsigned", col(x).cast("long"), F.lit(low))
    return moved if width >= 64 else moved.bitwiseAND(F.lit((1 << width) - 1))


def combine_uint(high, low) -> Column:
    """high * 2**64 + low of two unsigned 64-bit patterns, as decimal(38,0)."""
    two64 = F.lit(str(1 << 64)).cast("decimal(20,0)")
    unsigned = lambda x: F.when(col(x) < 0, col(x).cast("decimal(20,0)") + two64).otherwise(col(x).cast("decimal(20,0)"))
    return (unsigned(high) * two64 + unsigned(low)).cast("decimal(38,0)")


def bit_vector(x, width: int = 8, reverse: bool = False) -> Column:
    """A string of | for set bits and . for others, lowest bit last (first if reversed)."""
    places = range(width) if reverse else range(width - 1, -1, -1)
    return F.concat(*[F.when(F.getbit(col(x).cast("long"), F.lit(i)) == 1, "|").otherwise(".") for i in places])


def vectorize(flags: Sequence) -> Column:
    """Booleans to a bit vector; the first is the lowest bit."""
    out = F.lit(0).cast("long")
    for i, flag in enumerate(flags):
        out = out + F.when(col(flag), 1 << i).otherwise(0)
    return out


def fields(x, names: str, separator: str = "", pad: str = "-") -> Column:
    """Named bit flags: a letter for each set bit, the pad otherwise; the first name is the highest bit."""
    n = len(names)
    return F.concat_ws(separator, *[F.when(F.getbit(col(x).cast("long"), F.lit(n - 1 - i)) == 1, c).otherwise(pad) for i, c in enumerate(names)])


def ip_format(x) -> Column:
    """A dotted IPv4 address of an integer."""
    x = col(x).cast("long")
    part = lambda n: F.call_function("shiftright", x, F.lit(n)).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", part(24), part(16), part(8), part(0))


def ip_parse(text) -> Column:
    """The integer of a dotted address; NULL if it isn't one."""
    bits = F.split(col(text), r"\.")
    value = sum((F.get(bits, i).try_cast("long") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(bits, 0).try_cast("long") * (1 << 24))
    return F.when(is_ipv4(text), value)


def is_ipv4(text) -> Column:
    one = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.coalesce(col(text).rlike(rf"^({one}\.){{3}}{one}$"), F.lit(False))


def is_ipv6_number(high) -> Column:
    """Whether a 128-bit address given by its upper half is not an IPv4 one."""
    return col(high) != 0
