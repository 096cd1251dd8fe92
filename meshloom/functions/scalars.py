"""Scalar expressions over meshes and logs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_MASK, _MULTIPLIER = 0xFFFFFFFF, 0x5BD1E995


def triple(a: Column, b: Column, c: Column) -> Column:
    """Scalar triple product of three vectors given as arrays."""
    return (
        a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    )


def tet_volume(p: list[Column]) -> Column:
    """Volume of a tetrahedron from its four corner arrays."""
    minus = lambda q: F.zip_with(q, p[0], lambda x, y: x - y)
    return F.abs(triple(minus(p[1]), minus(p[2]), minus(p[3]))) / 6


#: Five tetrahedra that fill a hexahedron, by corner number.  Fixed values.
HEX_TETS = ((0, 1, 3, 4), (1, 2, 3, 6), (1, 4, 5, 6), (3, 4, 6, 7), (1, 3, 4, 6))


def hex_volume(corners: list[Column]) -> Column:
    total = [tet_volume([corners[i] for i in tet]) for tet in HEX_TETS]
    return sum(total[1:], total[0])


def scientific(value: Column) -> Column:
    """1600000 -> 1.6 \\times 10^{6}."""
    parts = F.split(F.format_string("%.1e", value), "e")
    return F.concat(parts[0], F.lit(" \\times 10^{"), parts[1].cast("int").cast("string"), F.lit("}"))


def stretch(size: Column) -> Column:
    return F.log2(size.cast("double")) + 1


def trailing_number(path: Column) -> Column:
    """The digits between the last _ and the extension of a file name; null if there are none."""
    found = F.regexp_extract(path, r"_([0-9]+)\.[^.]*$", 1)
    return F.when(found != "", found.cast("long"))


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def floor_log2(n: Column) -> Column:
    """Place of the highest bit; null below 1."""
    return F.when(n > 0, F.length(F.bin(n)) - 1)


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1)).cast("double")).cast("long"))


def previous_power_of_two(n: Column) -> Column:
    return F.when(n > 0, F.pow(F.lit(2.0), (F.length(F.bin(n)) - 1).cast("double")).cast("long"))


def to_binary(n: Column, digits: int) -> Column:
    """The low ``digits`` bits as text, most significant first."""
    return F.lpad(F.bin(n.cast("long").bitwiseAND(F.lit((1 << digits) - 1))), digits, "0")


def from_binary(text: Column) -> Column:
    return F.conv(text, 2, 10).cast("long")


def scrambled(n: Column) -> Column:
    """A reversible scrambling of 32 bits: xor with the upper half, then an odd multiplier, twice."""
    x = n.cast("long")
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 16)) * F.lit(_MULTIPLIER)
        x = x.bitwiseAND(F.lit(_MASK))
    return x


def unscrambled(n: Column) -> Column:
    """The inverse of ``scrambled``."""
    x = n.cast("long")
    back = pow(_MULTIPLIER, -1, _MASK + 1)
    for _ in range(2):
        low, high = F.lit(back & 0xFFFF), F.lit(back >> 16)  # the product is made of two, each below 2 ** 63
        x = (x * low + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 16))
    return x


def colour(label: Column) -> list[Column]:
    """Red, green and blue of a label, by bits of its hash."""
    h = F.hash(F.lit(2), label)
    return [F.shiftright(h, k).bitwiseAND(F.lit(255)) for k in (0, 8, 16)]


def slice_of(x: Column, low: Column, high: Column, parts: int) -> Column:
    """Part of equal-width slices of [low, high]; the last one takes the upper end."""
    return F.when(high > low, F.least(F.floor((x - low) / (high - low) * parts), F.lit(parts - 1))).otherwise(F.lit(0)).cast("long")
