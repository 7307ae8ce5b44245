"""Z-order codes as Column expressions: 21 bits an axis, 63 in all, so codes are never negative."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 21
TOP = (1 << BITS) - 1
_STEPS = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))
ALMOST_ONE = math.nextafter(1.0, 0.0)


@dataclass(frozen=True)
class Bounds:
    """The box that codes refer to."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]

    @property
    def span(self) -> tuple[float, float, float]:
        return tuple(b - a for a, b in zip(self.low, self.high, strict=True))  # type: ignore[return-value]


def spread(x: Column) -> Column:
    """Two zero bits after every one of 21 bits."""
    x = x.bitwiseAND(TOP)
    for shift, mask in _STEPS:
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(mask)
    return x


def compact(x: Column) -> Column:
    """Inverse of spread."""
    masks = [TOP, *(m for _, m in _STEPS)]
    x = x.bitwiseAND(masks[-1])
    for (shift, _), mask in zip(reversed(_STEPS), reversed(masks[:-1]), strict=True):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(mask)
    return x


def interleave(x: Column, y: Column, z: Column) -> Column:
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def axes(code: Column) -> list[Column]:
    return [compact(F.shiftrightunsigned(code, i)) for i in range(3)]


def grid(p: Column, low: float, high: float) -> Column:
    """Integer coordinate on 2^21 - 1 steps, rounded half to even."""
    share = (p - F.lit(low)) / F.lit(high - low)
    return F.rint(F.least(F.greatest(share, F.lit(0.0)), F.lit(ALMOST_ONE)) * F.lit(float(TOP))).cast("long")


def encode(x: Column, y: Column, z: Column, box: Bounds) -> Column:
    return interleave(*(grid(p, a, b) for p, a, b in zip((x, y, z), box.low, box.high, strict=True)))


def with_code(points: DataFrame, box: Bounds, name: str = "code") -> DataFrame:
    """points with their code. Grid coordinates are columns of their own, as spreading bits repeats its argument 32 times."""
    at = {f"__{a}": grid(F.col(a), low, high) for a, low, high in zip("xyz", box.low, box.high, strict=True)}
    return points.withColumns(at).withColumn(name, interleave(*map(F.col, at))).drop(*at)


def decode(code: Column, box: Bounds) -> list[Column]:
    """x, y, z of a code; coordinates pass through single precision."""
    # Spark divides in double precision; rounding the quotient of two floats to float gives float division.
    return [F.lit(a) + (c.cast("float") / F.lit(float(TOP)).cast("float")).cast("float").cast("double") * F.lit(b - a) for c, a, b in zip(axes(code), box.low, box.high, strict=True)]


def bit_length(x: Column) -> Column:
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def common_prefix(a: Column, b: Column) -> Column:
    """Leading bits that two codes share, of 64."""
    return F.lit(64) - bit_length(a.bitwiseXOR(b))


def prefix(code: Column, depth: Column) -> Column:
    """The code of the cell at a depth: all lower bits are zero."""
    shift = (63 - 3 * depth).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", code, shift), shift)


def octant(code: Column, depth: Column) -> Column:
    """Which child of its parent the cell at a depth is."""
    return F.call_function("shiftright", code, (63 - 3 * depth).cast("int")).bitwiseAND(7)


def common_depth(a: Column, b: Column) -> Column:
    """Deepest level at which two codes share a cell."""
    return F.when(a == b, BITS).otherwise(F.floor((common_prefix(a, b) - 1) / 3)).cast("int")


def address(code: Column, depth: Column) -> Column:
    """A number for every cell, in order of depth, then code."""
    first = F.floor((F.call_function("shiftleft", F.lit(1).cast("long"), (3 * depth).cast("int")) - 1) / 7)
    return first.cast("long") + F.call_function("shiftright", code, (63 - 3 * depth).cast("int"))
