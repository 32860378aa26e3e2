"""Rounding as Python's ``round`` does it: on the double's exact value, halves to the even digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vouchwell.functions.text import let

#: Digits for which ten to their power times half a double is exact.
MAX_DIGITS = 7
_SPLIT = float(2**27 + 1)


def round_half_even(value: Column, digits: int) -> Column:
    """``value`` (a double) to so many digits. The product with the power of ten is kept as two
    doubles whose sum is exact (the upper and the lower half of the value's bits are multiplied
    apart), so a value just off a half isn't taken for one."""
    if not 0 <= digits <= MAX_DIGITS:
        raise ValueError(f"0 to {MAX_DIGITS} digits")
    scale = float(10**digits)

    def of(x):
        big = x * _SPLIT
        parted = F.struct((big - (big - x)).alias("upper"), (x * scale).alias("p"))
        error = lambda s: (s["upper"] * scale - s["p"]) + (x - s["upper"]) * scale
        return let(let(parted, lambda s: F.struct(s["p"], error(s).alias("e"), F.floor(s["p"]).cast("double").alias("down"))), lambda s: _whole(s["p"], s["e"], s["down"]) / scale)

    def _whole(p, e, down):
        odd = F.pmod(down, F.lit(2.0)) == 1
        # p - down is a multiple of p's last place, and e less than that: the sums' signs are right
        above = lambda half: (p - down - half) + e
        up = (above(0.5) > 0) | ((above(0.5) == 0) & odd)
        low = (above(-0.5) < 0) | ((above(-0.5) == 0) & odd)
        return F.when(up, down + 1).when(low, down - 1).otherwise(down)

    def signed(x):
        size = F.abs(x)
        plain = F.isnan(x) | (size * scale >= float(2**53)) | (x == 0)
        rounded = let(size, of)
        return F.when(plain, x).otherwise(F.when(x < 0, -rounded).otherwise(rounded))

    return let(value.cast("double"), signed)
