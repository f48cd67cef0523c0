"""Rounding of doubles by their exact binary value, as column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this every value rounds to 0 at up to 4 places; from 2**53 on doubles are whole, and from
#: 2**49 on they have 3 places at most.
_SMALL, _WHOLE, _SHORT, _PLACES = 1e-5, float(1 << 53), float(1 << 49), 4


def round_binary(x: Column, *places: int) -> Column:
    """array<double>: x to each of the numbers of decimal places (0 to 4), half to even, decided by the value
    that the double really has: 2.675 is a little less than it looks and gives 2.67. Null, NaN and
    infinities stay.

    The double is m / 2**k with whole m and k, both small enough for exact arithmetic; the remainder of
    m * 10**places by 2**k tells on which side of the half it lies.
    """
    if not all(0 <= p <= _PLACES for p in places):
        raise ValueError(f"0 to {_PLACES} places")
    size = F.abs(x)
    # Two more bits than a double has, so that a logarithm off by one does no harm; a long holds 2**60.
    k = F.greatest(F.lit(0), F.lit(54) - F.floor(F.log2(size)).cast("int"))
    power = lambda e: F.pow(F.lit(2.0), e).cast("long")
    unit = power(F.least(k, F.lit(60))).cast("decimal(19,0)") * power(F.greatest(k - 60, F.lit(0))).cast("decimal(5,0)")
    plain = ~(x.isNull() | F.isnan(x) | (size < _SMALL) | (size >= _WHOLE))
    m = F.when(plain, (size * F.pow(F.lit(2.0), k)).cast("long").cast("decimal(17,0)"))
    one = F.struct(x.alias("x"), size.alias("size"), m.alias("m"), F.when(plain, unit).alias("unit"))
    tens = F.array(*(F.lit(Decimal(10**p)).cast("decimal(5,0)") for p in places))

    def at(s: Column, ten: Column) -> Column:
        rest = (s["m"] * ten) % s["unit"]
        down = F.call_function("floor", F.try_divide(s["m"] * ten - rest, s["unit"])).cast("decimal(20,0)")
        up = (rest * 2 > s["unit"]) | ((rest * 2 == s["unit"]) & (down % 2 == 1))
        value = (F.when(up, down + 1).otherwise(down).cast("decimal(20,0)") / ten).cast("double")
        exact = F.when(s["size"] < _SMALL, F.lit(0.0)).when((s["size"] >= _SHORT) & (ten == 10**_PLACES), s["size"]).otherwise(value)
        return F.when(s["m"].isNull() & ~(s["size"] < _SMALL), s["x"]).when(s["x"] < 0, -exact).otherwise(exact)

    return F.get(F.transform(F.array(one), lambda s: F.transform(tens, lambda ten: at(s, ten))), F.lit(0))
