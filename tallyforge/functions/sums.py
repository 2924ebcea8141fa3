"""Sums of doubles that are rounded once, so that they don't depend on the order of rows.

An amount is split without loss into whole numbers of 2^-10 and of 2^-63, which
add up as decimals in any order, in groups and windows alike. So two ways to the
same sum never differ at a tolerance, nor does a sum from that of a correctly
rounded loop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amounts from here on (they have no cents) and those that aren't finite are added up as doubles in whatever order they come.
LARGE = float(1 << 53)
_UNIT, _REST = float(1 << 10), 1 << 53


def parts(amount: Column) -> dict[str, Column]:
    """What to add up of each amount, by name; a missing amount is 0."""
    value = F.coalesce(amount.cast("double"), F.lit(0.0))
    small = F.abs(value) < LARGE
    scaled = F.when(small, value).otherwise(0.0) * _UNIT
    high = F.floor(scaled)
    low = F.floor((scaled - high) * float(_REST))
    return {"_high": high.cast("decimal(20,0)"), "_low": low.cast("decimal(20,0)"), "_large": F.when(small, 0).otherwise(1).cast("long"), "_double": value}


def total(added: Callable[[str], Column]) -> Column:
    """The sum, from the sums of its parts by name."""
    high, low, rest = added("_high"), added("_low"), F.lit(_REST).cast("decimal(17,0)")
    exact = ((high + F.call_function("div", low, rest)).cast("double") + (low % rest).cast("double") / float(_REST)) / _UNIT
    return F.when(added("_large") == 0, exact).otherwise(added("_double"))


def exact_sum(amount: Column) -> Column:
    """The aggregate sum of an amount, 0.0 if all are missing."""
    of = parts(amount)
    return total(lambda name: F.sum(of[name]))
