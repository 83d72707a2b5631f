"""Sums of doubles that are exact before they are rounded once.

A double is a whole number of up to 53 bits times a power of two. It is cut into three limbs of 32 bits on a grid that all
values share, and limbs are added as whole numbers, so the order of rows and tasks does not matter and nothing is
lost between 10^-320 and 10^308. Values of one stretch of the grid share a bin; a group has few bins (66 at most), whose sums
meet in a second, small aggregation. There carries are propagated and the result is rounded to the nearest double.

Nulls are left out; a sum of no values is NULL. Infinities and NaN give what adding them gives.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.functions.columns import let

_BITS = 32
_WIDE = "decimal(38,0)"

#: A partial aggregate of the rows and how its parts are merged.
Measure = tuple[Column, Callable[[Column], Column]]


def _scaled(value: Column, exponent: Column) -> Column:
    """value * 2^exponent, in two steps so that neither power overflows."""
    half = F.floor(exponent / 2)
    return value * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), exponent - half)


def _limbs(value: Column) -> list[Column]:
    """The bin of a finite double and its three limbs, the highest first."""
    size, sign = F.abs(value), F.when(value < 0, -1).otherwise(1)
    place = F.when(size > 0, F.floor(F.log2(size) / _BITS)).otherwise(0)

    def cut(p: Column) -> Column:
        first = _scaled(size, -p * _BITS)
        return let(first, lambda a: let((a - F.floor(a)) * 2.0**_BITS, lambda b: F.struct(
            F.floor(a).alias("h"), F.floor(b).alias("m"), F.floor((b - F.floor(b)) * 2.0**_BITS).alias("l"))))

    parts = let(place, lambda p: F.struct(p.cast("int").alias("p"), cut(p).alias("c")))
    return [parts["p"], *[(parts["c"][n] * sign).cast("decimal(20,0)") for n in "hml"]]


def _digits(bins: Column, sign: int) -> Column:
    """Digits of 32 bits, the lowest first, of the sum of all bins times ``sign``, and what is carried out of them."""
    radix = F.lit(Decimal(1 << _BITS)).cast("decimal(10,0)")
    zero = F.lit(0).cast(_WIDE)
    low, high = F.array_min(F.transform(bins, lambda b: b["p"])) - 2, F.array_max(F.transform(bins, lambda b: b["p"])) + 3

    def at(place: Column) -> Column:
        def limb(b: Column) -> Column:
            return F.when(b["p"] == place, b["h"]).when(b["p"] == place + 1, b["m"]).when(b["p"] == place + 2, b["l"]).otherwise(0).cast(_WIDE)

        return F.aggregate(bins, zero, lambda n, b: (n + limb(b)).cast(_WIDE))

    def step(acc: Column, place: Column) -> Column:
        total = (acc["carry"] + at(place) * sign).cast(_WIDE)
        return let(total, lambda t: F.struct(
            ((t - F.pmod(t, radix)) / radix).cast(_WIDE).alias("carry"), F.concat(acc["digits"], F.array(F.pmod(t, radix).cast("bigint"))).alias("digits")))

    start = F.struct(zero.alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.struct(low.alias("low"), F.aggregate(F.sequence(low, high), start, step).alias("sum"))


def _rounded(found: Column) -> Column:
    """The digits as the nearest double: the three highest in full, those below as a trace that breaks ties."""
    digits, low = found["sum"]["digits"], found["low"]
    top = F.aggregate(F.transform(digits, lambda d, i: F.when(d > 0, i).otherwise(-1)), F.lit(-1), lambda a, i: F.greatest(a, i))

    def value(t: Column) -> Column:
        def digit(k: int) -> Column:
            return F.when(t >= k, F.get(digits, t - k)).otherwise(0).cast(_WIDE)

        radix = F.lit(Decimal(1 << _BITS)).cast(_WIDE)
        whole = ((digit(0) * radix).cast(_WIDE) + digit(1)).cast(_WIDE)
        whole = ((whole * radix).cast(_WIDE) + digit(2)).cast(_WIDE)
        trace = F.exists(F.slice(digits, F.lit(1), F.greatest(t - 2, F.lit(0))), lambda d: d > 0)
        whole = (whole * 2 + F.when(trace, 1).otherwise(0)).cast(_WIDE)
        return F.when(t < 0, 0.0).otherwise(_scaled(whole.cast("double"), (low + t - 2) * _BITS - 1))

    return let(top, value)


def _total(bins: Column) -> Column:
    both = F.array(_digits(bins, 1), _digits(bins, -1))
    return let(both, lambda b: F.when(b[0]["sum"]["carry"] < 0, -_rounded(b[1])).otherwise(_rounded(b[0])))


def exact_totals(rows: DataFrame, keys: Sequence[str], value: str, total: str, measures: Mapping[str, Measure]) -> DataFrame:
    """Rows grouped by ``keys`` with the exact sum of the column ``value`` as ``total`` and further measures.

    Each measure is an aggregate of the rows and a function that merges its partial results.
    """
    finite = F.abs(F.col(value)) < float("inf")
    names = ["_bin", "_high", "_middle", "_low"]
    clean = F.when(finite, F.col(value)).otherwise(0.0)
    binned = rows.withColumns(dict(zip(names, _limbs(clean))))
    first = binned.groupBy(*keys, "_bin").agg(
        *[F.sum(n).alias(n) for n in names[1:]],
        F.sum(F.when(~finite, F.col(value))).alias("_other"),
        F.count(value).alias("_values"),
        *[part.alias(name) for name, (part, _) in measures.items()],
    )
    bins = F.collect_list(F.struct(F.col("_bin").alias("p"), F.col("_high").alias("h"), F.col("_middle").alias("m"), F.col("_low").alias("l")))
    second = first.groupBy(*keys).agg(
        bins.alias("_bins"), F.sum("_other").alias("_other"), F.sum("_values").alias("_values"), *[merge(F.col(name)).alias(name) for name, (_, merge) in measures.items()])
    exact = F.when(F.col("_values") > 0, F.coalesce("_other", _total(F.col("_bins"))))
    return second.select(*keys, exact.alias(total), *measures)


def counted(c: Column | str = "*") -> Measure:
    return F.count(c), lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")


def counted_if(condition: Column) -> Measure:
    return F.count_if(condition), lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("bigint")
