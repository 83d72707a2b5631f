"""Exact sums against math.fsum."""

import math
import random

import pytest
from pyspark.sql import functions as F

from auditframe.operators.totals import counted, exact_totals


def groups():
    rng = random.Random(9)
    wide = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-30, 12) for _ in range(400)]
    return {
        "wide": wide, "cancels": [*wide, *[-x for x in wide], 2.0**-40], "tenths": [0.1] * 1000, "large and small": [1e12, 1e-30, -1e12, 1e-30, 3.0],
        "extremes": [1.7e308, -1.7e308, 5e-324, 1e-310, 5e-324], "ties": [2.0**53, 1.0, 2.0**-60], "ties down": [2.0**53, 1.0], "ties up": [2.0**53 + 2, 1.0],
        "zeros": [0.0, -0.0], "negative": [-1.5, -2.0**70, 0.25], "near a step": [2.0**32, 2.0**32 - 2.0**-20, 2.0**-32, 1 - 2.0**-53, 2.0**64 - 2048], "one": [0.3],
        "borrow": [2.0**96, -(2.0**-30)], "many": [rng.uniform(-1e3, 1e6) for _ in range(3000)],
    }


def test_sums_equal_fsum_in_any_order(rows):
    data = groups()
    want = {k: math.fsum(v) for k, v in data.items()}
    flat = [(k, x) for k, v in data.items() for x in v]
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(flat)
        table = rows(flat, "k string, v double").repartition(parts)
        got = {r["k"]: (r["total"], r["n"]) for r in exact_totals(table, ["k"], "v", "total", {"n": counted()}).collect()}
        assert got == {k: (want[k], len(data[k])) for k in data}


def test_nulls_and_what_is_no_number(rows):
    inf = float("inf")
    flat = [("null", None), ("some", None), ("some", 1.5), ("inf", inf), ("inf", 1.0), ("both", inf), ("both", -inf), ("nan", math.nan), ("nan", 2.0), (None, 4.0)]
    got = {r["k"]: r["t"] for r in exact_totals(rows(flat, "k string, v double"), ["k"], "v", "t", {}).collect()}
    assert got.pop("null") is None and math.isnan(got.pop("both")) and math.isnan(got.pop("nan"))
    assert got == {"some": 1.5, "inf": inf, None: 4.0}


def test_one_row_without_keys(rows):
    table = rows([(1.0,), (None,)], "v double")
    assert tuple(exact_totals(table, [], "v", "v", {"n": counted()}).first()) == (1.0, 2)
    assert tuple(exact_totals(table.where(F.lit(False)), [], "v", "v", {"n": counted()}).first()) == (None, 0)


@pytest.mark.parametrize("exponent", range(-1074, 1024, 97))
def test_single_values_come_back(exponent):
    # The cut is exact wherever the grid lies; the same arithmetic in Python.
    value = math.ldexp(1 + 2.0**-30, exponent) if exponent > -1000 else math.ldexp(1.0, exponent)
    place = math.floor(math.log2(value) / 32)
    a = math.ldexp(value, -32 * place)
    b = (a - math.floor(a)) * 2.0**32
    c = (b - math.floor(b)) * 2.0**32
    assert c == math.floor(c) and math.floor(a) < 2**33
