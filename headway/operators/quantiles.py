"""Exact quantiles of a whole table without sorting it or holding its values in one task.

The values are counted by ranges of their span; the range that holds a rank becomes the next span, until it is one value
or holds few enough to be looked at one by one. A pass is one aggregate with a few thousand groups, counted within tasks
first; a value that a third of all rows has is a count like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a span is counted by; different values that are looked at one by one.
RANGES, FEW = 2048, 2048


def _selected(values: DataFrame, ranks: Iterable[int], low: float, high: float, n: int) -> dict[int, float]:
    """The values at ranks (from 0) of values(x), of which n lie from low to high."""
    found: dict[int, float] = {}
    # a span: (lowest, highest, how many lie below it, how many in it) -> the ranks it holds
    spans = {(low, high, 0, n): set(ranks)}
    while spans:
        few = [s for s in spans if s[3] <= FEW and s[0] < s[1]]
        for s in [s for s in spans if s[0] == s[1]]:
            found |= dict.fromkeys(spans.pop(s), s[0])
        order = list(spans)
        if not order:
            break
        # a span of few values is counted by value, others by range
        number, place = F.lit(None).cast("int"), F.lit(None).cast("double")
        for k, (lo, hi, _, _) in enumerate(order):
            inside = F.col("x").between(lo, hi)
            width = hi / RANGES - lo / RANGES
            number = F.when(inside, k).otherwise(number)
            at = F.col("x") if order[k] in few else F.least(F.floor((F.col("x") - lo) / width).cast("double"), F.lit(RANGES - 1.0)) if width > 0 else F.col("x")
            place = F.when(inside, at).otherwise(place)
        rows = values.select("x", number.alias("k"), place.alias("at")).filter("k IS NOT NULL").groupBy("k", "at").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # RANGES or FEW rows a span
        new: dict[tuple, set] = {}
        for k, s in enumerate(order):
            below, wanted = s[2], sorted(spans[s])
            for r in sorted((r for r in rows if r.k == k), key=lambda r: r.lo):
                here = {x for x in wanted if below <= x < below + r.n}
                if here:
                    new.setdefault((r.lo, r.hi, below, r.n), set()).update(here)
                below += r.n
        spans = new
    return found


def exact_quantiles(rows: DataFrame, value: Column | str, parts: tuple[float, ...]) -> list[float | None]:
    """The values below which the parts of the rows lie, between neighbours in proportion; None without values. Null values don't count; values are finite.

    Reads the rows about three times; give a table or a checkpoint where they are dear.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = rows.select(x.alias("x")).filter("x IS NOT NULL")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(parts)
    at = [p * (n - 1) for p in parts]
    found = _selected(values, {k for a in at for k in (math.floor(a), math.ceil(a))}, low, high, n)
    return [found[math.floor(a)] + (found[math.ceil(a)] - found[math.floor(a)]) * (a - math.floor(a)) for a in at]
