"""Hashed draws of whole numbers that any engine with md5 can repeat."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.hashing import draw


def whole(seed: int, *parts: Column | str) -> Column:
    """A number below 2^60: the first 15 hex digits of the hash of seed and parts."""
    return F.conv(F.substring(draw(seed, *parts), 1, 15), 16, 10).cast("bigint")


def distinct_below(q: Column, n: Column, number: Callable[[Column], Column]) -> Column:
    """``q`` different numbers below ``n``, every set of them equally likely, from the draws ``number(0)`` to ``number(q - 1)``.

    Draw i is taken below n - q + i + 1; if it is there already, n - q + i comes in its place. So ``q`` draws do, with no
    permutation of n and no second tries. Needs ``q`` up to ``n``; none of ``q`` are an empty array.
    """
    top = lambda i: n - q + i
    fresh = lambda i: F.pmod(number(i), top(i) + 1)
    return F.aggregate(
        _upto(q), F.array().cast("array<bigint>"),
        lambda have, i: F.concat(have, F.array(F.when(F.array_contains(have, fresh(i)), top(i)).otherwise(fresh(i)))),
    )


def any_below(q: Column, n: Column, number: Callable[[Column], Column]) -> Column:
    """``q`` numbers below ``n``, repeats allowed."""
    return F.transform(_upto(q), lambda i: F.pmod(number(i), n))


def _upto(q: Column) -> Column:
    """0 to ``q`` - 1 as bigint."""
    q = q.cast("bigint")
    return F.when(q > 0, F.sequence(F.lit(0).cast("bigint"), q - 1)).otherwise(F.array().cast("array<bigint>"))
