"""Positions of regular-expression matches, with built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(start: Column, steps: Column) -> Column:
    """``start``, then the sums after each of ``steps``."""
    return F.aggregate(steps, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def match_spans(text: Column, pattern: str, before: int = 0, after: int = 0) -> Column:
    """array<struct<s:int,e:int,m:string,left:string,right:string>>: leftmost non-overlapping matches, in code points, end exclusive.

    ``left`` and ``right`` are up to ``before`` and ``after`` code points beside the match. Null text has null spans; text
    without a match is cut only once. The pieces between the matches and the matches themselves alternate, so
    positions are running sums of their lengths. For n matches they are summed in about sqrt(n) parts of as many
    pieces, and context is cut from the text of a part, so no step walks the whole text or list for each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(found.alias("m"), F.split(text, pattern, -1).alias("g"))
    wide = lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0))

    def parts(p: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(p))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / width).cast("int")), lambda c: F.slice(p, c * width + 1, width))

    def spans(part: Column, first: Column, last: Column) -> Column:
        low = F.greatest(first - before, F.lit(0))

        def one(near: Column, x: Column, at: Column) -> Column:
            s = at + F.length(x["g"])
            e = s + F.length(x["m"])
            left = F.greatest(s - before, F.lit(0))
            return F.struct(
                s.alias("s"), e.alias("e"), x["m"].alias("m"), F.substring(near, left - low + 1, s - left).alias("left"),
                F.substring(near, e - low + 1, F.lit(after)).alias("right"),
            )

        at = F.slice(_running(first, F.transform(part, wide)), F.lit(1), F.size(part))
        near = F.substring(text, low + 1, last - low + after) if before or after else F.lit("")
        return F.filter(_bound(near, lambda n: F.zip_with(part, at, lambda x, a: one(n, x, a))), lambda r: r["m"].isNotNull())

    def all_spans(cut: Column) -> Column:
        totals = F.transform(cut, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + wide(x)))
        return _bound(
            _running(F.lit(0), totals),
            lambda b: F.flatten(F.transform(cut, lambda part, i: spans(part, F.get(b, i), F.get(b, i + 1)))),
        )

    none = F.array().cast("array<struct<s:int,e:int,m:string,left:string,right:string>>")
    every = _bound(pieces, lambda p: _bound(parts(p), all_spans))
    return F.when(F.regexp_like(text, F.lit(pattern)), every).when(text.isNotNull(), none)
