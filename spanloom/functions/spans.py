"""Half-open spans [start, end) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def overlaps(s1, e1, s2, e2) -> Column:
    """Do two non-empty spans share a position?"""
    return (_c(s1) < _c(e2)) & (_c(s2) < _c(e1))


def inside(s, e, lo, hi) -> Column:
    """Does [s, e) lie within [lo, hi)?"""
    return (_c(s) >= _c(lo)) & (_c(e) <= _c(hi))


def localise(x, origin) -> Column:
    """A position counted from an origin."""
    return _c(x) - _c(origin)


def clip_start(s, block_start) -> Column:
    return F.greatest(_c(s) - _c(block_start), F.lit(0))


def clip_end(e, block_start, block_end) -> Column:
    return F.least(_c(e) - _c(block_start), _c(block_end) - _c(block_start))


def window_around(s, e, lo, hi, size: int) -> tuple[Column, Column]:
    """The block of at most `size` positions around [s, e) within [lo, hi).

    Both sides grow alike as far as either may; what is then left, if more than one position, goes to the side that has room."""
    s, e, lo, hi = _c(s), _c(e), _c(lo), _c(hi)
    d = F.least(s - lo, hi - e, F.floor((F.lit(size) - (e - s)) / 2).cast("long"))
    start, end = s - d, e + d
    rest = F.lit(size) - (end - start)
    at_left, at_right = start == lo, end == hi
    start2 = F.when((rest > 1) & ~at_left & at_right, F.greatest(lo, start - rest)).otherwise(start)
    end2 = F.when((rest > 1) & at_left, F.least(hi, end + rest)).otherwise(end)
    return start2, end2
