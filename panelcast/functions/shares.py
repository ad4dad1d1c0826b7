"""Shares, margins, winner labels and blends as column expressions.

Every division is ``try_divide``: a zero total gives NULL, also in ANSI mode.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

DEMOCRAT = "D"
REPUBLICAN = "R"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def share_of(part: Column | str, total: Column | str) -> Column:
    """``part`` as a percentage of ``total``."""
    return F.try_divide(_col(part) * 100.0, _col(total))


def two_party_share(own: Column | str, other: Column | str) -> Column:
    """``own`` as a percentage of the pair; also renormalises a predicted pair to 100."""
    return F.try_divide(_col(own) * 100.0, _col(own) + _col(other))


def two_party_margin(d: Column | str, r: Column | str) -> Column:
    """Signed margin of ``d`` over ``r`` in points of the two-party total."""
    return F.try_divide((_col(d) - _col(r)) * 100.0, _col(d) + _col(r))


def winner_or_second(d: Column | str, r: Column | str, first: str, second: str) -> Column:
    """Two-way label with a default: ties and NULLs get ``second``."""
    return F.when(_col(d) > _col(r), F.lit(first)).otherwise(F.lit(second))


def winner(d: Column | str, r: Column | str, first: str = DEMOCRAT, second: str = REPUBLICAN) -> Column:
    """Label without a default: ties and NULLs stay NULL."""
    return F.when(_col(d) > _col(r), F.lit(first)).when(_col(r) > _col(d), F.lit(second))


def lean(margin: Column | str) -> Column:
    """Lean of a signed margin; an exact tie has none."""
    return winner(_col(margin), F.lit(0.0))


def other_party(party: Column | str) -> Column:
    """The opposite side of a two-party label."""
    return F.when(_col(party) == DEMOCRAT, F.lit(REPUBLICAN)).when(
        _col(party) == REPUBLICAN, F.lit(DEMOCRAT)
    )


def incumbent_party(party: Column | str, is_incumbent: Column | str) -> Column:
    """Party in office, read off a row of either side."""
    return F.when(_col(is_incumbent), _col(party)).when(~_col(is_incumbent), other_party(party))


def challenger_party(party: Column | str, is_incumbent: Column | str) -> Column:
    """Party out of office, read off a row of either side."""
    return F.when(_col(is_incumbent), other_party(party)).when(~_col(is_incumbent), _col(party))


def side_value(side: Column | str, d: Column | str, r: Column | str) -> Column:
    """The value that belongs to the named side."""
    return F.when(_col(side) == DEMOCRAT, _col(d)).when(_col(side) == REPUBLICAN, _col(r))


def blend(*weighted: tuple[float, Column | str]) -> Column:
    """Fixed-weight sum; NULL when any part is NULL."""
    return reduce(add, [_col(c) * F.lit(float(w)) for w, c in weighted])


def strict_avg(c: Column | str) -> Column:
    """Mean that is NULL as soon as one value is NULL (``avg`` skips them)."""
    return F.when(F.count(F.lit(1)) == F.count(_col(c)), F.avg(_col(c)))
