"""Period (month-range) functions, C1-C9, as Spark column expressions.

``as_of`` (the "current" date) is a parameter everywhere; the default is
``current_date()``. The earliest valid month defaults to the fixed value in
:mod:`tallyzone.constants`.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyzone.constants import EARLIEST_MONTH, EARLIEST_YEAR, MONTH_NAMES


def _col(c):
    if isinstance(c, Column):
        return c
    if isinstance(c, str):
        return F.col(c)
    return F.lit(c)


def as_of_col(as_of: _dt.date | str | Column | None) -> Column:
    """The reference date as a DATE column (default: today)."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of.cast("date")
    return F.lit(str(as_of)).cast("date")


def month_start(year, month) -> Column:
    """First day of a month."""
    return F.make_date(_col(year), _col(month), F.lit(1))


def month_key(year, month) -> Column:
    """``YYYYMM`` as an integer; sorts like the zero-padded text key."""
    return (_col(year) * 100 + _col(month)).cast("int")


def current_month(as_of=None) -> Column:
    """Month number of ``as_of``."""
    return F.month(as_of_col(as_of))


def current_year(as_of=None) -> Column:
    """Year of ``as_of``."""
    return F.year(as_of_col(as_of))


def latest_month(as_of=None) -> Column:
    """First day of the month of ``as_of`` (latest selectable month)."""
    return F.trunc(as_of_col(as_of), "month")


def valid_years(as_of=None, earliest_year: int = EARLIEST_YEAR) -> Column:
    """Array of years from the year of ``as_of`` down to the earliest year."""
    return F.sequence(current_year(as_of), F.lit(earliest_year), F.lit(-1))


def start_not_after_end(sy, sm, ey, em) -> Column:
    """C4: start month <= end month."""
    return month_start(sy, sm) <= month_start(ey, em)


def month_in_range(year, month, as_of=None, earliest: tuple[int, int] = (EARLIEST_YEAR, EARLIEST_MONTH)) -> Column:
    """The month lies in [earliest, month of as_of], both ends included."""
    d = month_start(year, month)
    return (d >= month_start(earliest[0], earliest[1])) & (d <= latest_month(as_of))


def period_valid(sy, sm, ey, em, as_of=None,
                 earliest: tuple[int, int] = (EARLIEST_YEAR, EARLIEST_MONTH)) -> Column:
    """Both ends in range and start not after end."""
    return (
        month_in_range(sy, sm, as_of, earliest)
        & month_in_range(ey, em, as_of, earliest)
        & start_not_after_end(sy, sm, ey, em)
    )


def previous_month(as_of=None) -> Column:
    """First day of the month before ``as_of`` (January -> December of the year before)."""
    return F.add_months(latest_month(as_of), -1)


def month_name(month) -> Column:
    """English month name of a month number (locale-independent lookup)."""
    names = F.array(*[F.lit(n) for n in MONTH_NAMES])
    return F.element_at(names, _col(month).cast("int"))


def request_valid(start: tuple[int, int], end: tuple[int, int], as_of: _dt.date | str,
                  earliest: tuple[int, int] = (EARLIEST_YEAR, EARLIEST_MONTH)) -> bool:
    """C6 for one request of (year, month) pairs, before any job runs."""
    day = _dt.date.fromisoformat(str(as_of))
    return tuple(earliest) <= tuple(start) <= tuple(end) <= (day.year, day.month) and all(
        1 <= m <= 12 for _, m in (start, end))


def request_months(requests: Sequence[tuple[int, tuple[int, int], tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(request, year, month) of every month of (request, start, end) periods."""
    return [(i, m // 12, m % 12 + 1) for i, (sy, sm), (ey, em) in requests
            for m in range(sy * 12 + sm - 1, ey * 12 + em)]


def previous_period(as_of: _dt.date | str) -> tuple[int, int]:
    """C7 as a (year, month) pair."""
    day = _dt.date.fromisoformat(str(as_of)).replace(day=1) - _dt.timedelta(days=1)
    return day.year, day.month
