"""Selection predicates over frames, written as Python expressions.

    select_frames(frames, lambda v: (v.hfr < v.median(v.hfr) + 2 * v.mad(v.hfr))
                                    & ~v.trailed & v.path.not_like("%reject%"))

Conditions are two-valued: a comparison with an unknown value is false and
its negation true, `!=` with an unknown value is true.  Unknown is NULL.
Python's operators build Column expressions only; Spark plans the rest.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightledger.functions.numeric import known


def _number(v) -> Column:
    if isinstance(v, Num):
        return v.col
    if isinstance(v, Flag):
        return v.strict().cast("double")
    if isinstance(v, Column):
        return v
    return F.lit(float(v))


class Flag:
    """A condition.  NULL inside counts as false, so AND and OR stay plain
    and can reach the scan; only negation has to spell it out."""

    def __init__(self, col: Column):
        self.col = col

    def strict(self) -> Column:
        return F.coalesce(self.col, F.lit(False))

    def __and__(self, other):
        return Flag(self.col & as_flag(other).col)

    def __or__(self, other):
        return Flag(self.col | as_flag(other).col)

    def __invert__(self):
        return Flag(~self.strict())

    __rand__, __ror__ = __and__, __or__

    def __bool__(self):
        raise TypeError("use &, | and ~ to combine conditions; a chain a < b < c is (a < b) & (b < c)")


class Num:
    """A number per frame; NULL is unknown."""

    def __init__(self, col: Column):
        self.col = col

    def __add__(self, o):
        return Num(known(self.col + _number(o)))

    def __radd__(self, o):
        return Num(known(_number(o) + self.col))

    def __sub__(self, o):
        return Num(known(self.col - _number(o)))

    def __rsub__(self, o):
        return Num(known(_number(o) - self.col))

    def __mul__(self, o):
        return Num(known(self.col * _number(o)))

    def __rmul__(self, o):
        return Num(known(_number(o) * self.col))

    def __truediv__(self, o):
        return Num(_divide(self.col, _number(o)))

    def __rtruediv__(self, o):
        return Num(_divide(_number(o), self.col))

    def __mod__(self, o):
        return Num(_modulo(self.col, _number(o)))

    def __rmod__(self, o):
        return Num(_modulo(_number(o), self.col))

    def __pow__(self, o):
        return Num(known(F.pow(self.col, _number(o))))

    def __rpow__(self, o):
        return Num(known(F.pow(_number(o), self.col)))

    def __neg__(self):
        return Num(-self.col)

    def __pos__(self):
        return self

    def __abs__(self):
        return Num(F.abs(self.col))

    def __lt__(self, o):
        return Flag(self.col < _number(o))

    def __le__(self, o):
        return Flag(self.col <= _number(o))

    def __gt__(self, o):
        return Flag(self.col > _number(o))

    def __ge__(self, o):
        return Flag(self.col >= _number(o))

    def __eq__(self, o):
        return Flag(self.col == _number(o))

    def __ne__(self, o):
        return Flag(F.coalesce(self.col != _number(o), F.lit(True)))

    def between(self, lo, hi):
        return (self >= lo) & (self <= hi)

    def not_between(self, lo, hi):
        """Outside the range; an unknown value is not outside."""
        return (self < lo) | (self > hi)

    def missing(self):
        return Flag(self.col.isNull())

    def present(self):
        return Flag(self.col.isNotNull())

    def like(self, pattern: str):
        _pattern(pattern)
        return Flag(F.lit(False))  # a number never matches a text pattern

    def not_like(self, pattern: str):
        return ~self.like(pattern)

    __hash__ = None


class Text:
    """Lowercased text; missing is the empty string, so it never is NULL."""

    def __init__(self, col: Column):
        self.col = col

    @staticmethod
    def _other(o) -> Column:
        return o.col if isinstance(o, Text) else F.lit(_fold(o))

    def __eq__(self, o):
        return Flag(self.col == self._other(o))

    def __ne__(self, o):
        return Flag(self.col != self._other(o))

    def __lt__(self, o):
        return Flag(self.col < self._other(o))

    def __le__(self, o):
        return Flag(self.col <= self._other(o))

    def __gt__(self, o):
        return Flag(self.col > self._other(o))

    def __ge__(self, o):
        return Flag(self.col >= self._other(o))

    def between(self, lo, hi):
        return (self >= lo) & (self <= hi)

    def not_between(self, lo, hi):
        return (self < lo) | (self > hi)

    def like(self, pattern: str):
        """% is any run, _ one character, all else literal; case is ignored."""
        return Flag(self.col.like(_pattern(pattern)))

    def not_like(self, pattern: str):
        return ~self.like(pattern)

    def isin(self, *values: str):
        return Flag(self.col.isin([_fold(v) for v in values]))

    __hash__ = None


class When:
    """A capture time.  A comparison with text works at the precision typed:
    `date == "2026-05-13"` is that whole day."""

    def __init__(self, col: Column):
        self.col = col

    def _bounds(self, o) -> tuple[Column, Column]:
        if isinstance(o, When):
            return o.col, o.col + F.expr("INTERVAL 1 MILLISECOND")
        lo, hi = date_span(o)
        return _ntz(lo), _ntz(hi)

    def __ge__(self, o):
        return Flag(self.col >= self._bounds(o)[0])

    def __lt__(self, o):
        return Flag(self.col < self._bounds(o)[0])

    def __gt__(self, o):
        return Flag(self.col >= self._bounds(o)[1])

    def __le__(self, o):
        return Flag(self.col < self._bounds(o)[1])

    def __eq__(self, o):
        lo, hi = self._bounds(o)
        return Flag((self.col >= lo) & (self.col < hi))

    def __ne__(self, o):
        lo, hi = self._bounds(o)
        return Flag(F.coalesce((self.col < lo) | (self.col >= hi), F.lit(True)))

    def between(self, lo, hi):
        return (self >= lo) & (self <= hi)

    def not_between(self, lo, hi):
        return (self < lo) | (self > hi)

    def missing(self):
        return Flag(self.col.isNull())

    def present(self):
        return Flag(self.col.isNotNull())

    __hash__ = None


def as_flag(v) -> Flag:
    """A number used as a condition is true when non-zero or unknown."""
    if isinstance(v, Flag):
        return v
    if isinstance(v, Num):
        return Flag(F.coalesce(v.col != 0, F.lit(True)))
    if isinstance(v, Column):
        return Flag(v)
    if isinstance(v, bool):
        return Flag(F.lit(v))
    raise TypeError(f"not a condition: {v!r}")


def _fold(text) -> str:
    return str(text).lower().replace("\\", "/")


def _pattern(text) -> str:
    if not isinstance(text, str):
        raise TypeError("a like pattern is text")
    return _fold(text)


def _divide(a: Column, b: Column) -> Column:
    """Division as floating point defines it: x/0 is infinite, 0/0 unknown."""
    inf = float("inf")
    return (
        F.when(b != 0, known(a / F.nullif(b, F.lit(0.0))))
        .when((b == 0) & (a > 0), F.lit(inf))
        .when((b == 0) & (a < 0), F.lit(-inf))
    )


def _modulo(a: Column, b: Column) -> Column:
    safe = F.nullif(b, F.lit(0.0))
    return known(a - b * F.floor(a / safe))


_DATE = re.compile(r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(?:\.(\d{1,3}))?)?)?)?)?)?Z?$")


def date_span(text: str) -> tuple[datetime, datetime]:
    """[start, end) covered by a date text at the precision typed."""
    m = _DATE.match(str(text).strip().upper())
    try:
        if not m:
            raise ValueError
        y, mo, d, h, mi, s, frac = m.groups()
        start = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((frac or "0").ljust(3, "0")) * 1000)
        if frac:
            end = start + timedelta(microseconds=10 ** (6 - len(frac)))
        elif s:
            end = start + timedelta(seconds=1)
        elif mi:
            end = start + timedelta(minutes=1)
        elif h:
            end = start + timedelta(hours=1)
        elif d:
            end = start + timedelta(days=1)
        elif mo:
            end = start.replace(year=start.year + start.month // 12, month=start.month % 12 + 1)
        else:
            end = start.replace(year=start.year + 1)
    except (ValueError, OverflowError):
        raise ValueError(f"invalid date: {text!r} (use e.g. '2026-05-01' or '2026-05-01 22:30')") from None
    return start, end


def _ntz(t: datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
