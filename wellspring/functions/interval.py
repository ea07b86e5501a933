"""Intervals and boxes with inclusive bounds: the algebra that plans a pipeline backwards from its output.

A missing end is unbounded.  Empty means the maximum lies below the minimum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intmath import py_align_down, py_align_up, py_euclid_div


@dataclass(frozen=True)
class Interval:
    min: int | None = None
    max: int | None = None

    @property
    def extent(self) -> int:
        if self.min is None or self.max is None:
            raise ValueError("unbounded")
        return max(0, self.max - self.min + 1)

    @property
    def begin(self) -> int | None:
        return self.min

    @property
    def end(self) -> int | None:
        return None if self.max is None else self.max + 1

    @property
    def empty(self) -> bool:
        return self.min is not None and self.max is not None and self.max < self.min

    @property
    def bounded(self) -> bool:
        return self.min is not None and self.max is not None

    @property
    def is_point(self) -> bool:
        return self.bounded and self.min == self.max

    def __or__(self, o: Interval) -> Interval:
        """Hull; an open end stays open."""
        if self.empty:
            return o
        if o.empty:
            return self
        return Interval(None if self.min is None or o.min is None else min(self.min, o.min), None if self.max is None or o.max is None else max(self.max, o.max))

    def __and__(self, o: Interval) -> Interval:
        lows, highs = [x.min for x in (self, o) if x.min is not None], [x.max for x in (self, o) if x.max is not None]
        return Interval(max(lows, default=None), min(highs, default=None))

    def __add__(self, o: int | Interval) -> Interval:
        o = o if isinstance(o, Interval) else point(o)
        return Interval(*[None if a is None or b is None else a + b for a, b in ((self.min, o.min), (self.max, o.max))])

    def __neg__(self) -> Interval:
        return Interval(None if self.max is None else -self.max, None if self.min is None else -self.min)

    def __sub__(self, o: int | Interval) -> Interval:
        return self + (-o)

    def __mul__(self, k: int | Interval) -> Interval:
        """Products of the members; with an interval of unknown sign, their hull."""
        if isinstance(k, Interval):
            if self.empty or k.empty:
                return EMPTY
            return _hull([_times(a, b) for a in self._ends() for b in k._ends()])
        if k < 0:
            return -(self * -k)
        return point(0) if k == 0 else Interval(*[None if a is None else a * k for a in (self.min, self.max)])

    def floordiv(self, k: int | Interval) -> Interval:
        """Quotients of the members, rounded so that the remainder is not negative; by zero the quotient is zero."""
        if not isinstance(k, Interval):
            if k > 0:
                return Interval(*[None if a is None else a // k for a in (self.min, self.max)])
            k = point(k)
        if self.empty or k.empty:
            return EMPTY
        out = point(0) if k.contains(0) else EMPTY
        for part in (k & Interval(1, None), k & Interval(None, -1)):
            if not part.empty:  # of one sign, where the quotient is monotone in either number
                out = out | _hull([_over(a, b) for a in self._ends() for b in part._ends()])
        return out

    def _ends(self) -> tuple[float | int, float | int]:
        return -INFINITE if self.min is None else self.min, INFINITE if self.max is None else self.max

    # What is known of the sign of all members; nothing is known of an empty interval's.
    @property
    def is_positive(self) -> bool:
        return self.min is not None and self.min > 0 and not self.empty

    @property
    def is_non_negative(self) -> bool:
        return self.min is not None and self.min >= 0 and not self.empty

    @property
    def is_negative(self) -> bool:
        return self.max is not None and self.max < 0 and not self.empty

    @property
    def is_non_positive(self) -> bool:
        return self.max is not None and self.max <= 0 and not self.empty

    @property
    def is_zero(self) -> bool:
        return self == point(0)

    def align(self, n: int) -> Interval:
        """The least hull whose ends fall on multiples of n."""
        return Interval(None if self.min is None else py_align_down(self.min, n), None if self.max is None else py_align_up(self.max + 1, n) - 1)

    def contains(self, x: int | Interval) -> bool:
        x = x if isinstance(x, Interval) else point(x)
        if x.empty:
            return True
        return (self.min is None or (x.min is not None and x.min >= self.min)) and (self.max is None or (x.max is not None and x.max <= self.max))

    def holds(self, c: Column) -> Column:
        """The predicate that a filter pushes to the scan."""
        if self.bounded:
            return c.between(self.min, self.max)
        if self.min is None and self.max is None:
            return F.lit(True)
        return c <= self.max if self.min is None else c >= self.min


INFINITE = float("inf")
EMPTY = Interval(0, -1)
EVERYTHING = Interval()


def _times(a, b):
    return 0 if a == 0 or b == 0 else a * b


def _over(a, b):
    """Of an end that may be infinite, by one that is not zero."""
    if abs(b) == INFINITE:
        if abs(a) == INFINITE:
            return 0  # any quotient between the other ends' and this
        return 0 if a >= 0 else (-1 if b > 0 else 1)
    return a * b if abs(a) == INFINITE else py_euclid_div(a, b)


def _hull(ends: list) -> Interval:
    return Interval(None if min(ends) == -INFINITE else min(ends), None if max(ends) == INFINITE else max(ends))


def point(x: int) -> Interval:
    return Interval(x, x)


def bounds(a: int, b: int) -> Interval:
    """[a, b]."""
    return Interval(a, b)


def span(begin: int, end: int) -> Interval:
    """[begin, end)."""
    return Interval(begin, end - 1)


def min_extent(a: int, n: int) -> Interval:
    return Interval(a, a + n - 1)


def choose(c: bool, a: Interval, b: Interval) -> Interval:
    return a if c else b


class Box(dict[str, Interval]):
    """An interval for each dimension, in the order of the dimensions."""

    def __or__(self, o: Box) -> Box:
        return Box({d: self[d] | o[d] for d in self})

    def __and__(self, o: Box) -> Box:
        return Box({d: self[d] & o[d] if d in o else self[d] for d in self})

    def contains(self, o: Box) -> bool:
        return any(i.empty for i in o.values()) or all(self[d].contains(o[d]) for d in o if d in self)

    @property
    def volume(self) -> int:
        n = 1
        for i in self.values():
            n *= i.extent
        return n

    @property
    def empty(self) -> bool:
        return any(i.empty for i in self.values())

    def holds(self) -> Column:
        out = F.lit(True)
        for d, i in self.items():
            if i.min is not None or i.max is not None:
                out = out & i.holds(F.col(d))
        return out

    def with_(self, **dims: Interval) -> Box:
        return Box({**self, **dims})

    def without(self, *dims: str) -> Box:
        return Box({d: i for d, i in self.items() if d not in dims})

    def check(self) -> Box:
        for d, i in self.items():
            if i.bounded and not -(1 << 62) < i.min <= i.max + 1 < 1 << 62:
                raise ValueError(f"bad bounds of {d}: {i}")
        return self


def box(**dims: tuple[int, int]) -> Box:
    return Box({d: Interval(*i) for d, i in dims.items()})
