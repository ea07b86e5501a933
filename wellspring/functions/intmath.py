"""Integer arithmetic of index expressions, as Columns and, under the same names with ``py_``, on Python integers.

Division is Euclidean: the remainder lies in [0, abs(b)), and dividing by zero gives 0.  Kernels over values use
truncating division instead (``trunc_div``).  Spark's own ``div`` truncates, ``pmod`` may be negative for a negative
divisor and both raise on zero in ANSI mode, so each is guarded here.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def euclid_mod(a, b) -> Column:
    """Without abs(b) or a sum that could leave 64 bits."""
    a, b = _col(a), _col(b)
    r = a % b
    return F.when(b == 0, F.lit(0).cast("long")).when(r >= 0, r).when(b < 0, r - b).otherwise(r + b)


def euclid_div(a, b) -> Column:
    a, b = _col(a), _col(b)
    q = _div(a, b)
    return F.when(b == 0, F.lit(0).cast("long")).when(a % b >= 0, q).when(b < 0, q + 1).otherwise(q - 1)


def positive_mod(a, n: int) -> Column:
    """For a divisor known to be positive."""
    return F.pmod(_col(a), F.lit(n).cast("long"))


def positive_div(a, n: int) -> Column:
    return _div(_col(a) - positive_mod(a, n), F.lit(n).cast("long"))


def trunc_div(a, n: int) -> Column:
    return _div(_col(a), F.lit(n).cast("long"))


def floor_div(a, b) -> Column:
    """Euclidean and floor division agree for the positive divisors that layouts use."""
    return euclid_div(a, b)


def ceil_div(a, b) -> Column:
    a, b = _col(a), _col(b)
    return euclid_div(a + b - 1, b)


def round_div(a, b) -> Column:
    a, b = _col(a), _col(b)
    return euclid_div(a + euclid_div(b, 2), b)


def align_down(a, n) -> Column:
    return euclid_div(a, n) * _col(n)


def align_up(a, n) -> Column:
    return ceil_div(a, n) * _col(n)


def clamp(x, low=None, high=None) -> Column:
    """The lower bound wins where the bounds cross."""
    x = _col(x)
    if high is not None:
        x = F.least(x, _col(high))
    return x if low is None else F.greatest(_col(low), x)


def truth(p: Column) -> Column:
    """A condition as 0 or 1."""
    return F.when(p, F.lit(1)).otherwise(F.lit(0)).cast("long")


def boolean(x) -> Column:
    return truth(_col(x) != 0)


def negate(x) -> Column:
    return truth(_col(x) == 0)


def select(c, t, f) -> Column:
    return F.when(_col(c) != 0, _col(t)).otherwise(_col(f))


def and_then(*xs) -> Column:
    """Left to right; what stands behind a false one is not evaluated."""
    out = F.lit(1).cast("long")
    for x in reversed(xs):
        out = F.when(_col(x) != 0, out).otherwise(F.lit(0).cast("long"))
    return out


def or_else(*xs) -> Column:
    out = F.lit(0).cast("long")
    for x in reversed(xs):
        out = F.when(_col(x) != 0, F.lit(1).cast("long")).otherwise(out)
    return out


def sat_add(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.coalesce(F.try_add(a, b), F.when(a < 0, F.lit(LOW)).otherwise(F.lit(HIGH)))


def sat_sub(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.coalesce(F.try_subtract(a, b), F.when(a < 0, F.lit(LOW)).otherwise(F.lit(HIGH)))


def sat_mul(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.coalesce(F.try_multiply(a, b), F.when((a < 0) != (b < 0), F.lit(LOW)).otherwise(F.lit(HIGH)))


def sat_div(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.when((a == LOW) & (b == -1), F.lit(HIGH)).otherwise(euclid_div(a, b))


def overflows(op: str, a, b) -> Column:
    """Does add, sub or mul leave 64 bits?"""
    return {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](_col(a), _col(b)).isNull()


def checked(op: str, a, b) -> Column:
    """The result, or 0 where it overflows."""
    return F.coalesce({"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply}[op](_col(a), _col(b)), F.lit(0).cast("long"))


def wrap(x: Column, bits: int, signed: bool = True) -> Column:
    """A value stored in so many bits."""
    low = F.pmod(x.cast("decimal(38,0)"), F.lit(1 << bits).cast("decimal(38,0)")).cast("long") if bits < 63 else x
    return F.when(low >= (1 << (bits - 1)), low - (1 << bits)).otherwise(low) if signed and bits < 63 else low


# -- the same on Python integers ------------------------------------------------------------------------------------
def py_euclid_mod(a: int, b: int) -> int:
    return a % abs(b) if b else 0


def py_euclid_div(a: int, b: int) -> int:
    return (a - py_euclid_mod(a, b)) // b if b else 0


def py_ceil_div(a: int, b: int) -> int:
    return py_euclid_div(a + b - 1, b)


def py_round_div(a: int, b: int) -> int:
    return py_euclid_div(a + py_euclid_div(b, 2), b)


def py_align_down(a: int, n: int) -> int:
    return py_euclid_div(a, n) * n


def py_align_up(a: int, n: int) -> int:
    return py_ceil_div(a, n) * n


def py_saturate(x: int) -> int:
    return max(LOW, min(HIGH, x))


def gcd(a: int, b: int) -> int:
    return math.gcd(a, b)


def lcm(a: int, b: int) -> int:
    return math.lcm(a, b)


def is_power_of_two(x: int) -> bool:
    return x > 0 and x & (x - 1) == 0


def sign(x: int) -> int:
    return (x > 0) - (x < 0)


def staircase_range(*stairs: tuple[int, int, int], largest_period: int = 1024) -> tuple[int | None, int | None]:
    """Least and greatest, over all x, of the sum of staircases ((x + a) div b) * c, each given as (a, b, c).

    A sum is bounded exactly where the slopes c / b add up to nothing; it then repeats with the least common multiple of
    the widths, over which it is searched.  Both ends are None where it is unbounded, or a width beyond largest_period.
    A staircase of width 0 is 0.
    """
    stairs = [s for s in stairs if s[1] and s[2]]
    if sum((Fraction(c, b) for _, b, c in stairs), Fraction(0)) or any(abs(b) > largest_period for _, b, _ in stairs):
        return None, None
    period = math.lcm(*[b for _, b, _ in stairs]) if stairs else 1
    seen = [sum(py_euclid_div(x + a, b) * c for a, b, c in stairs) for x in range(period)]
    return min(seen), max(seen)


class Alignment:
    """The integers m * k + r, for all k; m = 0 is the single number r."""

    def __init__(self, m: int, r: int = 0):
        self.m, self.r = abs(m), r % abs(m) if m else r

    def __eq__(self, other) -> bool:
        return (self.m, self.r) == (other.m, other.r)

    def __repr__(self) -> str:
        return f"Alignment({self.m}, {self.r})"

    def __add__(self, o: Alignment) -> Alignment:
        return Alignment(math.gcd(self.m, o.m), self.r + o.r)

    def __sub__(self, o: Alignment) -> Alignment:
        return Alignment(math.gcd(self.m, o.m), self.r - o.r)

    def __mul__(self, o: Alignment) -> Alignment:
        return Alignment(math.gcd(self.m * o.m, self.m * o.r, self.r * o.m), self.r * o.r)

    def __or__(self, o: Alignment) -> Alignment:
        """Holds for either."""
        return Alignment(math.gcd(self.m, o.m, self.r - o.r), self.r)

    def __floordiv__(self, n: int) -> Alignment:
        """Quotients by n whose remainder is not negative; by zero they are zero."""
        if n == 0:
            return Alignment(0, 0)
        if self.m % n == 0:
            return Alignment(self.m // n, py_euclid_div(self.r, n))
        return Alignment(1)

    def __and__(self, o: Alignment) -> Alignment | None:
        """Holds for both; None if nothing does."""
        if not self.m or not o.m:
            one, other = (self, o) if not self.m else (o, self)
            return one if one.r in other else None
        g = math.gcd(self.m, o.m)
        if (o.r - self.r) % g:
            return None
        step = (o.r - self.r) // g * pow(self.m // g, -1, o.m // g) % (o.m // g) if o.m > g else 0
        return Alignment(math.lcm(self.m, o.m), self.r + self.m * step)

    def __mod__(self, n: int) -> Alignment:
        return Alignment(0, self.r % abs(n)) if n and self.m % n == 0 else Alignment(math.gcd(self.m, n), self.r)

    def __contains__(self, x: int) -> bool:
        return x == self.r if not self.m else (x - self.r) % self.m == 0
