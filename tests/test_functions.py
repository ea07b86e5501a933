import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wellspring.functions import intmath as im
from wellspring.functions.interval import Box, Interval, bounds, box, choose, min_extent, point, span

small = st.integers(-50, 50)
intervals = st.builds(lambda a, n: Interval(a, a + n), small, st.integers(0, 20))


@given(st.integers(-(10**9), 10**9), st.integers(-100, 100))
def test_euclidean_laws(a, b):
    q, r = im.py_euclid_div(a, b), im.py_euclid_mod(a, b)
    if b:
        assert a == q * b + r and 0 <= r < abs(b)
    else:
        assert q == r == 0


def test_columns_agree_with_integers(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-99, 99), rng.choice([-7, -2, -1, 0, 1, 3, 8])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", im.euclid_div(a, b).alias("q"), im.euclid_mod(a, b).alias("r"), im.clamp(a, 5, -5).alias("c"), im.round_div(a, b).alias("ro"), im.align_up(a, 4).alias("up"), im.positive_div(a, 3).alias("pd")).collect()
    for r in got:
        assert (r.q, r.r) == (im.py_euclid_div(r.a, r.b), im.py_euclid_mod(r.a, r.b))
        assert r.c == 5 and r.ro == im.py_round_div(r.a, r.b) and r.up == im.py_align_up(r.a, 4) and r.pd == r.a // 3


def test_saturation_and_overflow(spark):
    df = spark.createDataFrame([(im.HIGH, 1), (im.LOW, -1), (im.HIGH, im.LOW), (5, 7)], "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = df.select(im.sat_add(a, b).alias("s"), im.sat_sub(a, b).alias("d"), im.sat_mul(a, b).alias("m"), im.sat_div(a, b).alias("q"), im.checked("add", a, b).alias("c")).collect()
    for (x, y), r in zip([(im.HIGH, 1), (im.LOW, -1), (im.HIGH, im.LOW), (5, 7)], got):
        assert (r.s, r.d, r.m, r.q) == tuple(map(im.py_saturate, (x + y, x - y, x * y, im.py_euclid_div(x, y))))
        assert r.c == (x + y if im.LOW <= x + y <= im.HIGH else 0)


@given(intervals, intervals, st.integers(-5, 5), st.integers(1, 6))
def test_interval_algebra_is_sound(a, b, k, n):
    for x in range(a.min, a.max + 1):
        assert (a | b).contains(x) and (a * k).contains(x * k) and (-a).contains(-x) and (a + k).contains(x + k)
        assert a.align(n).contains(x) and a.floordiv(n).contains(x // n)
        assert (a & b).contains(x) == b.contains(x)
    assert a.align(n).min % n == 0 and (a.align(n).max + 1) % n == 0


def test_open_and_empty_intervals():
    assert (Interval(None, 3) | Interval(5, 9)) == Interval(None, 9)
    assert (Interval(None, 3) & Interval(1, None)) == Interval(1, 3)
    assert Interval(0, -1).empty and (Interval(0, -1) | Interval(2, 3)) == Interval(2, 3) and Interval(0, -1).extent == 0
    assert span(0, 5) == bounds(0, 4) == min_extent(0, 5) and point(3).is_point and choose(False, point(1), point(2)) == point(2)
    assert (Interval(0, 4).begin, Interval(0, 4).end) == (0, 5)
    with pytest.raises(ValueError):
        _ = Interval(None, 3).extent


def test_boxes():
    a, b = box(x=(0, 9), y=(0, 4)), box(x=(3, 12), y=(1, 2))
    assert (a | b) == box(x=(0, 12), y=(0, 4)) and (a & b) == box(x=(3, 9), y=(1, 2)) and a.volume == 50
    assert a.contains(a & b) and not a.contains(b) and a.contains(Box(x=Interval(50, 40), y=Interval(0, 0)))


@given(st.integers(0, 12), small, st.integers(0, 12), small, st.integers(-30, 30))
def test_alignment_lattice(m, r, n, s, k):
    a, b = im.Alignment(m, r), im.Alignment(n, s)
    x, y = m * k + r, n * (k + 1) + s
    assert x in a and y in b and x + y in a + b and x - y in a - b and x * y in a * b and x in a | b and y in a | b


def test_small_helpers():
    assert (im.gcd(12, 18), im.lcm(4, 6), im.is_power_of_two(8), im.is_power_of_two(6), im.sign(-3)) == (6, 12, True, False, -1)
    assert im.staircase_range((0, 4, 4), (0, 1, -1)) == (-3, 0) and im.staircase_range((0, 4, 3)) == (None, None) == im.staircase_range((0, 2000, 2000), (0, 1, -1))
    assert im.staircase_range() == im.staircase_range((3, 0, 5), (1, 7, 0)) == (0, 0)


stairs = st.tuples(small, st.integers(-9, 9).filter(bool), st.integers(-6, 6))


@given(stairs, stairs, st.integers(-3, 3), st.integers(-3000, 3000))
def test_staircases_stay_in_their_range(p, q, k, x):
    both = [p, q, (0, 1, k)]
    low, high = im.staircase_range(*both)
    if low is not None:
        assert low <= sum(im.py_euclid_div(x + a, b) * c for a, b, c in both) <= high


@given(intervals, intervals, st.tuples(*[st.booleans()] * 4))
def test_products_and_quotients_of_intervals(a, b, opened):
    wide = [Interval(None if lo else i.min, None if hi else i.max) for i, lo, hi in ((a, *opened[:2]), (b, *opened[2:]))]
    product, quotient = wide[0] * wide[1], wide[0].floordiv(wide[1])
    for x in (a.min, (a.min + a.max) // 2, a.max, *([a.min - 70] if opened[0] else []), *([a.max + 70] if opened[1] else [])):
        for y in (b.min, -1, 0, 1, b.max, *([b.min - 70] if opened[2] else []), *([b.max + 70] if opened[3] else [])):
            if wide[1].contains(y):
                assert product.contains(x * y) and quotient.contains(im.py_euclid_div(x, y))
    if not any(opened):
        members = [x * y for x in range(a.min, a.max + 1) for y in (b.min, b.max)]
        assert (product.min, product.max) == (min(members), max(members))


@given(intervals)
def test_signs(a):
    own = range(a.min, a.max + 1)
    assert (a.is_positive, a.is_non_negative, a.is_negative, a.is_non_positive, a.is_zero) == (min(own) > 0, min(own) >= 0, max(own) < 0, max(own) <= 0, set(own) == {0})
    assert not Interval(None, None).is_non_negative and Interval(1, None).is_positive and not Interval(0, -1).is_positive


@given(st.integers(0, 12), small, st.integers(0, 12), small, st.integers(-30, 30), st.integers(-9, 9))
def test_lattice_quotients_and_meets(m, r, n, s, k, by):
    a, b = im.Alignment(m, r), im.Alignment(n, s)
    x = m * k + r
    assert im.py_euclid_div(x, by) in a // by
    meet = a & b
    for y in range(-200, 200):
        assert (y in a and y in b) == (meet is not None and y in meet)
