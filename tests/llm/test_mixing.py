import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from wellspring.llm import mixing as mx


def test_targets_share_and_stop():
    assert mx.targets([60, 60, 60], [1.0, 2.0, 3.0]) == [30.0, 60.0, 90.0]
    got = mx.targets([100, 1, 100], [1.0, 2.0, 3.0])
    assert got[1] == 3.0 and abs(sum(got) - 201) < 1e-9 and abs(got[2] / got[0] - 3) < 1e-9
    assert mx.targets([], []) == [] and mx.targets([0, 5], [1.0, 2.0]) == [0.0, 5.0]


def test_subset_sum_is_exact():
    rng = random.Random(3)
    for _ in range(200):
        lengths = rng.sample(range(1, 12), rng.randint(1, 4))
        counts = [rng.randint(0, 4) for _ in lengths]
        budget = rng.randint(0, 40)
        got = mx.subset_sum(lengths, counts, budget)
        assert all(0 <= g <= c for g, c in zip(got, counts))
        best = max(s for t in itertools.product(*[range(c + 1) for c in counts]) if (s := sum(n * k for n, k in zip(lengths, t))) <= budget)
        assert sum(n * k for n, k in zip(lengths, got)) == best


def shares(sizes):
    """Of sources in their order, by bisection: the level at which what all take, at most three times their size, is all."""
    weights = [float(i % 3 + 1) for i in range(len(sizes))]
    lo, hi = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(3 * n, mid * w) for n, w in zip(sizes, weights)) < sum(sizes):
            lo = mid
        else:
            hi = mid
    return [min(3.0 * n, hi * w) for n, w in zip(sizes, weights)]


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += size(t)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, shares([totals[s] for s in names])))
    assert sum(r["size"] for r in got) == sum(totals.values()) and len(got) == len(rows)
    taken = Counter()
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r.taken <= 3 * r["size"] and r.source_size == totals[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-6 * (1 + r.target)
        taken[source[r.doc_id]] += r.taken
    return {s: (abs(taken[s] - want[s]), want[s]) for s in names}


def test_sources_come_near_their_targets(spark, make, real):
    docs, _ = real
    rows = [(d.doc_id, d.text, d.source) for d in docs] + [(10_000, None, None), (10_001, "a b c", None), (10_002, "", "src1"), (10_003, "w " * 30_000, "src2")]
    one, two = (mx.mix(spark, make(rows)).collect() for _ in range(2))
    off = check(rows, one)
    far = sorted(a / w for a, w in off.values() if w > 3)
    assert far[-1] < 0.05 and far[len(far) // 2] < 0.003, far  # sources of ten documents
    assert sorted((r.doc_id, r.taken) for r in one) == sorted((r.doc_id, r.taken) for r in two)


def test_a_hot_length_is_taken_exactly(spark, make):
    rows = [(i, "a b c d e f g", "x" if i % 3 else "y") for i in range(3000)]
    assert all(a < 7 for a, _ in check(rows, mx.mix(spark, make(rows)).collect()).values())


def test_documents_repeat_as_taken(spark, make):
    rows = [(1, "a b", "p"), (2, "c d e f g h i j k l", "q"), (3, "m n", "r"), (3, "m n", "r"), (None, None, None)]
    docs = make(rows)
    plan = mx.mix(spark, docs).collect()
    out = mx.mix_documents(spark, docs)
    assert out.columns == docs.columns
    assert sum(len(r.text.split()) for r in out.collect()) == sum(r.taken for r in plan)
    assert mx.mix(spark, make([])).count() == 0 and mx.mix_documents(spark, make([])).count() == 0


def test_rows_that_differ_in_source_alone(spark, make):
    rows = [(1, "a b c d", "p"), (1, "a b c d", "q"), (2, "e f " * 40, "r"), (2, "e f " * 40, None), (3, "g", "+"), (3, "g", "-"), (3, "g", "p")]
    got = []
    for some in (rows, rows[::-1]):
        plan = {(r.doc_id, r.s): r.taken for r in mx.mix(spark, make(some)).collect()}
        taken = Counter()
        for r in mx.mix_documents(spark, make(some)).collect():
            taken[r.doc_id, "-" if r.source is None else "+" + r.source] += len(r.text.split())
        assert taken == +Counter(plan)
        got.append(taken)
    assert got[0] == got[1] and len(plan) == len(rows)


def test_many_sources_settle_as_the_list_form(spark, make):
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 4000 if i % 97 == 0 else 7]), rng.choice([f"s{rng.randint(0, 60)}é", "", "\U0010ffff", "Z", None])) for i in range(900)]
    got = {r.s: (r.source_size, r.target) for r in mx.mix(spark, make(rows)).collect()}
    names = sorted(got)
    want = mx.targets([got[s][0] for s in names], [float(i % 3 + 1) for i in range(len(names))])
    assert names[-1] == "-" and all(abs(got[s][1] - w) < 1e-6 * (1 + w) for s, w in zip(names, want))


def test_repeated_rows_share_what_is_taken(spark, make):
    rows = [(5, "x y z", "p")] * 7 + [(6, "w " * 20, "q"), (None, "", "q")]
    plan = mx.mix(spark, make(rows)).collect()
    out = mx.mix_documents(spark, make(rows)).collect()
    assert len([r for r in out if r.doc_id == 5]) == sum(r.times for r in plan if r.doc_id == 5)


@pytest.mark.parametrize("target", [0, 1, 999, 5000, 123_456])
def test_plans_hit_the_target(target):
    import numpy as np

    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 900, 120))
    counts = rng.integers(1, 6, len(lengths))
    whole, extra = mx.plan(lengths, counts, float(target))
    assert (extra <= counts).all() and abs(whole * (lengths * counts).sum() + (extra * lengths).sum() - target) <= lengths.min()


@pytest.mark.parametrize("lengths,counts,target,want", [([100_000], [1], 90_000, 100_000), ([3000, 4000], [1, 1], 6000, 7000), ([1, 5000], [1, 1], 3500, 5000), ([40_000, 70_000], [2, 1], 70_000, 70_000)])
def test_few_long_documents_give_the_nearest_sum(lengths, counts, target, want):
    import numpy as np

    _, extra = mx.plan(np.array(lengths), np.array(counts), float(target))
    assert (extra * np.array(lengths)).sum() == want


def test_plans_are_nearest():
    import numpy as np

    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60_000), rng.randint(1, 4)))
        counts = [rng.randint(1, 2) for _ in lengths]
        sums = {sum(n * k for n, k in zip(lengths, t)) for t in itertools.product(*[range(c + 1) for c in counts])}
        target = rng.randint(0, max(sums) - 1)
        whole, extra = mx.plan(np.array(lengths), np.array(counts), float(target))
        assert whole == 0 and abs(int((extra * np.array(lengths)).sum()) - target) == min(abs(s - target) for s in sums)
