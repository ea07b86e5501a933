import math

import numpy as np
import pytest

from wellspring.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, ids int")


def brute(rows, top=20, every=20):
    seen = {}
    for i, e, *_ in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e) and any(e):
            seen.setdefault(i, np.array(e, np.float32).astype(float))
    ids = sorted(seen)
    x = np.array([seen[i] for i in ids])
    out = {}
    for q in (i for i in ids if i % every == 0):
        s = (x * seen[q]).sum(1)
        out[q] = [(-a, b) for a, b in sorted((-float(v), i) for v, i in zip(s, ids) if i != q)[:top]]
    return out


def result(spark, rows, **k):
    got = {}
    for r in sorted(ann.search(spark, frame(spark, rows), **k).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if scaled:
        x *= rng.uniform(0.2, 3, (1500, 1))
    rows = [(i, v.tolist(), "", 0) for i, v in enumerate(x)]
    got, want = result(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    for q in got:
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[0], p[1]))


def test_ties_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0, 0.5], "", 0) for i in range(60)] + [(60, [0.0, 1.0, 0.0], "", 0), (61, None, "", 0), (62, [0.0, 0.0, 0.0], "", 0)]
    rows += [(80, [1.0, None, 2.0], "", 0), (100, [float("nan"), 1.0, 1.0], "", 0), (120, [float("inf"), 1.0, 1.0], "", 0), (None, [1.0, 1.0, 1.0], "", 0), (20, [1.0, 0.0, 0.5], "", 0), (63, [1.0, 2.0], "", 0)]
    got, want = result(spark, rows), brute([r for r in rows if r[0] != 63])
    assert got == want and [i for _, i in got[0]] == list(range(1, 21))


def test_few_rows(spark):
    assert result(spark, []) == {}
    assert result(spark, [(0, [1.0, 2.0], "", 0)]) == {}
    rows = [(i, [1.0 + i, 2.0, -1.0 * i], "", 0) for i in range(5)]
    assert result(spark, rows) == brute(rows)


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, (3000, 4)).astype(np.uint16)
    codes[:40] = codes[40] ^ (rng.random((40, 4)) < 0.5).astype(np.uint16)
    index = ann.MultiIndex(codes)
    for q in codes[:60]:
        d = ann.hamming(q[None], codes)[0]
        for radius in (0, 2, 9, 25):
            at, found = index.within(q, radius)
            assert sorted(at) == np.flatnonzero(d <= radius).tolist() and (found == d[at]).all()
        assert len(index.search(q, 0, 30)) >= 30


def clustered(n=3000, dim=48, seed=9):
    """Tight groups far apart, of 25 vectors and more."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 40, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.05 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_clustered_vectors_are_probed(spark, monkeypatch):
    """Probing on keys, with few candidates; queries that find too few go to the blocks."""
    x = clustered()
    rows = [(i, v.tolist(), "", 0) for i, v in enumerate(x)] + [(4000, x[7].tolist(), "", 0), (4001, x[0].tolist(), "", 0)]
    asked, blocks, found = [], [], []
    monkeypatch.setattr(ann, "admitted", lambda r, bits, f=ann.admitted: asked.append(f(r, bits)) or asked[-1])
    real, scan = ann.candidates, ann._blocks
    monkeypatch.setattr(ann, "candidates", lambda q, *a: found.append(real(q, *a)) or found[-1])
    monkeypatch.setattr(ann, "_blocks", lambda s, q, *a: blocks.append(q.count()) or scan(s, q, *a))
    got, want = result(spark, rows), brute(rows)
    assert asked[0] <= ann.ADMITS and got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    assert blocks[0] < len(want) / 2 and found[0].count() < 0.1 * len(want) * len(rows)


def test_candidates_are_all_codes_within_the_radius(spark):
    x = clustered(600, 24, 4)
    codes = ann.learn(x, 1.0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    radius = codes.turns.shape[1] // 8
    got = {tuple(r) for r in ann.candidates(rows.where("vec_id < 30"), rows.withColumnRenamed("vec_id", "rep"), codes, radius, 24).collect()}
    d = ann.hamming(codes.of(x[:30], True), codes.of(x, False))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius))}


def test_probing_and_blocks_agree(spark, monkeypatch):
    x = clustered(800, 16, 3)
    rows = [(i, (v * (1 + i % 3)).tolist(), "", 0) for i, v in enumerate(x)] + [(i, x[5].tolist(), "", 0) for i in range(900, 960)]
    monkeypatch.setattr(ann, "ADMITS", 100.0)
    probed = result(spark, rows)
    monkeypatch.setattr(ann, "ADMITS", -1.0)
    scanned, want = result(spark, rows), brute(rows)
    for got in (probed, scanned):
        assert got.keys() == want.keys() and [len(got[q]) for q in want] == [20] * len(want)
        assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 20 * len(want)
