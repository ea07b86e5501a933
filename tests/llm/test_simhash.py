import re

import numpy as np
import xxhash

from wellspring.llm import simhash as sh
from wellspring.llm.components import connected_components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(n) and rows[m][0] is not None]
        out.append((i, f"{prints[n]:016x}", min(ids, default=None)))
    return out


def test_as_brute_force(spark, make, real):
    docs, _ = real
    rows = [(d.doc_id, d.text) for d in docs] + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two three"), (None, "nobody else has this"), (906, "É é\u00a0x y"), (907, "a b c d " * 20_000), (5, docs[0].text), (5, docs[0].text)]
    got = sh.classify(spark, make(rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_links_at_every_distance(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 30)]
    prints = set(base)
    for i, b in enumerate(base):
        for n in (1, 2, 3):
            x = b & (1 << 64) - 1
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            prints.add(x - (1 << 64) if x >> 63 else x)
    frame = spark.createDataFrame([(p,) for p in prints], "f long")
    root = {r.node: r.root for r in connected_components(spark, sh.links(frame)).collect()}
    many = sorted(prints)
    own = {p: p for p in many}

    def find(p):
        while own[p] != p:
            p = own[p]
        return p

    for i, a in enumerate(many):
        for b in many[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                own[y] = x
    assert {p: root.get(p, p) for p in many} == {p: find(p) for p in many}


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (301, 302), (302, 301)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)} | {200 + i: 200 for i in range(1, 9)} | {302: 301}
    assert {n: r for n, r in got.items() if n != r} == want
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_component_stays(spark, make):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (1, "A b c d e f g"), (2, "quite another text stands here"), (None, "a b c d e f g"), (8, None), (9, "")]
    docs = make(rows)
    out = sh.keep_one(spark, docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 8]
    assert sh.keep_one(spark, make([])).count() == 0 and sh.classify(spark, make([])).count() == 0
