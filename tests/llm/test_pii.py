import hashlib
import random
import re

from wellspring.llm import pii

KINDS = ("email", "ip", "card", "phone")


def naive(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum((lambda v: v - 9 if v > 9 else v)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans(real):
    rng = random.Random(6)
    texts = [d.text for d in real[0]] + ["".join(rng.choice("01259.@+- ()a-Z%_é") for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    texts += ["", "a@b.c@d.e", "@x.y", "a@b", "..@a.b.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.004", "4539 1488 0343 6467", "+1 (415) 555-0100 x", "1" * 60_000, "a" * 60_000 + "@", "+" * 30_000]
    for t in texts:
        assert pii.base_spans(t) == naive(t), t[:80]


def documents():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, f"{text(20)} api key: {rng.randbytes(20).hex()} {text(10)}") for i in range(40)]
    rows += [(100 + i, f"{text(15)} of the {rng.randint(10**8, 10**9)} {text(5)} of the house") for i in range(40)]
    rows += [(200, f"{text(9)} API key: AB-9981-XY77 {text(4)}"), (201, f"{text(9)} see version 2.0.1-build7 {text(4)}"), (202, "mail me at a.b@example.com or +1 415 555 0100")]
    return rows


def test_patterns_discover_unseen_identifiers(spark, make):
    rows = documents()
    docs = make([*rows, (None, None), (300, ""), (200, rows[-3][1])])
    assert pii.train(spark, docs) == {"api key:"}
    got = pii.find_in_documents(spark, docs).collect()
    assert len(got) == len(rows) + 3
    text = dict(rows)
    for r in got:
        base = naive(text.get(r.doc_id) or "")
        joined = [f"{KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for _, k, _ in base) for n in range(4))
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("id:")] == joined and r.n_added == len(spans) - len(joined)
        found = [text[r.doc_id][int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans if s.startswith("id:")]
        assert found == (["AB-9981-XY77"] if r.doc_id == 200 else re.findall("[0-9a-f]{40}", text.get(r.doc_id) or ""))


def test_few_or_no_documents(spark, make):
    assert pii.train(spark, make([])) == frozenset() and pii.find_in_documents(spark, make([])).count() == 0
    r = pii.find_in_documents(spark, make([(1, None)])).first()
    assert (r.n_email, r.spans, r.base_sha256) == (0, "", hashlib.sha256(b"").hexdigest())


def test_no_pattern_is_cut_by_its_rank(spark, make):
    """1,100 frequent pairs of low confidence come before a rare one of high confidence."""
    rng = random.Random(4)
    key = lambda: rng.randbytes(16).hex()
    rows = [(i, " ".join(f"of w{i} {key()} and." for _ in range(6)) + f" of w{i} here" * 6) for i in range(1100)]
    rows += [(5000 + i, f"some words secret token: {key()} and more") for i in range(5)] + [(6000, "my secret token: ZX-4471-QQ90 was here")]
    docs = make(rows)
    assert pii.train(spark, docs) == {"secret token:"}
    got = {r.doc_id: r for r in pii.find_in_documents(spark, docs).where("n_added > 0").collect()}
    assert set(got) == {5000 + i for i in range(5)} | {6000} and got[6000].spans == "id:17:29"


def chained():
    """Keys induce one pattern, what it finds induces another, and only that one finds the last identifier."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 90)))
    badges = [f"AB-{1000 + i}-XY{i}" for i in range(8)]
    rows = [f"{word()} {word()} secret token: {rng.randbytes(18).hex()} {word()}" for _ in range(60)]
    rows += [f"{word()} secret token: {b} {word()}" for b in badges]
    rows += [f"{word()} staff badge no. {b} {word()}" for b in badges for _ in range(5)]
    rows += [f"{word()} staff badge no. ZQ-77-0815 {word()}", f"in the year {rng.randint(100000, 999999)} of the", "this year 123456 of that " * 9]
    return list(enumerate(rows))


def naive_patterns(rows):
    """Confident patterns, by loops over all texts."""
    words, seen, count, seeds = {}, {}, {}, set()
    for _, text in rows:
        own = naive(text)
        for m in re.finditer(r"\S+", text):
            bare = m[0].strip(pii._EDGES)
            s = m.start() + m[0].index(bare) if bare else 0
            before = re.sub(f"[{re.escape(pii._JUNK)}]", "", text[:s].lower()).replace('"', " ").split()
            if len(bare) < pii.MIN_LENGTH or not re.search("[0-9]", bare) or len(before) < 2:
                continue
            p, x = " ".join(before[-2:]), bare.lower()
            if any(a == s for a, _, _ in own) or pii._HEX.fullmatch(bare):
                seeds.add(x)
            seen.setdefault(p, {}).setdefault(x, 0)
            seen[p][x] += 1
        flat = re.sub(f"[{re.escape(pii._JUNK)}]", "", text.lower()).replace('"', " ").split()
        for a, b in zip(flat, flat[1:-1]):
            count[f"{a} {b}"] = count.get(f"{a} {b}", 0) + 1
    good = {x: 1.0 for x in seeds}
    for _ in range(20):
        words = {p: sum(good.get(x, 0.0) * n for x, n in own.items()) / max(count.get(p, 0), sum(own.values())) for p, own in seen.items() if sum(good.get(x, 0.0) >= pii.CONFIDENCE for x in own) >= pii.MIN_SEEDS}
        good = {x: max([float(x in seeds), *[s for p, s in words.items() if x in seen[p]]]) for own in seen.values() for x in own}
    return {p for p, s in words.items() if s >= pii.CONFIDENCE}


def test_found_instances_induce_new_patterns(spark, make):
    rows = chained()
    docs = make(rows)
    want = naive_patterns(rows)
    assert want == {"secret token:", "badge no."} and pii.train(spark, docs) == want
    got = {r.doc_id: r for r in pii.find_in_documents(spark, docs).collect()}
    last = [i for i, t in rows if "ZQ-77-0815" in t][0]
    assert got[last].n_added == 1 and not any(pii._HEX.fullmatch(x) for x in ("ZQ-77-0815", "AB-1000-XY0"))
    assert all(got[i].n_added == 0 for i, t in rows if "year" in t)


def test_scores_as_brute_force(spark, make):
    rng = random.Random(13)
    ids = [f"{rng.choice('ABC')}{rng.randint(10000, 10030)}" for _ in range(40)]
    key = [rng.randbytes(16).hex() for _ in range(12)]
    rows = [(i, " ".join(f"{rng.choice('pqrs')} {rng.choice('uvw')} {rng.choice(key if rng.random() < 0.75 else [*ids, 'none'])}" for _ in range(6)) + " end") for i in range(60)]
    rows += [(100 + i, f"k{i % 3} m {rng.choice(key)} x k{i % 3} m {rng.choice(ids)} y") for i in range(120)]
    assert pii.train(spark, make(rows)) == naive_patterns(rows)
