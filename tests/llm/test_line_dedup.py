import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wellspring.llm import line_dedup as ld
from wellspring.llm.wordstream import LONG, SLICE, Words

BLANK = " \t\n\v\f\r"
ALONE = "฀-࿿က-Ⴟក-៿　-鿿\U00010000-\U0010ffff"


def words(text):
    """By regular expressions, as the rules say."""
    out = []
    for stretch in re.findall(f"[^{BLANK}]+", text or ""):
        for piece in re.findall(f"[{ALONE}]|[^{ALONE}]+", stretch):
            long = len(piece.encode()) > LONG
            out += re.findall(r"(?:[^\x00-\x7f]|[0-9A-Za-z])+|[\x00-\x7f]", piece) if long else [piece]
    return out


def prints(own, min_words):
    """Naive winnowing: positions of the least hash in each window, the leftmost at a tie."""
    line, window = ld.grain(min_words)
    w = Words(pa.array([" ".join(own)])).hash
    n = len(own)
    if n < min_words:
        return {}
    h = {i: int(ld.span_hash(w, np.array([i]), np.array([i + line]))[0]) for i in range(n - line + 1)}
    cut = n.bit_length()
    return {min(range(s, s + window), key=lambda i: (h[i] >> cut, i)) for s in range(n - min_words + 1)}


def brute(texts, min_words=ld.MIN_WORDS, min_line=None):
    """Words to delete of each text: what fingerprints share with their first holder, at most a window around them."""
    line, window = ld.grain(min_words)
    docs = [words(t) for t in texts]
    first, whole, out = {}, {}, []
    for n, own in enumerate(docs):
        gone = set()
        for p in sorted(prints(own, min_words)):
            m, q = first.setdefault(tuple(own[p : p + line]), (n, p))
            if (m, q) == (n, p):
                continue
            a = b = 0
            while a < window - 1 and min(p, q) - a > 0 and own[p - a - 1] == docs[m][q - a - 1]:
                a += 1
            while b < window - 1 and p + line + b < len(own) and q + line + b < len(docs[m]) and own[p + line + b] == docs[m][q + line + b]:
                b += 1
            if a + line + b >= min_words:
                gone |= set(range(p - a, p + line + b))
        at, spans = 0, [(0, len(own))] if len(own) >= min_words else []
        for x in (texts[n] or "").split("\n"):
            size = len(words(x))
            spans += [(at, at + size)] if min_line is not None and size >= min_line else []
            at += size
        for i, j in spans:
            if whole.setdefault(tuple(own[i:j]), (n, i)) != (n, i):
                gone |= set(range(i, j))
        out.append(gone)
    return out


def check(spark, make, texts, **k):
    got = {r.row.doc_id: r for r in ld.line_dedup(spark, make(list(enumerate(texts))), **k).collect()}
    want = brute(texts, **k)
    for i, t in enumerate(texts):
        assert (got[i].n_deleted or 0) == len(want[i]), (i, t, sorted(want[i]))
        assert words(got[i].text) == [w for n, w in enumerate(words(t)) if n not in want[i]]
        assert want[i] or got[i].text == (t or "")
    return got


@pytest.mark.parametrize("text", ["", " \t\n", "a  b\tc\nd", "日本語のテキスト and 語", "x" * 70 + "-" + "y" * 9 + " z", "ไทย ab", "é" * 40 + ",é", "😀a😀", "a\x1cb c \r\n d"])
def test_words_follow_the_rules(text):
    many = ["q", text, "", text + " end", text]
    w = Words(pa.array(many))
    raw, want = "".join(many).encode(), [words(t) for t in many]
    assert [raw[a:b].decode() for a, b in zip(w.first, w.end)] == [x for own in want for x in own]
    assert w.sizes.tolist() == [len(own) for own in want]
    seen = {}
    for x, h in zip([x for own in want for x in own], w.hash.tolist()):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_of_texts_longer_than_a_slice():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(SLICE // 3))
    w = Words(pa.array(["one two", text, "three"]))
    assert w.sizes.tolist() == [2, len(text.split()), 1]
    by = {}
    for x, h in zip(["one", "two", *text.split(), "three"], w.hash.tolist()):
        assert by.setdefault(x, h) == h


def test_random_texts_as_brute_force(spark, make):
    rng = random.Random(1)
    lines = [" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(14)]
    texts = [rng.choice(["\n", " ", "\n\n", "\t"]).join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(80)]
    got = check(spark, make, texts, min_words=9)
    assert sum((r.n_deleted or 0) > 0 for r in got.values()) > 20
    check(spark, make, texts, min_words=12, min_line=3)


def test_edited_copies_as_brute_force(spark, make):
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        own = [f"{rng.choice('bcdfg')}{rng.randint(0, 99999)}" for _ in range(rng.randint(30, 400))]
        for _ in range(4):
            texts.append(" ".join(own))
            own = [w for w in own if rng.random() > 0.01]
            for at in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"new{len(texts)}x{at}"
    rng.shuffle(texts)
    got = check(spark, make, texts, min_line=4)
    assert sum((r.n_deleted or 0) for r in got.values()) > 3000


def test_no_passage_survives_and_own_words_do(spark, make):
    """Passages of 26 words and more, pasted anywhere, with other blanks: nothing of them stays in later documents."""
    rng = random.Random(4)
    passages = [[f"p{n}w{i}" for i in range(rng.choice([26, 40, 60, 200]))] for n in range(10)]
    texts = []
    for n in range(60):
        own = [[f"d{n}a{i}" for i in range(rng.randint(0, 30))], rng.choice(passages), [f"d{n}b{i}" for i in range(rng.randint(0, 30))], rng.choice(passages)]
        texts.append("".join(w + rng.choice(["  ", " ", "\n", "\t"]) for part in own for w in part))
    got = {r.row.doc_id: r.text.split() for r in ld.line_dedup(spark, make(list(enumerate(texts)))).collect()}
    seen = set()
    for n, t in enumerate(texts):
        assert [w for w in t.split() if w[0] == "d"] == [w for w in got[n] if w[0] == "d"]
        left = {w for w in got[n] if w[0] == "p"}
        assert not left & seen
        seen |= left
    assert seen == {w for p in passages for w in p if any(p[0] in t.split() for t in texts)}


def test_scripts_without_blanks(spark, make):
    passage = "".join(chr(0x4E00 + 7 * i % 900) for i in range(300))
    got = check(spark, make, [f"甲乙{passage}丙", f"前文不同{passage}后文", passage[:20]])
    assert got[1].text == "前文不同 后文" and got[2].n_deleted == 0


def test_repeats_inside_one_text_and_repeated_rows(spark, make):
    line = " ".join(f"t{i}" for i in range(30))
    check(spark, make, [f"{line}\n{line}\nend\n{line}", line, "ha " * 200])
    same = make([(7, line), (7, line), (None, line)])
    got = ld.line_dedup(spark, same).collect()
    assert sorted((r.row.doc_id is None, r.n_deleted or 0) for r in got) == [(False, 0), (False, 0), (True, 30)]


def test_real_texts_as_brute_force(spark, real, make):
    texts = [d.text for d in real[0]]
    got = check(spark, make, texts, min_line=ld.MIN_LINE)
    assert {w for r in got.values() for w in words(r.text)} == {w for t in texts for w in words(t)}


def test_columns_stay_and_empty_tables(spark, make):
    docs = make([(1, "a b"), (2, None)])
    out = ld.dedup_documents(spark, docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert ld.dedup_documents(spark, make([])).count() == 0
    assert ld.line_dedup(spark, make([])).count() == 0


def test_very_long_line(spark, make):
    long = " ".join(f"u{i}" for i in range(50_000))
    got = {r.row.doc_id: r.text for r in ld.line_dedup(spark, make([(0, long), (1, long + "."), (2, "own " + long[:-7])])).collect()}
    assert got[0] == long and got[1] == "u49999." and got[2] == "own"


def test_later_equal_whole_lines_go_however_short_the_run(spark, make):
    line, short = "Subscribe to our newsletter for more. Thank you all.", "All rights reserved."
    texts = [f"own {i} text\n{line}\nmore {i}\n{short}" for i in range(5)] + [f"in a longer line: {line}", f"{line}\n{line}", None]
    out = {r.doc_id: r.text for r in ld.dedup_documents(spark, make([*enumerate(texts), (1, texts[1])])).collect()}
    assert out[0] == texts[0] and out[5] == texts[5] and out[6] == "" and out[7] is None
    assert all(out[i] == f"own {i} text\nmore {i}\n{short}" for i in range(1, 5))


def test_shuffled_rows_give_the_same(spark, make):
    rng = random.Random(5)
    rows = [(i % 40 if i % 7 else None, " ".join(rng.choice("ab") + str(rng.randint(0, 3)) for _ in range(60))) for i in range(60)]
    a, b = (sorted(map(str, ld.dedup_documents(spark, make(x), min_words=6).select("doc_id", "text").collect())) for x in (rows, rows[::-1]))
    assert a == b
