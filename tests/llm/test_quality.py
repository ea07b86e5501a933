import random
import re
from collections import Counter

import numpy as np

from wellspring.llm import quality as ql


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts(real):
    docs, _ = real
    odd = ["", " \n\t", "a b c a b c", "x x x x x", "é\u00a0ü |#\u2003b\x0bc\x0cd\re", "a\n\na\n a\na", "one", "a b c", "\x1c \x1c", "w " * 30_000]
    for text in [d.text for d in docs] + odd:
        assert ql.base(text.encode(), text) == naive(text), text[:80]


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(50):
        crf = ql.Crf(rng.standard_normal(len(ql.FEATURES)), rng.standard_normal((2, 2)), rng.standard_normal(2), True)
        rows = rng.standard_normal((6, len(ql.FEATURES))).tolist()

        def score(path):
            s = crf.start[path[0]]
            for i, y in enumerate(path):
                s += y * float(np.dot(rows[i], crf.emit)) + (crf.move[path[i - 1], y] if i else 0)
            return s

        best = max((score(p), p) for p in ([n >> i & 1 for i in range(6)] for n in range(64)))[0]
        assert abs(score([int(x) for x in crf.decode(rows)]) - best) < 1e-9


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(8))
    bad = lambda: "\n".join(" ".join(word() + rng.choice(["###", "$$$", "&&&"]) for _ in range(9)) for _ in range(9))
    return [(i, (good() if i % 3 else bad()) + f"\nline {i} is here.") for i in range(120)]


def test_held_out_documents(spark, make, label):
    rows = corpus()
    mixed = rows[0][1] + "\n" + rows[1][1] + "\n" + rows[2][1]
    docs = make([*rows, (None, None), (500, ""), (501, "few words"), (502, mixed), (503, "a b c " * 100), (503, "a b c " * 100)])
    got = ql.judge_documents(spark, docs, label([(i, int(i % 3 > 0), 0) for i, _ in rows if i % 2])).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 6 and all(by[i].kept == (i % 3 > 0) and not by[i].base_failed for i, _ in rows)
    assert by[None].base_failed and by[500].base_failed and by[501].base_failed and by[503].base_failed and not by[503].kept
    assert by[502].kept and by[502].content_words < by[502].n_words


def test_without_labels(spark, make, label):
    docs = make(corpus()[:4])
    assert all(r.kept and r.content_words == r.n_words for r in ql.judge_documents(spark, docs, label([])).collect())
    assert all(r.kept for r in ql.judge_documents(spark, docs, label([(0, 0, 0), (None, 1, 0), (1, None, 0)])).collect())
    assert ql.judge_documents(spark, make([]), label([])).count() == 0
