import numpy as np

from wellspring.llm import toxicity as tx


def corpus():
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(["river", "stone", "green", "walk", "early", "table"], 12)) for _ in range(160)]
    bad = [f"{c} {w} {v}" for c, w, v in zip(clean, rng.choice(["idiot", "scum", "disgusting"], 60), rng.choice(["moron", "trash", "pathetic"], 60))]
    return clean, bad


def test_held_out_documents(spark, make, label):
    clean, bad = corpus()
    rows = [(i, t) for i, t in enumerate(clean + bad)]
    labels = label([(i, 1, int(i >= len(clean))) for i, _ in rows if i % 2])
    docs = make([*rows, (None, None), (998, ""), (999, "SCUM!! you IDIOT%%%"), (999, "SCUM!! you IDIOT%%%"), (1000, "river " * 20_000)])
    out = tx.drop_toxic(spark, docs, labels)
    kept = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns
    assert set(kept) == {*range(len(clean)), None, 998, 1000} and len(kept) == len(clean) + 3


def test_the_chain_feeds_earlier_probabilities_on(spark, make, label):
    clean, bad = corpus()
    rows = list(enumerate(clean + bad))
    chain = tx.train(spark, make(rows), label([(i, 1, int(i >= len(clean))) for i, _ in rows]))
    columns = max(chain.terms.values()) + 1
    assert [len(w) for w in chain.weights] == [columns + 1 + k for k in range(4)] and columns < len(chain.terms)
    assert chain.score(["river stone"])[0, 3] < 0.2 and chain.score(["an idiot and scum"])[0, 3] > 0.8


def naive_score(chain, text):
    """The chain by loops: each category's probability joins the sum of the next ones."""
    own = {chain.terms[w] for w in tx.words(text) if w in chain.terms}
    columns, out = max(chain.terms.values()) + 1, []
    for w in chain.weights:
        z = w[-1] + sum(w[i] for i in own) + sum(w[columns + j] * p for j, p in enumerate(out))
        out.append(1 / (1 + np.exp(-z)))
    return out


def test_scores_as_brute_force(spark, make, label):
    clean, bad = corpus()
    rows = list(enumerate(clean + bad)) + [(5000, None), (5001, ""), (5002, "idiot " * 30_000)]
    labels = label([(i, 1, int(i >= len(clean))) for i, _ in rows[: len(clean) + len(bad)]])
    chain = tx.train(spark, make(rows), labels)
    got = {r.row.doc_id: r for r in tx.score_documents(spark, make(rows), labels).collect()}
    for i, t in rows:
        want = naive_score(chain, t or "")
        assert np.allclose([got[i].p[c] for c in tx.CATEGORIES], want) and got[i].rejected == (want[-1] >= chain.threshold)


def test_fits_are_optimal():
    """No small step lowers the penalised loss."""
    rng = np.random.default_rng(7)
    x, y = (rng.random((200, 6)) < 0.4).astype(float), (rng.random(200) < 0.4).astype(float)
    w = tx.fit_linear(x, y)

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return np.sum(np.log1p(np.exp(z)) - y * z) + 0.5 * (0.03 * w[:-1] @ w[:-1] + 1e-3 * w[-1] ** 2)

    assert all(loss(w) <= loss(w + 1e-3 * s * e) for e in np.eye(7) for s in (1, -1))


def test_a_row_does_not_reach_its_own_earlier_probability():
    """Flipping the labels of one fold leaves what the chain feeds to that fold's rows as it was."""
    rng = np.random.default_rng(3)
    x, y = (rng.random((60, 5)) < 0.5).astype(float), (rng.random((60, 2)) < 0.5).astype(float)
    fold = np.arange(60) % tx.FOLDS
    seen = []
    real = tx.fit_linear

    def spy(a, b, **k):
        seen.append((a.copy(), len(b)))
        return real(a, b, **k)

    tx.fit_linear = spy
    try:
        for flip in (False, True):
            z = y.copy()
            if flip:
                z[fold == 1, 0] = 1 - z[fold == 1, 0]
            tx.fit_chain({str(i): i for i in range(5)}, x, z, fold)
    finally:
        tx.fit_linear = real
    one, two = [a for a, n in seen if a.shape == (60, 6)]
    assert np.allclose(one[fold == 1], two[fold == 1]) and not np.allclose(one[fold != 1], two[fold != 1])


def test_kinds_are_found_in_the_rows():
    x = np.zeros((30, 6))
    for i in range(30):
        x[i, [2 * (i % 3), 2 * (i % 3) + 1]] = 1
    own = tx.clusters(x)
    assert len({tuple(sorted(set(own[i::3]))) for i in range(3)}) == 3 and all(len(set(own[i::3])) == 1 for i in range(3))
    assert tx.clusters(x[:0]).shape == (0,) and set(tx.clusters(np.zeros((4, 3)))) <= {0, 1, 2}


def test_equal_columns_are_one():
    where, x = tx.merge_columns(["a", "b", "c"], np.array([[1.0, 0, 1], [0, 1, 0], [1, 0, 1]]))
    assert where == {"a": 0, "b": 1, "c": 0} and x.tolist() == [[1, 0], [0, 1], [1, 0]]


def test_out_of_fold_predictions_are_used():
    rng = np.random.default_rng(1)
    x, y = (rng.random((80, 30)) < 0.3).astype(float), (rng.random((80, 2)) < 0.5).astype(float)
    chain = tx.fit_chain({str(i): i for i in range(30)}, x, y, np.arange(80) % tx.FOLDS)
    fitted = tx.fit_linear(np.hstack([x, tx.probability(x, chain.weights[0])[:, None]]), y[:, 1])
    assert not np.allclose(fitted, chain.weights[1])


def test_without_labels_nothing_goes(spark, make, label):
    docs = make([(1, "idiot"), (2, None)])
    for labels in (label([]), label([(1, 1, 0)]), label([(1, 1, None), (None, 1, 1)])):
        assert tx.drop_toxic(spark, docs, labels).count() == 2
    assert tx.drop_toxic(spark, make([]), label([(1, 1, 1)])).count() == 0
