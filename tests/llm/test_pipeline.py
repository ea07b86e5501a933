import corpus_pipeline as cp
from wellspring.llm import entry


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, small)
        if n < len(cp.STAGES) - 1:
            assert out.columns == first.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, cp.run(spark, small).collect()))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"] and docs.count() > 50


def test_registered():
    names = entry.queries()
    assert [n.split("_")[0] for n in names] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
    assert set(entry.oracle_sql()) <= set(names)


def test_defined_cases_of_every_stage(spark, small, make):
    """Nulls, empty and long texts, repeated rows, clashing columns, and no rows at all."""
    rows = [(1, None, None), (2, "", "p"), (3, "a b c d e", "p"), (3, "a b c d e", "p"), (None, None, None), (None, "x y z " * 20_000, "q"), (4, " \n ", "q"), (5, "one two three", "+")]
    docs, none = make(rows), make([])
    kept = {}
    for name, stage in cp.STAGES:
        assert stage(spark, none, small).count() == 0, name
        out = stage(spark, docs, small)
        got = out.collect()
        if name != "bpe":
            assert out.columns == docs.columns and all((r.row, r.d, r.k, r.f) == ("x", "y", 1, "z") for r in got), name
            kept[name] = sorted((str(r.doc_id), (r.text or "")[:9]) for r in got)
        else:
            assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in rows) and {r.n_tokens for r in got if r.doc_id in (1, 2, 4)} == {0}
    every = sorted((str(i), (t or "")[:9]) for i, t, _ in rows)
    assert kept["toxicity"] == every and len(kept["line_dedup"]) == len(every)
    assert [i for i, _ in kept["near_dedup"]] == ["1", "3", "5", "None"]  # texts without words are one component
    assert all(t.strip() for _, t in kept["mixing"])
