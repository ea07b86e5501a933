import pytest
from pyspark.sql import functions as F

from wellspring.functions.interval import Box, Interval, box
from wellspring.operators import elementwise as ew
from wellspring.operators import reduce as rd
from wellspring.operators import reindex as ri
from wellspring.operators import stencil as st
from wellspring.plans.graph import Buffer, InsufficientInput, InsufficientStage, Pipeline, Stage, halo, pointwise, tile_sizes
from wellspring.sources import frame as fr


def values(a):
    return {tuple(r[d] for d in a.dims): r["v"] for r in a.df.collect()}


def chain(persist=False, parts=None):
    a, mid, out = (Buffer(n, ("x", "y")) for n in ("in", "mid", "out"))
    if persist:
        mid.compute_root()
    if parts:
        mid.repartition(parts)
    Stage(lambda i: st.square_sum(i, 1), [(a, halo(x=(-1, 1), y=(-1, 1)))], [mid], "first")
    Stage(lambda i: st.square_sum(i, 1), [(mid, halo(x=(-1, 1), y=(-1, 1)))], [out], "second")
    return Pipeline([a], [out])


def test_needs_grow_backwards():
    p, out = chain(), box(x=(0, 9), y=(5, 7))
    needs = {b.name: v for b, v in p.needs({"out": out}).items()}
    assert needs["mid"] == box(x=(-1, 10), y=(4, 8)) and needs["in"] == box(x=(-2, 11), y=(3, 9))
    assert '"in" -> "mid"' in p.dot() and "in: x in [-2, 11]" in p.describe({"out": out})


def test_insufficient_input_fails(spark):
    src = fr.generate(spark, box(x=(-2, 11), y=(3, 8)), F.col("x"))
    with pytest.raises(InsufficientInput):
        chain().evaluate({"out": box(x=(0, 9), y=(5, 7))}, {"in": src})


def test_hints_do_not_change_results(spark):
    src = fr.generate(spark, box(x=(-2, 11), y=(3, 9)), F.col("x") * F.col("y"))
    got = [values(p.evaluate({"out": box(x=(0, 9), y=(5, 7))}, {"in": src})["out"]) for p in (chain(), chain(persist=True), chain(parts=3))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 30
    want = {(x, y): sum((x + i + k) * (y + j + m) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) for m in (-1, 0, 1)) for x in range(10) for y in range(5, 8)}
    assert got[0] == want


def test_scalars_lets_unused_and_aligned(spark):
    src = fr.generate(spark, box(x=(0, 63)), F.col("x"))
    a, unused, one, two, out = Buffer("in", ("x",)), Buffer("unused", ("x",)), Buffer("one", ("x",)), Buffer("two", ("x",)), Buffer("out", ("x",))
    Stage(lambda i, k, kk: (ew.apply(i, lambda v: v + kk), ew.apply(i, lambda v: v * k)), [(a, pointwise)], [one, two], "both", align={"x": 8})
    Stage(lambda i, k, kk: ew.apply(i, lambda v: v - k), [(one, pointwise)], [out], "sub")
    p = Pipeline([a, unused], [out], ("k",), {"kk": lambda v: v["k"] * 2})
    needs = {b.name: v for b, v in p.needs({"out": box(x=(9, 12))}).items()}
    assert needs["in"] == box(x=(8, 15)) and "unused" not in needs and "two" not in needs
    assert values(p.evaluate({"out": box(x=(9, 12))}, {"in": src}, {"k": 3})["out"]) == {(x,): x + 3 for x in range(9, 13)}
    with pytest.raises(ValueError):
        p.evaluate({"out": box(x=(9, 12))}, {"in": src}, {})


def test_uncovered_copy_fails_and_padding_helps(spark):
    src = fr.generate(spark, box(x=(0, 4)), F.col("x"))
    with pytest.raises(ValueError):
        ri.copy(src, {"x": ri.Affine("x", 1, 1)}, box(x=(0, 4)))
    assert values(ri.copy(src, {"x": ri.Affine("x", 1, 1)}, box(x=(0, 4)), -9)) == {(0,): 1, (1,): 2, (2,): 3, (3,): 4, (4,): -9}


@pytest.mark.parametrize("scale,offset", [(1, 0), (2, 0), (3, 5), (-1, 4), (-2, 9), (8, 1)])
def test_affine_copies(spark, scale, offset):
    src = fr.generate(spark, box(x=(-20, 40)), F.col("x") * 7)
    out = box(x=(-2, 3))
    assert values(ri.copy(src, {"x": ri.Affine("x", scale, offset)}, out)) == {(x,): (scale * x + offset) * 7 for x in range(-2, 4)}


def test_repeated_and_constant_indices(spark):
    src = fr.generate(spark, box(x=(0, 3), y=(0, 3)), F.col("x") * 10 + F.col("y"))
    both = ri.copy(src, {"x": ri.Affine("z"), "y": ri.Affine("z")}, box(z=(0, 3)))
    assert values(both) == {(z,): 11 * z for z in range(4)}
    flat = ri.copy(src, {"x": ri.Affine(None, offset=2), "y": ri.Affine("y")}, box(y=(0, 3), w=(0, 1)))
    assert values(flat) == {(y, w): 20 + y for y in range(4) for w in range(2)}


def test_sparse_sums_are_total(spark):
    df = spark.createDataFrame([(1, 5, 2), (1, 5, 3), (4, 7, 1)], "x long, y long, q long")
    a = fr.scatter(df, {"x": F.col("x"), "y": F.col("y")}, F.col("q"))
    assert values(rd.total(a, "y")) == {(1,): 5, (2,): 0, (3,): 0, (4,): 1}
    assert a.sparse and not a.check_total()
    nothing = ri.crop(fr.generate(spark, box(x=(0, 3)), F.col("x")), Box(x=Interval(9, 5)))
    assert values(rd.total(nothing, "x")) == {(): 0}


def test_division_by_zero_norms(spark):
    a = fr.constant(spark, [(0, 0), (1, 4)], ["x"])
    assert values(ew.reciprocal_sqrt(a)) == {(0,): float("inf"), (1,): 0.5}
    soft = fr.constant(spark, [(0, 0, 100), (1, 0, 0), (2, 0, 100)], ["x", "y"])
    assert [round(v, 6) for _, v in sorted(values(rd.softmax(soft, "x")).items())] == [0.5, 0.0, 0.5]


def test_a_footprint_declared_too_small_fails(spark):
    src = fr.generate(spark, box(x=(0, 20)), F.col("x"))
    a, out = Buffer("in", ("x",)), Buffer("out", ("x",))
    Stage(lambda i: st.chunked_sum(i, "x", -1, 1), [(a, pointwise)], [out], "sum")
    p = Pipeline([a], [out])
    with pytest.raises(InsufficientStage, match="sum gives"):
        p.evaluate({"out": box(x=(5, 14))}, {"in": src})
    seen = []
    p.on_failure = lambda e, needs: seen.append((type(e), needs)) or {"out": src}
    assert len(values(p.evaluate({"out": box(x=(5, 14))}, {"in": src})["out"])) == 10 and seen == [(InsufficientStage, {"out": box(x=(5, 14))})]


def test_roots_are_freed_and_stages_traced(spark):
    src = fr.generate(spark, box(x=(-2, 11), y=(3, 9)), F.col("x"))
    events = []
    with chain(persist=True) as p:
        p.trace = lambda *e: events.append(e[:2])
        df = p.evaluate({"out": box(x=(0, 9), y=(5, 7))}, {"in": src})["out"].df
        (kept,) = p.kept
        assert df.count() == 30 and kept.df.is_cached
    assert not kept.df.is_cached and p.kept == [] and df.count() == 30
    assert events == [("begin", "first"), ("end", "first"), ("begin", "second"), ("end", "second")]


def test_tiles_loops_and_threads(spark):
    src = fr.generate(spark, box(x=(-2, 12), y=(3, 9)), F.col("x") * F.col("y"))
    p, want = chain(), {"out": box(x=(0, 10), y=(5, 7))}
    tiles = [t["out"] for t in p.tiles(want, {"x": 4, "y": 2})]
    assert tiles[:3] == [box(x=(0, 3), y=(5, 6)), box(x=(4, 7), y=(5, 6)), box(x=(8, 10), y=(5, 6))] and tiles[-1] == box(x=(8, 10), y=(7, 7)) and len(tiles) == 6
    whole = values(p.evaluate(want, {"in": src})["out"])
    assert values(p.loop(want, {"x": 4, "y": 2}, {"in": src})["out"]) == whole
    assert p.start(lambda got: values(got["out"]), want, {"in": src}).result(120) == whole


def test_graphs_can_be_read_and_changed(spark):
    p = chain()
    mid = p.outputs[0].producer.inputs[0][0]
    assert {b.name for b in p.depends(p.outputs[0])} == {"in", "mid"} and p.depends(p.inputs[0]) == set()
    assert p.shape() == chain().shape() and "Stage(kernels['first']" in p.source()
    other = Buffer("other", ("x", "y"))
    cut = p.substitute({"mid": other})
    assert cut.shape() == (("second", ("other",), ("out",)),) and mid.producer is not None
    src = fr.generate(spark, box(x=(-1, 4), y=(-1, 4)), F.col("x"))
    assert values(cut.evaluate({"out": box(x=(0, 3), y=(0, 3))}, {"other": src})["out"]) == {(x, y): 9 * x for x in range(4) for y in range(4)}
    scope = {"Buffer": Buffer, "Stage": Stage, "Pipeline": Pipeline, "lets": {}, "kernels": {s.title: s.kernel for s in p.order()}, "needs": {s.title: [n for _, n in s.inputs] for s in p.order()}}
    text = p.source().replace("in = ", "in_ = ").replace("(in,", "(in_,").replace("[in]", "[in_]")
    exec(text, scope)
    assert scope["pipeline"].shape() == p.shape()


def test_long_lines_are_cut_into_chunks(spark):
    src = fr.generate(spark, box(x=(0, 2), y=(-40, 60)), F.col("x") * 1000 + F.col("y") * F.col("y"))
    taps = {"x": (0, 1), "y": (-2, 3)}
    assert values(st.rectangle_sum(src, taps, chunk=7)) == values(st.rectangle_sum(src, taps)) != {}
    from wellspring.operators import windows

    a = ri.translate(src, y=9)
    whole = values(ew.subtract(src, a))
    before, windows.dealt.__defaults__ = windows.dealt.__defaults__, (11,)
    try:
        assert values(ew.subtract(src, a)) == whole == {(x, y): 1000 * x + y * y - 1000 * x - (y - 9) ** 2 for x in range(3) for y in range(-31, 61)}
    finally:
        windows.dealt.__defaults__ = before


def test_long_lines_are_aggregated_first(spark, monkeypatch):
    src = fr.generate(spark, box(x=(0, 30), y=(0, 4)), (F.col("x") * 7 + F.col("y") * 3) % 11 - 5)
    short = [values(f(src, d)) for f in (rd.softmax, rd.l2_normalize, rd.centered) for d in ("x", "y")]
    monkeypatch.setattr(rd, "SHORT", 2)
    long = [values(f(src, d)) for f in (rd.softmax, rd.l2_normalize, rd.centered) for d in ("x", "y")]
    assert all(s.keys() == t.keys() and all(abs(s[k] - t[k]) < 1e-12 for k in s) for s, t in zip(short, long))
    line = fr.generate(spark, box(x=(0, 9)), F.col("x"))
    assert values(rd.centered(line, "x")) == {(x,): x - 46 for x in range(10)}


def test_products_in_blocks(spark):
    a = fr.generate(spark, box(i=(-3, 8), k=(0, 6)), F.col("i") * 5 + F.col("k"))
    b = fr.generate(spark, box(k=(1, 9), j=(2, 9)), F.col("k") * F.col("j") - 4)
    want = {(i, j): sum((i * 5 + k) * (k * j - 4) for k in range(1, 7)) for i in range(-3, 9) for j in range(2, 10)}
    assert values(rd.matmul(a, b)) == values(rd.matmul(a, b, block=4, most=0)) == want


def test_assertions_on_values(spark):
    a = fr.generate(spark, box(x=(0, 9)), F.col("x"))
    assert len(values(ew.require(a, lambda v: v < 10, "too large"))) == 10
    with pytest.raises(Exception, match="too large"):
        values(ew.require(a, lambda v: v < 9, "too large"))


def test_small_arrays(spark):
    assert fr.constant(spark, [], ["x"]).box.empty and values(fr.constant(spark, [], ["x"])) == {}
    assert values(fr.scalar(spark, 5)) == {(): 5} and fr.scalar(spark, 5).box.volume == 1
    sparse = fr.scatter(spark.createDataFrame([(1, 5, 6), (1, 5, 3), (4, 7, 1)], "x long, y long, q long"), {"x": F.col("x"), "y": F.col("y")}, F.col("q"), how=F.bit_xor)
    assert values(rd.xor(sparse, "y")) == {(1,): 5, (2,): 0, (3,): 0, (4,): 1}


def test_writing_and_reading_back(spark, tmp_path):
    a = fr.generate(spark, box(x=(0, 3), y=(-1, 1)), F.col("x") - F.col("y"))
    fr.write(a, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert fr.measured(back, ["x", "y"]) == a.box and values(fr.ArrayFrame(back, a.box)) == values(a)


def test_tile_sizes():
    assert [tile_sizes(10, n) for n in (1, 5, 20, 200)] == [(1, 1), (5, 1), (10, 2), (10, 20)]


def test_negative_coordinates_reshape_and_tile(spark):
    a = fr.generate(spark, box(x=(-8, 7), y=(-4, 3)), F.col("x") * 100 + F.col("y"))
    assert values(ri.untile(ri.tile(a, 4), 4)) == values(a)
    assert values(ri.upsample(fr.generate(spark, box(y=(-2, 1)), F.col("y")), "y")) == {(y,): y // 2 for y in range(-4, 4)}
    assert values(rd.box_downsample(a)).keys() == {(x, y) for x in range(-4, 4) for y in range(-2, 2)}


def test_stream_equals_batch(spark, small, tmp_path):
    from wellspring.streaming.sliding import read_events, windowed_sum

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = windowed_sum(read_events(spark, str(tmp_path / "in")), late="10000 days").writeStream.outputMode("update").format("memory").queryName("sums").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("sums").groupBy("event_type", "start").agg(F.max(F.struct("n", "total")).alias("m")).select("event_type", "start", "m.n", "m.total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windowed_sum(events).collect()))
