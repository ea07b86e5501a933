"""Every query against its SQL on DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from wellspring import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_as_sql(spark, small, duck, name):
    q = catalogue.QUERIES[name]
    got = q.run(spark, small).toPandas()
    want = duck.execute(q.sql).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    got, want = (df[cols].sort_values(cols).reset_index(drop=True) for df in (got, want))
    assert len(got) == len(want) > 0
    for c in cols:
        assert str(got[c].dtype) == str(want[c].dtype)
        assert got[c].astype(str).tolist() == want[c].astype(str).tolist()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = catalogue.QUERIES["crop_box"].run(spark, small)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(vec_id,10)" in plan and "LessThanOrEqual(vec_id,99)" in plan
    plan = catalogue.QUERIES["scatter_lineitem"].run(spark, small)._jdf.queryExecution().toString()
    assert "l_shipdate" not in plan.split("ReadSchema")[-1]


def test_maps_need_no_shuffle(spark, small):
    for name in ("map_chain", "transpose", "reshape", "tile", "upsample_nn", "im2col", "concat"):
        assert "Exchange" not in catalogue.QUERIES[name].run(spark, small)._jdf.queryExecution().executedPlan().toString(), name


def test_schedules_do_not_change_results(spark, small):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted(map(tuple, catalogue.QUERIES["stencil_chain"].run(spark, small).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert rows("1") == rows("5")


def test_queries_reach_every_value(spark, small):
    n = spark.read.parquet(f"{small}/embeddings.parquet").count()
    want = {"split_diff": n // 2 * 64, "reshape": n * 64, "im2col_2d": (n - 1) * 63 * 4, "planned_multi_output": n * 64, "matmul": n * 64, "matmul_chain": n * 64}
    assert {q: catalogue.QUERIES[q].run(spark, small).count() for q in want} == want


def test_arrays_of_one_origin_are_not_joined(spark, small):
    def plan(name):
        return catalogue.QUERIES[name].run(spark, small)._jdf.queryExecution().executedPlan().toString()

    for name in ("diamond", "binary_subtract", "binary_multiply", "self_shift_diff"):
        assert plan(name).count("FileScan") == 1 and "Join" not in plan(name), name
    assert plan("sum_two_grains").count("FileScan") == 1
