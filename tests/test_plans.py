import random

import pytest
from pyspark.sql import types as T

from slatework.plans import codec
from slatework.plans.builder import Q, col, f32, f64, i32, i64, string
from slatework.plans.lower import lower
from slatework.plans.nodes import Op, PlanError

OPS = [o.value for o in Op]


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "t": spark.createDataFrame([(1, 10, 0.5, "a"), (2, 2**53 + 1, 2.0, "b"), (3, -5, -1.0, "2")], "k int, n long, x double, s string"),
        "u": spark.createDataFrame([(1.0, "one"), (2.0, "two"), (2.5, "half")], "k double, s string"),
        "empty": spark.createDataFrame([], "k int, s string"),
        "f": spark.createDataFrame([(0.1,), (float("nan"),), (0.5,)], "y float"),
    }


def test_codec_round_trip_and_wire_form():
    q = Q.scan("a").cross(Q.scan("b")).filter_all(("x", "EQ", col("y")), ("z", "LT", f32(1.5)), ("w", "NE", "v")).sort("x", ("y", False)).project(("x", "z"), "y").build()
    assert codec.loads(codec.dumps(q)) == q
    assert codec.dump(Q.scan("r").filter("c", "GTE", i32(3)).build()) == {"root": {"Filter": {"predicates": [{"column_name": "c", "operator": "GTE", "value": {"I32": 3}}], "underlying": {"Scan": {"table_id": "r"}}}}}


@pytest.mark.parametrize("text", ["", "{}", '{"root": {"Limit": {}}}', '{"root": {"Scan": {"table": "x"}}}', '{"root": {"Filter": {"predicates": [{"column_name": "a", "operator": "LIKE", "value": {"I32": 1}}], "underlying": {"Scan": {"table_id": "x"}}}}}', '{"root": {"Filter": {"predicates": [{"column_name": "a", "operator": "EQ", "value": {"I32": "1"}}], "underlying": {"Scan": {"table_id": "x"}}}}}'])
def test_codec_is_strict(text):
    with pytest.raises(PlanError):
        codec.loads(text)


def test_unknown_names_raise(tables):
    for q in (Q.scan("nope"), Q.scan("t").filter("zz", "EQ", 1), Q.scan("t").project("zz"), Q.scan("t").sort("zz")):
        with pytest.raises(PlanError):
            lower(q.build(), tables)


def test_first_match_and_duplicate_names(spark, tables):
    df = lower(Q.scan("t").cross(Q.scan("t")).filter("k", "EQ", i32(1)).project("k", ("k", "k")).build(), tables)
    assert df.columns == ["k", "k"] and rows(df) == [(1, 1)] * 3


def test_incomparable_types_fold(tables):
    for op in OPS:
        got = len(rows(lower(Q.scan("t").filter("s", op, i32(2)).build(), tables)))
        assert got == (3 if op == "NE" else 0)
        got = len(rows(lower(Q.scan("t").cross(Q.scan("u").project(("s", "us"))).filter("k", op, col("us")).build(), tables)))
        assert got == (9 if op == "NE" else 0)


def test_int_and_float_keys_match(tables):
    df = lower(Q.scan("t").cross(Q.scan("u").project(("k", "uk"), ("s", "us"))).filter("k", "EQ", col("uk")).project("k", "us").build(), tables)
    assert sorted(rows(df)) == [(1, "one"), (2, "two")]


@pytest.mark.parametrize("op", OPS)
@pytest.mark.parametrize("value", [-6.0, -5.0, 1.5, 2.0, 10.0, 1e30, -1e30, float("inf"), float("-inf"), float("nan")])
def test_integer_column_by_float_literal(tables, op, value):
    import operator

    f = {"EQ": operator.eq, "NE": operator.ne, "GT": operator.gt, "GTE": operator.ge, "LT": operator.lt, "LTE": operator.le}[op]
    got = {r[0] for r in rows(lower(Q.scan("t").filter("n", op, f64(value)).project("n").build(), tables))}
    assert got == {n for n in (10, 2**53 + 1, -5) if f(n, value)}


def test_longs_compare_exactly(tables):
    assert rows(lower(Q.scan("t").filter("n", "EQ", i64(2**53)).build(), tables)) == []
    assert len(rows(lower(Q.scan("t").filter("n", "EQ", i64(2**53 + 1)).build(), tables))) == 1


def test_float32_literals_and_nan(tables):
    assert len(rows(lower(Q.scan("f").filter("y", "EQ", f32(0.1)).build(), tables))) == 1
    assert len(rows(lower(Q.scan("f").filter("y", "GT", f64(0.2)).build(), tables, strict_float=True))) == 1
    assert len(rows(lower(Q.scan("f").filter("y", "NE", f64(0.5)).build(), tables, strict_float=True))) == 2


def test_swapping_projection_then_filter(tables):
    q = Q.scan("t").project(("k", "n"), ("n", "k")).filter("k", "EQ", i64(10)).build()
    assert rows(lower(q, tables)) == [(1, 10)]


def test_sort_is_lexicographic_and_byte_wise(spark):
    t = {"s": spark.createDataFrame([("b", 1), ("B", 2), ("é", 3), ("a", 4), ("a", 5)], "s string, n int")}
    assert [r[1] for r in rows(lower(Q.scan("s").sort("s", ("n", False)).build(), t))] == [2, 5, 4, 1, 3]


def test_empty_tables_and_empty_filters(tables):
    assert rows(lower(Q.scan("empty").cross(Q.scan("t")).sort("s").build(), tables)) == []
    assert len(rows(lower(Q.scan("t").filter_all().build(), tables))) == 3


def test_arrays_cant_be_compared_or_sorted(spark):
    t = {"a": spark.createDataFrame([([1],)], T.StructType([T.StructField("v", T.ArrayType(T.IntegerType()))]))}
    for q in (Q.scan("a").filter("v", "EQ", 1), Q.scan("a").sort("v")):
        with pytest.raises(PlanError):
            lower(q.build(), t)


def test_filters_reach_the_scan(spark, sf):
    from slatework.sources.catalog import parquet_tables

    q = Q.scan("lineitem").sort("l_orderkey").filter("l_orderkey", "EQ", f64(5)).project("l_partkey").build()
    plan = lower(q, parquet_tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_orderkey,5)" in plan and "l_comment" not in plan and "struct<l_orderkey:bigint,l_partkey:bigint>" in plan


def test_joins_are_equi_joins(spark, sf):
    from slatework import queries

    for name in ("q2_shape", "q3_shape", "q5_shape", "q7_shape", "q8_shape", "q10_shape"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" in plan and "Join Cross\n" not in plan


def test_strategies(tables):
    q = Q.scan("t").cross(Q.scan("u").project(("k", "uk"))).filter("k", "EQ", col("uk")).project("k").build()
    for strategy, node in (("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("broadcast", "BroadcastHashJoin")):
        df = lower(q, tables, strategy)
        assert sorted(rows(df)) == [(1,), (2,)] and node in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(PlanError):
        lower(q, tables, "magic")


def test_random_plans_against_duckdb(spark):
    import duckdb

    rng = random.Random(4)
    data = {n: [(rng.randint(0, 5), round(rng.uniform(-2, 2), 1), rng.choice("abcd")) for _ in range(12)] for n in "pqr"}
    con = duckdb.connect()
    frames = {}
    for n, rows_ in data.items():
        con.execute(f"CREATE TABLE {n} ({n}_i INTEGER, {n}_x DOUBLE, {n}_s VARCHAR)")
        con.executemany(f"INSERT INTO {n} VALUES (?, ?, ?)", rows_)
        frames[n] = spark.createDataFrame(rows_, f"{n}_i int, {n}_x double, {n}_s string")
    signs = {"EQ": "=", "NE": "<>", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="}
    for _ in range(12):
        used = rng.sample("pqr", rng.randint(1, 3))
        plan, conditions, predicates = Q.scan(used[0]), [], []
        for n in used[1:]:
            plan = plan.cross(Q.scan(n))
            predicates.append((f"{used[0]}_i", "EQ", col(f"{n}_i")))
            conditions.append(f"{used[0]}_i = {n}_i")
        for _ in range(rng.randint(0, 3)):
            n, op = rng.choice(used), rng.choice(OPS)
            kind = rng.choice("ixs")
            other = rng.choice(used)
            value, text = {"i": (i32(3), "3"), "x": (f64(0.5), "0.5"), "s": (string("b"), "'b'")}[kind] if rng.random() < 0.6 else (col(f"{other}_{kind}"), f"{other}_{kind}")
            predicates.append((f"{n}_{kind}", op, value))
            conditions.append(f"{n}_{kind} {signs[op]} {text}")
        keep = [f"{n}_{k}" for n in used for k in "ixs" if rng.random() < 0.6] or [f"{used[0]}_i"]
        df = lower(plan.filter_all(*predicates).project(*keep).build(), frames)
        sql = f"SELECT {', '.join(keep)} FROM {', '.join(used)} WHERE {' AND '.join(conditions) or 'true'}"
        assert sorted(map(str, rows(df))) == sorted(map(str, con.sql(sql).fetchall())), sql
