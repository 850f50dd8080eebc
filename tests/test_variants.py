"""Open JSON documents: record sets, search of a key, merging, lengths, presence."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.functions import variants

SCHEMA = "a int, c boolean, n variant"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, doc string")


def test_record_set(spark):
    df = docs(spark, '[{"a": 1, "n": {"x": [1]}}, {"a": "7", "c": true, "extra": 1}, {"a": null}]', None, "[]").withColumn("a", F.lit("clash"))
    got = variants.records(df, "doc", SCHEMA).withColumn("n", F.to_json("n")).collect()
    assert [tuple(r) for r in got] == [(0, 1, None, '{"x":[1]}'), (0, 7, True, None), (0, None, None, None)]


@pytest.mark.parametrize("bad", ['{"a": 3}', '[{"a": "many"}]', "no json", "[1]"])
def test_record_set_refuses(spark, bad):
    with pytest.raises((PySparkException, Py4JJavaError)):
        variants.records(docs(spark, bad), "doc", SCHEMA).collect()
    lenient = variants.records(docs(spark, bad), "doc", SCHEMA, strict=False).select("a", "c").collect()
    assert [tuple(r) for r in lenient] == ([(None, None)] if "many" in bad else [])


def by_walking(value, key, path="$", depth=0):
    if depth > variants.DEEPEST:
        return
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from by_walking(v, key, f"{path}[{i:06d}]", depth + 1)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k == key:
                yield f"{path}.{k}", v
            yield from by_walking(v, key, f"{path}.{k}", depth + 1)


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["k", "", "語"]), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["k", "d", "語"]), inner, max_size=3), max_leaves=12)


def chain(n, v):
    return v if n == 0 else {"d": chain(n - 1, v)} if n % 2 else [chain(n - 1, v)]


@settings(max_examples=2, deadline=None)
@given(st.lists(VALUES, min_size=40, max_size=40))
def test_find_key_as_by_walking(spark, values):
    values = [*values, *[chain(n, {"k": n}) for n in (7, 8, 9, 10)], {"k": {"k": {"k": 1}}}]
    df = docs(spark, *map(json.dumps, values)).select("id", F.parse_json("doc").alias("doc"), F.lit(0).alias("found"))
    got = {r.id: [(p, json.loads(v)) for p, v in r.found] for r in variants.find_key(df, "doc", "k").select("id", F.transform("found", lambda x: F.struct(x["path"], F.to_json(x["value"]))).alias("found")).collect()}
    assert got == {i: sorted(by_walking(v, "k"), key=lambda x: x[0]) for i, v in enumerate(values)}


def test_find_key_without_documents(spark):
    df = docs(spark, None, '"k"', "3").select("id", F.parse_json("doc").alias("doc"))
    assert [r.found for r in variants.find_key(df, "doc", "k").collect()] == [[], [], []]
    assert variants.find_key(df.where("false"), "doc", "k").count() == 0


def test_columns(spark):
    pairs = [('{"a": 1, "b": 2}', '{"b": [3], "c": null}'), ("[1]", "[2, 3]"), ("[1]", '{"a": 1}'), ("1", '"a"'), (None, "[1]"), ("{}", "{}")]
    v, w = F.parse_json("v"), F.parse_json("w")
    df = spark.createDataFrame(pairs, "v string, w string")
    rows = df.select(F.to_json(variants.merge(v, w)).alias("merged"), variants.length(v).alias("n"), variants.has_key(w, "a").alias("a")).collect()
    assert [json.loads(r.merged) if r.merged else None for r in rows] == [{"a": 1, "b": [3], "c": None}, [1, 2, 3], [1, {"a": 1}], [1, "a"], None, {}]
    assert [r.n for r in rows] == [None, 1, 1, None, None, None] and [r.a for r in rows] == [False, False, True, True, False, False]


def test_no_python_and_no_shuffle(spark):
    df = docs(spark, "[]").select("id", F.parse_json("doc").alias("doc"))
    plan = variants.find_key(df, "doc", "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "MapIn" not in plan
