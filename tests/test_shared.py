"""Contracts of many operations by tables, against one expression for each operation; plans of large contracts; schemas as text."""

import time

import pytest
from pyspark.sql import functions as S

from tablepact.functions import formats
from tablepact.functions import text as F
from tablepact.operators.schema import Compiler
from tablepact.operators.values import Typed, Variant
from tablepact.plans import validate as plans
from tablepact.sources.contract import Contract

PET = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "minimum": 2}, "mail": {"type": "string", "format": "email"}, "tags": {"type": "array", "items": {"enum": ["a", 1]}, "uniqueItems": True}}}


def contract(n: int) -> Contract:
    paths = {}
    for i in range(n):
        parameters = [
            {"name": "id", "in": "path", "required": True, "schema": {"type": "integer", "minimum": i % 3}},
            {"name": "q", "in": "query", "required": i % 2 == 0, "schema": {"type": "string", "maxLength": 3 + i % 2}},
            {"name": "ids", "in": "query", "style": "pipeDelimited", "schema": {"type": "array", "items": {"type": "integer"}, "maxItems": 2}},
            {"name": "X-One", "in": "header", "schema": {"type": ["boolean", "integer"]}},
            {"name": "c", "in": "cookie", "schema": {"type": "number", "multipleOf": 0.5}},
        ]
        if i % 4 == 3:
            parameters.append({"name": "deep", "in": "query", "style": "deepObject", "schema": {"type": "object", "properties": {"a": {"type": "integer"}}}})
        content = {"application/json": {"schema": PET}} if i % 3 else {"application/json": {"schema": {"type": "array"}}, "text/plain": {"schema": {"type": "string", "minLength": 3}}}
        headers = {"X-Rate": {"required": True, "schema": {"type": "integer", "maximum": 5 + i % 2}}}
        responses = {"200": {"description": "", "headers": headers, "content": content}, "4XX": {"description": ""}} | ({"default": {"description": "", "content": {"application/json": {"schema": PET}}}} if i % 2 else {})
        paths[f"/r{i}/{{id}}"] = {"post": {"parameters": parameters, "requestBody": {"required": i % 2 == 1, "content": content}, "responses": responses, "security": [{"key": []}] if i % 4 == 0 else []}}
    return Contract.api("3.1.0", {"paths": paths, "components": {"securitySchemes": {"key": {"type": "apiKey", "in": "header", "name": "k"}}}})


def messages(spark, n: int):
    return spark.range(600).selectExpr(
        "id", "'POST' AS method", f"concat('/r', id % {n + 1}, '/', if(id % 5 = 0, 'x', string(id % 4))) AS path",
        "if(id % 3 = 0, null, concat('q=', repeat('z', int(id % 6)), '&ids=1|', id % 7, if(id % 4 = 0, '|x', ''), '&deep[a]=', id % 3, if(id % 2 = 0, 'k', ''))) AS query",
        "map('x-one', array(if(id % 2 = 0, 'true', 'no!')), if(id % 3 = 0, 'K', 'l'), array('v')) AS headers", "map('X-RATE', array(string(id % 9))) AS response_headers", "concat('c=', id % 4, '.5') AS cookie",
        "case when id % 11 = 0 then 'text/plain' when id % 13 = 0 then null else 'application/json' end AS content_type", "array(200, 404, 500, 301)[int(id % 4)] AS status",
        "case when id % 19 = 0 then '{' when id % 7 = 0 then null when id % 5 = 0 then '[1, 1.0]' else concat('{\"id\": ', id % 4, ', \"mail\": \"a@b', if(id % 2 = 0, '.co', ''), '\", \"tags\": [1, 1.0]}') end AS body",
    )


@pytest.mark.parametrize("options", [{"security": True}, {"coerce": False, "coerce_bodies": True}])
def test_tables_find_what_single_expressions_find(spark, monkeypatch, options):
    c, df = contract(4), messages(spark, 4).cache()
    monkeypatch.setattr(plans, "FEW", 2)
    found = lambda: [tuple(r) for r in plans.validate_requests(df, c, **options).select("id", "operation", "violations").orderBy("id").collect()]
    tables = found()
    monkeypatch.setattr(plans, "FEW", 100)
    assert tables == found()
    assert len({v["keyword"] for r in tables for v in r[2]}) > 6


def test_tables_of_responses(spark, monkeypatch):
    c, df = contract(4), messages(spark, 4)
    monkeypatch.setattr(plans, "FEW", 2)
    found = lambda: [tuple(r) for r in plans.validate_responses(df, c).select("id", "violations").orderBy("id").collect()]
    tables = found()
    monkeypatch.setattr(plans, "FEW", 100)
    assert tables == found() and {v["keyword"] for _, vs in tables for v in vs} >= {"status", "maximum", "route", "json"}


def test_a_thousand_operations_are_planned_in_seconds(spark):
    df, began = messages(spark, 1000), time.time()
    out = plans.validate_requests(df, contract(1000))
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 30  # 4 s alone; machines that run tests are shared


def test_a_hundred_schemas_are_compiled_at_once(spark):
    began = time.time()
    for i in range(100):
        Compiler().valid({"properties": {"a": {"type": "integer", "minimum": i}, "b": {"type": "string", "maxLength": i, "format": "uuid"}}}, Variant(F.col("v")))._jc
    assert time.time() - began < 5  # 0.5 s alone


def test_ordinary_columns_and_texts_mix(spark):
    df = spark.createDataFrame([("a${b}'c\\d\n", 5), ("x", None)], "s string, n int")
    for c in (F.col("s"), S.col("s"), S.concat(S.col("s"), S.lit(""))):
        got = df.select(Compiler().valid({"type": "string", "enum": ["a${b}'c\\d\n"]}, Typed(c, df.schema["s"].dataType)).alias("ok")).collect()
        assert [r.ok for r in got] == [True, False]
    assert [r[0] for r in df.select((S.col("n") > 3) | (F.col("n") < F.lit(0)) | F.col("n").isNull()).collect()] == [True, True]
    assert [r[0] for r in df.select(F.col("n") - (F.col("n") - F.lit(1)) * F.lit(-2)).collect()] == [5 + 8, None]
    formats.register_format("string", "short", lambda c: S.length(c) < 3)
    try:
        got = df.select(Compiler().valid({"type": "string", "format": "short"}, Typed(F.col("s"), df.schema["s"].dataType)).alias("ok")).collect()
        assert [r.ok for r in got] == [False, True]
    finally:
        del formats.CUSTOM["string", "short"]
