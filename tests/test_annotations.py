"""Evaluated properties and items, equality and multiples in both lanes; values that must not end a job."""

import itertools
import json
import time

import pytest

from tablepact.functions.strings import HostilePattern, java_pattern
from tablepact.operators.interpreter import Interpreter
from tablepact.operators.schema import compilable
from tablepact.plans import validate as plans
from tablepact.sources import decoders
from tablepact.sources.contract import Contract

A, B, C = ({"properties": {k: {"type": "integer"}}} for k in "abc")
SCHEMAS = [
    {"allOf": [A, B], "unevaluatedProperties": False},
    {"anyOf": [A | {"required": ["a"]}, B | {"required": ["b"]}], "unevaluatedProperties": False},
    {"oneOf": [A | {"required": ["a"]}, B | {"required": ["b"]}], "properties": {"c": True}, "unevaluatedProperties": {"type": "string"}},
    {"if": {"properties": {"a": {"const": 1}}, "required": ["a"]}, "then": B, "else": C, "unevaluatedProperties": False},
    {"allOf": [{"allOf": [A], "unevaluatedProperties": {"type": "string"}}], "unevaluatedProperties": False},
    {"dependentSchemas": {"a": B}, "properties": {"a": True}, "unevaluatedProperties": False},
    {"patternProperties": {"^[ab]$": True}, "not": {"required": ["z"], **C}, "unevaluatedProperties": {"minimum": 3}},
    {"allOf": [{"additionalProperties": {"type": "integer"}}], "unevaluatedProperties": False},
    {"prefixItems": [True], "unevaluatedItems": False},
    {"prefixItems": [True], "contains": {"const": 1}, "unevaluatedItems": {"type": "string"}},
    {"anyOf": [{"prefixItems": [{"type": "integer"}, True]}, {"contains": {"type": "string"}}], "unevaluatedItems": False},
    {"allOf": [{"prefixItems": [True], "items": {"type": "integer"}}], "unevaluatedItems": False},
    {"$ref": "#/components/schemas/P", "unevaluatedProperties": False},
    {"items": {"allOf": [A], "unevaluatedProperties": False}},
]
VALUES = [dict(zip(keys, vals)) for n in range(3) for keys in itertools.combinations("abz", n) for vals in itertools.product([1, "x"], repeat=n)]
VALUES += [list(v) for n in range(4) for v in itertools.product([1, "x"], repeat=n)] + [[{"a": 1}, {"b": 1}], 3, None, {"c": 2, "a": 1, "b": 4}]
DOC = Contract.api("3.1.0", {"components": {"schemas": {"P": {"allOf": [A, {"$ref": "#/components/schemas/Q"}]}, "Q": B}}})


def test_annotations_of_both_lanes(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)], "i int, t string")
    cols = [plans.violations(df, "t", s, DOC, lane="native").alias(f"c{k}") for k, s in enumerate(SCHEMAS)]
    assert all(compilable(DOC, s) for s in SCHEMAS)
    wrong = 0
    for row in df.select("i", *cols).collect():
        for k, s in enumerate(SCHEMAS):
            want = sorted((v["keyword"], v["data_path"]) for v in Interpreter(DOC).check(s, VALUES[row.i]))
            assert sorted((v.keyword, v.data_path) for v in row[f"c{k}"]) == want, (s, VALUES[row.i])
            wrong += bool(want)
    assert wrong > 100


def test_annotations_of_rows(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c string")
    found = df.select(plans.row_violations(df, {"allOf": [A], "unevaluatedProperties": False}).alias("v")).first().v
    assert {(v.keyword, v.data_path) for v in found} == {("unevaluatedProperties", "/b"), ("unevaluatedProperties", "/c")}


EQUAL = [({"const": {"a": 1, "b": [1, 2.5]}}, '{"b":[1e0,25e-1],"a":1.0}', True), ({"const": [1]}, '["1"]', False), ({"const": {"a": "1e0"}}, '{"a":"1e0"}', True), ({"const": [1e20]}, "[100000000000000000000]", False),
         ({"const": [1e20]}, "[1e20]", True), ({"const": 1.5e-7}, "0.00000015", True), ({"const": ['x"1\\']}, '["x\\"1\\\\"]', True), ({"uniqueItems": True}, "[[1],[1e0]]", False), ({"uniqueItems": True}, '[{"a":[1]},{"a":[2]}]', True),
         ({"multipleOf": 0.3}, "1000000000", False), ({"multipleOf": 2.5}, "2000000001", False), ({"multipleOf": 0.3}, "3000000000", True), ({"multipleOf": 0.01}, "4.35", True), ({"multipleOf": 0.1}, "-9007199254740993", True)]


@pytest.mark.parametrize("lane", ["native", "python"])
def test_equality_and_multiples(spark, lane):
    for schema, text, ok in EQUAL:
        df = spark.createDataFrame([(text,)], "t string")
        assert (df.select(plans.violations(df, "t", schema, lane=lane).alias("v")).first().v == []) is ok, (schema, text)


HOSTILE = ["[" * 100_000, "1e400", "1" * 400, '{"\\ud800": 1}', "NaN", '[1, Infinity]', '{"a": -1e999}', "{" * 5, '"' + "a" * 28 + '!"']


@pytest.mark.parametrize("lane", ["native", "python"])
def test_no_text_ends_a_job(spark, lane):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "i int, t string")
    schema = {"multipleOf": 3, "additionalProperties": False} | ({"pattern": "^(a{1,30}){1,30}$"} if lane == "python" else {})
    found = {r.i: {v.keyword for v in r.v} for r in df.select("i", plans.violations(df, "t", schema, lane=lane).alias("v")).collect()}
    assert [i for i in found if found[i] == {"json"}] == [0, 4, 5, 7] and found[1] == {"multipleOf"} == found[2] and found[6] == {"additionalProperties"}
    assert found[3] <= {"json", "additionalProperties"} and found[8] == ({"pattern"} if lane == "python" else set())


def test_xml_values(spark):
    texts = {
        "<a>" * 20_000 + "</a>" * 20_000: None, '<r xmlns:p="urn:x"><p:b> t </p:b><c/><d id="1">x<e/> y </d></r>': {"p:b": " t ", "c": None, "d": {"@id": "1", "e": None, "#text": "x y"}},
        "<r/>": None, "<r>1</r>": "1", "<!DOCTYPE r><r/>": "<!DOCTYPE r><r/>", "<r><a>1</a><a>2</a></r>": {"a": ["1", "2"]}, "<r>": "<r>",
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [json.loads(r[0]) for r in df.select(decoders.xml_json(df.t)).collect()]
    assert got[0] == list(texts)[0] and got[1:] == list(texts.values())[1:]


NODE = {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer", "maximum": 9}, "n": {"$ref": "#/components/schemas/N"}, "all": {"type": "array", "items": {"$ref": "#/components/schemas/N"}}}, "patternProperties": {"^m_": {"$ref": "#/components/schemas/M"}}}
MAPPED = {"type": ["object", "string"], "additionalProperties": {"$ref": "#/components/schemas/M"}, "prefixItems": [], "allOf": [{"properties": {"back": {"$ref": "#/components/schemas/N"}}}]}
RECURSIVE = Contract.api("3.1.0", {"components": {"schemas": {"N": NODE, "M": MAPPED, "X": {"anyOf": [{"type": "null"}, {"items": {"$ref": "#/components/schemas/X"}}]}}}})


def chain(n: int, last) -> dict:
    return {"v": n, "n": chain(n - 1, last)} if n else last


def test_trees_without_python(spark):
    values = [{"v": 1}, {"v": "x", "n": {"v": 10}}, {"v": 1, "all": [{"v": 2}, {"n": 3}, 4]}, {"v": 1, "m_a": {"b": "s", "c": {"d": 5, "back": {"w": 1}}}}, chain(9, {"v": 12}), chain(9, {}), 3, []]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(98, "{"), (99, None)], "i int, t string")
    ref = "#/components/schemas/N"
    out = df.select("i", plans.violations(df, "t", ref, RECURSIVE).alias("v"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: sorted((v.keyword, v.data_path) for v in r.v) for r in out.collect()}
    for i, v in enumerate(values):
        assert got[i] == sorted((x["keyword"], x["data_path"]) for x in Interpreter(RECURSIVE).check(RECURSIVE.schema(ref), v)), v
    assert got[98] == [("json", "")] and got[99] == []
    deep = spark.createDataFrame([(json.dumps(chain(k, {"v": 1})),) for k in (31, 40)], "t string")
    assert [{v.keyword for v in r.v} - {"maximum"} for r in deep.select(plans.violations(deep, "t", ref, RECURSIVE).alias("v")).collect()] == [set(), {"depth"}]
    chosen = df.select(plans.violations(df, "t", "#/components/schemas/X", RECURSIVE).alias("v"))
    assert "Python" in chosen._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pattern", ["^(a{1,30}){1,30}$", "^(a+)+$", "(a|a)*b", "(a|aa)+$", r"^(\w+\s?)*$", "(.*)*x", "([a-z]+)*[a-z0-9]+1", "^(?:(?:a{2,9}){1,9}b?)+$"])
def test_hostile_patterns_are_refused(pattern):
    with pytest.raises(HostilePattern):
        java_pattern(pattern)


@pytest.mark.parametrize("pattern", [r"^([a-z]{1,63}\.){1,10}[a-z]{2,}$", r"^(\d{1,3}\.){3}\d{1,3}$", r"^[\w.+-]+@\w+(\.\w+)+$", "^(ab|cd)*$", "^(?:a{2}){3}$", r"^\d{4}-\d\d-\d\d$", "(a+b)*", r"^(?:(a++)+|b)$", "^[A-Z]{3}-[0-9]{4,8}$"])
def test_harmless_patterns_are_taken(pattern):
    assert java_pattern(pattern).endswith(pattern)


def test_every_pattern_ends(spark):
    began = time.time()
    df = spark.createDataFrame([('"' + "a" * 40 + '!"',)], "t string")
    found = df.select(plans.violations(df, "t", {"pattern": "^(?:(a{1,30}){1,30})$"}, lane="python").alias("v")).first().v
    assert [v.keyword for v in found] == ["pattern"] and time.time() - began < 20
