"""Keywords, composition, formats, coercion, decoders, routing: verdicts, and the compiler against the interpreter."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablepact.functions import coercion, formats
from tablepact.operators import routing
from tablepact.operators.interpreter import Interpreter
from tablepact.plans import validate as plans
from tablepact.sources import decoders
from tablepact.sources.contract import Contract, ContractError, Registry, parse

CASES = [
    ({"type": "integer"}, ["3", "3.0"], ["3.5", '"3"', "true"]),
    ({"enum": [1, "a"]}, ["1", "1.0", '"a"'], ['"1"', "true"]),
    ({"const": None}, ["null"], ["0", '""']),
    ({"type": "string", "maxLength": 1}, ['"a"'], ['"😀"', '"ab"']),
    ({"multipleOf": 0.1}, ["0.3"], ["0.35"]),
    ({"multipleOf": 3}, ["9", "9.0"], ["10"]),
    ({"type": "number", "format": "float"}, ["1.5", "1.0"], ["1"]),
    ({"uniqueItems": True}, ['[1,"1"]', "{}"], ["[1,1.0]", '[{"a":1,"b":2},{"b":2,"a":1}]']),
    ({"contains": {"const": 1}, "minContains": 2}, ["[1,1]"], ["[1]", "[]"]),
    ({"minimum": 1, "exclusiveMaximum": 3}, ["1", "2.9", '"x"'], ["0", "3"]),
    ({"pattern": "^a.c$"}, ['"abc"', "1"], ['"abd"']),
    ({"required": ["a"], "properties": {"a": {"type": ["string", "null"]}}}, ['{"a":null}', "[]"], ["{}", '{"a":1}']),
    ({"properties": {"a": True}, "patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, ['{"a":1,"x1":2}'], ['{"b":1}', '{"x1":"s"}']),
    ({"additionalProperties": {"type": "integer"}, "minProperties": 1, "maxProperties": 2}, ['{"a":1}'], ["{}", '{"a":"s"}', '{"a":1,"b":1,"c":1}']),
    ({"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": False}, ['[1,"a"]', "[1]"], ['["a"]', '[1,"a",2]']),
    ({"propertyNames": {"maxLength": 2}}, ['{"ab":1}'], ['{"abc":1}']),
    ({"dependentSchemas": {"a": {"required": ["b"]}}}, ['{"a":1,"b":1}', "{}"], ['{"a":1}']),
    ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, ["2"], ["0", "4"]),
    ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, ['"x"', "3"], ["1"]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 3}]}, ["0", "4"], ["2"]),
    ({"not": {"type": "null"}}, ["1"], ["null"]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "integer"}}, ['"ab"', "1"], ['"a"', "1.5"]),
    ({"items": {"items": {"type": "integer"}}}, ["[[1],[2,3]]"], ['[[1],["x"]]']),
]


@pytest.mark.parametrize("lane", ["native", "python"])
def test_keywords(spark, lane):
    rows = [(i, text, good) for i, (_, yes, no) in enumerate(CASES) for good, texts in ((True, yes), (False, no)) for text in texts]
    df = spark.createDataFrame(rows, "i int, text string, good boolean")
    for i, (schema, _, _) in enumerate(CASES):
        bad = plans.validate(df.where(f"i = {i}"), "text", schema, lane=lane).where("valid <> good").collect()
        assert not bad, (schema, bad)


def test_violations_agree_between_lanes(spark):
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "array", "items": {"minimum": 2}}}, "additionalProperties": False}
    df = spark.createDataFrame([('{"a":[1,2,0],"c":1}',), ('{"a":3,"b":1}',), ("[]",), (None,), ("{",)], "text string")
    found = [sorted((v.keyword, v.data_path) for v in r.violations) for lane in ("native", "python") for r in plans.validate(df, "text", schema, lane=lane).collect()]
    assert found[:5] == found[5:]
    assert ("items", "") not in found[0] and ("minimum", "/a/0") in found[0] and found[3] == []


def test_recursion_and_unevaluated():
    c = Contract.of({"$defs": {"node": {"properties": {"next": {"$ref": "#/$defs/node"}, "v": {"type": "integer"}}}}})
    i = Interpreter(c)
    assert not i.check({"$ref": "#/$defs/node"}, {"next": {"next": {"v": 1}}})
    assert i.check({"$ref": "#/$defs/node"}, {"next": {"next": {"v": "x"}}})
    closed = {"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}
    assert not i.check(closed, {"a": 1}) and i.check(closed, {"b": 1})
    assert i.check({"prefixItems": [True], "unevaluatedItems": False}, [1, 2])


FORMATS = {
    "date": (["2024-02-29"], ["2023-02-29", "2024-1-1"]), "time": (["12:00:00Z", "23:59:60Z"], ["12:00:00", "12:00:60Z", "24:00:00Z"]), "date-time": (["2024-02-29T12:00:00+02:00"], ["2024-02-30T12:00:00Z", "2024-02-29 12"]),
    "duration": (["P1D", "P2W", "PT5M", "P1DT1H"], ["P", "PT", "P1S"]), "ipv4": (["1.2.3.4"], ["1.2.3", "256.1.1.1", "01.2.3.4"]), "ipv6": (["::1", "2001:db8::1", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1::"], [":::", "1:2:3", "1::2::3"]),
    "uuid": (["123e4567-e89b-12d3-a456-426614174000"], ["123e4567-e89b-92d3-a456-426614174000", "x"]), "email": (["a@b.example"], ["a@", "@b", "a b@c.example"]), "hostname": (["a.example"], ["-a.example", ""]),
    "uri": (["http://a.example:80/x", "urn:a"], ["http://a.example:70000/", "nothing"]), "byte": (["YWI=", ""], ["YWI", "Y"]), "json-pointer": (["", "/a~1b"], ["a", "/~2"]), "uri-template": (["/a/{b}"], ["/a/{b"]), "relative-json-pointer": (["0#", "1/a"], ["/a"]),
}


def test_formats(spark):
    rows = [(f, s, good) for f, pair in FORMATS.items() for good, texts in ((True, pair[0]), (False, pair[1])) for s in texts]
    df = spark.createDataFrame(rows, "f string, s string, good boolean")
    for f in FORMATS:
        bad = df.where(F.col("f") == f).withColumn("got", F.coalesce(formats.STRING[f](F.col("s")), F.lit(False))).where("got <> good").collect()
        assert not bad, bad


def test_coercion(spark):
    df = spark.createDataFrame([("007",), ("+5",), ("5.0",), (" 5 ",), ("yes",), ("1e400",), ("9" * 30,), ("1.5e2",)], "s string")
    got = {r.s: (r.i, r.n, r.b) for r in df.select("s", coercion.to_integer(F.col("s")).alias("i"), coercion.to_number(F.col("s")).alias("n"), coercion.to_boolean(F.col("s")).alias("b")).collect()}
    assert got["007"][0] == 7 and got["+5"][0] == 5 and got["5.0"][0] is None and got[" 5 "] == (None, None, None)
    assert got["yes"][2] is True and got["1e400"][1] is None and got["9" * 30][0] is None and got["1.5e2"][1] == 150.0


def test_decoders(spark):
    events = ": hi\r\nevent: add\r\ndata: {\"a\":1}\r\ndata: \r\nid: 7\r\n\r\ndata: x\n\n"
    body = "--B\r\nContent-Type: text/plain\r\nX-A: 1\r\n\r\nhello\r\n--B--\r\n"
    row = spark.createDataFrame([(events, body, "﻿{\"a\":1}\n\n[2]\r\n", "\x1e{}\n\x1e[1]", "a=1&b=x+y&a=%41", "<r k='1'><c>2</c><c>3</c></r>")], "e string, m string, l string, s string, f string, x string").select(
        decoders.server_events(F.col("e")).alias("e"), decoders.multipart(F.col("m"), F.lit("multipart/form-data; boundary=B")).alias("m"), decoders.json_lines(F.col("l")).alias("l"),
        decoders.json_seq(F.col("s")).alias("s"), decoders.form_body(F.col("f")).alias("f"), decoders.xml_json(F.col("x")).alias("x"),
    ).first()
    assert [(e.event, e.data, e.id) for e in row.e] == [("add", '{"a":1}\n', "7"), ("message", "x", None)]
    assert row.m[0].content == "hello" and row.m[0].headers == {"content-type": "text/plain", "x-a": "1"}
    assert row.l == ['{"a":1}', "[2]"] and row.s == ["{}", "[1]"]
    assert json.loads(row.f) == {"a": ["1", "A"], "b": "x y"} and json.loads(row.x) == {"@k": "1", "c": ["2", "3"]}


PETS = (Path(__file__).parent / "data" / "pets.yaml").read_text()
REQUEST = "method string, path string, query string, headers map<string,array<string>>, cookie string, content_type string, body string"


def test_requests(spark):
    c = Contract.from_text(PETS)
    k = {"x-key": ["s"]}
    rows = [
        ("GET", "/v1/pets", "limit=5&tags=ab&tags=c", k, None, None, None), ("GET", "/pets", "limit=500", k, None, None, None), ("GET", "/pets", "", k, None, None, None), ("GET", "/pets/7", "", k, None, None, None), ("GET", "/pets/x", "", k, None, None, None),
        ("GET", "/pets/mine", "", k, None, None, None), ("POST", "/pets", "", k, None, "application/json", '{"name":"a"}'), ("POST", "/pets", "", k, None, "application/json; charset=utf-8", '{"id":1}'), ("POST", "/pets", "", k, None, "text/plain", "x"), ("PUT", "/pets", "", k, None, None, None), ("GET", "/pets/mine", "", {}, None, None, None),
    ]
    got = plans.validate_requests(spark.createDataFrame(rows, REQUEST), c, security=True).collect()
    assert [r.operation for r in got] == ["list", "list", "list", "one", "one", "mine", "make", "make", "make", None, "mine"]
    assert [sorted(v.keyword for v in r.violations) for r in got] == [[], ["maximum"], ["parameter"], [], ["type"], [], [], ["readOnly", "required"], ["mediaType"], ["route"], ["security"]]


def test_lines_are_trimmed_of_blanks_alone(spark):
    assert spark.range(1).select(decoders.json_lines(F.lit("0\n 1 \n \n3\n")).alias("l")).first().l == ["0", "1", "3"]


def test_parts_over_the_limits_are_told(spark):
    many = "&".join(["a=1"] * 1000 + ["b=2"])
    row = spark.createDataFrame([(many, "--B\r\n\r\nx\r\n" * 1001 + "--B--")], "q string, m string").select(
        F.size(decoders.pairs(F.col("q"))).alias("n"), F.get(decoders.pairs(F.col("q")), F.lit(1000))["value"].alias("last"), F.size(decoders.multipart(F.col("m"), F.lit("multipart/form-data; boundary=B"))).alias("parts")
    ).first()
    assert tuple(row) == (1001, "2", 1001)
    array = {"type": "array", "items": {"type": "integer"}, "maxItems": 5000}
    c = Contract.api("3.1.0", {"paths": {"/p": {"post": {
        "parameters": [{"name": "ids", "in": "query", "explode": False, "schema": array}, {"name": "x-ids", "in": "header", "schema": array}],
        "requestBody": {"content": {k: {"schema": {"type": ["object", "array"]}} for k in ("application/x-www-form-urlencoded", "multipart/form-data")}},
        "responses": {"200": {"headers": {"x-ids": {"schema": array}}}},
    }}}})
    ids, form, parts = ",".join(["1"] * 1001), "application/x-www-form-urlencoded", "--B\r\n\r\nx\r\n" * 1001 + "--B--"
    few = ",".join(["1"] * 1000)
    rows = [
        (many, {}, None, None, None), ("&".join(["a=1"] * 1000), {}, "; ".join(["c=1"] * 100), None, None), ("", {}, "; ".join(["c=1"] * 101), None, None), (f"ids={ids}", {}, None, None, None), (f"ids={few}", {"x-ids": [few]}, None, None, None),
        ("", {"x-ids": [ids]}, None, None, None), ("", {}, None, form, many), ("", {}, None, form, "a=1"), ("", {}, None, "multipart/form-data; boundary=B", parts),
    ]
    got = plans.validate_requests(spark.createDataFrame([("POST", "/p", *r) for r in rows], REQUEST), c).collect()
    assert [[(v.keyword, v.data_path) for v in r.violations] for r in got] == [[("pairs", "query")], [], [("pairs", "cookie")], [("items", "query/ids")], [], [("items", "header/x-ids")], [("parts", "body")], [], [("parts", "body")]]
    sent = spark.createDataFrame([("POST", "/p", 200, {"x-ids": [x]}, None, None) for x in (few, ids)], "method string, path string, status int, response_headers map<string,array<string>>, content_type string, body string")
    assert [[v.keyword for v in r.violations] for r in plans.validate_responses(sent, c).collect()] == [[], ["items"]]


def test_responses(spark):
    c = Contract.from_text(PETS)
    rows = [("GET", "/pets", 200, {"x-n": ["3"]}, "application/json", '[{"name":"a"}]'), ("GET", "/pets", 200, {}, "application/json", "[{}]"), ("GET", "/pets", 404, {}, None, None), ("GET", "/pets", 500, {}, None, None), ("POST", "/pets", 201, {}, "application/jsonl", '{"name":"a"}\n{}\n{')]
    got = plans.validate_responses(spark.createDataFrame(rows, "method string, path string, status int, response_headers map<string,array<string>>, content_type string, body string"), c).collect()
    assert [sorted(v.keyword for v in r.violations) for r in got] == [[], ["header", "required"], [], ["status"], ["json", "required"]]


def test_contract_guards(tmp_path):
    with pytest.raises(ContractError):
        Contract.api("2.0.0", {})
    with pytest.raises(ContractError):
        parse("[" * 200 + "]" * 200, "json")
    with pytest.raises(ContractError):
        Contract.of({"a": {"$ref": "#/b"}, "b": {"$ref": "#/a"}}).resolve("#/a")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "u.yaml").write_text("U: {type: string}")
    (tmp_path / "out.yaml").write_text("U: {}")
    c = Contract({}, base=str(tmp_path / "in"))
    assert c.schema("u.yaml#/U") == {"type": "string"}
    with pytest.raises(ContractError):
        c.resolve("../out.yaml#/U")
    old = Contract.api("3.0.0", {})
    assert old.schema({"minimum": 1, "exclusiveMinimum": True}) == {"exclusiveMinimum": 1}
    r = Registry().register("a", "1.9", c).register("a", "1.10", old)
    assert r.get("a") is old and len(r) == 2 and "a" in r


def test_links_webhooks_reports(spark):
    c = Contract.api("3.1.0", {"webhooks": {"w": {"post": {}}}, "components": {"callbacks": {"cb": {"{$request.body#/u}": {"post": {}}}}}})
    assert ("w", "post") in c.webhooks() and ("cb", "post") in c.callbacks()
    df = spark.createDataFrame([("w", "POST", '{"u":{"v":[5]}}')], "name string, method string, body string")
    row = df.select(routing.named_operation(c.webhooks(), F.col("name"), F.col("method")).alias("w"), routing.link_value("$request.body#/u/v/0", {"body": F.col("body")}).alias("l")).first()
    assert row.w and row.l == "5"
    found = plans.validate(df, "body", {"required": ["x"]}).select(plans.simple_report(F.col("violations")).alias("s"), plans.json_report(F.col("violations")).alias("j")).first()
    assert found.s == "[/x] x is missing" and json.loads(found.j)["count"] == 1


def test_stream(spark, tmp_path):
    from tablepact.streaming.conformance import conformance_rate, validate_stream

    spark.createDataFrame([("2024-01-01 00:10:00", '{"a":1}'), ("2024-01-01 00:20:00", "{}")], "ts string, body string").selectExpr("timestamp(ts) ts", "body").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, body string").parquet(str(tmp_path / "in"))
    q = conformance_rate(validate_stream(stream, "body", {"required": ["a"]}), "ts").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("rates").select("n_rows", "n_valid").collect() == [(2, 1)]


def test_deprecated_fields_are_told_by_place():
    schema = {"properties": {"example": {"type": "string", "nullable": True}, "n": {"exclusiveMinimum": True, "exclusiveMaximum": 3, "xml": {"attribute": True, "name": "n"}}}, "default": {"nullable": True}, "x-own": {"nullable": True}}
    parts = {
        "paths": {"/p": {"get": {"parameters": [{"name": "q", "in": "query", "allowEmptyValue": True, "example": 1, "schema": {"nullable": False}}], "responses": {"200": {"headers": {"nullable": {"allowEmptyValue": True, "example": 1}}, "content": {"application/json": {"example": 1, "schema": {"example": None}}}}}}}},
        "components": {"schemas": {"S": schema}},
    }
    told = Contract.api("3.2.0", parts).deprecations()
    assert told == sorted([
        "/components/schemas/S/properties/example/nullable", "/components/schemas/S/properties/n/exclusiveMinimum", "/components/schemas/S/properties/n/xml/attribute",
        "/paths//p/get/parameters/0/allowEmptyValue", "/paths//p/get/responses/200/headers/nullable/allowEmptyValue", "/paths//p/get/responses/200/content/application/json/example",
    ])
    assert Contract.api("3.1.0", parts).deprecations() == [] and Contract.of({"nullable": True}).deprecations() == []


def test_files_refer_to_files_by_their_own_place(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    (tmp_path / "api.json").write_text(json.dumps({"$defs": {"A": {"$ref": "parts/a.yaml#/A"}}}))
    (tmp_path / "parts/a.yaml").write_text("A: {$ref: './more/../b.json#/B'}\n")
    (tmp_path / "parts/b.json").write_text('{"B": {"minimum": 3}}')
    c = Contract.from_file(str(tmp_path / "api.json"))
    df = spark.createDataFrame([("2",), ("3",)], "t string")
    assert [r.valid for r in plans.validate(df, "t", "#/$defs/A", c).collect()] == [False, True]


def test_array_styles(spark):
    from tablepact.operators import parameters

    def items(raw, style, explode=False):
        return spark.range(1).select(parameters.split_style(F.lit(raw), style, explode, "p")).first()[0]

    assert items("", "simple") == [] and items(" a", "simple") == [" a"] and items(" a,\tb", "simple") == ["a", "b"]
    assert items(".", "label") == [] and items(".a. b", "label", True) == ["a", "b"] and items(".a.b", "label") == ["a.b"]
    assert items(";p=a;p=b", "matrix", True) == ["a", "b"] and items(";p=", "matrix") == []
    assert items("a | b", "pipeDelimited") == ["a ", " b"] and items("a, b", "form") == ["a", " b"] and items(None, "simple") is None
