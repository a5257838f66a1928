"""The two lanes on generated schemas and values; limits, parameters, webhooks, coercion, warnings, routing of many paths."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tablepact.functions import formats
from tablepact.functions.value_formats import VALUE
from tablepact.operators import parameters, routing
from tablepact.operators.interpreter import Interpreter, equality_key, json_equal
from tablepact.operators.schema import Compiler
from tablepact.operators.values import Variant
from tablepact.plans import validate as plans
from tablepact.sources import decoders
from tablepact.sources.contract import ROOT_KEY, Contract, ContractError, parse

R = random.Random(3)
SCALARS = [None, True, False, 0, 1, 3, -2, 1.0, 2.5, 1e300, 1e20, 2**53 + 1, 2**53, "", "a", "abc", "😀", "2024-02-29", "a@b.example", "12"]


def value(depth=2):
    roll = R.random()
    if depth == 0 or roll < 0.4:
        return R.choice(SCALARS)
    if roll < 0.7:
        return [value(depth - 1) for _ in range(R.randrange(4))]
    return {k: value(depth - 1) for k in R.sample("abcx", R.randrange(4))}


def schema(depth=2):
    if R.random() < 0.08:
        return R.choice([True, False, {}])
    options = {
        "type": lambda: R.choice(["integer", "number", "string", "boolean", "null", "array", "object", ["string", "integer"], ["object", "null"]]), "minimum": lambda: R.choice([0, 1, 2.5, 2**53 + 1]), "exclusiveMaximum": lambda: R.choice([1, 3, 2**53 + 1]),
        "multipleOf": lambda: R.choice([1, 2, 0.5]), "enum": lambda: R.sample([None, 1, "a", True, "abc", 2.5], 3), "const": lambda: R.choice([1, "a", None, True, False]), "minLength": lambda: R.randrange(3), "maxLength": lambda: R.randrange(3), "pattern": lambda: R.choice(["^a", "b", r"^\d+$"]),
        "required": lambda: R.sample("abx", 2), "minProperties": lambda: R.randrange(3), "maxProperties": lambda: R.randrange(3), "minItems": lambda: R.randrange(3), "maxItems": lambda: R.randrange(3), "uniqueItems": lambda: True,
    }
    if depth:
        sub = lambda: schema(depth - 1)
        options |= {
            "properties": lambda: {k: sub() for k in R.sample("abx", 2)}, "additionalProperties": lambda: R.choice([False, sub()]), "patternProperties": lambda: {"^[ab]$": sub()}, "propertyNames": lambda: {"maxLength": R.randrange(2)}, "dependentSchemas": lambda: {"a": sub()},
            "items": sub, "prefixItems": lambda: [sub()], "contains": sub, "allOf": lambda: [sub(), sub()], "anyOf": lambda: [sub(), sub()], "oneOf": lambda: [sub(), sub()], "not": sub, "if": sub, "then": sub, "else": sub,
        }
    made = {k: options[k]() for k in R.sample(sorted(options), R.randrange(1, 4))}
    if R.random() < 0.15:
        made |= {"type": "string", "format": R.choice(sorted(formats.STRING))}
    return made


def test_lanes_agree_on_generated_cases(spark):
    schemas, values = [schema() for _ in range(60)], [value() for _ in range(60)] + SCALARS
    texts = [json.dumps(v) for v in values]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("v", F.parse_json("text"))
    for at in range(0, 60, 12):
        some = schemas[at : at + 12]
        made = [Compiler().valid(s, Variant(F.col("v"))).alias(f"a{k}") for k, s in enumerate(some)] + [(F.size(Compiler().violations(s, Variant(F.col("v")))) == 0).alias(f"b{k}") for k, s in enumerate(some)]
        for r in df.select("i", *made).collect():
            for k, s in enumerate(some):
                want = not Interpreter(Contract({})).check(s, json.loads(texts[r.i]))
                assert (r[f"a{k}"], r[f"b{k}"]) == (want, want), (s, texts[r.i], r[f"a{k}"], r[f"b{k}"], want)


def test_formats_agree_between_lanes(spark):
    some = ["", "2024-02-29", "2023-02-29", "0000-01-01", "12:00:00Z", "23:59:60Z", "24:00:00Z", "2024-02-29T12:00:00+02:00", "P1D", "PT1.5S", "P2W", "PT", "a@b.example", "a@b.12", f"{'l' * 65}@b.example", f"{'l' * 64}@b.example", '"q q"@b.example', "a@[1.2.3.4]", "a.example", "-a", "x" * 64, "1.2.3.4", "256.1.1.1", "01.2.3.4", "::1", "2001:db8::1", ":::", "1::2::3", "::ffff:1.2.3.4", "fe80::1%eth0", "http://a.example:80/x", "http://a.example:70000/", "urn:a", "urn:", "/x{y}", "a b", "//h/^", "/a/{b}", "/a/{b", "x y {b}", "00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff", "123e4567-e89b-12d3-a456-426614174000", "123e4567-e89b-92d3-a456-426614174000", "YWI=", "YWI", "_-8=", "/a~1b", "/~2", "0#", "1/a", "é.example"]
    df = spark.createDataFrame(list(enumerate(some)), "i int, s string")
    rows = df.select("s", *(F.coalesce(f(F.col("s")), F.lit(False)).alias(name) for name, f in formats.STRING.items())).collect()
    for r in rows:
        for name in formats.STRING:
            assert bool(VALUE[name](r.s)) == r[name], (name, r.s, r[name])


def test_large_integers_whole_doubles_and_repeated_keys(spark):
    df = spark.createDataFrame([("1e300",), ("100000000000000000000",), ("1.5",), ("9007199254740993",), ('{"a":1,"a":2}',)], "text string")
    for lane in ("native", "python"):
        assert [r.valid for r in plans.validate(df, "text", {"type": "integer"}, lane=lane).collect()] == [True, True, False, True, False]
        assert [r.valid for r in plans.validate(df.where("text like '9007%'"), "text", {"maximum": 9007199254740992}, lane=lane).collect()] == [False]


def test_unique_items_by_key():
    values = [value() for _ in range(300)] + [1, 1.0, True, "1", [1], [1.0], {"a": 1, "b": 2}, {"b": 2, "a": 1.0}, 2**53 + 1, 2**53 + 2]
    assert all(json_equal(a, b) == (equality_key(a) == equality_key(b)) for a in values[-60:] for b in values)
    assert Interpreter(Contract({})).check({"uniqueItems": True}, [*map(str, range(10_000)), "7"]) and not Interpreter(Contract({})).check({"uniqueItems": True}, [*map(str, range(10_000))])


def test_additional_properties_beyond_the_listed_ones_are_told(spark):
    df = spark.createDataFrame([(json.dumps({f"k{i}": 1 for i in range(n)}),) for n in (100, 130)], "text string")
    got = plans.validate(df, "text", {"additionalProperties": False}).collect()
    assert [len(r.violations) for r in got] == [100, 101] and got[1].violations[-1].message == "30 more aren't allowed"


def test_a_discriminator_without_a_name(spark):
    c = Contract.api("3.2.0", {"paths": {}, "components": {"schemas": {"A": {"required": ["a"]}, "D": {"discriminator": {"defaultMapping": "A"}}, "E": {"discriminator": {}}}}})
    df = spark.createDataFrame([('{"a":1}',), ("{}",)], "text string")
    for lane in ("native", "python"):
        assert [[r.valid for r in plans.validate(df, "text", f"#/components/schemas/{n}", c, lane=lane).collect()] for n in "DE"] == [[True, False], [True, True]]


def test_many_routes(spark):
    paths = {f"/r{i}/{{id}}/x": {"get": {"operationId": f"p{i}"}} for i in range(500)} | {f"/r{i}/me/x": {"get": {"operationId": f"l{i}"}} for i in range(500)} | {"/{a}/{b}/x": {"get": {"operationId": "any"}}, "/files/{+rest}": {"get": {"operationId": "files"}}}
    c = Contract.api("3.1.0", {"paths": paths})
    df = spark.createDataFrame([("GET", "/r7/5/x", "p7"), ("GET", "/r7/me/x", "l7"), ("get", "/zz/5/x", "any"), ("GET", "/files/a/b/c", "files"), ("GET", "/r7/5", None), ("POST", "/r7/5/x", None), ("GET", "/r499/q/x", "p499"), ("GET", None, None)], "m string, p string, want string")
    got = df.select("want", routing.operation_name(c, routing.match_route(c, F.col("m"), F.col("p"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_bodies_by_media_type(spark):
    node = {"webhooks": {"w": {"post": {"requestBody": {"required": True, "content": {k: {"schema": {}} for k in ("multipart/form-data", "application/xml", "application/json")} | {"application/jsonl": {"itemSchema": {"minimum": 1}}}}}}, "r": {"post": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/N"}}}}}}}, "components": {"schemas": {"N": {"properties": {"next": {"$ref": "#/components/schemas/N"}, "v": {"type": "integer"}}, "unevaluatedProperties": False}}}}
    c = Contract.api("3.1.0", node)
    big = "x" * (11 << 20)
    rows = [("w", "POST", "multipart/form-data; boundary=B", f"--B\r\n\r\n{big}\r\n--B--"), ("w", "POST", "application/json", f'"{big}"'), ("w", "POST", "application/xml", f"<a>{big[: 2 << 20]}</a>"), ("w", "POST", "application/jsonl", "2\n" + " " * 9 + '"' + "y" * (2 << 20) + '"'), ("w", "POST", "application/json", None), ("r", "POST", "application/json", '{"next":{"next":{"v":"x"}}}'), ("r", "POST", "application/json", '{"next":{"w":1}}'), ("r", "POST", "application/json", '{"next":{"v":1}}'), ("gone", "POST", None, None)]
    got = plans.validate_webhooks(spark.createDataFrame(rows, "name string, method string, content_type string, body string"), c).collect()
    assert [[v.keyword for v in r.violations] for r in got[:5]] == [[], ["body"], ["body"], ["records"], ["body"]]
    assert [sorted(v.keyword for v in r.violations) for r in got[5:]][:1] == [["type"]] or "type" in [v.keyword for v in got[5].violations]
    assert not got[6].valid and got[7].valid and [v.keyword for v in got[8].violations] == ["name"] and got[5].violations[0].data_path.startswith("body/next")


def test_coerced_bodies_and_whole_queries(spark):
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "l": {"type": "array", "items": {"type": "number"}}, "o": {"type": "object", "properties": {"b": {"type": ["boolean", "null"]}}}, "s": {"type": "string"}}}
    c = Contract.api("3.2.0", {"paths": {"/p": {"post": {"parameters": [{"name": "q", "in": "querystring", "required": True, "content": {"application/json": {"schema": {"required": ["a"]}}}}], "requestBody": {"content": {"application/json": {"schema": schema}}}}}}})
    body = '{"n":"7","l":["1.5",2],"o":{"b":"yes","x":"1"},"s":"5"}'
    rows = [("POST", "/p", '{"a":1}', {}, None, "application/json", body), ("POST", "/p", "%7B%22a%22:1%7D", {}, None, "application/json", '{"n":"x"}'), ("POST", "/p", "", {}, None, None, None), ("POST", "/p", "nothing", {}, None, None, None)]
    df = spark.createDataFrame(rows, "method string, path string, query string, headers map<string,array<string>>, cookie string, content_type string, body string")
    assert [[v.keyword for v in r.violations] for r in plans.validate_requests(df, c, coerce_bodies=True).collect()] == [[], ["type"], ["parameter"], ["json"]]
    assert len(plans.validate_requests(df.limit(1), c).first().violations) == 3
    with pytest.raises(ContractError):
        plans.querystring_violations(c, Compiler(c), {"name": "q", "in": "querystring", "schema": {}}, F.lit(""))


def test_cookies_nested_keys_and_warnings(spark):
    row = spark.range(1).select(parameters.cookie_pairs(F.lit("a=1+2; b=%2B")).alias("c"), decoders.nested_pairs(decoders.pairs(F.lit("a[b][]=1&x=2&a[=3&a[b]c=4"))).alias("n")).first()
    assert [(p.name, p.value) for p in row.c] == [("a", "1+2"), ("b", "+")]
    assert [(list(p.path), p.value) for p in row.n] == [(["a", "b", ""], "1"), (["x"], "2"), (["a["], "3"), (["a[b]c"], "4")]
    df = spark.createDataFrame([('{"a":1,"l":[{"b":2},{}]}',), ("[]",), (None,)], "text string")
    got = df.select(plans.warnings(df, "text", {"properties": {"a": {"deprecated": True}, "l": {"items": {"properties": {"b": {"deprecated": True}}}}}}).alias("w")).collect()
    assert [[v.data_path for v in r.w] for r in got] == [["/a", "/l/0/b"], [], []]


def test_deep_objects(spark):
    cases = {
        "f[a]=1&f[b]=x": {"a": "1", "b": "x"}, "f[a][b][c]=v&g=1&f[a][d]=w": {"a": {"b": {"c": "v"}, "d": "w"}}, "f[a][]=1&f[a][]=2": {"a": ["1", "2"]}, "f[]=1&f[]=2": ["1", "2"], "f[0]=x&f[1][k]=y": ["x", {"k": "y"}],
        "f[][a]=1&f[][a]=2": [{"a": "1"}, {"a": "2"}], "f[a][b]=1&f[a]=2": {"a": "2"}, "f[a]=1&f[a][b]=2": {"a": {"b": "2"}}, "f[a]=1&f[a]=2": {"a": "2"}, "f=x": ["x"], "f=x&f=y": ["x", "y"], "f[a]=1&f=x": ["x"],
        "f%5Ba%5D=%22+%C3%A9": {"a": '" \u00e9'}, "g[a]=1": None, "": None, "f[a]=1&f[][]=2": {"a": "1", "0": ["2"]}, "f[1]=x&f[0]=y": {"1": "x", "0": "y"},
    }
    rows = spark.createDataFrame([(q,) for q in [*cases, None]], "q string").repartition(1)
    got = {r.q: r.o and json.loads(r.o) for r in rows.select("q", decoders.deep_object(decoders.pairs(F.col("q")), "f").alias("o")).collect()}
    assert got == cases | {None: None}


def test_deep_objects_follow_their_schema(spark):
    schema = {"type": "object", "required": ["n"], "additionalProperties": False, "properties": {"n": {"type": "integer", "maximum": 9}, "s": {"type": "string"}, "o": {"type": "object", "properties": {"on": {"type": "boolean"}, "l": {"type": "array", "items": {"type": "number"}}}}}}
    c = Contract.api("3.1.0", {"paths": {"/p": {"get": {"parameters": [{"name": "f", "in": "query", "style": "deepObject", "schema": schema}]}}}})
    cases = [
        ("f[n]=5&f[s]=7&f[o][on]=yes&f[o][l][]=1.5", []), ("f[n]=10", ["maximum"]), ("f[n]=x", ["type"]), ("f[n]=1&f[s][b]=v", ["type"]), ("f[n]=1&f[o][on]=maybe", ["type"]), ("f[n]=1&f[z]=1", ["additionalProperties"]), ("f[s]=a", ["required"]),
        ("f=x", ["type"]), ("", []), (None, []), ("f[n]=1&g" + "[a]" * 63 + "=1", []), ("f[n]=1&g" + "%5Ba%5D" * 64 + "=1", ["nesting"]),
    ]
    df = spark.createDataFrame([("GET", "/p", q, {}, None, None, None) for q, _ in cases], "method string, path string, query string, headers map<string,array<string>>, cookie string, content_type string, body string")
    assert [[v.keyword for v in r.violations] for r in plans.validate_requests(df.repartition(1), c).collect()] == [want for _, want in cases]


def test_callbacks_by_path(spark):
    item = lambda n: {"post": {"requestBody": {"required": True, "content": {"application/json": {"schema": {"const": n}}}}}}
    own = {"c": {"/done": item(1), "/done/{id}": item(2), "https://h.example/abs?x=1": item(3), "{$request.body#/u}": item(4)}, "hidden": {"/x": item(5)}}
    c = Contract.api("3.1.0", {"paths": {"/p": {"post": {"callbacks": own}}, "/q": {"post": {"callbacks": {"c": {"/done": item(6)}}}}}, "components": {"callbacks": {"hidden": {"/y": item(7)}}}})
    cases = [
        ("c", "POST", "/done", "6", []), ("c", "POST", "/done", "1", ["const"]), ("c", "post", "/done/8", "2", []), ("c", "POST", "/abs", "3", []), ("c", "POST", "/else", "4", ["callback"]), ("c", "GET", "/done", "6", ["name"]),
        ("hidden", "POST", "/x", "5", ["name"]), ("hidden", "POST", "/y", "7", []), ("gone", "POST", "/y", "7", ["name"]), ("hidden", "POST", None, "7", ["name"]),
    ]
    df = spark.createDataFrame([(*x[:3], "application/json", x[3]) for x in cases], "name string, method string, path string, content_type string, body string")
    assert [[v.keyword for v in r.violations] for r in plans.validate_callbacks(df, c).collect()] == [x[4] for x in cases]
    assert plans.validate_callbacks(df, c, strict_templates=False).collect()[4].valid
    assert [r.valid for r in plans.validate_callbacks(df.drop("path"), c).collect()][:2] == [True, False]


def test_documents_are_guarded(tmp_path):
    deep = "a: &a0 [x]\n" + "".join(f"b{i}: &a{i + 1} [*a{i}]\n" for i in range(12))
    with pytest.raises(ContractError):
        parse(deep, "yaml")
    assert parse("a: &a [x]\nb: *a", "yaml") == {"a": ["x"], "b": ["x"]}
    with pytest.raises(ContractError):
        Compiler().valid({"pattern": "^(a+)+$"}, Variant(F.col("v")))
    (tmp_path / "c.json").write_text(json.dumps({ROOT_KEY: "3.1.0", "paths": {}}))
    (tmp_path / "c.yaml").write_text(f"{ROOT_KEY}: 3.1.0\npaths: {{}}")
    assert Contract.from_file(str(tmp_path / "c.json")).document == Contract.from_file(str(tmp_path / "c.yaml")).document
