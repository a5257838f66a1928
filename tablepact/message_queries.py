"""Queries of formats, references, bodies, parameters, requests, responses and reports, with their SQL for DuckDB.

Each makes a message or a value of every event and gives what the engine says of it, in one projection over the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import coercion
from .functions.formats import CUSTOM, register_format
from .operators import parameters, routing
from .operators.schema import Compiler
from .operators.values import Typed, Variant
from .plans import validate as plans
from .sources import decoders
from .sources.contract import Contract

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def projected(name: str, build: Callable[[], Column], sql: str, out: str = "value") -> None:
    """A query of one column made of each event."""
    _queries[name] = lambda spark, sf_dir: events(spark, sf_dir).select("event_id", build().alias(out))
    _sql[name] = f"SELECT event_id, {sql} AS {out} FROM events"


def text_format(name: str, derive: Callable[[], Column], sql: str, kind: str = "string") -> None:
    projected(f"format_{name.replace('-', '_')}", lambda: Compiler().valid({"type": kind, "format": name}, Typed(derive(), T.StringType())), sql, "valid")


def of_text(name: str, schema: Any, derive: Callable[[], Column], sql: str, contract: Contract | None = None, **options) -> None:
    """A query of JSON texts against a schema, by the lane that the schema asks for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plans.validate(events(spark, sf_dir).select("event_id", derive().alias("t")), "t", schema, contract, **options).select("event_id", "valid")

    _queries[name] = run
    _sql[name] = f"SELECT event_id, {sql} AS valid FROM events"


ID = lambda: F.col("event_id").cast("string")
N = lambda k: F.col("event_id") % k
S = lambda k: N(k).cast("string")
CASE = lambda k, *texts: F.element_at(F.array(*map(F.lit, texts)), (N(k) + 1).cast("int"))


# formats

text_format("hostname", lambda: F.concat(F.lit("h"), S(100), F.when(N(6) == 0, ".-bad").otherwise(".example"), F.lit(".org")), "event_id % 6 <> 0")
text_format("idn-hostname", lambda: F.concat(CASE(5, "b_x", "bücher", "b", "例え", "x-y"), F.lit(".example")), "event_id % 5 <> 0")
text_format("idn-email", lambda: F.concat(F.lit("jörg"), ID(), F.when(N(3) == 0, "@nodot").otherwise("@exämple.org")), "event_id % 3 <> 0")
text_format("uri-reference", lambda: CASE(4, "/a b", "../x?y={z}", "http://h.example:8080/", "#f"), "event_id % 4 <> 0")
text_format("iri", lambda: F.concat(F.lit("http://exämple.org:"), (F.col("event_id") * 7919 % 100000).cast("string"), F.lit("/é")), "event_id * 7919 % 100000 <= 65535")
text_format("iri-reference", lambda: CASE(3, "/ä ö", "/ä/ö", "?q=é"), "event_id % 3 <> 0")
text_format("uri-template", lambda: F.concat(F.lit("/a b/{"), CASE(3, "b c", "b", "+b*,c:3"), F.lit("}")), "event_id % 3 <> 0")
text_format("byte", lambda: F.concat(F.base64(F.encode(ID(), "utf-8")), F.when(N(2) == 1, "x").otherwise("")), "event_id % 2 = 0")
text_format("binary", ID, "TRUE")
text_format("password", ID, "TRUE")
text_format("relative-json-pointer", lambda: F.concat(F.when(N(2) == 0, S(10)).otherwise("-1"), F.lit("/a")), "event_id % 2 = 0")
of_text("format_regex", {"type": "string", "format": "regex"}, lambda: CASE(3, '"(a"', '"(a)"', '"[a-z]+"'), "event_id % 3 <> 0")
FIELD = lambda value: F.concat(F.lit('{"v":'), value, F.lit("}"))
of_text("format_int32", {"properties": {"v": {"type": "integer", "format": "int32"}}}, lambda: FIELD((F.col("event_id") * 10000019).cast("string")), "event_id * 10000019 <= 2147483647")
of_text("format_int64", {"properties": {"v": {"type": "integer", "format": "int64"}}}, lambda: FIELD(F.concat(F.lit("1"), ID(), F.when(N(3) == 0, ".5").otherwise("000"))), "event_id % 3 <> 0")
for _kind in ("float", "double"):
    of_text(f"format_{_kind}", {"properties": {"v": {"type": "number", "format": _kind}}}, lambda: FIELD(F.concat(S(10), F.when(N(2) == 1, ".5").otherwise(""))), "event_id % 2 = 1")


def custom_format() -> Column:
    """A format that the user brings; known while the expression is made."""
    register_format("string", "even-digits", lambda s: s.rlike(r"^(?:\d\d)+\z"))
    try:
        return Compiler().valid({"type": "string", "format": "even-digits"}, Typed(ID(), T.StringType()))
    finally:
        CUSTOM.pop(("string", "even-digits"))


projected("custom_format", custom_format, "length(CAST(event_id AS VARCHAR)) % 2 = 0", "valid")

# keywords, references and composition

of_text("json_equality", {"enum": [[1, 2], {"a": 1, "b": None}, "x"]}, lambda: CASE(5, "[1,2]", "[2,1]", '{"b":null,"a":1}', '{"a":1}', '"x"'), "event_id % 5 IN (0, 2, 4)")
of_text("content_encoding", {"type": "string", "contentEncoding": "base64"}, lambda: F.concat(F.lit('"'), F.base64(F.encode(ID(), "utf-8")), F.when(N(2) == 1, "x").otherwise(""), F.lit('"')), "event_id % 2 = 0")
of_text("content_media_type", {"type": "string", "contentMediaType": "application/json"}, lambda: CASE(3, '"{k"', '"{\\"k\\":1}"', '"[1]"'), "event_id % 3 <> 0")
of_text("write_only", {"properties": {"v": {"writeOnly": True}}}, lambda: CASE(2, '{"v":1}', '{"w":1}'), "event_id % 2 = 1", mode="response")
of_text("unevaluated_items", {"allOf": [{"prefixItems": [{"minimum": 3}]}], "unevaluatedItems": False}, lambda: CASE(3, "[5]", "[1]", "[5,6]"), "event_id % 3 = 0")
of_text(
    "annotations_of_branches",
    {"anyOf": [{"properties": {"a": {"const": 1}}, "required": ["a"]}, {"properties": {"b": True}, "required": ["b"]}], "unevaluatedProperties": False},
    lambda: CASE(4, '{"a":1}', '{"b":2}', '{"a":1,"c":1}', '{"a":2,"b":1}'), "event_id % 4 < 2",
)
PARTS = Contract.api("3.1.0", {"paths": {}, "components": {"schemas": {
    "Low": {"minimum": 10, "maximum": 50}, "Odd": {"not": {"multipleOf": 2}}, "List": {"type": "array", "items": {"$ref": "#/components/schemas/Low"}},
    "Node": {"properties": {"n": {"$ref": "#/components/schemas/Node"}, "v": {"maximum": 50}}},
    "C": {"properties": {"v": {"minimum": 10}}}, "Any": {"discriminator": {"propertyName": "t", "mapping": {"click": "#/components/schemas/C"}}, "properties": {"v": {"maximum": 90}}},
}}})
REF = lambda name: {"$ref": f"#/components/schemas/{name}"}
of_text("reference_siblings", REF("Low") | {"maximum": 30}, lambda: S(100), "event_id % 100 BETWEEN 10 AND 30", PARTS)
of_text("composed_references", {"allOf": [REF("Low"), REF("Odd")]}, lambda: S(100), "event_id % 100 BETWEEN 10 AND 50 AND event_id % 2 = 1", PARTS)
of_text("references_in_keywords", {"properties": {"v": REF("List")}}, lambda: FIELD(F.concat(F.lit("[20,"), S(100), F.lit("]"))), "event_id % 100 BETWEEN 10 AND 50", PARTS)
of_text("discriminator_alone", REF("Any"), lambda: F.concat(F.lit('{"t":"'), F.col("event_type"), F.lit('","v":'), S(100), F.lit("}")), "event_type = 'click' AND event_id % 100 BETWEEN 10 AND 90", PARTS)
of_text("recursive_reference", REF("Node"), lambda: F.concat(F.lit('{"n":{"n":'), FIELD(S(100)), F.lit("}}")), "event_id % 100 <= 50", PARTS)
of_text("nesting_limit", REF("Node"), lambda: F.when(N(10) == 0, F.concat(F.repeat(F.lit('{"n":'), 70), F.lit("{}"), F.repeat(F.lit("}"), 70))).otherwise('{"n":{}}'), "event_id % 10 <> 0", PARTS)

# bodies

projected("text_body", lambda: decoders.body_json(F.concat(F.lit('say "'), F.col("event_type"), F.lit('"')), F.lit("text/plain; charset=utf-8")), "'\"say \\\"' || event_type || '\\\"\"'")
projected("other_body", lambda: decoders.body_json(ID(), F.lit("application/octet-stream")), "'\"' || event_id || '\"'")
projected("form_body", lambda: decoders.body_json(F.concat(F.lit("id="), ID(), F.lit("&t=a+b&t=%C3%A9")), F.lit("application/x-www-form-urlencoded")), "'{\"id\":\"' || event_id || '\",\"t\":[\"a b\",\"é\"]}'")
PART = lambda name, value: F.concat(F.lit("--xx\r\nContent-Disposition: form-data; name="), F.lit(name), F.lit("\r\n\r\n"), value, F.lit("\r\n"))
projected(
    "multipart_parts",
    lambda: F.array_join(F.transform(decoders.multipart(F.concat(PART("a", ID()), PART("b", F.col("event_type")), F.lit("--xx--\r\n")), F.lit("multipart/form-data; boundary=xx")), lambda p: F.concat(F.try_element_at(p["headers"], F.lit("content-disposition")), F.lit("="), p["content"])), "|"),
    "'form-data; name=a=' || event_id || '|form-data; name=b=' || event_type",
)
projected("xml_body", lambda: decoders.body_json(F.concat(F.lit('<e id="'), ID(), F.lit('"><v>a</v><v>'), F.col("event_type"), F.lit("</v></e>")), F.lit("text/xml")), "'{\"@id\": \"' || event_id || '\", \"v\": [\"a\", \"' || event_type || '\"]}'")
projected("json_seq", lambda: F.array_join(decoders.json_seq(F.concat(F.lit("\x1e"), F.col("props"), F.lit("\n\x1e\n\x1e"), ID(), F.lit("\n"))), "|"), "props || '|' || event_id")
projected(
    "event_stream",
    lambda: F.array_join(F.transform(decoders.server_events(F.concat(F.lit(": hello\n\ndata: "), ID(), F.lit("\ndata: b\nretry: 5x\n\nevent: "), F.col("event_type"), F.lit("\nid: 7\ndata:c\n"))), lambda e: F.concat_ws("/", e["event"], e["data"], e["id"], e["retry"].cast("string"))), "|"),
    "'message/' || event_id || chr(10) || 'b|' || event_type || '/c/7'",
)
projected("streaming_media", lambda: decoders.is_streaming(CASE(4, "application/jsonl", "Text/Event-Stream; charset=utf-8", "application/json", "application/json-seq")), "event_id % 4 <> 2", "streams")
projected("xml_limit", lambda: decoders.too_large(F.when(N(1000) == 0, F.repeat(F.lit("a"), (1 << 20) + 1)).otherwise("a"), F.lit("application/xml")), "event_id % 1000 = 0", "over")
projected("record_limit", lambda: decoders.too_many(decoders.json_lines(F.repeat(F.lit("1\n\n"), N(6).cast("int"))), 3), "event_id % 6 > 3", "over")

# parameters

NONE = lambda: F.lit(None).cast("string")
HEADERS = lambda **named: F.create_map(*(x for k, v in named.items() for x in (F.lit(k.replace("_", "-")), F.array(v)))) if named else F.create_map().cast("map<string,array<string>>")
INTS = {"type": "array", "items": {"type": "integer"}}


def style(name: str, place: str, raw: Callable[[], Column], sql: str, explode: bool = False, schema: dict = INTS, **more: str) -> None:
    """A query of the parameter ``p``, which is written as ``raw`` at its place, as JSON text."""

    def build() -> Column:
        message = {"path": F.concat(F.lit("/x/"), raw()), "query": raw(), "cookie": raw(), "headers": HEADERS(p=raw())}
        return parameters.parameter_json({"in": place, "name": "p", "explode": explode} | more, schema, message, "^/x/([^/?#]+)$", ["p"])

    projected(name, build, sql)


LIST = "'[' || event_id || ',7]'"
style("style_simple", "path", lambda: F.concat(ID(), F.lit(", 7")), LIST)
style("style_simple_header", "header", lambda: F.concat(ID(), F.lit(",7")), LIST)
style("style_label", "path", lambda: F.concat(F.lit("."), ID(), F.lit(",7")), LIST, style="label")
style("style_label_exploded", "path", lambda: F.concat(F.lit("."), ID(), F.lit(".7")), LIST, True, style="label")
style("style_label_scalar", "path", lambda: F.concat(F.lit("."), ID()), "CAST(event_id AS VARCHAR)", schema={"type": "integer"}, style="label")
style("style_matrix", "path", lambda: F.concat(F.lit(";p="), ID(), F.lit(",7")), LIST, style="matrix")
style("style_matrix_exploded", "path", lambda: F.concat(F.lit(";p="), ID(), F.lit(";p=7")), LIST, True, style="matrix")
style("style_form", "query", lambda: F.concat(F.lit("q=1&p="), ID(), F.lit(",7")), LIST)
style("style_form_exploded", "query", lambda: F.concat(F.lit("p="), ID(), F.lit("&q=1&p=7")), LIST, True)
style("style_pipe", "query", lambda: F.concat(F.lit("p="), ID(), F.lit("|7")), LIST, style="pipeDelimited")
style("style_pipe_text", "query", lambda: F.concat(F.lit("p="), ID(), F.lit("+%7C+7")), "'[\"' || event_id || ' \",\" 7\"]'", True, {"type": "array", "items": {"type": "string"}}, style="pipeDelimited")
style("style_label_blank", "path", lambda: F.lit("."), "'[]'", style="label")
style("style_single_item", "header", lambda: F.concat(F.lit("a "), ID()), "'[\"a ' || event_id || '\"]'", schema={"type": "array", "items": {"type": "string"}})
style("style_form_repeated", "query", lambda: F.concat(F.lit("p="), ID(), F.lit("&p=7")), LIST)
style("style_space", "query", lambda: F.concat(F.lit("p="), ID(), F.lit("%207")), LIST, style="spaceDelimited")
style("style_cookie", "cookie", lambda: F.concat(F.lit("a=1; p="), ID(), F.lit(",7")), LIST, style="cookie")
style("style_of_place", "cookie", lambda: F.concat(F.lit("p="), ID(), F.lit("; p=7")), LIST, True)
projected(
    "item_limit",
    lambda: parameters.too_many_items({"in": "query", "name": "p", "explode": False}, INTS, {"query": F.concat(F.lit("p=1"), F.repeat(F.lit(",1"), N(1100).cast("int")))}, "", []),
    "event_id % 1100 + 1 > 1000", "over",
)
projected("pair_limit", lambda: decoders.too_many_pairs(F.concat(F.lit("a=1"), F.repeat(F.lit("&b=2"), N(1100).cast("int")))), "event_id % 1100 + 1 > 1000", "over")
projected("coerce_number", lambda: coercion.to_number(F.concat(S(100), CASE(4, "", ".25", "e2", "x"))), "CASE event_id % 4 WHEN 0 THEN CAST(event_id % 100 AS DOUBLE) WHEN 1 THEN event_id % 100 + CAST(0.25 AS DOUBLE) WHEN 2 THEN CAST(event_id % 100 * 100 AS DOUBLE) END")
projected("coerce_union", lambda: coercion.coerce_json(F.concat(S(10), CASE(3, "", ".5", "x")), ["integer", "number", "string"]), "CASE event_id % 3 WHEN 0 THEN CAST(event_id % 10 AS VARCHAR) WHEN 1 THEN (event_id % 10) || '.5' ELSE '\"' || (event_id % 10) || 'x\"' END")
projected("coerce_boolean_lenient", lambda: coercion.to_boolean(CASE(5, "YES", "off", "maybe", "", "0"), strict=False), "event_id % 5 IN (0, 2)")

# requests and responses

PET = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}}
SHOP = Contract.api("3.2.0", {
    "servers": [{"url": "https://{region}.example/{stage}", "variables": {"region": {"default": "eu"}, "stage": {"default": "v2", "enum": ["v1", "v2"]}}}],
    "paths": {
        "/pets/{id}": {
            "get": {"operationId": "read", "security": [{"token": []}, {"key": []}], "parameters": [
                {"name": "id", "in": "path", "required": True, "schema": {"type": "integer", "minimum": 100}},
                {"name": "page", "in": "query", "required": True, "schema": {"type": "integer", "maximum": 5}},
                {"name": "X-Trace", "in": "header", "schema": {"pattern": "^t"}},
            ], "responses": {"200": {"$ref": "#/components/responses/Pet"}, "4XX": {"content": {"application/jsonl": {"itemSchema": PET}}}, "default": {"description": ""}}},
            "put": {"operationId": "write", "requestBody": {"required": True, "content": {"application/json": {"schema": PET}, "text/*": {"schema": {"maxLength": 3}}}}},
            "additionalOperations": {"COPY": {"operationId": "copy"}},
        },
        "/pets": {"get": {"operationId": "list"}},
    },
    "components": {
        "responses": {"Pet": {"content": {"application/json": {"schema": PET}}}},
        "securitySchemes": {"token": {"type": "http", "scheme": "bearer"}, "key": {"type": "apiKey", "in": "query", "name": "key"}},
    },
})


def request(name: str, sql: str, *, path: Callable[[], Column] = lambda: F.lit("/pets/100"), query: Callable[[], Column] = lambda: F.lit("page=1"), method: str = "GET", headers: Callable[[], Column] = HEADERS, content_type: Callable[[], Column] = NONE, body: Callable[[], Column] = NONE, show: str = "valid", **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        verb = F.lit(method) if method != "*" else CASE(4, "GET", "put", "COPY", "DELETE")
        made = {"method": verb, "path": path(), "query": query(), "headers": headers(), "cookie": NONE(), "content_type": content_type(), "body": body()}
        rows = events(spark, sf_dir).select("event_id", *(v.alias(k) for k, v in made.items()))
        return plans.validate_requests(rows, SHOP, **options).select("event_id", show)

    _queries[name] = run
    _sql[name] = f"SELECT event_id, {sql} AS {show} FROM events"


request("path_parameters", "event_id % 1000 >= 100", path=lambda: F.concat(F.lit("/pets/"), S(1000)))
request("query_parameters", "event_id % 9 <= 5", query=lambda: F.concat(F.lit("page="), S(9)))
request("required_parameters", "event_id % 3 <> 0", query=lambda: CASE(3, "", "page=1", "q=2&page=2"))
request("header_parameters", "event_id % 4 <> 0", headers=lambda: F.when(N(4) == 3, HEADERS()).otherwise(HEADERS(x_trace=CASE(4, "x", "t1", "t2", ""))))
request("security", "event_id % 4 IN (0, 2)", headers=lambda: HEADERS(Authorization=CASE(4, "Bearer abc", "Basic abc", "", "bearer")), query=lambda: F.concat(F.lit("page=1"), F.when(N(4) == 2, "&key=k").otherwise("")), security=True)
request("request_body", "event_id % 100 <= 50 AND event_id % 7 <> 0", method="PUT", content_type=lambda: F.lit("application/json"), body=lambda: F.when(N(7) == 0, "").otherwise(F.concat(F.lit('{"k":'), S(100), F.lit("}"))))
request("media_types", "event_id % 4 <> 2", method="PUT", content_type=lambda: CASE(4, "Application/JSON ; charset=utf-8", "text/csv", "image/png", "text/plain"), body=lambda: F.when(N(4) == 0, '{"k":1}').otherwise("abc"))
request("body_coercion_lenient", "event_id % 100 <= 50", method="PUT", content_type=lambda: F.lit("application/json"), body=lambda: F.concat(F.lit('{"k":"'), S(100), F.lit('x"}')), coerce_bodies=True, strict=False)
request("method_lookup", "CASE event_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'copy' END", method="*", show="operation")
request("not_found", "event_id % 3 = 1", path=lambda: CASE(3, "/pets/", "/pets", "/pet"), query=lambda: F.lit(""))
request("request_checks", "event_id % 200 >= 100 AND event_id % 8 <= 5", path=lambda: F.concat(F.lit("/v2/pets/"), S(200)), query=lambda: F.concat(F.lit("page="), S(8)), headers=lambda: HEADERS(X_Trace=F.lit("t")))
projected("server_prefix", lambda: routing.strip_server(F.concat(CASE(3, "/v2", "/v1", "/v22"), F.lit("/pets/"), ID()), SHOP), "CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/v1' ELSE '/v22' END || '/pets/' || event_id", "path")
projected("server_variables", lambda: routing.strip_server(F.concat(CASE(2, "/v2", "/v1"), F.lit("/pets")), SHOP, stage="v1"), "CASE WHEN event_id % 2 = 0 THEN '/v2/pets' ELSE '/pets' END", "path")


def response(name: str, sql: str, status: Callable[[], Column], content_type: str, body: Callable[[], Column], **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir).select("event_id", F.lit("GET").alias("method"), F.lit("/pets/100").alias("path"), status().alias("status"), HEADERS().alias("response_headers"), F.lit(content_type).alias("content_type"), body().alias("body"))
        return plans.validate_responses(rows, SHOP, **options).select("event_id", "valid")

    _queries[name] = run
    _sql[name] = f"SELECT event_id, {sql} AS valid FROM events"


JSON_K = lambda: F.concat(F.lit('{"k":'), S(100), F.lit("}"))
response("response_references", "event_id % 100 <= 50", lambda: F.lit(200), "application/json", JSON_K)
response("response_body", "event_id % 2 = 0 OR event_id % 100 <= 50", lambda: F.when(N(2) == 0, 302).otherwise(200), "application/json; charset=utf-8", JSON_K)
response("response_other_media", "TRUE", lambda: F.lit(200), "image/png", JSON_K)
response("response_stream", "event_id % 100 <= 50 AND event_id % 5 <> 0", lambda: F.lit(404), "application/jsonl", lambda: F.concat(F.lit('{"k":1}\n\n'), JSON_K(), F.when(N(5) == 0, "\n{").otherwise("\n")))
response("response_coercion", "event_id % 100 <= 50", lambda: F.lit(200), "application/json", lambda: F.concat(F.lit('{"k":"'), S(100), F.lit('"}')), coerce_bodies=True)
projected(
    "link_values",
    lambda: F.concat_ws("|", *(routing.link_value(x, {"url": F.lit("u"), "method": F.lit("GET"), "status": F.lit(200), "query": F.concat(F.lit("q="), ID()), "headers": HEADERS(X_A=F.col("event_type")), "response_headers": HEADERS(), "body": NONE(), "response_body": F.col("props"), "path_parameters": F.create_map(F.lit("id"), ID())}) for x in ("$method", "$statusCode", "$request.query.q", "$request.header.x-a", "$request.path.id", "$response.body#/k", "plain"))),
    "concat_ws('|', 'GET', '200', CAST(event_id AS VARCHAR), event_type, CAST(event_id AS VARCHAR), json_extract_string(props, '$.k'), 'plain')",
)
projected("json_pointer", lambda: F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"a/b":[{"c~d":'), ID(), F.lit("}]}"))), routing.variant_path("/a~1b/0/c~0d"), "string"), "CAST(event_id AS VARCHAR)")

# reports


def report(name: str, made: Callable[[Column], Column], sql: str) -> None:
    def build() -> Column:
        return made(Compiler().violations({"properties": {"k": {"maximum": 50}}}, Variant(F.try_parse_json(F.concat(F.lit('{"k":'), S(100), F.lit("}"))))))

    projected(name, build, f"CASE WHEN event_id % 100 > 50 THEN {sql[0]} ELSE {sql[1]} END" if isinstance(sql, tuple) else sql)


report("report_keywords", lambda v: F.array_join(F.transform(v, lambda x: F.concat_ws(" ", x["keyword"], x["data_path"], x["schema_path"])), "|"), ("'maximum /k #/properties/k/maximum'", "''"))
report("report_simple", lambda v: F.regexp_replace(plans.simple_report(v), r"\] .*", "]"), ("'[/k]'", "''"))
report("report_detailed", lambda v: F.regexp_replace(plans.detailed_report(v), r"\n  (?!by).*", ""), ("'maximum at /k' || chr(10) || '  by #/properties/k/maximum'", "''"))
report("report_json", lambda v: F.get_json_object(plans.json_report(v), "$.errors[0].keyword"), ("'maximum'", "NULL"))
projected("report_sanitized", lambda: plans.sanitized(F.concat(F.lit("a\n\t"), ID(), F.repeat(F.lit("x"), 300))), "substr('a??' || event_id || repeat('x', 300), 1, 256)")
_queries["example_warnings"] = lambda spark, sf_dir: (lambda df: df.select("event_id", F.size(plans.warnings(df, "event_type", {}, examples=["click", "view"])).alias("n_warnings")))(events(spark, sf_dir).withColumn("event_type", F.to_json(F.struct(F.col("event_type").alias("v")))).withColumn("event_type", F.regexp_extract("event_type", r"^\{\"v\":(.*)\}$", 1)))
_sql["example_warnings"] = "SELECT event_id, CAST(event_type NOT IN ('click', 'view') AS INT) AS n_warnings FROM events"


def conformance_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and valid rows by type, with a count observed beside."""
    checked = plans.validate(events(spark, sf_dir), "value", {"maximum": 20})
    return plans.conformance(plans.observed(checked), "event_type").select("event_type", "n_rows", "n_valid")


_queries["conformance_share"] = conformance_share
_sql["conformance_share"] = "SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL OR value <= 20) AS n_valid FROM events GROUP BY event_type"


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
