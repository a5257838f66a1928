"""Checks of whole DataFrames: a column against a schema, requests and responses against an API description."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions import text as F
from ..functions.coercion import coerce_body
from ..functions.strings import bind
from ..operators import parameters, routing
from ..operators.interpreter import violations_udf
from ..operators.recursion import trees
from ..operators.schema import Compiler, compilable, none
from ..operators.values import Typed, Variant
from ..sources import decoders
from ..sources.contract import Contract, ContractError, Operation


def violations(df: DataFrame, column: str, schema: Any, contract: Contract | None = None, *, mode: str | None = None, strict_formats: bool = False, lane: str | None = None) -> Column:
    """An array of violations of a column. Strings are JSON texts; other types are checked as they are.

    ``lane``: native or python; by default native wherever the schema allows it.
    """
    contract = contract or Contract({})
    schema = contract.schema(schema)
    kind = df.schema[column].dataType
    native = lane == "native" or lane is None and compilable(contract, schema)
    compiler = Compiler(contract, mode=mode, strict_formats=strict_formats)
    tree = None if lane == "python" or compilable(contract, schema) else trees(compiler, schema)
    if tree is not None and isinstance(kind, (T.StringType, T.VariantType)):
        text = isinstance(kind, T.StringType)
        value = F.try_parse_json(F.col(column)) if text else F.col(column)
        bad = F.array(compiler._one("json", F.lit(""), "#", "is not JSON"))
        return bind(value, lambda v: F.when(F.col(column).isNull(), none()).when(v.isNull(), bad).otherwise(tree.violations(v, F.lit(""))))
    if not native:
        text = F.col(column) if isinstance(kind, T.StringType) else F.to_json(F.col(column))
        return violations_udf(contract, schema, mode, strict_formats)(text)
    if isinstance(kind, T.StringType):
        value = F.try_parse_json(F.col(column))
        bad = F.array(compiler._one("json", F.lit(""), "#", "is not JSON"))
        return F.when(F.col(column).isNull(), none()).when(value.isNull(), bad).otherwise(compiler.violations(schema, Variant(value)))
    return compiler.violations(schema, Variant(F.col(column)) if isinstance(kind, T.VariantType) else Typed(F.col(column), kind))


def validate(df: DataFrame, column: str, schema: Any, contract: Contract | None = None, **options) -> DataFrame:
    """``df`` with violations and valid."""
    found = violations(df, column, schema, contract, **options)
    return df.withColumns({"violations": found, "valid": holds(df, column, schema, contract, **options)}) if plain_check(df, column, schema, contract, **options) else df.withColumn("violations", found).withColumn("valid", F.size("violations") == 0)


def plain_check(df: DataFrame, column: str, schema: Any, contract: Contract | None = None, *, lane: str | None = None, **_: Any) -> bool:
    """Whether validity is compiled as a condition of its own."""
    contract = contract or Contract({})
    return lane != "python" and column not in ("violations", "valid") and compilable(contract, contract.schema(schema))


def holds(df: DataFrame, column: str, schema: Any, contract: Contract | None = None, *, mode: str | None = None, strict_formats: bool = False, lane: str | None = None) -> Column:
    """Whether a column has no violations, without making any."""
    contract = contract or Contract({})
    compiler, kind, schema = Compiler(contract, mode=mode, strict_formats=strict_formats), df.schema[column].dataType, contract.schema(schema)
    if isinstance(kind, T.StringType):
        fits = bind(F.try_parse_json(F.col(column)), lambda v: F.when(v.isNull(), F.lit(False)).otherwise(compiler.valid(schema, Variant(v))))
        return F.when(F.col(column).isNull(), F.lit(True)).otherwise(fits)
    return compiler.valid(schema, Variant(F.col(column)) if isinstance(kind, T.VariantType) else Typed(F.col(column), kind))


def row_violations(df: DataFrame, schema: Any, contract: Contract | None = None) -> Column:
    """Violations of the row itself as an object of its typed columns; only columns that the schema names are read."""
    contract = contract or Contract({})
    schema = contract.schema(schema)
    if not compilable(contract, schema):
        raise ContractError("rows need a schema without recursion whose patterns Java can read")
    return Compiler(contract).violations(schema, Row(df.schema))


class Row(Typed):
    """A row of typed columns as an object that is never null."""

    def __init__(self, schema: T.StructType):
        super().__init__(F.lit(True), schema)

    def get(self, key: str):
        return (Typed(F.col(key), self.kind[key].dataType), F.lit(True)) if key in self.kind.names else None

    def is_type(self, name: str) -> Column:
        return F.lit(name == "object")


def _says(keyword: str, path: str | Column, message: str) -> Column:
    return F.array(F.struct(F.lit(keyword).alias("keyword"), F.lit(path).alias("data_path"), F.lit("#").alias("schema_path"), F.lit(message).alias("message")))


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none()


def text_violations(contract: Contract, compiler: Compiler, schema: Any, text: Column, path: str, *, coerce: bool = False, strict: bool = True) -> Column:
    """Violations of JSON text. Schemas that the compiler doesn't take go to the interpreter; ``coerce`` turns strings into what
    the schema's types take them for first."""
    if not compilable(contract, schema) and not coerce and (tree := trees(compiler, schema)) is not None:
        return bind(F.try_parse_json(text), lambda v: F.when(text.isNull(), none()).when(v.isNull(), _says("json", path, "is not JSON")).otherwise(tree.violations(v, F.lit(path))))
    if not compilable(contract, schema):
        return F.coalesce(violations_udf(contract, schema, compiler.mode, compiler.strict, path)(text), none())
    value = F.try_parse_json(text)
    if coerce:
        value = F.try_parse_json(bind(value, lambda v: coerce_body(contract, schema, Variant(v), strict)))
    return bind(value, lambda v: F.when(v.isNull(), _says("json", path, "is not JSON")).otherwise(compiler.violations(schema, Variant(v), F.lit(path))))


def querystring_violations(contract: Contract, compiler: Compiler, p: dict, query: Column) -> Column:
    """Of a parameter that is the whole query: ``content`` names its media type and schema. JSON is percent-decoded as a whole,
    anything else is read as a form."""
    if p.get("schema") is not None or not p.get("content"):
        raise ContractError(f"parameter {p.get('name')} of the whole query needs content, not a schema")
    parts = []
    for name, node in contract.content(p).items():
        text = decoders.decode_url(query) if name.endswith("json") else decoders.form_body(query)
        parts.append(text_violations(contract, compiler, contract.schema(node.get("schema") or {}), text, "querystring"))
    missing = _says("parameter", "querystring", "is missing") if p.get("required") else none()
    return F.when(F.coalesce(query, F.lit("")) == "", missing).otherwise(_joined(parts))


def operation_violations(contract: Contract, compiler: Compiler, op: Operation, message: dict[str, Column], *, coerce: bool = True, coerce_bodies: bool = False, strict: bool = True, security: bool = False) -> Column:
    """Of the parameters, the body and, if asked for, the credentials of one operation."""
    parts: list[Column] = []
    for place in ("path", "query", "header", "cookie"):
        for p in op.parameters:
            if p.get("in") != place:
                continue
            schema = contract.schema(p.get("schema") or next((c.get("schema") for c in (p.get("content") or {}).values()), {}) or {})
            schema = contract.schema(schema["$ref"]) if isinstance(schema, dict) and set(schema) == {"$ref"} else schema
            text = parameters.parameter_json(p, schema, message, op.regex, op.path_names, coerce)
            missing = _says("parameter", f"{place}/{p['name']}", "is missing") if p.get("required") else none()
            over = parameters.too_many_items(p, schema, message, op.regex, op.path_names)
            found = lambda t, p=p, schema=schema, place=place: text_violations(contract, compiler, schema, t, f"{place}/{p['name']}", coerce=coerce and p.get("style") == "deepObject", strict=strict)
            judged = lambda t, p=p, place=place, missing=missing, over=over, found=found: F.when(t.isNull(), missing).when(over, _says("items", f"{place}/{p['name']}", "has too many items")).otherwise(found(t))
            parts.append(bind(text, judged) if compilable(contract, schema) else judged(text))
    parts += [querystring_violations(contract, compiler, p, message["query"]) for p in op.parameters if p.get("in") == "querystring"]
    body = contract.deref(op.definition.get("requestBody") or {})
    if body:
        parts.append(body_violations(contract, compiler, body, message["body"], message["content_type"], required=bool(body.get("required")), coerce=coerce_bodies, strict=strict))
    if security:
        parts.append(F.when(routing.secure(contract, op.definition.get("security"), message), none()).otherwise(_says("security", "", "no security requirement holds")))
    return _joined(parts)


MESSAGE = ("path", "query", "headers", "cookie", "method", "body", "content_type")


def over_limits(message: dict[str, Column]) -> list[Column]:
    limits = (("query", decoders.too_many_pairs(message["query"])), ("cookie", decoders.too_many_pairs(message["cookie"], ";", parameters.MAX_COOKIES)))
    deep = F.when(decoders.too_deep(message["query"]), _says("nesting", "query", "has a name of too many steps")).otherwise(none())
    return [*(F.when(hit, _says("pairs", place, "has too many pairs")).otherwise(none()) for place, hit in limits), deep]


#: Contracts of more operations are checked by tables, see ``plans.shared``; fewer by one expression for each.
FEW = 8


def request_violations(contract: Contract, **options) -> tuple[Column, Column]:
    """(route, violations) of rows with method, path, query, headers (map of arrays), cookie, content_type, body.

    ``options``: coerce (parameters, true), coerce_bodies (false), strict (true), security (false).
    """
    from .shared import Requests

    message = {k: F.col(k) for k in MESSAGE}
    message["path"] = routing.strip_server(message["path"], contract)
    route = routing.match_route(contract, F.col("method"), message["path"])
    compiler, operations = Compiler(contract, mode="request"), routing.ranked(contract)
    unknown = _says("route", "", "no operation fits")
    if len(operations) > FEW:
        tables = Requests(contract, compiler, **options)
        own = [(i, op) for i, op in enumerate(operations) if not tables.add(op)]
        made = F.when(route.isNull(), unknown)
        for i, op in own:
            made = made.when(route == i, operation_violations(contract, compiler, op, message, **options))
        made = made.otherwise(tables.violations(route, message))
    else:
        made = F.when(route.isNull(), unknown)
        for i, op in enumerate(operations):
            made = made.when(route == i, operation_violations(contract, compiler, op, message, **options))
        made = made.otherwise(none())
    return route, _joined([*over_limits(message), made])


def validate_named(df: DataFrame, contract: Contract, cases: list[tuple[Column, Operation | None]], **options) -> DataFrame:
    """Messages to webhooks or callbacks: like requests, but held against the operation of the first of ``cases`` that holds; None
    says that its address is known at run time only. Adds violations and valid."""
    message = {k: F.col(k) if k in df.columns else F.lit(None).cast("string") for k in MESSAGE}
    if "headers" not in df.columns:
        message["headers"] = F.create_map().cast("map<string,array<string>>")
    compiler, made = Compiler(contract, mode="request"), None
    for hit, op in cases:
        found = _says("callback", "path", "its address is known at run time only") if op is None else operation_violations(contract, compiler, op, message, **options)
        made = F.when(hit, found) if made is None else made.when(hit, found)
    unknown = _says("name", "", "no operation has this name and method")
    found = unknown if made is None else made.otherwise(unknown)
    return df.withColumn("violations", _joined([*over_limits(message), found])).withColumn("valid", F.size("violations") == 0)


def _called(name: str, method: str) -> Column:
    return (F.col("name") == name) & (F.lower("method") == method)


def validate_webhooks(df: DataFrame, contract: Contract, **options) -> DataFrame:
    return validate_named(df, contract, [(_called(*k), op) for k, op in contract.webhooks().items()], **options)


def validate_callbacks(df: DataFrame, contract: Contract, *, strict_templates: bool = True, **options) -> DataFrame:
    """Found by name and method, and by the first expression that fits the path: an absolute address by its path, a template, or a
    path as it is. Runtime expressions are violations, as they can't be resolved here, unless ``strict_templates`` is false: then
    they fit any path. Without a column path the first expression that has the method is taken."""
    cases: list[tuple[Column, Operation | None]] = []
    for (name, method), ops in contract.callbacks().items():
        for op in ops if "path" in df.columns else ops[:1]:
            hit, address = _called(name, method), op.template
            if "path" in df.columns and "{$" in address:
                op = None if strict_templates else op
            elif "path" in df.columns:
                if address.startswith(("http://", "https://")):
                    op = replace(op, template=urlsplit(address).path)
                    if not op.template:
                        continue
                templated = op.template == address and "{" in address
                hit &= F.col("path").rlike(op.regex) if templated else F.col("path") == op.template
            cases.append((hit, op))
    return validate_named(df, contract, cases, **options)


def warnings(df: DataFrame, column: str, schema: Any, contract: Contract | None = None, examples: list | None = None) -> Column:
    """What is worth saying of valid values: deprecated properties, and, with ``examples``, values that equal none of them."""
    contract = contract or Contract({})
    kind, schema = df.schema[column].dataType, contract.schema(schema)
    value = Variant(F.try_parse_json(column)) if isinstance(kind, T.StringType) else Variant(F.col(column)) if isinstance(kind, T.VariantType) else Typed(F.col(column), kind)
    parts = [Compiler(contract).warnings(schema, value)]
    if examples:
        text = value if isinstance(value, Variant) else Variant(F.to_variant_object(F.col(column)) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else F.col(column).cast("variant"))
        parts.append(F.when(examples_differ(text.c, examples), _says("example", "", "equals none of the examples")).otherwise(none()))
    return F.coalesce(_joined(parts), none())


def body_violations(contract: Contract, compiler: Compiler, node: dict, body: Column, content_type: Column, *, required: bool, coerce: bool = False, strict: bool = True) -> Column:
    """Of a body with a media type among those of ``node``; framed bodies are checked record by record."""
    content = contract.content(node)
    blank = F.coalesce(F.trim(body), F.lit("")) == ""
    made = F.when(blank, _says("body", "body", "is missing") if required else none()).when(decoders.too_large(body, content_type), _says("body", "body", "is too large"))
    for name, media in sorted(content.items(), key=lambda kv: kv[0].count("*")):
        m = decoders.media(content_type)
        hit = F.lit(True) if name == "*/*" else F.startswith(m, F.lit(name[:-1])) if name.endswith("/*") else m == name
        if name in decoders.STREAMS:
            schema = contract.schema(media.get("itemSchema") or media.get("schema") or {})
            if not compilable(contract, schema):
                raise ContractError(f"records of {name} need a schema without recursion and unevaluated keywords")
            items = decoders.records(body, F.lit(name))
            each = F.flatten(F.transform(items, lambda x, i: F.when(F.try_parse_json(x).isNull(), F.array(compiler._one("json", F.concat(F.lit("body/"), i.cast("string")), "#", "is not JSON"))).otherwise(compiler.violations(schema, Variant(F.try_parse_json(x)), F.concat(F.lit("body/"), i.cast("string"))))))
            found = F.when(decoders.too_many(items), _says("records", "body", "has too many records")).when(decoders.too_long(items), _says("records", "body", "has a record that is too long")).otherwise(each)
        else:
            schema = contract.schema(media.get("schema") or {})
            text = decoders.body_json(body, content_type, name)
            found = F.when(decoders.too_many_parts(body, content_type), _says("parts", "body", "has too many parts")).otherwise(text_violations(contract, compiler, schema, text, "body", coerce=coerce, strict=strict))
        made = made.when(hit, found)
    return made.otherwise(_says("mediaType", "body", "media type isn't supported") if compiler.mode == "request" else none())


def validate_requests(df: DataFrame, contract: Contract, **options) -> DataFrame:
    route, found = request_violations(contract, **options)
    out = df.withColumn("route", route).withColumn("violations", found)
    return out.withColumn("operation", routing.operation_name(contract, F.col("route"))).withColumn("valid", F.size("violations") == 0)


def response_violations(contract: Contract, compiler: Compiler, op: Operation, message: dict[str, Column], *, coerce_bodies: bool = False, strict: bool = True) -> Column:
    """Of the headers and the body of a response of an operation, by its status."""
    responses = {str(k): contract.deref(r) for k, r in (op.definition.get("responses") or {}).items()}
    key = routing.status_key(message["status"], list(responses))
    made = F.when(key.isNull(), _says("status", "", "status isn't defined"))
    for status, response in responses.items():
        parts = []
        for name, header in (response.get("headers") or {}).items():
            header = contract.deref(header)
            schema = contract.schema(header.get("schema") or {})
            place = {"in": "header", "name": name}
            text = parameters.parameter_json(place, schema, message, "", [])
            over = parameters.too_many_items(place, schema, message, "", [])
            missing = _says("header", f"header/{name}", "is missing") if header.get("required") else none()
            found = text_violations(contract, compiler, schema, text, f"header/{name}")
            parts.append(F.when(text.isNull(), missing).when(over, _says("items", f"header/{name}", "has too many items")).otherwise(found))
        if response.get("content"):
            parts.append(body_violations(contract, compiler, response, message["body"], message["content_type"], required=False, coerce=coerce_bodies, strict=strict))
        made = made.when(key == (status if status == "default" else status.upper()), _joined(parts))
    return made.otherwise(none())


def validate_responses(df: DataFrame, contract: Contract, *, coerce_bodies: bool = False, strict: bool = True) -> DataFrame:
    """Rows with method, path, status, response_headers, content_type, body."""
    from .shared import Responses

    path = routing.strip_server(F.col("path"), contract)
    route = routing.match_route(contract, F.col("method"), path)
    compiler, operations = Compiler(contract, mode="response"), routing.ranked(contract)
    message = {"headers": F.col("response_headers"), "body": F.col("body"), "content_type": F.col("content_type"), "status": F.col("status")}
    made = F.when(route.isNull(), _says("route", "", "no operation fits"))
    options = {"coerce_bodies": coerce_bodies, "strict": strict}
    if len(operations) > FEW:
        tables = Responses(contract, compiler, **options)
        for i, op in enumerate(operations):
            if not tables.add(op):
                made = made.when(route == i, response_violations(contract, compiler, op, message, **options))
        made = made.otherwise(tables.violations(route, message))
    else:
        for i, op in enumerate(operations):
            made = made.when(route == i, response_violations(contract, compiler, op, message, **options))
        made = made.otherwise(none())
    return df.withColumn("violations", made).withColumn("valid", F.size("violations") == 0)


def roll_up(checked: DataFrame, *by: str) -> DataFrame:
    """Violations by keyword and place. Rows are reduced before the shuffle."""
    each = checked.select(*by, F.explode("violations").alias("v")).select(*by, "v.keyword", "v.schema_path")
    return each.groupBy(*by, "keyword", "schema_path").agg(F.count("*").alias("n"))


def conformance(checked: DataFrame, *by: str) -> DataFrame:
    """Rows, valid rows and their share."""
    return checked.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_if("valid").alias("n_valid"), F.avg(F.col("valid").cast("double")).alias("share_valid"))


def observed(checked: DataFrame, name: str = "conformance") -> DataFrame:
    """Counts as a side effect of any action, for listeners."""
    return checked.observe(name, F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("valid")).alias("n_invalid"))


def simple_report(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda v: F.concat(F.lit("["), v["data_path"], F.lit("] "), v["message"])), "\n")


def detailed_report(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda v: F.concat(v["keyword"], F.lit(" at "), v["data_path"], F.lit("\n  "), v["message"], F.lit("\n  by "), v["schema_path"])), "\n")


def json_report(found: Column) -> Column:
    return F.to_json(F.struct(found.alias("errors"), F.size(found).alias("count")))


def sanitized(text: Column, limit: int = 256) -> Column:
    """For logs: control characters escaped, cut to ``limit``."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1F\x7F]", "?"), 1, limit)


def examples_differ(value: Column, examples: list) -> Column:
    """A warning, not a violation: the value equals none of the declared examples."""
    from ..operators.schema import scalar_key

    return ~reduce(lambda a, b: a | b, (Variant(value).key() == scalar_key(x) for x in examples), F.lit(False)) if examples else F.lit(False)


