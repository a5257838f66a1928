"""From messages to operations, statuses, servers, links and credentials.

A contract is small and known on the driver, so its lookups are compiled to CASE expressions: routing a message needs no
join and no shuffle, and each pattern is compiled once.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import text as F
from ..sources.contract import Contract, ContractError, Operation
from ..sources.decoders import pairs, values_of
from .parameters import cookie_pairs, header_value


def ranked(contract: Contract) -> list[Operation]:
    """Operations in the order in which they are tried: fewest placeholders first, then as in the document."""
    return sorted(contract.operations(), key=lambda o: (len(o.path_names), o.order))


def strip_server(path: Column, contract: Contract, **values: str) -> Column:
    """Without the longest base path of a server that begins it."""
    made = None
    for base in contract.servers(**values):
        hit = (path == base) | F.startswith(path, F.lit(base + "/"))
        rest = F.when(path == base, "/").otherwise(F.substring(path, F.lit(len(base) + 1), F.length(path)))
        made = F.when(hit, rest) if made is None else made.when(hit, rest)
    return path if made is None else made.otherwise(path)


def shape(template: str) -> str | None:
    """What must equal in a path for the template to fit: its number of slashes and its first literal segment; None where a
    placeholder takes several segments."""
    if "{+" in template:
        return None
    first = template.split("/")[1] if template.count("/") else template
    return f"{template.count('/')} " + ("" if "{" in first else first)


#: Contracts with more patterns are looked up in a table of groups; below, patterns are compiled once as parts of one expression.
MANY_ROUTES = 64


def match_route(contract: Contract, method: Column, path: Column) -> Column:
    """The index of the operation in ``ranked``; null where none fits. Of what fits, the first counts.

    Literal paths are looked up by method and path. Paths with placeholders are tried in order or, where there are more than
    ``MANY_ROUTES``, looked up by method and ``shape``, so that a path tries the patterns of its groups only.
    """
    method = F.lower(method)
    literal, patterns = {}, []
    for i, op in enumerate(ranked(contract)):
        if op.path_names:
            patterns.append((i, op))
        else:
            literal.setdefault(f"{op.method} {op.template}", i)
    found = [F.try_element_at(constant(literal, "map<string,int>"), F.concat(method, F.lit(" "), path))] if literal else []
    grouped: dict[str, list] = {}
    tried = None
    for i, op in patterns:
        if len(patterns) > MANY_ROUTES and (s := shape(op.template)) is not None:
            grouped.setdefault(f"{op.method} {s}", []).append({"route": i, "regex": op.regex})
        else:
            hit = (method == op.method) & path.rlike(op.regex)
            tried = F.when(hit, i) if tried is None else tried.when(hit, i)
    if tried is not None:
        found.append(tried)
    if grouped:
        table = constant(grouped, "map<string,array<struct<route:int,regex:string>>>")
        slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
        first = F.when(F.startswith(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(2))).otherwise(path)
        for last in (first, F.lit("")):
            some = F.try_element_at(table, F.concat(method, F.lit(" "), slashes.cast("string"), F.lit(" "), last))
            found.append(F.get(F.filter(some, lambda c: F.rlike(path, c["regex"])), F.lit(0))["route"])
    return F.lit(None).cast("int") if not found else F.least(*found) if len(found) > 1 else found[0]


def constant(value: dict | list, kind: str) -> Column:
    """A value as one constant, however large: the optimizer evaluates it once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def routes_table(spark: SparkSession, contract: Contract) -> DataFrame:
    """A row for each operation, for reports and joins."""
    rows = [(i, o.name, o.method, o.template, o.regex, len(o.path_names)) for i, o in enumerate(ranked(contract))]
    return spark.createDataFrame(rows, "route int, operation string, method string, template string, regex string, n_parameters int")


def operation_name(contract: Contract, route: Column) -> Column:
    return F.get(constant([o.name for o in ranked(contract)], "array<string>"), route)


def status_key(status: Column, known: list[str]) -> Column:
    """The response that a status takes: exact, then its class, then default; null where there is none."""
    text = status.cast("string")
    group = F.concat(F.substring(text, 1, 1), F.lit("XX"))
    listed = {k.upper() if k != "default" else k: k for k in map(str, known)}
    exact = F.when(text.isin(*listed), text)
    by_class = F.when((F.length(text) == 3) & group.isin(*listed), group)
    return F.coalesce(exact, by_class, F.lit("default") if "default" in listed else F.lit(None).cast("string"))


def named_operation(table: dict[tuple[str, str], object], name: Column, method: Column) -> Column:
    """Whether a webhook or callback of that name has the method."""
    keys = [f"{n} {m}" for n, m in table]
    return F.concat_ws(" ", name, F.lower(method)).isin(*keys) if keys else F.lit(False)


def link_value(expression: str, message: dict[str, Column]) -> Column:
    """A runtime expression over columns url, method, status, path parameters, query, headers and bodies; else a constant."""
    text = {"$url": "url", "$method": "method", "$statusCode": "status"}
    if expression in text:
        return message[text[expression]].cast("string")
    m = re.fullmatch(r"\$(request|response)\.(path|query|header|body)(?:\.([^#]+)|#(.*))?", expression)
    if not m:
        return F.lit(expression)
    side, place, name, pointer = m.groups()
    if place == "query":
        return F.get(values_of(pairs(message["query"]), name), F.lit(0))
    if place == "header":
        return header_value(message["headers" if side == "request" else "response_headers"], name)
    if place == "path":
        return F.try_element_at(message["path_parameters"], F.lit(name))
    body = F.try_parse_json(message["body" if side == "request" else "response_body"])
    if not pointer:
        return F.to_json(body)
    return F.try_variant_get(body, variant_path(pointer), "string")


def variant_path(pointer: str) -> str:
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("'", "\\'") + "']" for p in parts)


def secure(contract: Contract, requirements: list[dict] | None, message: dict[str, Column]) -> Column:
    """Whether any requirement holds with all its schemes; no requirements, or an empty one, always hold."""
    wanted = contract.document.get("security") if requirements is None else requirements
    if not wanted:
        return F.lit(True)
    schemes = (contract.document.get("components") or {}).get("securitySchemes") or {}
    some = F.lit(False)
    for requirement in wanted:
        every = F.lit(True)
        for name in requirement:
            s = contract.deref(schemes.get(name) or {})
            if s.get("type") == "http" and str(s.get("scheme")).lower() == "bearer":
                ok = header_value(message["headers"], "authorization").rlike(r"(?i)^bearer +\S+\z")
            elif s.get("type") == "apiKey":
                value = {
                    "header": lambda n: header_value(message["headers"], n), "query": lambda n: F.get(values_of(pairs(message["query"]), n), F.lit(0)), "cookie": lambda n: F.get(values_of(cookie_pairs(message["cookie"]), n), F.lit(0)),
                }[s["in"]](s["name"])
                ok = F.coalesce(value, F.lit("")) != ""
            else:
                raise ContractError(f"security scheme {name} isn't supported")
            every = every & F.coalesce(ok, F.lit(False))
        some = some | every
    return some
