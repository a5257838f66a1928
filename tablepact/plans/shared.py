"""Checks of contracts with many operations: what operations have in common is one expression, what differs is a table.

An operation is a row of a constant table: its parameters with how each is read (``Signature``), its schema, its body and its security, as
numbers. A message is looked up by its route, its parameters are read by the expression of their signature, and
what is found is held against the expression of its schema. Schemas, bodies and credentials that are equal in several
operations are there once, so the plan grows with the distinct schemas of a contract, not with its operations. Which expression a
number means is decided by halves.

Operations with whole-query parameters, bodies that may be XML or schemas that need the interpreter aren't taken:
``add`` says so.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column

from ..functions import text as F
from ..functions.coercion import coerce_body
from ..functions.strings import bind
from ..operators import routing
from ..operators.parameters import Signature, index_of
from ..operators.schema import Compiler, compilable, none
from ..operators.values import Variant
from ..sources import decoders
from ..sources.contract import Contract, Operation
from .validate import _joined, _says, body_violations

PARAMETER = "struct<sig:int,path:string,name:string,schema:int,required:boolean,regex:string,index:int,deep:int>"
JSON = "application/json"


def chosen(number: Column, made: list[Column], first: int = 0) -> Column:
    """The expression that a number from ``first`` on means."""
    if len(made) == 1:
        return made[0]
    half = len(made) // 2
    return F.when(number < first + half, chosen(number, made[:half], first)).otherwise(chosen(number, made[half:], first + half))


class Numbers:
    """Numbers of values that are equal as JSON, in order of appearance."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.values: list[Any] = []

    def has(self, value: Any) -> bool:
        return self._key(value) in self.known

    @staticmethod
    def _key(value: Any) -> str:
        return json.dumps(value, sort_keys=True, default=str)

    def of(self, value: Any) -> int:
        key = self._key(value)
        if key not in self.known:
            self.known[key] = len(self.values)
            self.values.append(value)
        return self.known[key]


class Shared:
    def __init__(self, contract: Contract, compiler: Compiler, *, coerce: bool = True, coerce_bodies: bool = False, strict: bool = True, security: bool = False):
        self.contract, self.compiler = contract, compiler
        self.coerce, self.coerce_bodies, self.strict, self.security = coerce, coerce_bodies, strict, security
        self.signatures: list[Signature] = []
        self.schemas, self.records, self.deep, self.bodies, self.credentials = Numbers(), Numbers(), Numbers(), Numbers(), Numbers()
        self.rows: list[Any] = []

    def schema(self, numbers: Numbers, schema: Any) -> int | None:
        """Its number; None if the compiler doesn't take it."""
        return numbers.of(schema) if numbers.has(schema) or compilable(self.contract, schema) else None

    def parameter(self, p: dict, schema: Any, regex: str, names: list[str]) -> dict | None:
        signature, number, index = Signature.of(p, schema), self.schema(self.schemas, schema), index_of(p, names)
        if number is None or signature.place == "path" and index is None:
            return None
        deep = self.deep.of(schema) if self.coerce and signature.style == "deepObject" else -1
        if signature not in self.signatures:
            self.signatures.append(signature)
        return {"sig": self.signatures.index(signature), "path": f"{p['in']}/{p['name']}", "name": p["name"], "schema": number, "required": bool(p.get("required")), "regex": regex, "index": index or 0, "deep": deep}

    def body(self, node: dict, required: bool) -> int | None:
        """Number of a body; -1 for none, None for one that needs the interpreter."""
        if not node:
            return -1
        content = self.contract.content(node)
        if any("*" in name or "xml" in name for name in content):  # XML is read by a Python function, which can't be part of a text
            return None
        if not all(compilable(self.contract, self.contract.schema(m.get("itemSchema") or m.get("schema") or {})) for m in content.values()):
            return None
        if self.alone(content):
            self.schema(self.records, self.record(content))
        return self.bodies.of({"content": content, "required": required})

    def alone(self, content: dict) -> bool:
        """Whether a body is JSON and nothing else, taken as it is."""
        return set(content) == {JSON} and not self.coerce_bodies

    def record(self, content: dict) -> Any:
        return self.contract.schema(content[JSON].get("schema") or {})

    def against(self, schemas: Numbers, number: Column, text: Column, path: Column) -> Column:
        """Violations of a JSON text of the schema of that number."""
        of = lambda v: Variant(v).bound(lambda a: chosen(number, [self.compiler.violations(s, a, path) for s in schemas.values]))
        bad = _says("json", path, "is not JSON")
        return bind(F.try_parse_json(text), lambda v: F.when(v.isNull(), bad).otherwise(of(v)))

    def parameters(self, listed: Column, message: dict[str, Column]) -> Column:
        """Violations of the parameters of a list of ``PARAMETER``."""
        if not self.signatures:
            return none()
        kind = "header" if self.compiler.mode == "response" else "parameter"

        def one(p: Column) -> Column:
            where = (message, p["name"], p["regex"], p["index"])
            text = chosen(p["sig"], [s.json(*where, self.coerce) for s in self.signatures])
            over = chosen(p["sig"], [s.too_many_items(*where) for s in self.signatures])
            if self.deep.values:  # members of deep objects are what their schema takes them for
                typed = lambda v: chosen(p["deep"], [coerce_body(self.contract, s, Variant(v), self.strict) for s in self.deep.values])
                text = bind(text, lambda t: F.when(p["deep"] < 0, t).otherwise(bind(F.try_parse_json(t), typed)))
            missing = F.when(p["required"], _says(kind, p["path"], "is missing")).otherwise(none())
            found = lambda t: F.when(t.isNull(), missing).when(over, _says("items", p["path"], "has too many items")).otherwise(self.against(self.schemas, p["schema"], t, p["path"]))
            return bind(text, found)

        return F.coalesce(F.flatten(F.transform(listed, one)), none())

    def body_found(self, number: Column, message: dict[str, Column]) -> Column:
        """Violations of the body of that number; those that are JSON alone share all but their schemas."""
        nodes = self.bodies.values
        if not nodes:
            return none()
        plain = [self.alone(n["content"]) for n in nodes]
        made: list[Column] = []
        schemas = F.get(routing.constant([self.records.of(self.record(n["content"])) if p else -1 for n, p in zip(nodes, plain)], "array<int>"), number)
        required = F.get(routing.constant([n["required"] for n in nodes], "array<boolean>"), number)
        body, kind = message["body"], message["content_type"]
        others = [body_violations(self.contract, self.compiler, n, body, kind, required=n["required"], coerce=self.coerce_bodies, strict=self.strict) for n, p in zip(nodes, plain) if not p]
        if any(plain):
            blank = F.when(required, _says("body", "body", "is missing")).otherwise(none())
            wrong = _says("mediaType", "body", "media type isn't supported") if self.compiler.mode == "request" else none()
            text = decoders.body_json(body, kind, JSON)
            shared = F.when(F.coalesce(F.trim(body), F.lit("")) == "", blank).when(decoders.too_large(body, kind), _says("body", "body", "is too large"))
            shared = shared.when(decoders.media(kind) == JSON, self.against(self.records, schemas, text, F.lit("body"))).otherwise(wrong)
            made.append(shared)
        made += others
        if len(made) == 1:
            return F.when(number >= 0, made[0]).otherwise(none())
        count, places = int(any(plain)), []
        for p in plain:
            places.append(0 if p else count)
            count += not p
        place = F.get(routing.constant(places, "array<int>"), number)
        return F.when(number >= 0, chosen(place, made)).otherwise(none())

    def row(self, route: Column, kind: str, use: Callable[[Column], Column]) -> Column:
        return bind(F.get(routing.constant(self.rows, f"array<{kind}>"), route), use)


class Requests(Shared):
    def add(self, op: Operation) -> bool:
        """Whether the tables take the operation; if they don't, its row is empty."""
        listed = []
        for place in ("path", "query", "header", "cookie"):
            for p in op.parameters:
                if p.get("in") == place:
                    schema = self.contract.schema(p.get("schema") or next((c.get("schema") for c in (p.get("content") or {}).values()), {}) or {})
                    schema = self.contract.schema(schema["$ref"]) if isinstance(schema, dict) and set(schema) == {"$ref"} else schema
                    listed.append(self.parameter(p, schema, op.regex, op.path_names))
        node = self.contract.deref(op.definition.get("requestBody") or {})
        body = self.body(node, bool(node.get("required")))
        taken = None not in listed and body is not None and not any(p.get("in") == "querystring" for p in op.parameters)
        wanted = self.credentials.of(op.definition.get("security")) if self.security else -1
        self.rows.append({"parameters": listed, "body": body, "security": wanted} if taken else None)
        return taken

    def violations(self, route: Column, message: dict[str, Column]) -> Column:
        def of(row: Column) -> Column:
            pairs = F.array(F.struct(decoders.pairs(message["query"]).alias("q"), cookie_pairs(message["cookie"]).alias("c")))
            listed = F.get(F.transform(pairs, lambda both: self.parameters(row["parameters"], message | {"query pairs": both["q"], "cookie pairs": both["c"]})), F.lit(0))
            parts = [listed, self.body_found(row["body"], message)]
            if self.security:
                holds = [routing.secure(self.contract, s, message) for s in self.credentials.values]
                parts.append(F.when(chosen(row["security"], holds), none()).otherwise(_says("security", "", "no security requirement holds")))
            return F.when(row.isNull(), none()).otherwise(_joined(parts))

        from ..operators.parameters import cookie_pairs

        return self.row(route, f"struct<parameters:array<{PARAMETER}>,body:int,security:int>", of)


class Responses(Shared):
    def add(self, op: Operation) -> bool:
        out = []
        for status, response in (op.definition.get("responses") or {}).items():
            response = self.contract.deref(response)
            headers = []
            for name, header in (response.get("headers") or {}).items():
                header = self.contract.deref(header)
                schema = self.contract.schema(header.get("schema") or {})
                headers.append(self.parameter({"in": "header", "name": name, "required": header.get("required")}, schema, "", []))
            body = self.body(response, False) if response.get("content") else -1
            out.append({"status": "default" if status == "default" else str(status).upper(), "headers": headers, "body": body})
        taken = not any(r["body"] is None or None in r["headers"] for r in out)
        self.rows.append({"responses": out} if taken else None)
        return taken

    def violations(self, route: Column, message: dict[str, Column]) -> Column:
        text = message["status"].cast("string")
        group = F.when(F.length(text) == 3, F.concat(F.substring(text, 1, 1), F.lit("XX")))

        def of(row: Column) -> Column:
            known = row["responses"]
            fits = lambda key: F.get(F.filter(known, lambda r: r["status"] == key), F.lit(0))
            undefined = _says("status", "", "status isn't defined")
            found = lambda r: F.when(r.isNull(), undefined).otherwise(F.concat(self.parameters(r["headers"], message), self.body_found(r["body"], message)))
            return F.when(row.isNull(), none()).otherwise(bind(F.coalesce(fits(text), fits(group), fits(F.lit("default"))), found))

        return self.row(route, f"struct<responses:array<struct<status:string,headers:array<{PARAMETER}>,body:int>>>", of)
