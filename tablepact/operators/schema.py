"""Schemas compiled to Column expressions: an array of violations for each row.

The compiler walks a schema once on the driver and emits one expression, so a check is a projection that Catalyst plans
with the scan: no shuffle, no Python. Which properties and items a schema has evaluated is an expression of
its own, joined by the outcomes of branches. Schemas that an expression can't hold (recursion through choices, patterns that Java can't read) go to the
interpreter in batches; ``compilable`` tells which way a schema takes, ``recursion`` holds trees.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal
from fractions import Fraction
from functools import reduce
from operator import add, and_, ge, gt, le, lt, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql.types import StringType

from ..functions import text as F
from ..functions import formats
from ..functions.strings import HostilePattern, bind, java_pattern, utf16_length
from ..sources.contract import Contract, ContractError
from .values import Typed, Variant

VIOLATION = "struct<keyword:string,data_path:string,schema_path:string,message:string>"
NONE = f"array<{VIOLATION}>"
#: Most violations of additional properties at one object.
MAX_ADDITIONAL = 100
#: Keyword, whether it is broken, and what to say of it.
Check = tuple[str, Column, str]
BEYOND_JAVA = re.compile(r"\(\?[&RP(|]|\(\?\d|\\[gKRX]|\(\*")


def none() -> Column:
    return F.array().cast(NONE)


def scalar_key(value: Any) -> str:
    """The key that ``Typed.key`` and ``Variant.key`` give an equal value."""
    if value is None:
        return "z"
    if isinstance(value, bool):
        return f"b{str(value).lower()}"
    if isinstance(value, (int, float)):
        return number_text(value)
    return f"s{value}" if isinstance(value, str) else "j" + canonical(value)


def number_text(value: float) -> str:
    """Integers and whole doubles below 2^53 as n and digits, other doubles as d and the text that Java writes."""
    if isinstance(value, int) or value.is_integer() and abs(value) < 2**53:
        return f"n{int(value)}"
    digits, exponent = (t := Decimal(repr(value)).normalize().as_tuple()).digits, len(t.digits) + t.exponent - 1
    sign, text = "-" if value < 0 else "", "".join(map(str, digits))
    if -3 <= exponent < 7:
        return "d" + (repr(value) if "e" not in repr(value) else f"{value:f}")
    return f"d{sign}{text[0]}.{text[1:] or '0'}E{exponent}"


def canonical(value: Any) -> str:
    """JSON text with keys in the order of UTF-16 and numbers by their values, as ``values.canonical`` makes it."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return number_text(value)
    return json.dumps(value, ensure_ascii=False)


def whole_reference(name: str) -> str:
    """A value of a mapping: a reference, or the bare name of a schema of the components."""
    return name if "/" in name or "#" in name else f"#/components/schemas/{name}"


def compilable(contract: Contract, schema: Any, seen: tuple[str, ...] = ()) -> bool:
    """Whether the compiler takes a schema: no recursion anywhere below."""
    if isinstance(schema, list):
        return all(compilable(contract, s, seen) for s in schema)
    if not isinstance(schema, dict):
        return True
    if schema.get("format") == "regex":
        return False
    if isinstance(schema.get("pattern"), str) and BEYOND_JAVA.search(schema["pattern"]):
        return False
    if isinstance(ref := schema.get("$ref"), str):
        if ref in seen:
            return False
        return compilable(contract, contract.resolve(ref)[0], (*seen, ref)) and compilable(contract, {k: v for k, v in schema.items() if k != "$ref"}, seen)
    maps = ("properties", "patternProperties", "dependentSchemas")
    below = [s for k in maps for s in (schema.get(k) or {}).values()]
    below += [schema[k] for k in ("items", "additionalProperties", "unevaluatedProperties", "unevaluatedItems", "not", "if", "then", "else", "contains", "propertyNames", "allOf", "anyOf", "oneOf", "prefixItems") if k in schema]
    if isinstance(d := schema.get("discriminator"), dict):
        named = [*(d.get("mapping") or {}).values(), *([d["defaultMapping"]] if d.get("defaultMapping") else [])]
        below += [{"$ref": whole_reference(r)} for r in named]
    return all(compilable(contract, s, seen) for s in below)


class Compiler:
    """``mode`` is request, response or None (neither readOnly nor writeOnly is held against anyone)."""

    def __init__(self, contract: Contract | None = None, *, mode: str | None = None, strict_formats: bool = False):
        self.contract, self.mode, self.strict = contract or Contract({}), mode, strict_formats

    def violations(self, schema: Any, value: Typed | Variant, path: Column | None = None, at: str = "#") -> Column:
        path = F.lit("") if path is None else F.written(path)
        if F.plain(value.c):
            return value.as_text(lambda v: self.violations(schema, v, path, at))
        if schema is True or schema == {}:
            return none()
        if schema is False:
            return F.array(self._one("false", path, at, "nothing is allowed here"))
        if isinstance(schema.get("$ref"), str):
            target = self.contract.schema(schema["$ref"])
            rest = beside(schema)
            found = self.violations(target, value, path, schema["$ref"])
            return F.concat(found, self.violations(rest, value, path, at)) if rest else found
        return value.bound(lambda v: self._all(schema, v, path, at))

    def valid(self, schema: Any, value: Typed | Variant) -> Column:
        """Whether there are no violations, as a condition of its own: none is made to be counted. Never null."""
        if F.plain(value.c):
            return value.as_text(lambda v: self.valid(schema, v))
        if schema is True or schema == {}:
            return F.lit(True)
        if schema is False:
            return F.lit(False)
        if isinstance(schema.get("$ref"), str):
            rest = beside(schema)
            found = self.valid(self.contract.schema(schema["$ref"]), value)
            return found & self.valid(rest, value) if rest else found
        return value.bound(lambda v: self._valid(schema, v))

    def _valid(self, s: dict, v) -> Column:
        parts = []
        if isinstance(s.get("discriminator"), dict):
            parts.append(self._discriminated(s, v))
            if "oneOf" in s:
                return parts[0]
        parts += [~F.coalesce(wrong, F.lit(False)) for _, wrong, _ in [*self._scalars(s, v), *self._sizes(s, v)]]
        parts += [*self._valid_objects(s, v), *self._valid_arrays(s, v), *self._valid_unevaluated(s, v)]
        parts += [self.valid(sub, v) for sub in s.get("allOf") or []]
        for k in ("anyOf", "oneOf"):
            if s.get(k):
                fits = [self.valid(sub, v) for sub in s[k]]
                parts.append(reduce(or_, fits) if k == "anyOf" else reduce(add, (x.cast("int") for x in fits)) == 1)
        if "not" in s:
            parts.append(~self.valid(s["not"], v))
        if "if" in s and ("then" in s or "else" in s):
            parts.append(F.when(self.valid(s["if"], v), self.valid(s.get("then", True), v)).otherwise(self.valid(s.get("else", True), v)))
        return reduce(and_, parts) if parts else F.lit(True)

    def _valid_objects(self, s: dict, v) -> list[Column]:
        out, is_object = [], v.is_type("object")
        if s.get("required"):
            there = [F.coalesce(got[1], F.lit(False)) if (got := v.get(k)) is not None else F.lit(False) for k in s["required"]]
            out.append(reduce(and_, there) | ~is_object)
        for name, sub in (s.get("properties") or {}).items():
            if (got := v.get(name)) is not None and sub is not True and sub != {}:
                barred = {"request": "readOnly", "response": "writeOnly"}.get(self.mode)
                no = barred and isinstance(sub, dict) and self.contract.deref(sub).get(barred) is True
                out.append(~F.coalesce(got[1], F.lit(False)) | (F.lit(False) if no else self.valid(sub, got[0])))
        every = lambda names, sub: (None if (found := v.members(names, lambda x, k: self.valid(sub, x))) is None else ~is_object | F.forall(found, lambda x: x))
        patterns = s.get("patternProperties") or {}
        for pattern, sub in patterns.items():
            if (held := every(F.filter(v.keys(), lambda k: k.rlike(java_pattern(pattern))), sub)) is not None:  # noqa: B023  (called at once)
                out.append(held)
        extra = s.get("additionalProperties", True)
        if extra is not True and extra != {}:
            names = self._additional(s, v)
            held = ~is_object | (F.size(names) == 0) if extra is False else every(names, extra)
            out += [held] if held is not None else []
        if "propertyNames" in s:
            out.append(~is_object | F.forall(v.keys(), lambda k: self.valid(s["propertyNames"], Typed(k, StringType()))))
        for name, sub in (s.get("dependentSchemas") or {}).items():
            out.append(~(is_object & F.array_contains(v.keys(), name)) | self.valid(sub, v))
        return out

    @staticmethod
    def _additional(s: dict, v) -> Column:
        """Names of properties that neither properties nor patternProperties know."""
        known = list(s.get("properties") or {})
        names = F.array_except(v.keys(), F.array(*map(F.lit, known))) if known else v.keys()
        for pattern in s.get("patternProperties") or {}:
            names = F.filter(names, lambda k: ~k.rlike(java_pattern(pattern)))  # noqa: B023  (called at once)
        return names

    def _valid_arrays(self, s: dict, v) -> list[Column]:
        out, is_array = [], v.is_type("array")
        prefix = s.get("prefixItems") or []
        for i, sub in enumerate(prefix):
            if (x := v.element(i)) is not None:
                out.append(~(is_array & (v.size() > i)) | self.valid(sub, x))
        items = s.get("items", True)
        if items is False:
            out.append(~(is_array & (v.size() > len(prefix))))
        elif items is not True and items != {} and (found := v.elements(lambda x, i: self.valid(items, x), len(prefix))) is not None:
            out.append(~is_array | F.forall(found, lambda x: x))
        return out

    def _one(self, keyword: str, path: Column, at: str, message: str | Column, suffix: str | None = None) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.struct(F.lit(keyword).alias("keyword"), path.alias("data_path"), F.lit(f"{at}/{suffix or keyword}").alias("schema_path"), text.alias("message"))

    def _if(self, failed: Column, *one, **more) -> Column:
        """An array of one violation, or none: arrays are joined in generated code, where filtering out nulls isn't."""
        return F.when(F.coalesce(failed, F.lit(False)), F.array(self._one(*one, **more))).otherwise(none())

    def _all(self, s: dict, v, path: Column, at: str) -> Column:
        if isinstance(s.get("discriminator"), dict):
            routed = self._discriminator(s, v, path, at)
            if "oneOf" in s:
                return routed
        else:
            routed = None
        flat = [self._if(wrong, k, path, at, message) for k, wrong, message in [*self._scalars(s, v), *self._sizes(s, v)]]
        parts = [*flat, *([routed] if routed is not None else [])]
        parts += [*self._objects(s, v, path, at), *self._arrays(s, v, path, at), *self._composed(s, v, path, at), *self._unevaluated(s, v, path, at)]
        return (F.concat(*parts) if len(parts) > 1 else parts[0]) if parts else none()

    # scalars

    def _scalars(self, s: dict, v) -> list[Check]:
        out: list[Check] = []
        if "type" in s:
            kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
            kinds = [*kinds, *(["null"] if s.get("nullable") is True else [])]
            fits = F.lit(False)
            for k in kinds:
                fits = fits | v.is_type(k)
            out.append(("type", ~fits, f"is not of type {' or '.join(kinds)}"))
        if "enum" in s:
            keys = [scalar_key(x) for x in s["enum"]]
            out.append(("enum", ~v.key().isin(*keys) if keys else F.lit(True), "is none of the allowed values"))
        if "const" in s:
            out.append(("const", v.key() != scalar_key(s["const"]), "is not the required value"))
        text, number = v.string(), v.number()
        for k, wrong in (("minLength", lambda n: utf16_length(text) < n), ("maxLength", lambda n: utf16_length(text) > n)):
            if k in s:
                out.append((k, wrong(s[k]), f"breaks {k} {s[k]}"))
        if s.get("pattern"):
            out.append(("pattern", ~text.rlike(checked_pattern(s["pattern"])), "does not match the pattern"))
        for k, wrong in {"minimum": lt, "maximum": gt, "exclusiveMinimum": le, "exclusiveMaximum": ge}.items():
            if k in s and not isinstance(s[k], bool):
                hit = F.isnan(number) | wrong(number, F.lit(float(s[k])))
                if 2**53 <= abs(s[k]) < 2**63 and s[k] == int(s[k]):  # doubles can't tell such integers apart
                    hit = F.coalesce(wrong(v.integer(), F.lit(int(s[k]))), hit)
                out.append((k, hit, f"breaks {k} {s[k]}"))
        if "multipleOf" in s:
            out.append(("multipleOf", ~self._multiple(v, s["multipleOf"]), f"is not a multiple of {s['multipleOf']}"))
        if "format" in s and "type" in s:
            kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
            wrong = self._format(next((k for k in kinds if k != "null"), "null"), s["format"], v, text)
            if wrong is not None:
                out.append(("format", wrong, f"is not a {s['format']}"))
        if s.get("contentEncoding") == "base64":
            out.append(("contentEncoding", F.coalesce(F.base64(F.try_to_binary(text, F.lit("base64"))) != text, text.isNotNull()), "is not base64"))
        if "contentMediaType" in s:
            raw = F.when(F.lit(s.get("contentEncoding") == "base64"), F.decode(F.try_to_binary(text, F.lit("base64")), "UTF-8")).otherwise(text)
            out.append(("contentMediaType", text.isNotNull() & ~media_syntax(s["contentMediaType"], raw), f"is not {s['contentMediaType']}"))
        return out

    @staticmethod
    def _multiple(v, by: float) -> Column:
        """Whole numbers are divided exactly: v is a multiple of p / q, in lowest terms, if p divides v q, and so, as they share no
        factor, if p divides v. For other numbers the quotient may be off by 1e-9 of itself."""
        exact = Fraction(repr(by))
        if exact <= 0:
            return F.lit(False)
        quotient = v.number() / F.lit(float(by))
        near = F.abs(quotient - F.round(quotient)) < 1e-9 * F.greatest(F.lit(1.0), F.abs(quotient))
        p = F.lit(exact.numerator) if exact.numerator < 2**63 else F.lit(str(exact.numerator)).cast("decimal(38,0)")
        return F.when(v.integer().isNotNull(), v.integer() % p == 0).otherwise(near)

    def _format(self, kind: str, name: str, v, text: Column) -> Column | None:
        """Whether a value of the type that the format is for breaks it; None for formats that aren't known."""
        if (kind, name) in formats.CUSTOM:
            return ~F.written(formats.CUSTOM[kind, name](text if kind == "string" else v.number()))
        if kind == "string" and name in formats.STRING:
            return ~F.coalesce(formats.STRING[name](text), text.isNull())
        if name == "int32" and kind == "integer":
            return ~v.integer().between(-(2**31), 2**31 - 1)
        if name in ("float", "double") and kind == "number":
            return v.number().isNotNull() & ~v.fraction()
        if name == "int64" and kind == "integer":
            return None
        if self.strict:
            raise ContractError(f"format {name} of {kind} is unknown")
        return None

    # objects

    def _sizes(self, s: dict, v) -> list[Check]:
        out: list[Check] = []
        for k, size, kind in (("minItems", v.size, "array"), ("maxItems", v.size, "array"), ("minProperties", lambda: F.size(v.keys()), "object"), ("maxProperties", lambda: F.size(v.keys()), "object")):
            if k in s:
                wrong = size() < s[k] if k.startswith("min") else size() > s[k]
                out.append((k, v.is_type(kind) & wrong, f"breaks {k} {s[k]}"))
        if s.get("uniqueItems") is True and (keys := v.elements(lambda x, i: x.key())) is not None:
            out.append(("uniqueItems", bind(keys, lambda k: F.size(F.array_distinct(k)) < F.size(k)), "has equal items"))
        if "contains" in s and (hits := v.elements(lambda x, i: self.valid(s["contains"], x))) is not None:
            n, least, most = F.size(F.filter(hits, lambda x: x)), s.get("minContains", 1), s.get("maxContains")
            out.append(("contains", v.is_type("array") & (n < least), f"has under {least} matching items"))
            if most is not None:
                out.append(("maxContains", v.is_type("array") & (n > most), f"has over {most} matching items"))
        return out

    def _objects(self, s: dict, v, path: Column, at: str) -> list[Column]:
        out, is_object = [], v.is_type("object")
        child = lambda key: F.concat(path, F.lit("/"), key)
        if s.get("required"):
            there = {k: F.coalesce(got[1], F.lit(False)) if (got := v.get(k)) is not None else F.lit(False) for k in dict.fromkeys(s["required"])}
            out += [self._if(is_object & ~x, "required", child(F.lit(k)), at, f"{k} is missing") for k, x in there.items()]
        for name, sub in (s.get("properties") or {}).items():
            if (got := v.get(name)) is not None and sub is not True and sub != {}:
                value, present = got
                found = self.violations(sub, value, child(F.lit(name)), f"{at}/properties/{name}")
                if self.mode and isinstance(sub, dict):
                    barred = {"request": "readOnly", "response": "writeOnly"}[self.mode]
                    if self.contract.deref(sub).get(barred) is True:
                        found = F.concat(F.array(self._one(barred, child(F.lit(name)), f"{at}/properties/{name}", f"must not be in a {self.mode}")), found)
                out.append(F.when(F.coalesce(present, F.lit(False)), found).otherwise(none()))
        patterns = s.get("patternProperties") or {}
        for pattern, sub in patterns.items():
            names = F.filter(v.keys(), lambda k: k.rlike(java_pattern(pattern)))  # noqa: B023  (called at once)
            found = v.members(names, lambda x, k, sub=sub, p=pattern: self.violations(sub, x, child(k), f"{at}/patternProperties/{p}"))
            if found is not None:
                out.append(F.when(is_object, F.flatten(found)).otherwise(none()))
        extra = s.get("additionalProperties", True)
        if extra is not True and extra != {}:
            names = self._additional(s, v)
            if extra is False:
                one = lambda k: self._one("additionalProperties", child(k), at, F.concat(k, F.lit(" isn't allowed")))
                over = lambda ks: self._if(F.size(ks) > MAX_ADDITIONAL, "additionalProperties", path, at, F.concat((F.size(ks) - MAX_ADDITIONAL).cast("string"), F.lit(" more aren't allowed")))
                found = bind(names, lambda ks: F.concat(F.transform(F.slice(ks, 1, MAX_ADDITIONAL), one), over(ks)))
                out.append(F.when(is_object, found).otherwise(none()))
            elif (found := v.members(names, lambda x, k: self.violations(extra, x, child(k), f"{at}/additionalProperties"))) is not None:
                out.append(F.when(is_object, F.flatten(found)).otherwise(none()))
        if "propertyNames" in s:
            found = F.transform(v.keys(), lambda k: F.when(~self.valid(s["propertyNames"], Typed(k, StringType())), self._one("propertyNames", child(k), at, "isn't an allowed name")))
            out.append(F.when(is_object, F.array_compact(found)).otherwise(none()))
        for name, sub in (s.get("dependentSchemas") or {}).items():
            out.append(F.when(is_object & F.array_contains(v.keys(), name), self.violations(sub, v, path, f"{at}/dependentSchemas/{name}")).otherwise(none()))
        return out

    # arrays

    def _arrays(self, s: dict, v, path: Column, at: str) -> list[Column]:
        out, is_array = [], v.is_type("array")
        child = lambda i: F.concat(path, F.lit("/"), i.cast("string"))
        prefix = s.get("prefixItems") or []
        for i, sub in enumerate(prefix):
            if (x := v.element(i)) is not None:
                out.append(F.when(is_array & (v.size() > i), self.violations(sub, x, child(F.lit(i)), f"{at}/prefixItems/{i}")).otherwise(none()))
        items = s.get("items", True)
        if items is False:
            out.append(self._if(is_array & (v.size() > len(prefix)), "items", path, at, "has more items than allowed"))
        elif items is not True and items != {} and (found := v.elements(lambda x, i: self.violations(items, x, child(i), f"{at}/items"), len(prefix))) is not None:
            out.append(F.when(is_array, F.flatten(found)).otherwise(none()))
        return out

    # annotations

    def evaluated(self, s: Any, v, of: str, own: bool = True) -> Column:
        """The keys (``of`` properties) or places (``of`` items) of a value that a schema which holds has evaluated. A branch gives
        its own where it holds. ``own``: whether unevaluated ones that pass count, as they do for schemas around this one."""
        nothing = F.array().cast("array<string>" if of == "properties" else "array<int>")
        if not isinstance(s, dict):
            return nothing
        parts: list[Column] = []

        def branch(sub: Any, condition: Column | None = None) -> None:
            holds = self.valid(sub, v) if condition is None else condition & self.valid(sub, v)
            if isinstance(sub, dict):
                parts.append(F.when(holds, self.evaluated(sub, v, of)).otherwise(nothing))

        if isinstance(ref := s.get("$ref", s.get(REFERRED)), str):
            branch(self.contract.schema(ref))
        if isinstance(s.get("discriminator"), dict):
            table, default = self._routes(s)
            got = v.get(s["discriminator"]["propertyName"]) if "propertyName" in s["discriminator"] else None
            if got is None:
                return self.evaluated({"$ref": default}, v, of) if default and "propertyName" not in s["discriminator"] else nothing
            known = F.lit(False)
            for key, ref in table.items():
                branch({"$ref": ref}, F.coalesce(got[0].string() == key, F.lit(False)))
                known = known | F.coalesce(got[0].string() == key, F.lit(False))
            if default:
                branch({"$ref": default}, ~known)
            if "oneOf" in s:
                return F.concat(*parts) if parts else nothing
        for k in ("allOf", "anyOf", "oneOf"):
            for sub in s.get(k) or []:
                branch(sub)
        if "if" in s:
            branch(s["if"])
            for k in ("then", "else"):
                if k in s:
                    branch(s[k], self.valid(s["if"], v) if k == "then" else ~self.valid(s["if"], v))
        for name, sub in (s.get("dependentSchemas") or {}).items():
            branch(sub, F.array_contains(v.keys(), name))
        parts += self._evaluated_keys(s, v, own) if of == "properties" else self._evaluated_places(s, v, own)
        return F.concat(nothing, *parts) if parts else nothing

    def _evaluated_keys(self, s: dict, v, own: bool) -> list[Column]:
        names, parts = list(s.get("properties") or {}), []
        if "additionalProperties" in s or own and s.get("unevaluatedProperties") in (True, {}):
            return [v.keys()]
        if names:
            parts.append(F.array_intersect(v.keys(), F.array(*map(F.lit, names))))
        parts += [F.filter(v.keys(), lambda k, p=p: k.rlike(java_pattern(p))) for p in s.get("patternProperties") or {}]
        if own and isinstance(s.get("unevaluatedProperties"), dict):
            fits = v.members(v.keys(), lambda x, k: F.when(self.valid(s["unevaluatedProperties"], x), k))
            parts += [F.array_compact(fits)] if fits is not None else []
        return parts

    def _evaluated_places(self, s: dict, v, own: bool) -> list[Column]:
        every, prefix, parts = places(v.size()), len(s.get("prefixItems") or []), []
        if s.get("items", False) is not False or own and s.get("unevaluatedItems") in (True, {}):
            return [every]
        if prefix:
            parts.append(F.slice(every, 1, prefix))
        fitting = [s[k] for k in ("contains", *(["unevaluatedItems"] if own else [])) if k in s and s[k] is not False]
        for sub in fitting:
            hits = v.elements(lambda x, i, sub=sub: F.when(self.valid(sub, x), i))
            parts += [F.coalesce(F.array_compact(hits), F.array().cast("array<int>"))] if hits is not None else []
        return parts

    def _left(self, s: dict, v) -> tuple[Column | None, Column | None]:
        """Keys and places that nothing has evaluated, where the schema asks for them."""
        keys = F.array_except(v.keys(), self.evaluated(s, v, "properties", False)) if s.get("unevaluatedProperties", True) not in (True, {}) else None
        left = F.array_except(places(v.size()), self.evaluated(s, v, "items", False)) if s.get("unevaluatedItems", True) not in (True, {}) else None
        return keys, left

    def _valid_unevaluated(self, s: dict, v) -> list[Column]:
        (keys, left), out = self._left(s, v), []
        if keys is not None:
            sub = s["unevaluatedProperties"]
            fits = None if sub is False else v.members(keys, lambda x, k: self.valid(sub, x))
            held = F.size(keys) == 0 if fits is None else F.forall(fits, lambda x: x)
            out.append(~v.is_type("object") | held)
        if left is not None:
            sub = s["unevaluatedItems"]
            held = F.size(left) == 0 if sub is False else F.forall(left, lambda i: self.valid(sub, v.at(i)))
            out.append(~v.is_type("array") | held)
        return out

    def _unevaluated(self, s: dict, v, path: Column, at: str) -> list[Column]:
        (keys, left), out = self._left(s, v), []
        child = lambda key: F.concat(path, F.lit("/"), key)
        if keys is not None:
            sub = s["unevaluatedProperties"]
            bad = keys if sub is False else v.members(keys, lambda x, k: F.when(~self.valid(sub, x), k))
            if bad is not None:
                found = F.transform(F.array_compact(bad), lambda k: self._one("unevaluatedProperties", child(k), at, F.concat(k, F.lit(" isn't allowed"))))
                out.append(F.when(v.is_type("object"), found).otherwise(none()))
        if left is not None:
            sub = s["unevaluatedItems"]
            bad = left if sub is False else F.filter(left, lambda i: ~self.valid(sub, v.at(i)))
            found = F.transform(bad, lambda i: self._one("unevaluatedItems", child(i.cast("string")), at, "isn't allowed"))
            out.append(F.when(v.is_type("array"), found).otherwise(none()))
        return out

    # composition

    def _composed(self, s: dict, v, path: Column, at: str) -> list[Column]:
        out = [self.violations(sub, v, path, f"{at}/allOf/{i}") for i, sub in enumerate(s.get("allOf") or [])]
        for k in ("anyOf", "oneOf"):
            if s.get(k):
                ok = [self.valid(sub, v) for sub in s[k]]
                n = reduce(add, (x.cast("int") for x in ok))
                wrong = n != 1 if k == "oneOf" else n == 0
                out.append(self._if(wrong, k, path, at, F.concat(F.lit("fits "), n.cast("string"), F.lit(f" of {len(ok)} schemas"))))
        if "not" in s:
            out.append(self._if(self.valid(s["not"], v), "not", path, at, "fits a schema that it must not fit"))
        if "if" in s and ("then" in s or "else" in s):
            ok = self.valid(s["if"], v)
            out.append(F.when(ok, self.violations(s.get("then", True), v, path, f"{at}/then")).otherwise(self.violations(s.get("else", True), v, path, f"{at}/else")))
        return out

    def _routes(self, s: dict) -> tuple[dict[str, str], str | None]:
        """References by value of the property, explicit mapping first, then the last part of each; and the default."""
        d, whole = s["discriminator"], whole_reference
        table: dict[str, str] = {}
        for k in ("oneOf", "anyOf", "allOf"):
            table |= {sub["$ref"].rsplit("/", 1)[-1]: sub["$ref"] for sub in s.get(k) or [] if isinstance(sub, dict) and "$ref" in sub}
        table |= {k: whole(r) for k, r in (d.get("mapping") or {}).items()}
        return table, whole(d["defaultMapping"]) if d.get("defaultMapping") else None

    def _discriminated(self, s: dict, v) -> Column:
        table, default = self._routes(s)
        name = s["discriminator"].get("propertyName")
        if name is None:
            return self.valid({"$ref": default}, v) if default else F.lit(True)
        if (got := v.get(name)) is None:
            return F.lit(False)
        text = got[0].string()
        made = F.when(~v.is_type("object") | ~F.coalesce(got[1], F.lit(False)) | text.isNull(), F.lit(False))
        for key, ref in table.items():
            made = made.when(text == key, self.valid({"$ref": ref}, v))
        return made.otherwise(self.valid({"$ref": default}, v) if default else F.lit(False))

    def _discriminator(self, s: dict, v, path: Column, at: str) -> Column:
        """One branch for each value of the property. Without a name of the property the default alone counts."""
        table, default = self._routes(s)
        name = s["discriminator"].get("propertyName")
        if name is None:
            return self.violations({"$ref": default}, v, path, at) if default else none()
        got = v.get(name)
        fail = lambda message: F.array(self._one("discriminator", path, at, message))
        if got is None:
            return fail(f"{name} is missing")
        value, present = got
        text = value.string()
        made = F.when(~v.is_type("object"), fail("is not an object")).when(~F.coalesce(present, F.lit(False)), fail(f"{name} is missing")).when(text.isNull(), fail(f"{name} is not a string"))
        for key, ref in table.items():
            made = made.when(text == key, self.violations({"$ref": ref}, v, path, f"{at}/discriminator"))
        return made.otherwise(self.violations({"$ref": default}, v, path, at) if default else fail(f"{name} names no schema"))

    def warnings(self, schema: Any, value: Typed | Variant, path: Column | None = None, at: str = "#") -> Column:
        """Deprecated properties that are there, at any depth of properties and items; they make nothing invalid."""
        path = F.lit("") if path is None else path
        if F.plain(value.c):
            return value.as_text(lambda v: self.warnings(schema, v, path, at))
        schema = self.contract.schema(schema["$ref"]) if isinstance(schema, dict) and isinstance(schema.get("$ref"), str) else schema
        if not has_deprecated(self.contract, schema):
            return none()

        def of(v) -> Column:
            parts = []
            for name, sub in (schema.get("properties") or {}).items():
                if isinstance(sub, dict) and (got := v.get(name)) is not None:
                    here = F.concat(path, F.lit(f"/{name}"))
                    own = F.array(self._one("deprecated", here, f"{at}/properties/{name}", f"{name} is deprecated")) if self.contract.deref(sub).get("deprecated") is True else none()
                    parts.append(F.when(F.coalesce(got[1], F.lit(False)), F.concat(own, self.warnings(sub, got[0], here, f"{at}/properties/{name}"))).otherwise(none()))
            items = schema.get("items")
            if isinstance(items, dict) and has_deprecated(self.contract, items) and (found := v.elements(lambda x, i: self.warnings(items, x, F.concat(path, F.lit("/"), i.cast("string")), f"{at}/items"))) is not None:
                parts.append(F.coalesce(F.flatten(found), none()))
            return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none()

        return value.bound(of)


#: Where what stands beside a reference keeps it, as what it evaluates counts there.
REFERRED = "$referred"


def beside(schema: dict) -> dict:
    """The keywords beside a reference."""
    rest = {k: v for k, v in schema.items() if k != "$ref"}
    return rest | {REFERRED: schema["$ref"]} if rest else rest


def places(size: Column) -> Column:
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def checked_pattern(pattern: str) -> str:
    try:
        return java_pattern(pattern)
    except HostilePattern as e:
        raise ContractError(str(e)) from e


def has_deprecated(contract: Contract, schema: Any, seen: tuple[str, ...] = ()) -> bool:
    """Whether a property below is deprecated; a reference is followed once on each path."""
    if not isinstance(schema, dict):
        return False
    if isinstance(ref := schema.get("$ref"), str):
        return ref not in seen and has_deprecated(contract, contract.resolve(ref)[0], (*seen, ref))
    below = (schema.get("properties") or {}).values()
    return any(isinstance(x, dict) and contract.deref(x).get("deprecated") is True for x in below) or any(has_deprecated(contract, x, seen) for x in [*below, schema.get("items")])


#: How a text of a media type looks; of other types none does. JSON is parsed.
MEDIA = {
    "text/plain": r"", "application/octet-stream": r"", "text/html": r"(?is)^\s*(?:<!doctype html|<html|<[a-z][^>]*>)", "application/xml": r"(?s)^\s*<[^>]+>.*>\s*$", "text/xml": r"(?s)^\s*<[^>]+>.*>\s*$",
    "image/svg+xml": r"<svg[\s>]", "application/pdf": r"^%PDF-", "image/png": r"^.PNG", "image/gif": r"^GIF8[79]a", "image/jpeg": "^\ufffd{2}", "multipart/form-data": r"^--",
    "application/x-www-form-urlencoded": r"^[^\s=&]*(?:=[^\s&]*)?(?:&[^\s&]*){0,999}$",
}


def media_syntax(media: str, raw: Column) -> Column:
    """Whether a text looks like the media type."""
    if media.lower() == "application/json":
        return F.try_parse_json(raw).isNotNull()
    rule = MEDIA.get(media.lower())
    return F.lit(False) if rule is None else F.coalesce(raw.rlike(rule), F.lit(False))
