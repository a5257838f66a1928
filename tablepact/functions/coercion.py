"""Strings of parameters and headers as typed values. Lenient functions leave null what can't be read; ``bad_*`` tell so."""

from __future__ import annotations

from pyspark.sql import Column

from . import text as F
from .strings import bind

TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def to_boolean(s: Column, strict: bool = True) -> Column:
    low = F.lower(s)
    known = F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False)
    return known if strict else known.otherwise(~s.isin("", "0"))


def to_integer(s: Column, strict: bool = True) -> Column:
    """Digits with a sign or without, leading zeros dropped; what doesn't fit 64 bits is null. Leniently the number that a text
    begins with, cut to an integer, and 0 where it begins with none."""
    if not strict:
        number = F.regexp_extract(s, r"^[ \t\n\r\x0b\f]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)", 1)
        return F.when(s.isNotNull(), F.when(number == "", F.lit(0).cast("bigint")).otherwise(number.try_cast("decimal(38,9)").try_cast("bigint")))
    return F.when(s.rlike(r"^[+-]?\d+\z"), s.try_cast("bigint"))


def to_number(s: Column) -> Column:
    """A finite double that keeps the digits written (17 significant ones at most)."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[eE].*", ""), r"[+.-]", ""), r"^0+|0+\z", "")
    value = s.try_cast("double")
    return F.when(s.rlike(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\z") & (F.length(digits) <= 17) & (F.abs(value) < float("inf")), value)


def to_array(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, ","), F.trim), lambda x: x != "")


COERCE = {"integer": to_integer, "number": to_number, "boolean": to_boolean, "string": lambda s: s, "array": to_array}


def coerce_body(contract, schema, v, strict: bool = True) -> Column:
    """JSON text of a VARIANT (``values.Variant``) in which strings are what the schema's types take them for, at any depth of
    properties and items; the rest stays as it is. The schema must be one without recursion."""
    schema = contract.schema(schema["$ref"]) if isinstance(schema, dict) and isinstance(schema.get("$ref"), str) else schema
    if not isinstance(schema, dict):
        return F.to_json(v.c)
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    made = F.when(v.string().isNotNull(), coerce_json(v.string(), kinds, strict))
    props, items = schema.get("properties") or {}, schema.get("items")
    if props:
        def member(e: Column) -> Column:
            value = None
            for name, sub in props.items():
                one = coerce_body(contract, sub, type(v)(e["value"]), strict)
                value = F.when(e["key"] == name, one) if value is None else value.when(e["key"] == name, one)
            key = F.regexp_extract(F.to_json(F.struct(e["key"].alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1)
            return F.concat(key, F.lit(":"), value.otherwise(F.to_json(e["value"])))

        made = made.when(v.is_type("object"), F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(v.map()), member), ","), F.lit("}")))
    if isinstance(items, dict):
        made = made.when(v.is_type("array"), F.concat(F.lit("["), F.array_join(v.elements(lambda x, i: coerce_body(contract, items, x, strict)), ","), F.lit("]")))
    return made.otherwise(F.to_json(v.c))


def coerce_json(s: Column, kinds: list[str], strict: bool = True) -> Column:
    """A string as JSON text of the first of ``kinds`` that takes it; as a JSON string otherwise."""
    lenient = {"integer": lambda x: to_integer(x, False), "boolean": lambda x: to_boolean(x, False)}
    known = COERCE if strict else COERCE | lenient

    def of(s: Column) -> Column:
        # a number or boolean that is written out as a text is its own JSON, but for doubles
        inner = [F.to_json(F.array(known[k](s))) if k == "number" else known[k](s).cast("string") for k in kinds if k in ("integer", "number", "boolean")]
        inner = [F.when(x != "[null]", F.regexp_extract(x, r"^\[(.*)\]\z", 1)) if k == "number" else x for k, x in zip((k for k in kinds if k in ("integer", "number", "boolean")), inner)]
        return F.coalesce(*inner, F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1))

    return bind(s, of) if any(k in ("integer", "number", "boolean") for k in kinds) else of(s)
