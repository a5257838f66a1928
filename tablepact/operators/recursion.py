"""Recursive schemas without Python: values are held against their schema level by level.

A reference that leads back to itself is cut where it stands. What is left of a schema compiles like any other, and so
does the list of values that its cut references ask about, each with its place and the number of its schema. Beginning with
the value itself, a step checks all values of the frontier and moves on to those that they ask about, until there are none.
The steps are one aggregation over an array in each row, so the work follows the depth of the values, and the plan holds each schema once.

References can be cut where a value must hold for them whatever else does: below properties, items and allOf. Those
in choices (anyOf, oneOf, not, if, contains, ...) need an answer on the spot; such schemas go to the interpreter. Values nested over
``MAX_DEPTH`` schemas are violations, as there; which of the places at that depth are told may differ.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column

from ..functions import text as F
from ..functions.strings import java_pattern
from ..sources.contract import Contract
from .schema import NONE, Compiler, compilable, none
from .values import Variant

#: Fixed value: deepest nesting of schemas.
MAX_DEPTH = 64
OPEN = "array<struct<v:variant,path:string,kind:int,depth:int>>"
STATE = f"struct<open:{OPEN},found:{NONE}>"


def carried(schema: dict) -> list[Any]:
    """Schemas that must hold for a part of the value, or for all of it, if this one does."""
    below = [s for k in ("properties", "patternProperties") for s in (schema.get(k) or {}).values()]
    return below + [schema[k] for k in ("items", "additionalProperties") if k in schema] + [s for k in ("prefixItems", "allOf") for s in schema.get(k) or []]


def cut_references(contract: Contract, schema: Any) -> list[str] | None:
    """References to cut so that nothing recurs; None where that isn't enough or a schema can't be compiled besides."""
    cuts: list[str] = []

    def walk(s: Any, seen: tuple[str, ...]) -> None:
        if not isinstance(s, dict):
            return
        if isinstance(ref := s.get("$ref"), str):
            if ref in seen:
                cuts.extend([ref] if ref not in cuts else [])
                return
            walk(contract.schema(ref), (*seen, ref))
        for sub in carried(s):
            walk(sub, seen)

    walk(schema, ())
    if not cuts:
        return None
    return cuts if all(compilable(Cut(contract, cuts), s) for s in [schema, *(contract.schema(r) for r in cuts)]) and not chosen_recursion(contract, [schema, *map(contract.schema, cuts)], cuts) else None


def chosen_recursion(contract: Contract, schemas: list[Any], cuts: list[str]) -> bool:
    """Whether a cut reference stands where it can't be cut."""
    todo, seen = [(s, True) for s in schemas], set()
    while todo:
        s, free = todo.pop()
        if isinstance(s, list):
            todo += [(x, free) for x in s]
            continue
        if not isinstance(s, dict):
            continue
        ref = s.get("$ref")
        if isinstance(ref, str):
            if ref in cuts and not free:
                return True
            if ref not in cuts and (ref, free) not in seen:
                seen.add((ref, free))
                todo.append((contract.schema(ref), free))
        todo += [(x, free and not any(k in s for k in ("unevaluatedProperties", "unevaluatedItems"))) for x in carried(s)]
        todo += [(s[k], False) for k in ("anyOf", "oneOf", "not", "if", "then", "else", "contains", "propertyNames", "unevaluatedProperties", "unevaluatedItems") if k in s]
        todo += [(x, False) for x in (s.get("dependentSchemas") or {}).values()]
        if isinstance(d := s.get("discriminator"), dict):
            todo += [({"$ref": r if "/" in r or "#" in r else f"#/components/schemas/{r}"}, False) for r in [*(d.get("mapping") or {}).values(), *([d["defaultMapping"]] if d.get("defaultMapping") else [])]]
    return False


class Cut(Contract):
    """A contract in which the references that are cut hold for everything."""

    def __init__(self, contract: Contract, cuts: list[str]):
        self.__dict__.update(contract.__dict__)
        self._cuts = set(cuts)

    def resolve(self, ref: str, within: str = "") -> tuple[Any, str]:
        return (True, "") if ref in self._cuts else super().resolve(ref, within)


class Trees:
    def __init__(self, compiler: Compiler, schema: Any, cuts: list[str]):
        self.contract, self.numbers = compiler.contract, {r: i for i, r in enumerate(cuts, 1)}
        self.compiler = Compiler(Cut(compiler.contract, cuts), mode=compiler.mode, strict_formats=compiler.strict)
        self.schemas = [schema, *(compiler.contract.schema(r) for r in cuts)]

    def asked(self, s: Any, v: Variant, path: Column, depth: Column, steps: int) -> list[Column]:
        """Arrays of the values that cut references below a schema ask about."""
        if not isinstance(s, dict):
            return []
        out: list[Column] = []
        child = lambda k: F.concat(path, F.lit("/"), k)
        if isinstance(ref := s.get("$ref"), str):
            if ref in self.numbers:
                node = F.struct(v.c.alias("v"), path.alias("path"), F.lit(self.numbers[ref]).alias("kind"), (depth + (steps + 1)).alias("depth"))
                out.append(F.array(node).cast(OPEN))
            else:
                out += self.asked(self.contract.schema(ref), v, path, depth, steps + 1)
        for sub in s.get("allOf") or []:
            out += self.asked(sub, v, path, depth, steps + 1)
        nothing = F.array().cast(OPEN)
        for name, sub in (s.get("properties") or {}).items():
            value, present = v.get(name)
            if found := self.asked(sub, value, child(F.lit(name)), depth, steps + 1):
                out.append(F.when(F.coalesce(present, F.lit(False)), joined(found)).otherwise(nothing))
        named = [(sub, lambda p=p: F.filter(v.keys(), lambda k: k.rlike(java_pattern(p)))) for p, sub in (s.get("patternProperties") or {}).items()]
        named += [(s["additionalProperties"], lambda: self.compiler._additional(s, v))] if isinstance(s.get("additionalProperties"), dict) else []
        for sub, names in named:
            if self.asked(sub, v, path, depth, steps):
                each = v.members(names(), lambda x, k, sub=sub: joined(self.asked(sub, x, child(k), depth, steps + 1)))
                out.append(F.coalesce(F.flatten(each), nothing))
        prefix = s.get("prefixItems") or []
        for i, sub in enumerate(prefix):
            if found := self.asked(sub, v.element(i), child(F.lit(str(i))), depth, steps + 1):
                out.append(F.when(v.size() > i, joined(found)).otherwise(nothing))
        if isinstance(s.get("items"), dict) and self.asked(s["items"], v, path, depth, steps):
            each = v.elements(lambda x, i: joined(self.asked(s["items"], x, child(i.cast("string")), depth, steps + 1)), len(prefix))
            out.append(F.coalesce(F.flatten(each), nothing))
        return out

    def violations(self, value: Column, path: Column) -> Column:
        by_kind = lambda n, of: chosen_by(n["kind"], [of(s) for s in self.schemas])

        def step(state: Column, _: Column) -> Column:
            within = F.filter(state["open"], lambda n: n["depth"] <= MAX_DEPTH)
            beyond = F.transform(F.filter(state["open"], lambda n: n["depth"] > MAX_DEPTH), lambda n: self.compiler._one("depth", n["path"], "#", f"schemas are nested over {MAX_DEPTH} levels"))
            found = F.flatten(F.transform(within, lambda n: by_kind(n, lambda s: self.compiler.violations(s, Variant(n["v"]), n["path"]))))
            more = F.flatten(F.transform(within, lambda n: by_kind(n, lambda s: joined(self.asked(s, Variant(n["v"]), n["path"], n["depth"], 0)))))
            moved = F.struct(more.alias("open"), F.concat(state["found"], beyond, found).alias("found")).cast(STATE)
            return F.when(F.size(state["open"]) == 0, state).otherwise(moved)

        first = F.array(F.struct(value.alias("v"), path.alias("path"), F.lit(0).alias("kind"), F.lit(0).alias("depth")))
        start = F.struct(first.alias("open"), none().alias("found")).cast(STATE)
        return F.aggregate(F.sequence(F.lit(0), F.lit(MAX_DEPTH + 1)), start, step, lambda state: state["found"])


def joined(found: list[Column]) -> Column:
    return F.concat(*found) if len(found) > 1 else found[0] if found else F.array().cast(OPEN)


def chosen_by(kind: Column, made: list[Column]) -> Column:
    out = None
    for i, m in enumerate(made[:-1]):
        out = F.when(kind == i, m) if out is None else out.when(kind == i, m)
    return made[-1] if out is None else out.otherwise(made[-1])


def trees(compiler: Compiler, schema: Any) -> Trees | None:
    """How to check a recursive schema without Python, if that is possible."""
    cuts = cut_references(compiler.contract, schema)
    return None if cuts is None else Trees(compiler, schema, cuts)
