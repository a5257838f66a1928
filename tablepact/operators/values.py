"""What a schema is checked against: a typed column, or a VARIANT column. Both offer the same questions as expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import types as T

from ..functions import text as F

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


def number_key(x: Column) -> Column:
    """Equal numbers have equal keys; whole doubles below 2^53 are written like integers."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 2**53), F.concat(F.lit("n"), F.floor(x).cast("bigint").cast("string"))).otherwise(F.concat(F.lit("d"), x.cast("string")))


TOKEN = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def canonical(text: Column) -> Column:
    """JSON text of a VARIANT, whose keys are in order, with its numbers as ``number_key`` writes them; strings stay as they are."""
    whole = lambda t: F.concat(F.lit("n"), F.when(t == "-0", "0").otherwise(t))
    number = lambda t: F.when(t.rlike(r"^-?[0-9]+\z"), whole(t)).otherwise(number_key(t.cast("double")))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.when(t.rlike(r"^-?[0-9]"), number(t)).otherwise(t)), "")


class Typed:
    """A column of a known type; null is JSON's null, and a struct always has all of its fields."""

    def __init__(self, column: Column, kind: T.DataType):
        self.c, self.kind = column, kind

    def bound(self, body: Callable[[Typed], Column]) -> Column:
        return body(self)

    def as_text(self, body: Callable[[Typed], Column]) -> Column:
        """``body`` of the same value as text, see ``functions.text``."""
        name = F.text_of(self.c)
        return F.bound_to(self.c, lambda c: body(Typed(c, self.kind))) if name is None else body(Typed(name, self.kind))

    @property
    def null(self) -> Column:
        return self.c.isNull()

    def is_type(self, name: str) -> Column:
        k, there = self.kind, self.c.isNotNull()
        if name == "null":
            return ~there
        if name == "integer" and isinstance(k, (T.FloatType, T.DoubleType, T.DecimalType)):
            return there & F.coalesce(self.c % 1 == 0, F.lit(False))
        fits = {
            "string": isinstance(k, (T.StringType, T.DateType, T.TimestampType)), "number": isinstance(k, NUMBERS), "integer": isinstance(k, INTEGRAL), "boolean": isinstance(k, T.BooleanType),
            "array": isinstance(k, T.ArrayType), "object": isinstance(k, (T.StructType, T.MapType)),
        }
        return there if fits.get(name) else F.lit(False)

    def fraction(self) -> Column:
        """Whether a number is written as a float."""
        return F.lit(isinstance(self.kind, (T.FloatType, T.DoubleType, T.DecimalType)))

    def integer(self) -> Column:
        return self.c.cast("bigint") if isinstance(self.kind, INTEGRAL) else F.lit(None).cast("bigint")

    def number(self) -> Column:
        return self.c.cast("double") if isinstance(self.kind, NUMBERS) else F.lit(None).cast("double")

    def string(self) -> Column:
        if isinstance(self.kind, T.TimestampType):
            return F.date_format(self.c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        return self.c.cast("string") if isinstance(self.kind, (T.StringType, T.DateType)) else F.lit(None).cast("string")

    def key(self) -> Column:
        k = self.kind
        if isinstance(k, T.BooleanType):
            made = F.concat(F.lit("b"), self.c.cast("string"))
        elif isinstance(k, INTEGRAL):
            made = F.concat(F.lit("n"), self.c.cast("string"))
        elif isinstance(k, NUMBERS):
            made = number_key(self.c.cast("double"))
        elif isinstance(k, (T.StringType, T.DateType, T.TimestampType)):
            made = F.concat(F.lit("s"), self.string())
        else:
            made = F.concat(F.lit("j"), canonical(F.to_json(F.to_variant_object(self.c))))
        return F.coalesce(made, F.lit("z"))

    def size(self) -> Column:
        return F.coalesce(F.size(self.c), F.lit(0)) if isinstance(self.kind, T.ArrayType) else F.lit(0)

    def elements(self, body: Callable[[Typed, Column], Column], start: int = 0) -> Column | None:
        if not isinstance(self.kind, T.ArrayType):
            return None
        all_of = F.slice(self.c, start + 1, F.greatest(F.size(self.c) - start, F.lit(0))) if start else self.c
        return F.transform(all_of, lambda x, i: body(Typed(x, self.kind.elementType), i + start))

    def element(self, i: int) -> Typed | None:
        return Typed(F.get(self.c, F.lit(i)), self.kind.elementType) if isinstance(self.kind, T.ArrayType) else None

    def at(self, i: Column) -> Typed:
        """The element at a place that is there."""
        return Typed(F.get(self.c, i), self.kind.elementType if isinstance(self.kind, T.ArrayType) else T.NullType())

    def keys(self) -> Column:
        if isinstance(self.kind, T.StructType):
            return F.array(*(F.lit(f.name) for f in self.kind.fields)) if self.kind.fields else F.array().cast("array<string>")
        return F.map_keys(self.c) if isinstance(self.kind, T.MapType) else F.array().cast("array<string>")

    def get(self, key: str) -> tuple[Typed, Column] | None:
        if isinstance(self.kind, T.StructType):
            return (Typed(self.c[key], self.kind[key].dataType), self.c.isNotNull()) if key in self.kind.names else None
        if isinstance(self.kind, T.MapType):
            return Typed(F.try_element_at(self.c, F.lit(key)), self.kind.valueType), F.coalesce(F.map_contains_key(self.c, key), F.lit(False))
        return None

    def members(self, names: Column, body: Callable[[Typed, Column], Column]) -> Column | None:
        if isinstance(self.kind, T.MapType):
            return F.transform(names, lambda k: body(Typed(F.try_element_at(self.c, k), self.kind.valueType), k))
        if isinstance(self.kind, T.StructType):
            parts = [F.when(F.array_contains(names, f.name), F.array(body(Typed(self.c[f.name], f.dataType), F.lit(f.name)))) for f in self.kind.fields]
            return F.flatten(F.array_compact(F.array(*parts))) if parts else None
        return None


class Variant:
    """A VARIANT column; SQL null is an absent value, JSON's null a value of its own."""

    def __init__(self, column: Column):
        self.c = column

    def bound(self, body: Callable[[Variant], Column]) -> Column:
        """``body`` of the value, of which each question is answered once: what it asks for is a field of one struct."""
        asked: dict[str, Column] = {}
        with F.deeper() as v:
            made = body(Answered(F.Text(v), self, asked))
        if not asked:
            return made
        fields = F.struct(*(c.alias(k) for k, c in asked.items()))
        return F.Text(f"get(transform(array({fields.sql}), {v} -> {F.operand(made, F.OR)}), 0)")

    def as_text(self, body: Callable[[Variant], Column]) -> Column:
        name = F.text_of(self.c)
        return F.bound_to(self.c, lambda c: body(Variant(c))) if name is None else body(Variant(name))

    def tag(self) -> Column:
        return F.schema_of_variant(self.c)

    @property
    def null(self) -> Column:
        return F.coalesce(F.is_variant_null(self.c), F.lit(False))

    def is_type(self, name: str) -> Column:
        t = self.tag()
        if name == "null":
            return self.null
        number = t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        made = {
            "string": t == "STRING", "boolean": t == "BOOLEAN", "array": F.startswith(t, F.lit("ARRAY")), "object": F.startswith(t, F.lit("OBJECT")), "number": number,
            "integer": (t == "BIGINT") | number & F.coalesce(self.number() % 1 == 0, F.lit(False)),
        }[name]
        return F.coalesce(made, F.lit(False))

    def fraction(self) -> Column:
        return F.coalesce(self.tag().rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit(False))

    def integer(self) -> Column:
        return F.when(self.tag() == "BIGINT", F.try_variant_get(self.c, "$", "bigint"))

    def number(self) -> Column:
        return F.when(self.tag().rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(self.c, "$", "double"))

    def string(self) -> Column:
        return F.when(self.tag() == "STRING", F.try_variant_get(self.c, "$", "string"))

    def key(self) -> Column:
        t = self.tag()
        return (
            F.when(self.null, "z").when(t == "STRING", F.concat(F.lit("s"), self.string())).when(t == "BOOLEAN", F.concat(F.lit("b"), F.try_variant_get(self.c, "$", "string")))
            .when(t == "BIGINT", F.concat(F.lit("n"), self.integer().cast("string"))).when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), number_key(self.number())).otherwise(F.concat(F.lit("j"), canonical(F.to_json(self.c))))
        )

    def array(self) -> Column:
        return F.when(F.startswith(self.tag(), F.lit("ARRAY")), F.try_variant_get(self.c, "$", "array<variant>"))

    def map(self) -> Column:
        return F.when(F.startswith(self.tag(), F.lit("OBJECT")), F.try_variant_get(self.c, "$", "map<string,variant>"))

    def size(self) -> Column:
        return F.coalesce(F.size(self.array()), F.lit(0))

    def elements(self, body: Callable[[Variant, Column], Column], start: int = 0) -> Column:
        all_of = F.slice(self.array(), start + 1, F.greatest(self.size() - start, F.lit(0))) if start else self.array()
        return F.transform(all_of, lambda x, i: body(Variant(x), i + start))

    def element(self, i: int) -> Variant:
        return Variant(F.get(self.array(), F.lit(i)))

    def at(self, i: Column) -> Variant:
        return Variant(F.get(self.array(), i))

    def keys(self) -> Column:
        return F.coalesce(F.map_keys(self.map()), F.array().cast("array<string>"))

    def get(self, key: str) -> tuple[Variant, Column]:
        """A member by its path, so that the object isn't taken apart; of what isn't an object none is present."""
        if re.search(r"['\\\]]", key):
            return Variant(F.try_element_at(self.map(), F.lit(key))), F.array_contains(self.keys(), key)
        value = F.try_variant_get(self.c, f"$['{key}']", "variant")
        return Variant(value), value.isNotNull()

    def members(self, names: Column, body: Callable[[Variant, Column], Column]) -> Column:
        return F.transform(names, lambda k: body(Variant(F.try_element_at(self.map(), k)), k))


class Answered(Variant):
    """A VARIANT as a struct of what was asked of it."""

    def __init__(self, struct: F.Text, value: Variant, asked: dict[str, Column]):
        self._struct, self._value, self._asked = struct, value, asked

    def _of(self, name: str, made: Callable[[], Column]) -> Column:
        if name not in self._asked:
            self._asked[name] = made()
        return self._struct[name]

    @property
    def c(self) -> Column:
        return self._of("v", lambda: self._value.c)

    def bound(self, body: Callable[[Variant], Column]) -> Column:
        return body(self)

    def as_text(self, body: Callable[[Variant], Column]) -> Column:
        return body(self)

    def tag(self) -> Column:
        return self._of("t", lambda: self._value.tag())

    @property
    def null(self) -> Column:
        return self._of("z", lambda: self._value.null)

    def is_type(self, name: str) -> Column:
        return self._of(name, lambda: self._value.is_type(name)) if name == "integer" else super().is_type(name)

    def integer(self) -> Column:
        return self._of("i", lambda: self._value.integer())

    def number(self) -> Column:
        return self._of("n", lambda: self._value.number())

    def string(self) -> Column:
        return self._of("s", lambda: self._value.string())

    def key(self) -> Column:
        return self._of("k", lambda: self._value.key())

    def array(self) -> Column:
        return self._of("a", lambda: self._value.array())

    def map(self) -> Column:
        return self._of("m", lambda: self._value.map())
