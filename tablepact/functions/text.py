"""The functions of ``pyspark.sql.functions`` over expressions that are SQL text until Spark asks for them.

A Column made by functions costs several calls into the JVM for each of its parts; a schema of a few keywords has hundreds of parts. ``Text``
is a Column whose JVM side is parsed from its text when it is first needed, so an expression of any size costs one call. Modules
import this one as ``F`` and look the same. What is given an ordinary Column gives an ordinary Column, so both can be mixed.

Equal expressions have equal texts: parameters of lambda functions are named by how deep they are nested. Texts of equal parts can
so be told apart from others and shared by them.
"""

from __future__ import annotations

import inspect
import math
import re
from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as S
from pyspark.sql.classic.column import Column as Classic
from pyspark.sql.types import DataType

#: How tightly a text binds: an operand that binds less than its place asks for is put in parentheses.
OR, AND, NOT, COMPARED, ADDED, MULTIPLIED, ATOM = range(7)
ESCAPED = {"\\": "\\\\", "'": "\\'", "\0": "\\u0000", "\n": "\\n", "\r": "\\r", "\x1a": "\\u001A", "$": "\\u0024"}


def quote(s: str) -> str:
    """A string literal. ``$`` is escaped as Spark puts values in the place of ``${name}``."""
    return "'" + re.sub(r"[\\'\0\n\r\x1a$]", lambda m: ESCAPED[m[0]], s) + "'"


def literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return quote(value)
    if isinstance(value, int):
        text = f"{value}L" if not -(2**31) <= value < 2**31 else str(value)
        return (text if -(2**63) < value < 2**63 else f"{value}BD") if value >= 0 else f"({text})" if -(2**63) < value else f"({value}BD)"
    if isinstance(value, float):
        if not math.isfinite(value):
            return f"double('{value}')"
        return f"{value!r}D" if value >= 0 and not str(value).startswith("-") else f"({value!r}D)"
    raise TypeError(f"no literal for {value!r}")


def plain(x: Any) -> bool:
    """Whether ``x`` is an ordinary Column, which has no text."""
    return isinstance(x, Column) and not isinstance(x, Text)


def operand(x: Any, least: int = ATOM) -> str:
    if isinstance(x, Text):
        return x.sql if x.binds >= least else f"({x.sql})"
    return literal(x)


#: What an operand may be without changing the other.
NEUTRAL = {"__and__": "TRUE", "__or__": "FALSE"}


def binary(sign: str, name: str, binds: int, left: int, right: int) -> tuple[Callable, Callable]:
    def forward(self: Text, other: Any) -> Column:
        if plain(other):
            return getattr(Classic, name)(self, other)
        if name in NEUTRAL and self.sql == NEUTRAL[name]:
            return lit(other)
        if name in NEUTRAL and isinstance(other, Text) and other.sql == NEUTRAL[name]:
            return self
        return Text(f"{operand(self, left)} {sign} {operand(other, right)}", binds)

    def backward(self: Text, other: Any) -> Column:
        if plain(other):  # Python asks the subclass first
            return getattr(Classic, name)(other, self)
        return Text(f"{operand(other, left)} {sign} {operand(self, right)}", binds)

    return forward, backward


class Text(Classic):
    def __new__(cls, *args: Any) -> Text:
        return object.__new__(cls)

    def __init__(self, sql: str, binds: int = ATOM, name: str | None = None) -> None:
        self.sql, self.binds, self.name, self._made = sql, binds, name, None

    @property
    def _jc(self):  # noqa: ANN202
        if self._made is None:
            made = S.expr(self.sql)
            self._made = (made.alias(self.name) if self.name else made)._jc
        return self._made

    def __repr__(self) -> str:
        return f"Text<{self.sql}>"

    def __hash__(self) -> int:
        return id(self)

    __and__, __rand__ = binary("AND", "__and__", AND, AND, AND)
    __or__, __ror__ = binary("OR", "__or__", OR, OR, OR)
    __eq__, _ = binary("=", "__eq__", COMPARED, ADDED, ADDED)
    __ne__, _ = binary("<>", "__ne__", COMPARED, ADDED, ADDED)
    __lt__, _ = binary("<", "__lt__", COMPARED, ADDED, ADDED)
    __le__, _ = binary("<=", "__le__", COMPARED, ADDED, ADDED)
    __gt__, _ = binary(">", "__gt__", COMPARED, ADDED, ADDED)
    __ge__, _ = binary(">=", "__ge__", COMPARED, ADDED, ADDED)
    __add__, __radd__ = binary("+", "__add__", ADDED, ADDED, MULTIPLIED)
    __sub__, __rsub__ = binary("-", "__sub__", ADDED, ADDED, MULTIPLIED)
    __mul__, __rmul__ = binary("*", "__mul__", MULTIPLIED, MULTIPLIED, ATOM)
    __truediv__, __rtruediv__ = binary("/", "__truediv__", MULTIPLIED, MULTIPLIED, ATOM)
    __mod__, __rmod__ = binary("%", "__mod__", MULTIPLIED, MULTIPLIED, ATOM)
    eqNullSafe, _ = binary("<=>", "eqNullSafe", COMPARED, ADDED, ADDED)

    def __invert__(self) -> Text:
        return Text(f"NOT {operand(self, NOT)}", NOT)

    def __neg__(self) -> Text:
        return Text(f"(-{operand(self)})")

    def __getitem__(self, k: Any) -> Column:
        return Text(f"{operand(self)}[{operand(k, OR)}]") if not plain(k) else Classic.__getitem__(self, k)

    def cast(self, kind: str | DataType) -> Text:
        return Text(f"CAST({self.sql} AS {kind if isinstance(kind, str) else kind.simpleString()})")

    def try_cast(self, kind: str | DataType) -> Text:
        return Text(f"TRY_CAST({self.sql} AS {kind if isinstance(kind, str) else kind.simpleString()})")

    def alias(self, *names: str, **kwargs: Any) -> Column:
        return Text(self.sql, self.binds, names[0]) if len(names) == 1 and not kwargs else Classic.alias(self, *names, **kwargs)

    def isNull(self) -> Text:
        return Text(f"isnull({self.sql})")

    def isNotNull(self) -> Text:
        return Text(f"isnotnull({self.sql})")

    def isin(self, *values: Any) -> Column:
        values = tuple(values[0]) if len(values) == 1 and isinstance(values[0], (list, set, tuple)) else values
        if any(map(plain, values)):
            return Classic.isin(self, *values)
        return Text(f"{operand(self, ADDED)} IN ({', '.join(operand(v, OR) for v in values)})", COMPARED) if values else Text("FALSE")

    def between(self, low: Any, high: Any) -> Column:
        return (self >= low) & (self <= high)

    def rlike(self, pattern: str) -> Text:
        return Text(f"rlike({self.sql}, {operand(pattern, OR)})")


class Cases(Text):
    """CASE with its branches so far."""

    def __init__(self, branches: list[tuple[Any, Any]], last: Any = None, closed: bool = False) -> None:
        self.branches, self.closed = branches, closed
        end = f" ELSE {operand(last, OR)}" if closed else ""
        Text.__init__(self, "CASE " + " ".join(f"WHEN {operand(c, OR)} THEN {operand(v, OR)}" for c, v in branches) + end + " END")

    def _plain(self) -> Column:
        made = S
        for c, v in self.branches:
            made = made.when(c, v)
        return made

    def when(self, condition: Column, value: Any) -> Column:
        if plain(condition) or plain(value):
            return self._plain().when(condition, value)
        return self if isinstance(condition, Text) and condition.sql == "FALSE" else Cases([*self.branches, (condition, value)])

    def otherwise(self, value: Any) -> Column:
        return self._plain().otherwise(value) if plain(value) else Cases(self.branches, value, True)


_depth = 0


@contextmanager
def deeper():  # noqa: ANN201
    global _depth
    _depth += 1
    try:
        yield f"__v{_depth}"
    finally:
        _depth -= 1


def over(name: str, first: list[Any], bodies: list[Callable]) -> Column:
    """A function that takes lambda functions."""
    if any(map(plain, first)):
        return getattr(S, name)(*first, *bodies)
    made = []
    with deeper() as v:
        for body in bodies:
            n = sum(p.default is p.empty for p in inspect.signature(body).parameters.values())
            names = [v + "abc"[i] * (n > 1) for i in range(n)]
            got = body(*(Text(x) for x in names))
            if plain(got):
                raise TypeError(f"{name}: the body of a function over text is a Column without text")
            made.append(f"{names[0] if n == 1 else '(' + ', '.join(names) + ')'} -> {operand(got, OR)}")
    return Text(f"{name}({', '.join([*(operand(x, OR) for x in first), *made])})")


#: Functions whose texts among the arguments are names of columns, not values.
OF_COLUMNS = {"array", "array_except", "arrays_overlap", "coalesce", "concat", "greatest", "least", "map_from_arrays", "nullif", "sequence", "struct", "try_element_at"}
OVER = {"transform": 1, "filter": 1, "exists": 1, "forall": 1, "map_filter": 1, "transform_values": 1, "transform_keys": 1, "aggregate": 2, "reduce": 2}


def col(name: str) -> Text:
    return Text(".".join(part if part.startswith("`") or part == "*" else f"`{part}`" for part in re.findall(r"`[^`]*`|[^.]+", name)))


def lit(value: Any) -> Column:
    return value if isinstance(value, Column) else Text(literal(value))


def expr(sql: str) -> Text:
    return Text(sql, OR)


def when(condition: Column, value: Any) -> Column:
    return S.when(condition, value) if plain(condition) or plain(value) else Cases([(condition, value)])


def struct(*columns: Any) -> Column:
    columns = tuple(col(c) if isinstance(c, str) else c for c in columns)
    if any(map(plain, columns)) or not all(c.name for c in columns):
        return S.struct(*columns)
    return Text("named_struct(" + ", ".join(f"{quote(c.name)}, {c.sql}" for c in columns) + ")")


def create_map(*columns: Any) -> Column:
    return S.create_map(*columns) if any(map(plain, columns)) else Text(f"map({', '.join(operand(c, OR) for c in columns)})")


def isnull(c: Column) -> Column:
    return c.isNull()


def call_function(name: str, *args: Any) -> Column:
    return S.call_function(name, *args) if any(map(plain, args)) else Text(f"{name}({', '.join(operand(x, OR) for x in args)})")


def text_of(c: Column) -> Text | None:
    """An ordinary Column as text if it names a column."""
    if not plain(c):
        return c
    node = c._jc.node()
    return Text(node.sql()) if node.getClass().getSimpleName() == "UnresolvedAttribute" else None


def written(c: Column) -> Text:
    """An ordinary Column as text, by Spark's own rendering; functions that take lambda functions have none."""
    if not plain(c):
        return c
    from pyspark.sql import SparkSession

    return Text(SparkSession.active()._jsparkSession.expression(c._jc).sql(), OR)


def bound_to(value: Column, body: Callable[[Text], Column]) -> Column:
    """``body`` of an ordinary Column as text: the value is the parameter of a function that is one text."""
    with deeper() as v:
        made = body(Text(v))
    if plain(made):
        raise TypeError("the body of a function over text is a Column without text")
    return S.get(S.call_function("transform", S.array(value), S.expr(f"{v} -> {operand(made, OR)}")), S.lit(0))


def __getattr__(name: str) -> Callable:
    real = getattr(S, name)
    if name in OVER:
        return lambda *args: over(name, [col(a) if isinstance(a, str) and i == 0 else a for i, a in enumerate(args[: len(args) - sum(map(callable, args))])], [a for a in args if callable(a) and not isinstance(a, Column)]) if any(callable(a) and not isinstance(a, Column) for a in args) else _called(name, real, args)
    if name in {"pandas_udf", "udf", "explode", "window"}:
        return real
    return lambda *args: _called(name, real, args)


def _called(name: str, real: Callable, args: tuple) -> Column:
    if any(map(plain, args)):
        return real(*args)
    args = tuple(col(a) if isinstance(a, str) and (i == 0 and name not in {"concat_ws", "call_function"} or name in OF_COLUMNS) else a for i, a in enumerate(args))
    return Text(f"{name}({', '.join(operand(x, OR) for x in args)})")
