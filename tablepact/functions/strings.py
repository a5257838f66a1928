"""Small expressions that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column

from . import text as F
from .patterns import exponential


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    if isinstance(value, F.Text) and "(" not in value.sql and "CASE" not in value.sql:
        return body(value)
    return F.get(F.transform(F.array(value), body), F.lit(0))


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


class HostilePattern(ValueError):
    """A pattern whose time may grow without bound on short texts."""


def refuse_nested_repeats(pattern: str) -> None:
    """For patterns that the automaton doesn't hold. Java's engine has no limit of steps, so a group that is repeated without bound may hold no unbounded repeat itself, unless
    one of them is possessive. Classes and escapes are skipped."""
    groups, last, i = [False], False, 0
    while i < len(pattern):
        c, ended = pattern[i], None
        if c == "\\":
            i += 1
        elif c == "[":
            i += 1
            while i < len(pattern) and (pattern[i] != "]" or pattern[i - 1] == "["):
                i += 2 if pattern[i] == "\\" else 1
        elif c == "(":
            groups.append(False)
        elif c == ")" and len(groups) > 1:
            ended = groups.pop()
            groups[-1] = groups[-1] or ended
        elif c in "*+" or c == "{" and re.match(r"\{\d*,\d*\}", pattern[i:]):
            i += pattern[i:].index("}") if c == "{" else 0
            possessive = pattern[i + 1 : i + 2] == "+"
            if last and not possessive:
                raise HostilePattern(f"pattern {pattern} repeats a repeat")
            groups[-1] = groups[-1] or not possessive
            i += possessive
        last = bool(ended)
        i += 1


@lru_cache(maxsize=1024)
def java_pattern(pattern: str) -> str:
    """A pattern, with or without delimiters and flags, for Java: unanchored, ``$`` at the very end or before ``\\n`` only."""
    flags = ""
    if len(pattern) > 1 and pattern[0] in "/#~!@%" and (end := pattern.rfind(pattern[0])) > 0 and all(c in "imsxuU" for c in pattern[end + 1 :]):
        flags, pattern = "".join(c for c in pattern[end + 1 :] if c in "imsx"), pattern[1:end]
    found = exponential(pattern)
    if found:
        raise HostilePattern(f"pattern {pattern} has words that it can read in exponentially many ways")
    if found is None:
        refuse_nested_repeats(pattern)
    return f"(?d{flags})" + pattern
