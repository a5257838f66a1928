"""Parameters of requests: found by place, deserialised by style, coerced, as JSON text for the schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import text as F
from ..functions.coercion import coerce_json
from ..functions.strings import bind
from ..sources.decoders import deep_object, pairs, quoted, values_of

MAX_ITEMS, MAX_COOKIES = 1000, 100
STYLE = {"path": "simple", "header": "simple", "query": "form", "cookie": "form"}
SEPARATOR = {"pipeDelimited": r"[|]", "spaceDelimited": " "}
TRIMMED = " \t\n\r\0\x0b"


def cookie_pairs(header: Column) -> Column:
    """Cookies aren't forms: ``+`` stays."""
    return pairs(F.regexp_replace(header, r";\s*", ";"), ";", plus=False)


def header_value(headers: Column, name: str | Column) -> Column:
    """The first value of a header, names without regard to case."""
    wanted = name.lower() if isinstance(name, str) else F.lower(name)
    entry = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == wanted)
    return F.get(F.get(entry, F.lit(0))["value"], F.lit(0))


def path_value(path: Column, regex: str | Column, index: int | Column) -> Column:
    return F.nullif(F.regexp_extract(path, regex, index + 1), F.lit(""))


def split_style(raw: Column, style: str, explode: bool, name: str | Column) -> Column:
    """The items of an array parameter that is written as one value. Forms and values delimited by pipes or spaces are split as they
    stand; in other styles nothing has no items, several items are trimmed, and one alone stays as it is."""
    if style == "form" or style in SEPARATOR:
        return F.split(raw, SEPARATOR.get(style, ","))
    body = scalar_style(raw, style, name)
    mark = F.lit({"label": "."}.get(style, ",") if explode else ",")
    if style == "matrix" and explode:
        mark = F.concat(F.lit(";"), F.lit(name), F.lit("="))
    several = F.transform(F.split(body, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E"))), lambda x: F.btrim(x, F.lit(TRIMMED)))
    return F.when(body == "", F.array().cast("array<string>")).when(F.contains(body, mark), several).when(body.isNotNull(), F.array(body))


def scalar_style(raw: Column, style: str, name: str | Column) -> Column:
    if style == "label":
        return F.regexp_replace(raw, r"^\.", "")
    return F.regexp_replace(raw, F.concat(F.lit(r"^;\Q"), F.lit(name), F.lit(r"\E=")), F.lit("")) if style == "matrix" else raw


def kinds_of(schema) -> list[str]:
    k = schema.get("type", []) if isinstance(schema, dict) else []
    return k if isinstance(k, list) else [k]


@dataclass(frozen=True)
class Signature:
    """How a parameter is read, apart from its name: parameters of one signature are read by one expression."""

    place: str
    style: str
    explode: bool
    kinds: tuple[str, ...]
    items: tuple[str, ...]

    @classmethod
    def of(cls, p: dict, schema) -> Signature:
        style = p.get("style", STYLE.get(p["in"], "form"))
        items = schema.get("items", {}) if isinstance(schema, dict) else {}
        return cls(p["in"], style, bool(p.get("explode", style in ("form", "deepObject"))), tuple(kinds_of(schema)), tuple(kinds_of(items)))

    @property
    def array(self) -> bool:
        return "array" in self.kinds

    def values(self, message: dict[str, Column], name: str | Column) -> Column:
        """All values of the name in the query or the cookies."""
        known = message.get(f"{self.place} pairs")
        return values_of(known if known is not None else pairs(message["query"]) if self.place == "query" else cookie_pairs(message["cookie"]), name)

    def raw(self, message: dict[str, Column], name: str | Column, regex: str | Column, index: int | Column | None) -> Column:
        """The value in the headers or the path, as it is written."""
        if self.place == "header":
            return header_value(message["headers"], name)
        return F.lit(None).cast("string") if index is None else path_value(message["path"], regex, index)

    def too_many_items(self, message: dict[str, Column], name: str | Column, regex: str | Column, index: int | Column | None) -> Column:
        """Whether an array that is written as one value has more than ``MAX_ITEMS`` items; those of many pairs are held by the limits of pairs."""
        paired = self.place in ("query", "cookie")
        if not self.array or self.style == "deepObject" or paired and self.explode and self.style == "form":
            return F.lit(False)
        if paired:
            found = self.values(message, name)
            raw = F.array_join(found, ",") if self.style == "form" else F.get(found, F.lit(0))
        else:
            raw = self.raw(message, name, regex, index)
        return F.coalesce(F.size(split_style(raw, self.style, self.explode, name)) > MAX_ITEMS, F.lit(False))

    def json(self, message: dict[str, Column], name: str | Column, regex: str | Column, index: int | Column | None, coerce: bool = True) -> Column:
        """JSON text of the value; null where it is absent. Members of deep objects are strings: their types are those of the schema's
        properties, see ``coerce_body``."""
        scalar = lambda s, ks: coerce_json(s, list(ks)) if coerce else quoted(s)
        listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: scalar(x, self.items)), ","), F.lit("]"))
        if self.place == "query" and self.style == "deepObject":
            return deep_object(pairs(message["query"]), name)

        def written(found: Column) -> Column:
            if self.array:
                one = split_style(F.array_join(found, ",") if self.style == "form" else F.get(found, F.lit(0)), self.style, self.explode, name)
                split = found if self.explode and self.style == "form" else F.when(F.size(found) == 1, one).otherwise(found) if self.style in SEPARATOR else one
                return F.when(F.size(found) > 0, listed(split))
            return F.when(F.size(found) > 0, scalar(F.get(found, F.lit(0)), self.kinds))

        if self.place in ("query", "cookie"):
            return bind(self.values(message, name), written)
        one = lambda r: listed(split_style(r, self.style, self.explode, name)) if self.array else scalar(scalar_style(r, self.style, name), self.kinds)
        return bind(self.raw(message, name, regex, index), lambda r: F.when(r.isNotNull(), one(r)))


def index_of(p: dict, names: list[str]) -> int | None:
    return names.index(p["name"]) if p["name"] in names else None


def too_many_items(p: dict, schema, message: dict[str, Column], regex: str, names: list[str]) -> Column:
    return Signature.of(p, schema).too_many_items(message, p["name"], regex, index_of(p, names))


def parameter_json(p: dict, schema, message: dict[str, Column], regex: str, names: list[str], coerce: bool = True) -> Column:
    """JSON text of a parameter's value; null where it is absent. ``message`` has path, query, headers, cookie."""
    return Signature.of(p, schema).json(message, p["name"], regex, index_of(p, names), coerce)
