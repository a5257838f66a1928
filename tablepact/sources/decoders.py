"""Bodies of messages as JSON text or VARIANT columns, by media type."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column

from ..functions import text as F
from ..functions.strings import bind

#: Limits of bodies and of their parts.
MAX_JSON, MAX_MULTIPART, MAX_XML, MAX_PARTS, MAX_PAIRS, MAX_RECORDS, MAX_RECORD = 10 << 20, 50 << 20, 1 << 20, 1000, 1000, 100_000, 1 << 20
STREAMS = ("application/jsonl", "application/x-ndjson", "application/json-seq", "text/event-stream")
BOM = "﻿"
PAIR = "array<struct<name:string,value:string>>"
LEAVES = "array<struct<at:int,path:array<string>,json:string>>"
#: Steps of a nested name, its first included.
MAX_NESTING = 64


def media(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1)))


def is_streaming(content_type: Column) -> Column:
    return media(content_type).isin(*STREAMS)


def too_large(body: Column, content_type: Column | None = None) -> Column:
    """Beyond the limit of the media type: XML, multipart, or what holds for all others."""
    m = F.lit("") if content_type is None else F.coalesce(media(content_type), F.lit(""))
    limit = F.when(m == "multipart/form-data", MAX_MULTIPART).when(m.isin("application/xml", "text/xml"), MAX_XML).otherwise(MAX_JSON)
    return F.octet_length(body) > limit


def json_text(body: Column) -> Column:
    """Without a byte order mark; blank bodies are null."""
    text = F.regexp_replace(body, "^" + BOM, "")
    return F.when(F.trim(text) != "", text)


def json_body(body: Column) -> Column:
    """VARIANT; null for blank bodies and for what isn't JSON."""
    return F.try_parse_json(json_text(body))


def decode_url(s: Column, plus: bool = True) -> Column:
    """``plus``: whether ``+`` is a space, as in queries and forms."""
    return F.coalesce(F.try_url_decode(s if plus else F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def pairs(query: Column, separator: str = "&", plus: bool = True) -> Column:
    """Decoded (name, value) in order; a part without ``=`` has an empty value. All of them: ``too_many_pairs`` tells of more than allowed."""
    parts = F.filter(F.split(F.coalesce(query, F.lit("")), separator), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(decode_url(F.substring_index(p, "=", 1), plus).alias("name"), decode_url(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(""), plus).alias("value")))


def nested_pairs(found: Column) -> Column:
    """(path, value) of pairs whose names have brackets: ``a[b][]=1`` has the path [a, b, ""]. An empty step appends to a list."""
    steps = lambda n: F.filter(F.transform(F.split(n, r"\["), lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(x, r"\]$", ""))), lambda x: x.isNotNull())
    whole = lambda n: n.rlike(r"^[^\[\]]+(?:\[[^\[\]]*\])*\z")
    return F.transform(found, lambda p: F.struct(F.when(whole(p["name"]), steps(p["name"])).otherwise(F.array(p["name"])).alias("path"), p["value"].alias("value")))


def too_many_pairs(query: Column, separator: str = "&", limit: int = MAX_PAIRS) -> Column:
    """Empty parts count."""
    return F.coalesce(F.size(F.split(query, separator)) > limit, F.lit(False))


def values_of(found: Column, name: str | Column) -> Column:
    """All values of a name, also written ``name[]``."""
    listed = name + "[]" if isinstance(name, str) else F.concat(name, F.lit("[]"))
    return F.transform(F.filter(found, lambda p: p["name"].isin(name, listed)), lambda p: p["value"])


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return bind(value, use)


def numbered(found: Column) -> Column:
    """(at, path, json) of ``nested_pairs``: an empty step is the number of the item that it appends."""

    def one(p: Column, i: Column) -> Column:
        first = F.array_position(p["path"], "").cast("int") - 1
        upto = lambda q: F.slice(q["path"], 1, first + 1)
        n = F.size(F.filter(F.slice(found, 1, i), lambda q: upto(q) == upto(p))).cast("string")
        path = F.transform(p["path"], lambda s, j: F.when(s != "", s).when(j == first, n).otherwise(F.lit("0")))
        return F.struct(i.alias("at"), path.alias("path"), quoted(p["value"]).alias("json"))

    return F.transform(found, one)


def folded(leaves: Column) -> Column:
    """JSON text of (at, path, json), level by level from the deepest. Names that count from 0 in their order make an array."""
    parent = lambda e, d: F.slice(e["path"], 1, d - 1)

    def node(own: Column, d: Column, p: Column) -> Column:
        names = F.transform(own, lambda e: F.element_at(e["path"], d))
        counted = names == F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda i: i.cast("string"))
        listed = F.concat(F.lit("["), F.array_join(F.transform(own, lambda e: e["json"]), ","), F.lit("]"))
        keyed = F.concat(F.lit("{"), F.array_join(F.transform(own, lambda e: F.concat(quoted(F.element_at(e["path"], d)), F.lit(":"), e["json"])), ","), F.lit("}"))
        return F.struct(F.get(own, F.lit(0))["at"].alias("at"), p.alias("path"), F.when(counted, listed).otherwise(keyed).alias("json"))

    def up(all_: Column, d: Column) -> Column:
        deep = F.filter(all_, lambda e: F.size(e["path"]) == d)
        made = bound(deep, lambda es: F.transform(F.array_distinct(F.transform(es, lambda e: parent(e, d))), lambda p: bound(F.array_sort(F.filter(es, lambda e: parent(e, d) == p)), lambda own: node(own, d, p))))
        return F.concat(F.filter(all_, lambda e: F.size(e["path"]) < d), made).cast(LEAVES)

    depth = F.array_max(F.transform(leaves, lambda e: F.size(e["path"])))
    return F.get(F.reduce(F.sequence(depth, F.lit(1), F.lit(-1)), leaves.cast(LEAVES), up), F.lit(0))["json"]


def deep_object(found: Column, name: str) -> Column:
    """JSON text of ``name[key]=value``, at any depth, with strings as values; null without such pairs. Of pairs for one place the
    last counts, also where one is a value and another goes deeper. A name without brackets is a list of its values."""
    prefix = lambda a, b: F.slice(b["path"], 1, F.size(a["path"])) == a["path"]
    later = lambda es, e: F.exists(es, lambda o: (o["at"] > e["at"]) & (prefix(e, o) | prefix(o, e)))

    def tree(own: Column) -> Column:
        plain = lambda p: F.size(p["path"]) == 1
        last = F.element_at(own, -1)
        values = F.transform(F.when(F.forall(own, plain), own).otherwise(F.array(last)), lambda p: quoted(p["value"]))
        below = F.transform(F.filter(own, lambda p: ~plain(p)), lambda p: F.struct(F.slice(p["path"], 2, F.size(p["path"])).alias("path"), p["value"].alias("value")))
        nested = bound(below, lambda b: bound(numbered(b), lambda es: bound(F.filter(es, lambda e: ~later(es, e)), folded)))
        return F.when(F.size(own) == 0, F.lit(None)).when(plain(last), F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))).otherwise(nested)

    return bound(F.filter(nested_pairs(found), lambda p: F.get(p["path"], F.lit(0)) == name), tree)


def too_deep(query: Column) -> Column:
    """Whether a name of the query has more than ``MAX_NESTING`` steps."""
    steps = lambda n: F.length(n) - F.length(F.replace(n, F.lit("["), F.lit(""))) + 1
    return F.coalesce(F.instr(query, "[") + F.instr(F.lower(query), "%5b") > 0, F.lit(False)) & F.exists(pairs(query), lambda p: steps(p["name"]) > MAX_NESTING)


def form_body(body: Column) -> Column:
    """The pairs of a form as a JSON object: one value as a string, several as an array."""
    found = pairs(body)
    names = F.array_distinct(F.transform(found, lambda p: p["name"]))
    values = lambda k: F.transform(F.filter(found, lambda p: p["name"] == k), lambda p: p["value"])
    strings = F.transform(names, lambda k: F.concat(quoted(k), F.lit(":"), F.when(F.size(values(k)) == 1, quoted(F.get(values(k), F.lit(0)))).otherwise(F.concat(F.lit("["), F.array_join(F.transform(values(k), quoted), ","), F.lit("]")))))
    return F.concat(F.lit("{"), F.array_join(strings, ","), F.lit("}"))


def quoted(s: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(s.alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1)


def sections(body: Column, content_type: Column) -> Column:
    """What lies between the boundaries of a multipart body; the boundary is the header's, or the first line's."""
    boundary = F.regexp_extract(content_type, r'(?i)boundary="?([^";]+)"?', 1)
    mark = F.concat(F.lit("--"), F.when(boundary != "", boundary).otherwise(F.regexp_extract(body, r"^--([^\r\n]+)", 1)))
    return F.split(body, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")))


def multipart(body: Column, content_type: Column) -> Column:
    """All parts as array<struct<headers: map, content>>."""
    raw = F.filter(sections(body, content_type), lambda p: ~p.rlike(r"^(?:--)?\s*\z"))
    chopped = F.transform(raw, lambda p: F.regexp_replace(p, r"^\r?\n|\r?\n\z", ""))
    head = lambda p: F.regexp_extract(p, r"(?s)^(.*?)\r?\n\r?\n", 1)
    lines = lambda p: F.filter(F.split(head(p), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    names = lambda p: F.transform(lines(p), lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    headers = lambda p: F.map_from_arrays(F.array_distinct(names(p)), F.transform(F.array_distinct(names(p)), lambda n: F.call_function("regexp_extract", head(p), F.concat(F.lit(r"(?im)^\s*\Q"), n, F.lit(r"\E\s*:[ \t]*(.*?)\r?$")), F.lit(1))))
    return F.transform(chopped, lambda p: F.struct(headers(p).alias("headers"), F.regexp_replace(p, r"(?s)^.*?\r?\n\r?\n", "").alias("content")))


def json_lines(body: Column) -> Column:
    """Texts of the non-blank lines; ``try_parse_json`` of one is null where it isn't JSON."""
    return F.filter(F.transform(F.split(F.regexp_replace(body, "^" + BOM, ""), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def json_seq(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\x1e"), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", "")), lambda x: x != "")


def server_events(body: Column) -> Column:
    """Events as array<struct<event, data, id, retry>>: comments dropped, data lines joined, ``message`` as default event."""
    text = F.regexp_replace(F.regexp_replace(body, "^" + BOM, ""), "\r\n|\r", "\n")
    blocks = F.filter(F.split(text, "\n\n+"), lambda b: b.rlike(r"(?m)^data(?::|$)"))
    of = lambda b, name: F.transform(F.filter(F.split(b, "\n"), lambda x: x.rlike(f"^{name}(?::|\\z)")), lambda x: F.regexp_replace(x, f"^{name}:? ?", ""))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    event = lambda b: F.coalesce(F.nullif(last(of(b, "event")), F.lit("")), F.lit("message"))
    retry = lambda b: last(F.filter(of(b, "retry"), lambda x: x.rlike(r"^\d+\z"))).try_cast("bigint")
    return F.transform(blocks, lambda b: F.struct(event(b).alias("event"), F.array_join(of(b, "data"), "\n").alias("data"), last(of(b, "id")).alias("id"), retry(b).alias("retry")))


def event_json(event: Column) -> Column:
    """An event as a JSON object; its data is JSON where it can be, else a string."""
    data = F.when(F.try_parse_json(event["data"]).isNotNull(), event["data"]).otherwise(quoted(event["data"]))
    return F.concat(F.lit('{"event":'), quoted(event["event"]), F.lit(',"data":'), data, F.coalesce(F.concat(F.lit(',"id":'), quoted(event["id"])), F.lit("")), F.lit("}"))


def records(body: Column, content_type: Column) -> Column:
    """JSON texts of the records of a framed body, by its media type; null for other types."""
    m = media(content_type)
    return F.when(m.isin("application/jsonl", "application/x-ndjson"), json_lines(body)).when(m == "application/json-seq", json_seq(body)).when(m == "text/event-stream", F.transform(server_events(body), event_json))


def too_many_parts(body: Column, content_type: Column) -> Column:
    """Of forms and multipart bodies; what precedes the first boundary and follows the last counts."""
    m = media(content_type)
    made = F.when(m == "application/x-www-form-urlencoded", too_many_pairs(body)).when(m == "multipart/form-data", F.size(sections(body, content_type)) > MAX_PARTS)
    return F.coalesce(made, F.lit(False))


def too_many(items: Column, limit: int = MAX_RECORDS) -> Column:
    return F.size(items) > limit


def too_long(items: Column, limit: int = MAX_RECORD) -> Column:
    """Whether a record has more bytes than one may have."""
    return F.coalesce(F.exists(items, lambda x: F.octet_length(x) > limit), F.lit(False))


#: Fixed value: deepest nesting of XML elements.
MAX_XML_DEPTH = 128


class XmlReader:
    """Values of elements as they close, without recursion: attributes as ``@name``, repeated children as lists, text as ``#text`` or,
    of a leaf, alone; an empty leaf is null. Names keep the prefix that they are written with."""

    def __init__(self) -> None:
        self.open: list[list] = [[None, {}, []]]

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if len(self.open) > MAX_XML_DEPTH:
            raise ValueError("too deep")
        self.open.append([name, {f"@{k}": v for k, v in attributes.items() if k != "xmlns" and not k.startswith("xmlns:")}, []])

    def data(self, text: str) -> None:
        self.open[-1][2].append(text)

    def end(self, name: str) -> None:
        _, out, texts = self.open.pop()
        text = "".join(texts)
        value = out if out else text or None
        if out and text.strip():
            out["#text"] = text.strip()
        siblings = self.open[-1][1]
        if name in siblings:
            siblings[name] = [*siblings[name], value] if isinstance(siblings[name], list) else [siblings[name], value]
        else:
            siblings[name] = value


def xml_document(text: str) -> str | None:
    """JSON text of the root element's value; None for what isn't XML, has a DTD or is nested too deep."""
    reader, parser = XmlReader(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.data

    def refused(*_: object) -> None:
        raise ValueError("DTD")

    parser.StartDoctypeDeclHandler = refused
    try:
        parser.Parse(text.encode("utf-8", "replace"), True)
    except (expat.ExpatError, ValueError):
        return None
    return json.dumps(next(iter(reader.open[0][1].values())))


def xml_json(body: Column) -> Column:
    """JSON text of XML bodies; documents with a DTD, too large or too deep ones, and what isn't XML stay a JSON string."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str | None) -> str | None:
            if text is None:
                return None
            made = xml_document(text) if len(text) <= MAX_XML else None
            return json.dumps(text) if made is None else made

        for batch in batches:
            yield batch.map(one)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(body)


KINDS = {
    r"application/(?:[^;]+\+)?json": lambda body, content_type: json_text(body), r"application/x-www-form-urlencoded": lambda body, content_type: form_body(body),
    r"multipart/form-data": lambda body, content_type: F.to_json(multipart(body, content_type)), r"(?:application|text)/xml": lambda body, content_type: xml_json(body),
}


def body_json(body: Column, content_type: Column, name: str = "*/*") -> Column:
    """JSON text of a body: JSON as it is, forms as objects, XML as above, other types as a JSON string. ``name`` is the media type,
    if it is known to be that one; with a wildcard the message's own tells."""
    if "*" not in name:
        found = [made for pattern, made in KINDS.items() if re.fullmatch(pattern, name)]
        return found[0](body, content_type) if found else quoted(body)
    m, out = media(content_type), None
    for pattern, made in KINDS.items():
        hit, value = m.rlike(f"^(?:{pattern})\\z"), made(body, content_type)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(quoted(body))
