"""Contracts: API descriptions (3.0 to 3.2) and JSON Schema documents in YAML or JSON, loaded once on the driver.

Documents are capped in size, depth and aliases, so what they turn into (expressions, lookups) is bounded as well.
"""

from __future__ import annotations

import copy
import json
import os
import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any
from urllib.parse import unquote, urljoin

import yaml

#: Limits of documents.
MAX_BYTES, MAX_DEPTH, MAX_ANCHORS, MAX_ALIASES, MAX_ALIAS_DEPTH, MAX_REF_BYTES = 1 << 20, 100, 100, 1000, 10, 10 << 20
ROOT_KEY = json.loads((Path(__file__).parent / "format.json").read_text())["root_key"]
METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace", "query")
VERSION = re.compile(r"3\.[0-2]\.\d+")


class ContractError(ValueError):
    """A document that can't be used as a contract."""


def depth_of(node: Any) -> int:
    """Depth of nested mappings and lists, without recursion."""
    most, todo = 0, [(node, 1)]
    while todo:
        x, d = todo.pop()
        if isinstance(x, (dict, list)):
            most = max(most, d)
            if most > MAX_DEPTH:
                return most
            todo += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x)]
    return most


def alias_depth(text: str) -> int:
    """How deep anchored nodes refer to one another: 1 for an alias of a node without aliases."""
    depth: dict[str, int] = {}
    open_: list[tuple[str | None, int]] = []
    for e in yaml.parse(text):
        if isinstance(e, yaml.AliasEvent):
            d = depth.get(e.anchor, 0) + 1
            open_ = [(a, max(n, d)) for a, n in open_]
            depth["*"] = max(depth.get("*", 0), d)
        elif isinstance(e, (yaml.MappingStartEvent, yaml.SequenceStartEvent)):
            open_.append((e.anchor, 0))
        elif isinstance(e, (yaml.MappingEndEvent, yaml.SequenceEndEvent)):
            anchor, n = open_.pop()
            if anchor:
                depth[anchor] = n
    return depth.get("*", 0)


def parse(text: str, kind: str, *, max_bytes: int = MAX_BYTES) -> Any:
    if len(text.encode()) > max_bytes:
        raise ContractError(f"document has over {max_bytes} bytes")
    if kind == "json":
        try:
            data = json.loads(text)
        except (ValueError, RecursionError) as e:
            raise ContractError(f"not JSON: {e}") from e
    else:
        try:
            names = [type(t).__name__ for t in yaml.scan(text)]
            if names.count("AnchorToken") > MAX_ANCHORS or names.count("AliasToken") > MAX_ALIASES:
                raise ContractError("too many anchors or aliases")
            if names.count("AliasToken") and alias_depth(text) > MAX_ALIAS_DEPTH:
                raise ContractError(f"aliases are nested over {MAX_ALIAS_DEPTH} levels")

            class Plain(yaml.SafeLoader):
                """Dates stay strings: instance values are JSON."""

            Plain.yaml_implicit_resolvers = {k: [x for x in v if x[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
            data = yaml.load(text, Plain)
        except (yaml.YAMLError, RecursionError) as e:
            raise ContractError(f"not YAML: {e}") from e
    if depth_of(data) > MAX_DEPTH:
        raise ContractError(f"document is nested over {MAX_DEPTH} levels")
    return data


def schema_for(version: str, node: Any) -> Any:
    """A schema in 3.1 terms: boolean exclusive bounds of 3.0 become numbers, nullable a type of its own."""
    if isinstance(node, bool) or not isinstance(node, dict):
        return node
    out = dict(node)
    if version.startswith("3.0"):
        for bound, exclusive in (("minimum", "exclusiveMinimum"), ("maximum", "exclusiveMaximum")):
            if out.get(exclusive) is True and bound in out:
                out[exclusive] = out.pop(bound)
            elif isinstance(out.get(exclusive), bool):
                del out[exclusive]
    if out.get("nullable") is True and "type" in out:
        kinds = out["type"] if isinstance(out["type"], list) else [out["type"]]
        out["type"] = [*kinds, *(["null"] if "null" not in kinds else [])]
        if "enum" in out and None not in out["enum"]:
            out["enum"] = [*out["enum"], None]
    if "multipleOf" in out and not out["multipleOf"] > 0:
        raise ContractError("multipleOf must be above 0")
    for k in ("items", "additionalProperties", "not", "if", "then", "else", "contains", "propertyNames", "unevaluatedItems", "unevaluatedProperties"):
        if k in out:
            out[k] = schema_for(version, out[k])
    for k in ("allOf", "anyOf", "oneOf", "prefixItems"):
        if k in out:
            out[k] = [schema_for(version, s) for s in out[k]]
    for k in ("properties", "patternProperties", "dependentSchemas", "$defs", "definitions"):
        if isinstance(out.get(k), dict):
            out[k] = {n: schema_for(version, s) for n, s in out[k].items()}
    return out


@dataclass(frozen=True)
class Operation:
    method: str
    template: str
    order: int
    definition: dict = field(hash=False)
    parameters: tuple = field(hash=False)

    @property
    def name(self) -> str:
        return self.definition.get("operationId") or f"{self.method.upper()} {self.template}"

    @property
    def regex(self) -> str:
        """Anchored; ``{x}`` takes one segment, ``{+x}`` any path."""
        parts = re.split(r"(\{[^}]*\})", self.template)
        made = ["([^?#]+)" if p.startswith("{+") else "([^/?#]+)" if p.startswith("{") else re.escape(p).replace("/", "/") for p in parts]
        return "^" + "".join(made) + "$"

    @property
    def path_names(self) -> list[str]:
        return [p.strip("{}+") for p in re.findall(r"\{[^}]*\}", self.template)]


@dataclass
class Contract:
    document: dict
    version: str = "3.1.0"
    base: str | None = None
    _outside: dict[str, Any] = field(default_factory=dict)

    # loading

    @classmethod
    def from_text(cls, text: str, kind: str = "yaml", *, base: str | None = None) -> Contract:
        return cls.of(parse(text, kind), base=base)

    @classmethod
    def from_file(cls, path: str, *, root: str | None = None) -> Contract:
        with open(path, encoding="utf-8") as f:
            text = f.read(MAX_BYTES + 1)
        return cls.from_text(text, "json" if path.endswith(".json") else "yaml", base=root or os.path.dirname(os.path.abspath(path)))

    @classmethod
    def api(cls, version: str, parts: dict, *, base: str | None = None) -> Contract:
        """A description of that version with these parts."""
        return cls.of({ROOT_KEY: version} | parts, base=base)

    @classmethod
    def of(cls, data: Any, *, base: str | None = None) -> Contract:
        """A whole API description, or a bare JSON Schema (then of version 3.1)."""
        if not isinstance(data, dict):
            raise ContractError("a contract is a mapping")
        version = str(data.get(ROOT_KEY, ""))
        if ROOT_KEY in data and not VERSION.fullmatch(version):
            raise ContractError(f"version {version} isn't 3.0, 3.1 or 3.2")
        own = data.get("$self")
        if own is not None and (not isinstance(own, str) or not own or "#" in own or not version.startswith("3.2")):
            raise ContractError("$self is a URI reference without a fragment, of versions from 3.2 on")
        return cls(data, version or "3.1.0", base)

    # references

    def _document(self, name: str) -> Any:
        if not name:
            return self.document
        if name not in self._outside:
            if self.base is None or "://" in name and not name.startswith("file://"):
                raise ContractError(f"reference to {name} isn't allowed")
            root = os.path.realpath(self.base)
            path = os.path.realpath(os.path.join(root, unquote(name.removeprefix("file://"))))
            if os.path.commonpath([root, path]) != root:
                raise ContractError(f"reference to {name} leaves {root}")
            with open(path, encoding="utf-8") as f:
                self._outside[name] = rebased(name, parse(f.read(MAX_REF_BYTES + 1), "json" if path.endswith(".json") else "yaml", max_bytes=MAX_REF_BYTES))
        return self._outside[name]

    def resolve(self, ref: str, within: str = "") -> tuple[Any, str]:
        """What a reference names, and the document it is in; follows chains and refuses circles."""
        seen: set[tuple[str, str]] = set()
        while True:
            name, _, pointer = ref.partition("#")
            name = urljoin(within, name) if name else within
            if (name, pointer) in seen:
                raise ContractError(f"circular reference {ref}")
            seen.add((name, pointer))
            node = pointer_get(self._document(name), pointer)
            if isinstance(node, dict) and set(node) == {"$ref"}:
                ref, within = node["$ref"], ""  # those of other documents are written from the root's place
                continue
            return node, name

    def schema(self, ref: str | dict | bool) -> Any:
        node = self.resolve(ref)[0] if isinstance(ref, str) else ref
        return schema_for(self.version, copy.deepcopy(node))

    def deref(self, node: Any) -> Any:
        return self.resolve(node["$ref"])[0] if isinstance(node, dict) and "$ref" in node else node

    # operations

    def operations(self) -> list[Operation]:
        out: list[Operation] = []
        for order, (template, item) in enumerate((self.document.get("paths") or {}).items()):
            out += self._of_item(template, self.deref(item), order)
        return out

    def _of_item(self, template: str, item: dict, order: int) -> list[Operation]:
        found = {m: item[m] for m in METHODS if m in item} | {m.lower(): d for m, d in (item.get("additionalOperations") or {}).items()}
        shared = [self.deref(p) for p in item.get("parameters") or []]
        out = []
        for method, definition in found.items():
            own = [self.deref(p) for p in definition.get("parameters") or []]
            named = {(p.get("in"), p.get("name")) for p in own}
            out.append(Operation(method, template, order, definition, (*own, *(p for p in shared if (p.get("in"), p.get("name")) not in named))))
        return out

    def webhooks(self) -> dict[tuple[str, str], Operation]:
        return {(name, op.method): op for i, (name, item) in enumerate((self.document.get("webhooks") or {}).items()) for op in self._of_item(name, self.deref(item), i)}

    def callbacks(self) -> dict[tuple[str, str], list[Operation]]:
        """Operations of callbacks by name and method, in the order of their expressions. A callback of the components hides those of
        that name in operations; of these the last with an expression counts."""
        shared = (self.document.get("components") or {}).get("callbacks") or {}
        named = {name: dict(self.deref(callback)) for name, callback in shared.items()}
        for op in self.operations():
            for name, callback in (op.definition.get("callbacks") or {}).items():
                if name not in shared:
                    named.setdefault(name, {}).update(self.deref(callback))
        out: dict[tuple[str, str], list[Operation]] = {}
        for i, (name, callback) in enumerate(named.items()):
            for expression, item in callback.items():
                for op in self._of_item(expression, self.deref(item), i):
                    out.setdefault((name, op.method), []).append(op)
        return out

    def servers(self, **values: str) -> list[str]:
        """Base paths of the servers, variables replaced by ``values`` or their defaults, longest first."""
        found = []
        for s in self.document.get("servers") or []:
            def value(m: re.Match, s=s) -> str:
                v = (s.get("variables") or {}).get(m[1])
                if m[1] not in values and not v:
                    raise ContractError(f"server variable {m[1]} is undefined")
                return values.get(m[1], str(v["default"]) if v else "")

            url = re.sub(r"\{([^}]+)\}", value, s.get("url", ""))
            found.append(re.sub(r"^[a-z][a-z0-9+.-]*://[^/]*", "", url, flags=re.I).rstrip("/"))
        return sorted({p for p in found if p}, key=len, reverse=True)

    def content(self, node: dict | None) -> dict[str, dict]:
        return {normal_media(k): v for k, v in ((node or {}).get("content") or {}).items()}

    def deprecations(self) -> list[str]:
        """Places of fields that descriptions from version 3.2 on deprecate; earlier ones have none. Names that users give, such as
        those of properties, and data, such as defaults, aren't fields."""
        out: list[str] = []
        todo: list[tuple[str, Any, str, bool]] = [("", self.document, "", False)] if self.version.startswith("3.2") else []
        while todo:
            at, node, owner, names = todo.pop()
            if isinstance(node, list):
                todo += [(f"{at}/{i}", v, owner, False) for i, v in enumerate(node)]
            elif isinstance(node, dict):
                if not names:
                    out += [f"{at}/{k}" for k in deprecated_fields(node, owner)]
                for k, v in node.items():
                    if names:
                        todo.append((f"{at}/{k}", v, owner, False))
                    elif k not in DATA_FIELDS and not str(k).startswith("x-"):
                        todo.append((f"{at}/{k}", v, k, k in NAME_FIELDS and isinstance(v, dict)))
        return sorted(out)


#: Fields whose members are named by users, and fields that hold data.
NAME_FIELDS = {"properties", "patternProperties", "dependentSchemas", "$defs", "schemas", "parameters", "responses", "headers", "requestBodies", "paths", "pathItems", "callbacks", "webhooks", "content", "links", "securitySchemes", "mediaTypes", "encoding"}
DATA_FIELDS = {"example", "examples", "enum", "const", "default", "mapping", "value"}


def deprecated_fields(node: dict, owner: str) -> list[str]:
    """Of one object; ``owner`` is the field that it stands in, or whose members it is one of."""
    carried = "in" in node or owner == "headers"
    hit = {
        "example": not carried and node.get("example") is not None,
        "nullable": not carried and bool(node.get("nullable")),
        "exclusiveMinimum": isinstance(node.get("exclusiveMinimum"), bool),
        "exclusiveMaximum": isinstance(node.get("exclusiveMaximum"), bool),
        "allowEmptyValue": carried and bool(node.get("allowEmptyValue")),
        "attribute": owner == "xml" and node.get("attribute") is not None,
        "wrapped": owner == "xml" and node.get("wrapped") is not None,
    }
    return [k for k, told in hit.items() if told]


def rebased(name: str, node: Any) -> Any:
    """A document of another file with its references as the root document would write them."""
    if isinstance(node, list):
        return [rebased(name, x) for x in node]
    if not isinstance(node, dict):
        return node
    whole = lambda ref: urljoin(name, ref) if ref.partition("#")[0] else name + ref
    out = {k: whole(v) if k == "$ref" and isinstance(v, str) else rebased(name, v) for k, v in node.items()}
    if isinstance(d := out.get("discriminator"), dict) and isinstance(d.get("mapping"), dict):
        out["discriminator"] = d | {"mapping": {k: whole(v) if isinstance(v, str) and "#" in v else v for k, v in d["mapping"].items()}}
    return out


def pointer_get(node: Any, pointer: str) -> Any:
    for part in unquote(pointer).split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        try:
            node = node[int(part)] if isinstance(node, list) else node[part]
        except (KeyError, IndexError, ValueError, TypeError) as e:
            raise ContractError(f"nothing at {pointer}") from e
    return node


def normal_media(name: str) -> str:
    return name.split(";")[0].strip().lower()


def media_for(content: dict[str, dict], media: str) -> dict | None:
    """Exact, then ``type/*``, then ``*/*``."""
    media = normal_media(media)
    return content.get(media) or content.get(media.split("/")[0] + "/*") or content.get("*/*")


class Registry:
    """Contracts by name and version; the latest is the highest version, compared number by number."""

    def __init__(self, contracts: dict[tuple[str, str], Contract] | None = None):
        self._all = dict(contracts or {})

    def register(self, name: str, version: str, contract: Contract, *, replace: bool = False) -> Registry:
        if (name, version) in self._all and not replace:
            raise ContractError(f"{name} {version} is registered")
        return Registry(self._all | {(name, version): contract})

    def versions(self, name: str) -> list[str]:
        return sorted((v for n, v in self._all if n == name), key=lambda v: [(0, int(x), "") if x.isdigit() else (-1, 0, x) for x in re.findall(r"\d+|[A-Za-z]+", v)] + [(0, 0, "")])

    def get(self, name: str, version: str | None = None) -> Contract:
        known = self.versions(name)
        if not known or version is not None and version not in known:
            raise ContractError(f"{name} {version or ''} isn't registered")
        return self._all[name, version or known[-1]]

    def __contains__(self, name: str) -> bool:
        return any(n == name for n, _ in self._all)

    def __len__(self) -> int:
        return len(self._all)


@lru_cache(maxsize=64)
def load(path: str, modified: float = 0.0) -> Contract:
    """A contract of a file, remembered by path and time of change."""
    return Contract.from_file(path)
