"""The string formats for single values, for schemas that only the interpreter takes. They agree with ``formats.STRING``."""

from __future__ import annotations

import base64
import binascii
import datetime
import ipaddress
from collections.abc import Callable

import regex

from .formats import IPV4, IPV6, OFFSET, ULABEL


def like(pattern: str) -> Callable[[str], bool]:
    compiled = regex.compile(pattern)
    return lambda s: compiled.fullmatch(s) is not None


def date(s: str) -> bool:
    try:
        return regex.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", s) is not None and bool(datetime.date.fromisoformat(s))
    except ValueError:
        return False


time = like(rf"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?{OFFSET}|23:59:60(?:\.[0-9]+)?(?:[Zz]|[+-]00:00)")
_email = like(rf"(?:[\p{{L}}\p{{N}}!#$%&'*+/=?^_`{{|}}~-]+(?:\.[\p{{L}}\p{{N}}!#$%&'*+/=?^_`{{|}}~-]+)*|\"(?:[^\"\\\r\n]|\\.)+\")@(?:(?:{ULABEL}\.)+(?![0-9]+$){ULABEL}|\[(?:{IPV4}|IPv6:(?:{IPV6}))\])")
_uri = like(r"[A-Za-z][A-Za-z0-9+.-]*:(?=.)(?://[^/?#\s]*)?[^\s]*")
_relative = like(r"(?![A-Za-z][A-Za-z0-9+.-]*:)[^\s]*")
_template = like(r"(?:[^{}]|\{[+#./;?&=,!@|]?[A-Za-z0-9_.%]+(?::[0-9]{1,4}|\*)?(?:,[A-Za-z0-9_.%]+(?::[0-9]{1,4}|\*)?)*\})*+")
_pointer = r"(?:/(?:[^~/]|~[01])*)*"


def ascii_length(host: str) -> int | None:
    """Bytes of a host name as IDNA writes it; None where a label is too long then, or can't be written."""
    try:
        return len(host if host.isascii() else host.encode("idna"))
    except UnicodeError:
        return None


def hostname(s: str) -> bool:
    return _host(s) and (ascii_length(s) or 254) <= 253


def email(s: str) -> bool:
    return _email(s) and ascii_length(s.rpartition("@")[2]) is not None and len(s.encode()) <= 254 and len(s.rpartition("@")[0].encode()) <= 64


def uri(s: str) -> bool:
    port = regex.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:([0-9]+)(?:[/?#]|$)", s)
    return _uri(s) and (port is None or len(port[1]) < 6 and int(port[1]) <= 65535)


def address(kind: type) -> Callable[[str], bool]:
    def check(s: str) -> bool:
        try:
            return bool(kind(s)) and "%" not in s
        except ValueError:
            return False

    return check


def byte(s: str) -> bool:
    plain = s.translate(str.maketrans("-_", "+/"))
    try:
        return base64.b64encode(base64.b64decode(plain, validate=True)).decode() == plain
    except (binascii.Error, ValueError):
        return False


def pattern(s: str) -> bool:
    try:
        return bool(regex.compile(s))
    except regex.error:
        return False


VALUE: dict[str, Callable[[str], bool]] = {
    "date": date, "time": time, "date-time": lambda s: date(s[:10]) and s[10:11] in ("T", "t", " ") and time(s[11:]), "email": email, "idn-email": email, "ipv4": like(IPV4), "ipv6": address(ipaddress.IPv6Address),
    "duration": like(r"P(?:[0-9]+W|(?=.)(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=[0-9])(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?)?)"),
    "uri": uri, "iri": uri, "uri-reference": lambda s: uri(s) or _relative(s), "iri-reference": lambda s: uri(s) or _relative(s), "uri-template": lambda s: s.count("{") <= 1000 and _template(s),
    "uuid": like(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}|0{8}-0{4}-0{4}-0{4}-0{12}|f{8}-f{4}-f{4}-f{4}-f{12}"),
    "byte": byte, "binary": lambda s: True, "password": lambda s: True, "json-pointer": like(_pointer), "relative-json-pointer": like(rf"(?:0|[1-9][0-9]*)(?:#|{_pointer})"), "regex": pattern,
}
_host = like(rf"{ULABEL}(?:\.{ULABEL})*")
VALUE["hostname"] = VALUE["idn-hostname"] = hostname
