"""String and number formats as Column predicates, by name. Each takes a string Column and gives a boolean one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from . import text as F

#: Java's ``$`` also matches before other line ends; UNIX_LINES leaves ``\n`` alone, ``\z`` none at all.
END = r"\z"


def match(pattern: str) -> Callable[[Column], Column]:
    return lambda s: s.rlike("^(?:" + pattern + ")" + END)


def date(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}" + END) & F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).isNotNull() & (F.substring(s, 1, 4) != "0000")


OFFSET = r"(?:[Zz]|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)"


def time(s: Column) -> Column:
    """RFC 3339 with an offset; second 60 only at 23:59 in UTC."""
    return s.rlike(r"^(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?" + OFFSET + END) | s.rlike(r"^23:59:60(?:\.\d+)?(?:[Zz]|[+-]00:00)" + END)


def date_time(s: Column) -> Column:
    return s.rlike(r"^.{10}[Tt ]") & date(F.substring(s, 1, 10)) & time(F.substring(s, F.lit(12), F.length(s)))


def duration(s: Column) -> Column:
    return s.rlike(r"^P(?:\d+W|(?=.)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?)" + END)


IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
H16 = r"[0-9A-Fa-f]{1,4}"
IPV6 = "|".join(
    [rf"(?:{H16}:){{7}}{H16}", rf"(?:{H16}:){{6}}{IPV4}"]
    + [rf"(?:{H16}(?::{H16}){{0,{n - 1}}})?::(?:{H16}(?::{H16}){{0,{6 - n}}})?" if 0 < n < 7 else rf"::(?:{H16}(?::{H16}){{0,6}})?" if n == 0 else rf"(?:{H16}(?::{H16}){{0,6}})::" for n in range(8)]
    + [rf"(?:{H16}(?::{H16}){{0,{n - 1}}})?::(?:{H16}:){{0,{5 - n}}}{IPV4}" for n in range(1, 6)] + [rf"::(?:{H16}:){{0,5}}{IPV4}"]
)
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
ULABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"


def email(s: Column) -> Column:
    local = r"(?:[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+(?:\.[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+)*|\"(?:[^\"\\\r\n]|\\.)+\")"
    domain = rf"(?:(?:{ULABEL}\.)+(?!\d+\z){ULABEL}|\[(?:{IPV4}|IPv6:(?:{IPV6}))\])"
    return (F.octet_length(s) <= 254) & (F.octet_length(F.regexp_replace(s, "@[^@]*$", "")) <= 64) & s.rlike("^" + local + "@" + domain + END) & ascii_host(F.regexp_extract(s, "@([^@]*)$", 1)).isNotNull()


def ascii_host(s: Column) -> Column:
    """A host name as IDNA (RFC 3490) writes it; null where a label is longer than 63 bytes then, or can't be written."""
    made = F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), s)
    return F.when(s.rlike(r"^[\x00-\x7F]*\z"), s).otherwise(made)


def hostname(s: Column) -> Column:
    return s.rlike(rf"^{ULABEL}(?:\.{ULABEL})*{END}") & F.coalesce(F.length(ascii_host(s)) <= 253, F.lit(False))


def uri(s: Column) -> Column:
    port = F.regexp_extract(s, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:(\d+)(?:[/?#]|\z)", 1)
    return s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#\s]*)?[^\s]*" + END) & ~s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:" + END) & ((port == "") | (F.length(port) < 6) & (port.try_cast("int") <= 65535))


def uri_reference(s: Column) -> Column:
    return uri(s) | s.rlike(r"^(?![A-Za-z][A-Za-z0-9+.-]*:)[^\s]*" + END)


def uri_template(s: Column) -> Column:
    return s.rlike(r"^(?:[^{}]|\{[+#./;?&=,!@|]?[A-Za-z0-9_.%]+(?::\d{1,4}|\*)?(?:,[A-Za-z0-9_.%]+(?::\d{1,4}|\*)?)*\})*+" + END) & (F.length(s) - F.length(F.translate(s, "{", "")) <= 1000)


def uuid(s: Column) -> Column:
    return s.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}" + END) | s.isin("00000000-0000-0000-0000-000000000000", "ffffffff-ffff-ffff-ffff-ffffffffffff")


def byte(s: Column) -> Column:
    """Base64, of either alphabet, that comes back as it was."""
    plain = F.translate(s, "-_", "+/")
    return plain.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?" + END) & (F.base64(F.try_to_binary(plain, F.lit("base64"))) == plain)


def always(s: Column) -> Column:
    return F.lit(True)


STRING: dict[str, Callable[[Column], Column]] = {
    "date": date, "time": time, "date-time": date_time, "duration": duration, "email": email, "idn-email": email, "hostname": hostname, "idn-hostname": hostname,
    "ipv4": match(IPV4), "ipv6": match(IPV6), "uri": uri, "iri": uri, "uri-reference": uri_reference, "iri-reference": uri_reference, "uri-template": uri_template,
    "uuid": uuid, "byte": byte, "binary": always, "password": always, "json-pointer": match(r"(?:/(?:[^~/]|~[01])*)*"),
    "relative-json-pointer": match(r"(?:0|[1-9]\d*)(?:#|(?:/(?:[^~/]|~[01])*)*)"),
}
#: By type and format: predicates of users, ``Column -> Column``, and the same for one value where the interpreter must have it.
CUSTOM: dict[tuple[str, str], Callable[[Column], Column]] = {}
CUSTOM_VALUES: dict[tuple[str, str], Callable[[object], bool]] = {}


def register_format(kind: str, name: str, predicate: Callable[[Column], Column], of_value: Callable[[object], bool] | None = None) -> None:
    CUSTOM[kind, name] = predicate
    if of_value is not None:
        CUSTOM_VALUES[kind, name] = of_value
