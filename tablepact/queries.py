"""The queries of contract validation, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import message_queries
from .functions import coercion
from .functions.strings import utf16_length
from .operators import routing
from .operators.schema import Compiler
from .operators.values import Typed, Variant
from .plans import validate as plans
from .plans.versions import read_versions, validate_as_of, versions_of
from .sources import decoders
from .sources.contract import ROOT_KEY, Contract
from .streaming.conformance import conformance_rate

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def typed(name: str, table: str, key: list[str], column: str, schema: Any, sql: str, derive: Callable[[], Column] | None = None) -> None:
    """A query for one column against a schema: keys and valid, in one projection over the scan."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = df if derive is None else df.withColumn(column, derive())
        value = Typed(F.col(column), df.schema[column].dataType)
        return df.select(*key, Compiler().valid(schema, value).alias("valid"))

    _queries[name] = run
    _sql[name] = f"SELECT {', '.join(key)}, {sql} AS valid FROM {table}"


def variant(name: str, schema: Any, sql: str, mode: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "events")
        return df.select("event_id", Compiler(mode=mode).valid(schema, Variant(F.try_parse_json("props"))).alias("valid"))

    _queries[name] = run
    _sql[name] = f"SELECT event_id, {sql} AS valid FROM events"


ORDER, LINE = ["o_orderkey"], ["l_orderkey", "l_linenumber", "l_partkey"]
typed("enum_status", "orders", ORDER, "o_orderstatus", {"enum": ["F", "O"]}, "o_orderstatus IN ('F', 'O')")
typed("const_role", "conversations", ["conv_id", "turn"], "role", {"const": "user"}, "role = 'user'")
typed("range_discount", "lineitem", LINE, "l_discount", {"minimum": 0.02, "maximum": 0.08}, "l_discount BETWEEN 0.02 AND 0.08")
typed("exclusive_range", "lineitem", LINE, "l_quantity", {"exclusiveMinimum": 10, "exclusiveMaximum": 40}, "l_quantity > 10 AND l_quantity < 40")
typed("multiple_of_qty", "lineitem", LINE, "l_quantity", {"multipleOf": 5}, "l_quantity % 5 = 0")
typed("multiple_of_cents", "orders", ORDER, "o_totalprice", {"multipleOf": 0.05}, "abs(o_totalprice / 0.05 - round(o_totalprice / 0.05)) < 1e-9 * greatest(1, abs(o_totalprice / 0.05))")
typed("pattern_priority", "orders", ORDER, "o_orderpriority", {"pattern": "^[12]-"}, "regexp_matches(o_orderpriority, '^[12]-')")
typed("type_integer", "orders", ORDER, "o_totalprice", {"type": "integer"}, "o_totalprice = floor(o_totalprice)")
typed("type_union", "part", ["p_partkey"], "p_name", {"type": ["integer", "null"]}, "p_name IS NULL")
typed("utf16_bounds", "documents", ["doc_id"], "text", {"minLength": 100, "maxLength": 2000}, "coalesce(length(text), 0) BETWEEN 100 AND 2000 OR text IS NULL")
typed("items_range", "embeddings", ["vec_id"], "embedding", {"items": {"minimum": -0.3}}, "len(list_filter(embedding, lambda x: NOT (CAST(x AS DOUBLE) >= -0.3))) = 0")
typed("contains_count", "embeddings", ["vec_id"], "embedding", {"contains": {"exclusiveMinimum": 0}, "minContains": 30, "maxContains": 34}, "len(list_filter(embedding, lambda x: x > 0)) BETWEEN 30 AND 34")
typed("unique_items", "embeddings", ["vec_id"], "rounded", {"uniqueItems": True}, "list_unique(list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS BIGINT))) = len(embedding)", lambda: F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000)))
typed("item_count", "embeddings", ["vec_id"], "embedding", {"minItems": 1, "maxItems": 64}, "len(embedding) BETWEEN 1 AND 64")
typed("prefix_items", "embeddings", ["vec_id"], "embedding", {"prefixItems": [{"minimum": 0}, {"maximum": 0}]}, "embedding[1] >= 0 AND embedding[2] <= 0")
typed("all_of", "orders", ORDER, "o_totalprice", {"allOf": [{"minimum": 50000}, {"maximum": 150000}]}, "o_totalprice >= 50000 AND o_totalprice <= 150000")
typed("any_of", "orders", ORDER, "o_totalprice", {"anyOf": [{"maximum": 50000}, {"minimum": 150000}]}, "o_totalprice <= 50000 OR o_totalprice >= 150000")
typed("one_of", "orders", ORDER, "o_totalprice", {"oneOf": [{"maximum": 150000}, {"minimum": 50000}]}, "(o_totalprice <= 150000) <> (o_totalprice >= 50000)")
typed("not_schema", "orders", ORDER, "o_orderstatus", {"not": {"const": "P"}}, "o_orderstatus <> 'P'")
typed("if_then_else", "lineitem", LINE, "l_quantity", {"if": {"minimum": 25}, "then": {"multipleOf": 5}, "else": {"multipleOf": 3}}, "CASE WHEN l_quantity >= 25 THEN l_quantity % 5 = 0 ELSE l_quantity % 3 = 0 END")
typed("format_uri", "pages", ["page_id"], "url", {"type": "string", "format": "uri"}, r"regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*:(//[^/?#\s]*)?[^\s]*')")
typed("format_date", "orders", ORDER, "day", {"type": "string", "format": "date"}, "month(o_orderdate) <> 2 OR day(o_orderdate) < 28", lambda: F.when((F.month("o_orderdate") == 2) & (F.dayofmonth("o_orderdate") >= 28), F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-30"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
typed("format_uuid", "events", ["event_id"], "id", {"type": "string", "format": "uuid"}, "regexp_full_match(md5(CAST(event_id AS VARCHAR)), '.{12}[1-8].{3}[89ab].{15}')", lambda: F.regexp_replace(F.md5(F.col("event_id").cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
typed("format_ipv4", "events", ["event_id"], "ip", {"type": "string", "format": "ipv4"}, "event_id % 300 < 256", lambda: F.concat(F.lit("10.0.0."), (F.col("event_id") % 300).cast("string")))
variant("required_keys", {"type": "object", "required": ["k", "missing"]}, "json_extract(props, '$.missing') IS NOT NULL")
variant("additional_properties", {"properties": {"k": {"type": "integer"}}, "additionalProperties": False}, "len(json_keys(props)) = 1")
variant("property_counts", {"minProperties": 2}, "len(json_keys(props)) >= 2")
variant("nested_range", {"properties": {"k": {"type": "integer", "minimum": 20, "maximum": 80}}}, "CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 20 AND 80")
variant("type_dispatch", {"properties": {"k": {"type": ["string", "integer"], "enum": [*range(0, 100, 7)]}}}, "CAST(json_extract(props, '$.k') AS BIGINT) % 7 = 0 AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 0 AND 99")
variant("property_names", {"propertyNames": {"pattern": "^[a-j]$"}}, "len(list_filter(json_keys(props), lambda k: NOT regexp_matches(k, '^[a-j]$'))) = 0")

K = "CAST(json_extract(props, '$.k') AS BIGINT)"
variant("read_only", {"properties": {"k": {"readOnly": True}}}, f"{K} IS NULL", "request")
variant("pattern_properties", {"patternProperties": {"^k": {"minimum": 30}}}, f"coalesce({K} >= 30, TRUE)")
variant("dependent_schemas", {"dependentSchemas": {"k": {"properties": {"k": {"maximum": 40}}}}}, f"coalesce({K} <= 40, TRUE)")
variant("nested_references", {"allOf": [{"anyOf": [{"properties": {"k": {"maximum": 10}}}, {"properties": {"k": {"minimum": 90}}}]}]}, f"coalesce({K} <= 10 OR {K} >= 90, TRUE)")


def text_format(name: str, derive: Callable[[], Column], sql: str) -> None:
    typed(f"format_{name.replace('-', '_')}", "events", ["event_id"], "t", {"type": "string", "format": name}, sql, derive)


EVENT = lambda n: (F.col("event_id") % n).cast("string")
text_format("date-time", lambda: F.concat(F.date_format("ts", "yyyy-MM-dd"), F.when(F.col("event_id") % 7 == 0, "T25:00:00Z").otherwise("T23:00:00+01:00")), "event_id % 7 <> 0")
text_format("time", lambda: F.concat(F.lit("12:"), EVENT(90), F.lit(":00Z")), "event_id % 90 BETWEEN 10 AND 59")
text_format("duration", lambda: F.when(F.col("event_id") % 3 == 0, "PT1.5S").otherwise(F.concat(F.lit("P"), EVENT(9), F.lit("DT2H"))), "event_id % 3 <> 0")
text_format("ipv6", lambda: F.concat(F.lit("2001:db8::"), F.when(F.col("event_id") % 5 == 0, "g").otherwise(EVENT(100))), "event_id % 5 <> 0")
text_format("email", lambda: F.concat(F.repeat(F.lit("a"), (F.col("event_id") % 70).cast("int")), F.lit("@x."), F.when(F.col("event_id") % 4 == 0, "12").otherwise("example")), "event_id % 70 BETWEEN 1 AND 64 AND event_id % 4 <> 0")
text_format("json-pointer", lambda: F.concat(F.when(F.col("event_id") % 2 == 0, "/a~1").otherwise("a/"), EVENT(10)), "event_id % 2 = 0")

PETS = Contract.api("3.1.0", {
    "servers": [{"url": "https://api.example/v1"}],
    "paths": {
        "/": {"get": {"operationId": "root"}}, "/en/{id}": {"get": {"operationId": "english"}}, "/{lang}/{id}": {"get": {"operationId": "any"}}, "/{lang}/{id}.html": {"get": {"operationId": "file"}},
    },
})
EVENTS = Contract.api("3.1.0", {
    "paths": {}, "components": {"schemas": {
        "click": {"required": ["type"], "properties": {"value": {"maximum": 50}}}, "view": {"properties": {"value": {"minimum": 10}}}, "purchase": {"properties": {"value": {"exclusiveMinimum": 1}}},
        "Event": {"discriminator": {"propertyName": "type"}, "oneOf": [{"$ref": f"#/components/schemas/{n}"} for n in ("click", "view", "purchase")]},
    }},
})


def discriminator_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("type"), "value").alias("e"))
    return plans.validate(df, "e", "#/components/schemas/Event", EVENTS).select("event_id", "valid")


_sql["discriminator_route"] = "SELECT event_id, coalesce(CASE event_type WHEN 'click' THEN NOT (value > 50) WHEN 'view' THEN NOT (value < 10) WHEN 'purchase' THEN NOT (value <= 1) ELSE FALSE END, TRUE) AS valid FROM events"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = routing.match_route(PETS, F.lit("GET"), url_path(F.col("url")))
    return read(spark, sf_dir, "pages").select("page_id", routing.operation_name(PETS, route).alias("operation"))


_sql["route_match"] = r"""SELECT page_id, CASE WHEN p = '/' THEN 'root' WHEN regexp_full_match(p, '/en/[^/?#]+') THEN 'english' WHEN regexp_full_match(p, '/[^/?#]+/[^/?#]+') THEN 'any' END AS operation
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)"""


def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decoders.pairs(F.regexp_extract("url", r"\?([^#]*)", 1))
    return read(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("p")).select("page_id", "p.name", "p.value")


_sql["query_parse"] = r"""SELECT page_id, split_part(p, '=', 1) AS name, url_decode(substr(p, strpos(p, '=') + 1)) AS value
FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '\?([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> ''"""


def coerce_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_extract("url", r"/([^/?#]*)/?(?:[?#].*)?$", 1)
    return read(spark, sf_dir, "pages").select("page_id", coercion.to_integer(raw).alias("value"))


_sql["coerce_integer"] = r"""SELECT page_id, CASE WHEN regexp_full_match(s, '[+-]?\d+') THEN TRY_CAST(s AS BIGINT) END AS value
FROM (SELECT page_id, regexp_extract(url, '/([^/?#]*)/?(?:[?#].*)?$', 1) AS s FROM pages)"""


def coerce_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.get(F.array(*map(F.lit, ["true", "NO", "On", "maybe", "0"])), (F.col("event_id") % 5).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", coercion.to_boolean(raw).alias("value"))


_sql["coerce_boolean"] = "SELECT event_id, [TRUE, FALSE, TRUE, NULL, FALSE][CAST(event_id % 5 AS BIGINT) + 1] AS value FROM events"


def status_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = (F.col("l_linenumber") * 100 + F.col("l_linenumber") % 2).cast("int")
    return read(spark, sf_dir, "lineitem").select(*LINE, routing.status_key(status, ["200", "4XX", "default"]).alias("response"))


_sql["status_lookup"] = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 2 THEN '200' WHEN l_linenumber = 4 THEN '4XX' ELSE 'default' END AS response FROM lineitem"


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = read(spark, sf_dir, "events").select("user_id", F.explode(decoders.json_lines(F.col("props"))).alias("line"))
    return each.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.try_variant_get(F.try_parse_json("line"), "$.k", "bigint")).alias("total"))


_sql["json_lines"] = "SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events WHERE props IS NOT NULL GROUP BY user_id"


def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", utf16_length(F.concat("text", F.lit("😀"))).alias("units"))


_sql["utf16_lengths"] = "SELECT doc_id, length(text) + 2 AS units FROM documents"

LINE_SCHEMA = {
    "required": ["l_quantity"],
    "properties": {"l_quantity": {"type": "number", "minimum": 5}, "l_discount": {"maximum": 0.08}, "l_returnflag": {"enum": ["A", "N"]}, "l_tax": {"exclusiveMinimum": 0}, "l_extendedprice": {"maximum": 90000}},
}


def violations_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "lineitem")
    return plans.roll_up(df.select("l_linestatus", plans.row_violations(df, LINE_SCHEMA).alias("violations")), "l_linestatus")


_sql["violations_rollup"] = " UNION ALL ".join(
    f"SELECT l_linestatus, '{k}' AS keyword, '#/properties/{c}/{k}' AS schema_path, count(*) AS n FROM lineitem WHERE {w} GROUP BY l_linestatus"
    for c, k, w in (("l_quantity", "minimum", "l_quantity < 5"), ("l_discount", "maximum", "l_discount > 0.08"), ("l_returnflag", "enum", "l_returnflag NOT IN ('A', 'N')"), ("l_tax", "exclusiveMinimum", "l_tax <= 0"), ("l_extendedprice", "maximum", "l_extendedprice > 90000"))
)


def conformance_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    rates = conformance_rate(df.withColumn("valid", Compiler().valid({"minimum": 5}, Typed(F.col("value"), T.DoubleType()))), "ts")
    return rates.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "n_rows", "n_valid")


_sql["conformance_by_hour"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL OR value >= 5) AS n_valid FROM events GROUP BY 1"


def interpreted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a branch hasn't evaluated isn't allowed."""
    schema = {"allOf": [{"properties": {"k": {"minimum": 50}}}], "unevaluatedProperties": False}
    return plans.validate(read(spark, sf_dir, "events"), "props", schema).select("event_id", "valid")


_sql["interpreted"] = "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT) >= 50, TRUE) AS valid FROM events"


def contract_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against the version of their contract that was in force on their date; of two names one has two versions."""
    version = lambda most, states: {ROOT_KEY: "3.1.0", "components": {"schemas": {"Order": {"properties": {"price": {"maximum": most}, "status": {"enum": states}}}}}}
    table = versions_of([("urgent", "1", datetime(1995, 1, 1), version(200_000, ["F", "O"])), ("urgent", "2", datetime(1996, 7, 1), version(150_000, ["F", "O", "P"])), ("other", "1", datetime(1993, 1, 1), version(250_000, ["F", "O", "P"]))], spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderpriority").startswith("1"), "urgent").otherwise("other").alias("kind"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("order"))
    checked = validate_as_of(orders, "order", "#/components/schemas/Order", read_versions(table), name_col="kind", time_col="o_orderdate")
    return checked.select("o_orderkey", "contract_version", F.array_join(F.array_sort(F.transform("violations", lambda v: v["keyword"])), ",").alias("broken"), "valid")


_sql["contract_versions"] = """
WITH o AS (SELECT *, o_orderpriority LIKE '1%' AS urgent, CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_orderdate >= '1996-07-01' THEN '2' WHEN o_orderdate >= '1995-01-01' THEN '1' END WHEN o_orderdate >= '1993-01-01' THEN '1' END AS v FROM orders),
b AS (SELECT *, CASE WHEN v IS NULL THEN 'version' ELSE concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') AND (urgent AND v = '1' OR o_orderstatus <> 'P') THEN 'enum' END, CASE WHEN o_totalprice > CASE WHEN NOT urgent THEN 250000 WHEN v = '1' THEN 200000 ELSE 150000 END THEN 'maximum' END) END AS broken FROM o)
SELECT o_orderkey, v AS contract_version, broken, broken = '' AS valid FROM b
"""


HOOKS = Contract.api("3.1.0", {"webhooks": {
    "click": {"post": {"requestBody": {"required": True, "content": {"application/json": {"schema": {"properties": {"k": {"minimum": 50}}}}}}}},
    "view": {"post": {"requestBody": {"content": {"application/json": {"schema": {"properties": {"k": {"maximum": 20}}}}}}}},
}, "paths": {"/e/{id}": {
    "get": {"operationId": "one", "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "integer", "maximum": 500}}, {"name": "s", "in": "cookie", "schema": {"type": "string", "pattern": r"^\d+\+1$"}}],
            "responses": {"200": {"headers": {"X-N": {"required": True, "schema": {"type": "integer", "maximum": 50}}}}}},
}}, "servers": [{"url": "https://x.example/v1"}]})


def webhook_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), F.lit("POST").alias("method"), F.lit("application/json").alias("content_type"), F.col("props").alias("body"))
    return plans.validate_webhooks(rows, HOOKS).select("event_id", "valid")


_sql["webhook_validation"] = f"SELECT event_id, CASE event_type WHEN 'click' THEN props IS NOT NULL AND coalesce({K} >= 50, TRUE) WHEN 'view' THEN coalesce({K} <= 20, TRUE) ELSE FALSE END AS valid FROM events"


def path_and_cookie(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.lit("GET").alias("method"), F.concat(F.when(F.col("event_id") % 2 == 0, "/v1").otherwise(""), F.lit("/e/"), (F.col("event_id") % 1000).cast("string")).alias("path"), F.lit("").alias("query"),
        F.create_map().cast("map<string,array<string>>").alias("headers"), F.concat(F.lit("s="), F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, "%2B1").otherwise("+1")).alias("cookie"), none.alias("content_type"), none.alias("body"),
    )
    return plans.validate_requests(rows, HOOKS).select("event_id", "operation", "valid")


_sql["path_and_cookie"] = "SELECT event_id, 'one' AS operation, event_id % 1000 <= 500 AS valid FROM events"


def response_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.when(F.col("event_id") % 10 == 0, F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("x-n"), F.array((F.col("event_id") % 100).cast("string"))))
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select("event_id", F.lit("GET").alias("method"), F.lit("/e/1").alias("path"), F.lit(200).alias("status"), header.alias("response_headers"), none.alias("content_type"), none.alias("body"))
    return plans.validate_responses(rows, HOOKS).select("event_id", "valid")


_sql["response_headers"] = "SELECT event_id, event_id % 10 <> 0 AND event_id % 100 <= 50 AS valid FROM events"


def whole_querystring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = {"name": "q", "in": "querystring", "content": {"application/x-www-form-urlencoded": {"schema": {"required": ["page"], "properties": {"page": {"pattern": "^[0-9]$"}}}}}}
    found = plans.querystring_violations(PETS, Compiler(PETS), p, F.regexp_extract("url", r"\?([^#]*)", 1))
    return read(spark, sf_dir, "pages").select("page_id", (F.size(found) == 0).alias("valid"))


_sql["whole_querystring"] = r"SELECT page_id, q = '' OR regexp_matches(q, '(^|&)page=[0-9](&|$)') AS valid FROM (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages)"


def body_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"properties": {"n": {"type": "integer", "maximum": 50}, "on": {"type": "boolean", "const": True}}}
    text = F.concat(F.lit('{"n":"'), (F.col("event_id") % 100).cast("string"), F.lit('","on":"'), F.when(F.col("event_id") % 3 == 0, "off").otherwise("yes"), F.lit('"}'))
    found = plans.text_violations(PETS, Compiler(PETS), schema, text, "body", coerce=True)
    return read(spark, sf_dir, "events").select("event_id", F.size(found).alias("n_violations"))


_sql["body_coercion"] = "SELECT event_id, CAST(CAST(event_id % 100 > 50 AS INT) + CAST(event_id % 3 = 0 AS INT) AS INT) AS n_violations FROM events"


def deprecated_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return df.select("event_id", F.size(plans.warnings(df, "props", {"properties": {"k": {"deprecated": True}}})).alias("n_warnings"))


_sql["deprecated_warnings"] = f"SELECT event_id, CAST({K} IS NOT NULL AS INT) AS n_warnings FROM events"


def coerce_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_extract("url", r"/([^/?#]*)/?(?:[?#].*)?$", 1)
    return read(spark, sf_dir, "pages").select("page_id", coercion.to_integer(raw, strict=False).alias("value"))


_sql["coerce_lenient"] = r"""SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(s, '^[+-]?\d+', 0), '') AS BIGINT), 0) AS value
FROM (SELECT page_id, regexp_extract(url, '/([^/?#]*)/?(?:[?#].*)?$', 1) AS s FROM pages)"""


def interpreted_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats in a schema that only the interpreter takes."""
    schema = {"properties": {"m": {"type": "string", "format": "email"}, "d": {"type": "string", "format": "date"}}, "unevaluatedProperties": False}
    text = F.concat(F.lit('{"m":"a@x.'), F.when(F.col("event_id") % 4 == 0, "12").otherwise("example"), F.lit('","d":"2023-02-'), F.lpad((F.col("event_id") % 31).cast("string"), 2, "0"), F.lit('"}'))
    return plans.validate(read(spark, sf_dir, "events").select("event_id", text.alias("t")), "t", schema).select("event_id", "valid")


_sql["interpreted_formats"] = "SELECT event_id, event_id % 4 <> 0 AND event_id % 31 BETWEEN 1 AND 28 AS valid FROM events"


def nested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = F.concat(F.lit("a[b]["), (F.col("event_id") % 5).cast("string"), F.lit("][]="), F.col("event_id").cast("string"))
    found = decoders.nested_pairs(decoders.pairs(query))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(F.get(found, F.lit(0))["path"], ">").alias("path"), F.get(found, F.lit(0))["value"].alias("value"))


_sql["nested_keys"] = "SELECT event_id, 'a>b>' || (event_id % 5) || '>' AS path, CAST(event_id AS VARCHAR) AS value FROM events"



def deep_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nested names as an object whose members have the types of its schema."""
    schema = {"type": "object", "properties": {"id": {"type": "integer", "minimum": 100}, "o": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 2}}}}}
    query = F.concat(F.lit("f[id]="), F.col("event_id").cast("string"), F.lit("&f[o][k]="), (F.col("event_id") % 5).cast("string"), F.when(F.col("event_id") % 7 == 0, "&f[id][x]=1").otherwise(""))
    text = decoders.deep_object(decoders.pairs(query), "f")
    found = plans.text_violations(PETS, Compiler(PETS), schema, text, "query/f", coerce=True)
    return read(spark, sf_dir, "events").select("event_id", F.size(found).alias("n_violations"))


_sql["deep_objects"] = "SELECT event_id, CAST(CAST(event_id % 7 = 0 OR event_id < 100 AS INT) + CAST(event_id % 5 > 2 AS INT) AS INT) AS n_violations FROM events"


#: Two addresses of one callback, one of them a template.
CALLED = Contract.api("3.1.0", {"paths": {}, "components": {"callbacks": {"done": {path: {"post": {"requestBody": {"content": {"application/json": {"schema": {"properties": {"k": bound}}}}}}} for path, bound in (("/done", {"minimum": 50}), ("/done/{id}", {"maximum": 20}))}}}})


def callback_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("event_type") == "click", "/done").when(F.col("event_type") == "view", F.concat(F.lit("/done/"), F.col("event_id").cast("string"))).otherwise("/gone")
    rows = read(spark, sf_dir, "events").select("event_id", F.lit("done").alias("name"), F.lit("POST").alias("method"), path.alias("path"), F.lit("application/json").alias("content_type"), F.col("props").alias("body"))
    return plans.validate_callbacks(rows, CALLED).select("event_id", "valid")


_sql["callback_validation"] = f"SELECT event_id, CASE event_type WHEN 'click' THEN coalesce({K} >= 50, TRUE) WHEN 'view' THEN coalesce({K} <= 20, TRUE) ELSE FALSE END AS valid FROM events"

_queries |= {f.__name__: f for f in (callback_validation, deep_objects, webhook_validation, path_and_cookie, response_headers, whole_querystring, body_coercion, deprecated_warnings, coerce_lenient, interpreted_formats, nested_keys)}
_queries |= {f.__name__: f for f in (violations_rollup, discriminator_route, route_match, query_parse, coerce_integer, coerce_boolean, status_lookup, json_lines, utf16_lengths, conformance_by_hour, interpreted, contract_versions)}


def queries() -> dict[str, Query]:
    return _queries | message_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | message_queries.oracle_sql()
