"""Values against the version of their contract that was in force at their time.

Versions come from a table ``contracts(name, version, valid_from, document)``. It is read once on the driver, where its documents are
compiled, as contracts are; each of its rows is bounded by the limits of documents and their number by ``MAX_VERSIONS``. What is joined to the
rows is only which version holds: the last of the row's name that begins at or before its time. That is looked up in a constant, so
rows aren't shuffled, and versions whose schemas are equal share one expression.

Rows before the first version of their contract, of an unknown contract, or without a name or time have one violation, ``version``. Of
versions that begin at the same time the last by version counts. Null values have no violations.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions import text as F
from ..functions.strings import bind
from ..operators.routing import constant
from ..operators.schema import Compiler, compilable, none
from ..operators.values import Typed, Variant
from ..sources.contract import Contract, ContractError
from .shared import Numbers, chosen
from .validate import _says

#: Most rows of a table of contracts.
MAX_VERSIONS = 10_000


@dataclass(frozen=True)
class Version:
    name: str
    version: str
    valid_from: int  # microseconds
    contract: Contract


def read_versions(contracts: DataFrame) -> list[Version]:
    """The versions of a table of contracts, by name and time."""
    rows = contracts.select("name", "version", F.call_function("unix_micros", F.col("valid_from").cast("timestamp")).alias("at"), "document").limit(MAX_VERSIONS + 1).collect()
    if len(rows) > MAX_VERSIONS:
        raise ContractError(f"over {MAX_VERSIONS} versions")
    if any(None in tuple(r) for r in rows):
        raise ContractError("a version needs a name, a version, a time and a document")
    found = [Version(r.name, r.version, r.at, Contract.from_text(r.document, "json" if r.document.lstrip().startswith("{") else "yaml")) for r in rows]
    return sorted(found, key=lambda v: (v.name, v.valid_from, v.version))


def version_at(versions: list[Version], name: Column, time: Column) -> Column:
    """The index of the version in force, null where there is none."""
    table: dict[str, list[dict]] = {}
    for i, v in enumerate(versions):
        table.setdefault(v.name, []).append({"at": v.valid_from, "index": i})
    own = F.try_element_at(constant(table, "map<string,array<struct<at:bigint,index:int>>>"), name)
    at = F.call_function("unix_micros", time.cast("timestamp"))
    return F.try_element_at(F.filter(own, lambda v: v["at"] <= at), F.lit(-1))["index"]


def validate_as_of(df: DataFrame, column: str, schema: str, versions: list[Version], *, name_col: str = "contract", time_col: str = "time") -> DataFrame:
    """``df`` with contract_version, violations and valid. ``schema``: the reference of the schema within each document."""
    kind, schemas, numbers = df.schema[column].dataType, Numbers(), []
    for v in versions:
        own = v.contract.schema(schema)
        if not compilable(v.contract, own):
            raise ContractError(f"{v.name} {v.version}: the schema can't be compiled")
        numbers.append(schemas.of([own, (v.contract.document.get("components") or {}).get("schemas"), v.contract.version]))
    contracts = [versions[numbers.index(i)].contract for i in range(len(schemas.values))]
    value = F.try_parse_json(F.col(column)) if isinstance(kind, T.StringType) else F.col(column)
    of = (lambda v: Typed(v, kind)) if not isinstance(kind, (T.StringType, T.VariantType)) else Variant

    def against(index: Column) -> Column:
        unknown = _says("version", "", "no version of its contract is in force")
        number = F.get(constant(numbers, "array<int>"), index)
        checks = lambda v: chosen(number, [Compiler(c).violations(s[0], of(v)) for c, s in zip(contracts, schemas.values)]) if contracts else none()
        bad = F.when(F.col(column).isNotNull(), _says("json", "", "is not JSON")).otherwise(none())
        found = bind(value, lambda v: F.when(v.isNull(), bad).otherwise(checks(v))) if isinstance(kind, T.StringType) else checks(value)
        return F.when(index.isNull(), unknown).otherwise(found)

    names = F.get(constant([v.version for v in versions], "array<string>"), F.col("__index"))
    indexed = df.withColumn("__index", version_at(versions, F.col(name_col), F.col(time_col)))
    out = indexed.withColumn("contract_version", names).withColumn("violations", against(F.col("__index")))
    return out.withColumn("valid", F.size("violations") == 0).drop("__index")


def versions_of(rows: list[tuple[str, str, Any, dict]], spark) -> DataFrame:
    """A table of contracts from (name, version, timestamp, document)."""
    return spark.createDataFrame([(n, v, t, json.dumps(d)) for n, v, t, d in rows], "name string, version string, valid_from timestamp, document string")
