"""Versions of contracts by time."""

from datetime import datetime

import pytest

from tablepact.plans.versions import read_versions, validate_as_of, version_at, versions_of
from tablepact.sources.contract import ROOT_KEY, ContractError


def document(most: int) -> dict:
    return {ROOT_KEY: "3.1.0", "components": {"schemas": {"S": {"properties": {"a": {"maximum": most}}}}}}


def test_rows_are_held_against_the_version_of_their_time(spark):
    day = lambda d: datetime(2024, 1, d)
    table = versions_of([("c", "2", day(10), document(2)), ("c", "1", day(5), document(1)), ("c", "3", day(10), document(3)), ("d", "1", day(1), document(1))], spark)
    versions = read_versions(table)
    rows = [(1, "c", day(4), '{"a": 9}'), (2, "c", day(5), '{"a": 2}'), (3, "c", day(9), '{"a": 1}'), (4, "c", day(10), '{"a": 3}'), (5, "d", day(10), '{"a": 3}'), (6, "e", day(10), "{}"), (7, None, day(10), "{}"), (8, "c", None, "{}"), (9, "c", day(20), None), (10, "c", day(20), "{")]
    df = spark.createDataFrame(rows, "id int, contract string, time timestamp, body string")
    out = validate_as_of(df, "body", "#/components/schemas/S", versions)
    got = {r.id: (r.contract_version, [v.keyword for v in r.violations], r.valid) for r in out.collect()}
    assert got == {
        1: (None, ["version"], False), 2: ("1", ["maximum"], False), 3: ("1", [], True), 4: ("3", [], True), 5: ("1", ["maximum"], False), 6: (None, ["version"], False), 7: (None, ["version"], False),
        8: (None, ["version"], False), 9: ("3", [], True), 10: ("3", ["json"], False),
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert validate_as_of(df, "body", "#/components/schemas/S", []).where("valid").count() == 0
    assert df.select(version_at(versions, df.contract, df.time)).count() == 10
    with pytest.raises(ContractError):
        read_versions(spark.createDataFrame([("c", None, day(1), "{}")], "name string, version string, valid_from timestamp, document string"))
