"""Host names by their IDNA form, references inside files that are referred to, validity without violations, missing libraries."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from tablepact.functions.value_formats import VALUE
from tablepact.plans import validate as plans
from tablepact.sources.contract import ROOT_KEY, Contract

HOSTS = {"a.example": True, "ü" * 20 + ".de": True, "ü" * 60: False, "ü" * 56 + ".de": True, "a" * 63: True, "a" * 64: False, ".".join(["ü" * 40] * 6): False, "bücher.example": True, "-a.de": False, "": False}


def test_hosts_have_the_length_of_their_ascii_form(spark):
    df = spark.createDataFrame([(i, json.dumps(h), json.dumps("x@" + h + ".de")) for i, h in enumerate(HOSTS)], "i int, h string, m string")
    for lane in ("native", "python"):
        got = df.select("i", plans.violations(df, "h", {"type": "string", "format": "hostname"}, lane=lane).alias("h"), plans.violations(df, "m", {"type": "string", "format": "email"}, lane=lane).alias("m")).orderBy("i").collect()
        assert [not r.h for r in got] == list(HOSTS.values()), lane
        long = [i for i, h in enumerate(HOSTS) if h == "ü" * 60]
        assert [bool(got[i].m) for i in long] == [True] and not got[0].m and not got[1].m
    assert [VALUE["hostname"](h) for h in HOSTS] == list(HOSTS.values())


def test_files_refer_to_themselves_and_on(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/other.yaml").write_text("A:\n  properties:\n    b: {$ref: '#/B'}\n    c: {$ref: '../third.yaml#/C'}\n    r: {$ref: '#/R'}\nB: {type: integer}\nR: {$ref: 'more.json#/x'}\n")
    (tmp_path / "sub/more.json").write_text('{"x": {"$ref": "#/y"}, "y": {"maximum": 3}}')
    (tmp_path / "third.yaml").write_text("C: {type: string}\nB: {type: 'null'}\n")
    (tmp_path / "api.yaml").write_text(f"{ROOT_KEY}: 3.1.0\ninfo: {{title: t, version: '1'}}\npaths: {{}}\ncomponents: {{schemas: {{X: {{$ref: 'sub/other.yaml#/A'}}}}}}\n")
    c = Contract.from_file(str(tmp_path / "api.yaml"))
    df = spark.createDataFrame([('{"b": 1, "c": "x", "r": 2}',), ('{"b": "1", "c": 1, "r": 4}',)], "t string")
    found = [sorted(v.data_path for v in r.v) for r in df.select(plans.violations(df, "t", "#/components/schemas/X", c).alias("v")).collect()]
    assert found == [[], ["/b", "/c", "/r"]]


def test_validity_makes_no_violations(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": "x"}',), ("{",), (None,)], "t string")
    out = plans.validate(df, "t", {"properties": {"a": {"type": "integer"}}})
    assert [(r.valid, not r.violations) for r in out.collect()] == [(True, True), (False, False), (False, False), (True, True)]
    assert "is not of type" not in out.where("valid").select("t")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("missing", ["public_tokenizers", "xxhash"])
def test_contracts_stay_without_libraries_of_the_others(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=False).returncode == 0
