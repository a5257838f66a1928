"""The driver's contract: every query of contracts has SQL, and the entry query gives rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from tablepact import queries as contracts

D = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(contracts.queries()))
def test_query_has_its_sql_rows(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = contracts.queries()[name](spark, D)
    cols = sorted(got.columns)
    mine = sorted(map(repr, map(tuple, got.select(*cols).collect())))
    theirs = sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({contracts.oracle_sql()[name]})").fetchall()))
    assert mine == theirs


def test_json_lines_gathers_no_user_in_one_value(spark, tmp_path):
    (spark.range(5000).selectExpr("cast(if(id % 3 = 0, 7, id) as int) AS user_id", "if(id % 5 = 0, null, concat('{\"k\": ', id, '}')) AS props")).write.parquet(str(tmp_path / "events.parquet"))
    got = contracts.queries()["json_lines"](spark, str(tmp_path))
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    hot = [i for i in range(5000) if i % 5 and (i % 3 == 0 or i == 7)]
    assert tuple(got.where("user_id = 7").select("n", "total").first()) == (len(hot), sum(hot)) and got.where("user_id = 10").count() == 0
