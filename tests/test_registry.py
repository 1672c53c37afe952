"""The registered queries as the driver sees them."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()
# streaming jobs have their own tests
BATCH = sorted(n for n in ORACLES if not n.startswith("stream_"))


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", BATCH)
def test_query_equals_oracle(spark, con, name):
    got = normal(contract.queries()[name](spark, FOLDER).toPandas())
    want = normal(con.execute(ORACLES[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.values.tolist() == want.values.tolist()


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())


def scans_of_orders(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [line for line in plan.split("\n") if "FileScan parquet" in line and "orders.parquet" in line]


def test_workload_has_one_exchange(spark):
    plan, scans = scans_of_orders(contract.queries()["workload"](spark, FOLDER))
    assert len(scans) == 1 and plan.count("Exchange hashpartitioning") == 1 and "RoundRobin" not in plan


def test_reassignment_reads_keys_only(spark):
    _, scans = scans_of_orders(contract.queries()["reassigned_tasks"](spark, FOLDER))
    assert scans and all("o_orderstatus" not in s and "o_orderdate" not in s for s in scans)
