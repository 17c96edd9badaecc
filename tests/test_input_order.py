"""Keep-first by the order of the input, as the data preparation job keeps the first of repeated ids."""

import pandas as pd
import pytest

from vigil.operators.quality import dedupe_keep_first
from vigil.sources import views
from vigil.sources.tables import RAW_ACCOUNT_COLUMNS, in_file_order, read_accounts_csv


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_first_row_of_csv(spark, tmp_path, small_splits):
    """Repeated ids far apart in a file of many splits: the first row stays, whatever its values."""
    n = 2000
    frame = pd.DataFrame({c: [(i * 7919) % 1000 for i in range(n)] for c in RAW_ACCOUNT_COLUMNS})
    frame["ID"] = [(i * 31) % 700 for i in range(n)]
    frame["LIMIT_BAL"] = [float(n - i) for i in range(n)]  # the first row never has the least value
    frame.to_csv(tmp_path / "accounts.csv", index=False)
    rows = in_file_order(read_accounts_csv(spark, str(tmp_path / "accounts.csv")))
    assert rows.rdd.getNumPartitions() > 8
    got = dedupe_keep_first(rows, ["ID"], ["position"]).select("ID", "LIMIT_BAL").collect()
    want = frame.drop_duplicates(subset=["ID"], keep="first")
    assert sorted(map(tuple, got)) == sorted(zip(want["ID"], want["LIMIT_BAL"]))


def test_first_customer_of_several_files(spark, tmp_path, small_splits):
    """The account view carries the place of its customer, over parquet files of several row groups."""
    customers = pd.DataFrame({"c_custkey": [i % 400 for i in range(1200)], "c_acctbal": [float(1200 - i) for i in range(1200)], "c_nationkey": [i % 25 for i in range(1200)]})
    folder = tmp_path / "customer.parquet"
    folder.mkdir()
    for part in range(3):
        customers[part * 500:(part + 1) * 500].to_parquet(folder / f"part-{part}.parquet", row_group_size=50, index=False)
    orders = pd.DataFrame({"o_custkey": [3], "o_orderkey": [1], "o_orderdate": [pd.Timestamp("1995-01-01")], "o_totalprice": [10.0], "o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT"]})
    orders.to_parquet(tmp_path / "orders.parquet", index=False, coerce_timestamps="us")
    rows = dedupe_keep_first(views.accounts(spark, str(tmp_path), position=True), ["id"], ["position"]).drop("position")
    assert rows.columns == views.accounts(spark, str(tmp_path)).columns
    want = customers.drop_duplicates(subset=["c_custkey"], keep="first")
    assert sorted((r["id"], r["limit_bal"]) for r in rows.collect()) == sorted(zip(want["c_custkey"], want["c_acctbal"]))
