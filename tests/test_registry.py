"""Every ledger query against its SQL oracle on the smallest test data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tallowmere.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "orders lineitem events".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    ours = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    assert ours and ours == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_incremental_keeps_earlier_decisions(spark):
    from tallowmere.operators import resolve
    from tallowmere.sources.views import ledger_txn

    txn = ledger_txn(spark, SF)
    first = resolve.resolve(txn.where("seq <= 500"))
    later = resolve.resolve_new(txn, first, 500)
    legs = first.unionByName(later).selectExpr("user_id", "explode(array(debit_seq, credit_seq)) AS seq")
    assert legs.count() == legs.distinct().count()
    assert later.where("greatest(debit_seq, credit_seq) <= 500").count() == 0
