"""The contract's three functions, and registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract

DATA = os.environ.get("CARDAMOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_have_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


#: One of each family; all of them are held against their SQL by the driver.
SAMPLE = ["a2_coverage_audit", "a4_audit_totals", "a5_length_bounds", "j10_longest_prefix", "j12_near_dup", "m1_upsert", "k4_change_flags", "v9_diversity", "e2_prf", "w1_alloc", "q2_stratified", "p6_duration", "p26_leaf_flatten", "l1_prompt_roles", "s4_bad_json_split", "x_events_session"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
