"""Registered queries against their DuckDB SQL on the smallest tables: a few of each module, all of them with CAIRN_ALL_QUERIES=1."""

import collections
import os

import pytest

import __spark_entry__ as entry
from cairn.plans import core_problems

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the test tables")
SOME = [*core_problems.SQL, "t1_ranked_search", "w4_recall_quotas", "x22_name_tokens", "j10_include_resolution", "g1_reach_scopes", "j13_package_edges", "j16_counterparts", "a12_relations", "a8_dispositions", "a10_merged_evidence", "j6_effective", "q_p3_references", "e7_callables", "j20_alias_chains", "r4_streamed_state", "r10_streamed_counts"]
CORE = {k: v for m in entry._MODULES for k, v in m.SQL.items()}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE) if os.environ.get("CAIRN_ALL_QUERIES") else SOME)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    mine = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    other = duck.sql(CORE[name])
    at = [other.columns.index(c) for c in cols]
    assert len(other.columns) == len(cols)
    assert mine == collections.Counter(tuple(plain(r[i]) for i in at) for r in other.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["generation", "file_id", "change_kind"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
