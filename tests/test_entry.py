"""The driver contract, and every SQL-backed query against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from meshwork.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
FAST = ("edges_clean_ps", "edges_symmetric_ps", "csr_offsets_ps", "degree_buckets_ps", "adjacency_ps", "succession_edges", "bfs_ps", "bfs_priority_delta", "pagerank_directed", "coloring_ps", "components_ps", "partition_relabel", "edge_cut_balance", "scalar_functions", "run_log_times", "components_path", "bfs_path", "source_mtx", "source_csr", "source_vector_text", "edge_difference_os", "stream_depths")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def rows(columns, values):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in values)


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    other = con.sql(ORACLES[name])
    assert sorted(other.columns) == columns
    chosen = ", ".join(f'"{c}"' for c in columns)
    assert rows(columns, found.select(columns).collect()) == rows(columns, con.sql(f"SELECT {chosen} FROM ({ORACLES[name]})").fetchall())
