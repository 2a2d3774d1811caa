"""Fast registered queries against their SQL twins on the smallest tables; tools/check.py runs all of them."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from tools.check import table

SF = "/root/testdata/sf0.001"
NAMES = [
    "normalize_query", "key_collapse", "validate_queries", "validate_responses", "text_search", "vector_search_cosine", "semantic_match",
    "query_stats", "traffic_snapshot", "percentiles_linear", "classify_freshness", "replay_stale", "ttl_grid", "drift_window",
    "health_timeline", "circuit_timeline", "movements", "fold_cdc", "label_cdc", "stream_tumbling",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry_points.queries()[name](spark, SF)
    rel = con.execute(entry_points.oracle_sql()[name])
    want = table([d[0] for d in rel.description], rel.fetchall())
    assert table(df.columns, df.collect()) == want


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
