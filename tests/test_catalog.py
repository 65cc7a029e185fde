"""Every registered query against DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as contract  # noqa: E402
from hangstats.catalog import queries as catalog  # noqa: E402

SURVEYED = """
ping_filter ping_filter_range ping_filter_wildcard empty_selection source_pruning prefix_fraction
ping_parse malformed_pings hang_rows histogram_explode weighted_replicate zip_arrays
normalize_frames last_frame bin_midpoint plugin_flag nonempty_stacks plugin_frames rank_range
median_upper assert_positive_hangs raw_contains subtract_keep_dups pings_analyzed hang_totals
top_frames top_stacks_per_frame top_plugin_stacks top_plugin_frames plugin_hang_stats
plugin_hang_median session_hangs hang_clusters lzma_text_scan
""".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"create view {path.stem} as from '{path}'")
    return connection


def test_register_is_complete():
    assert sorted(catalog.QUERIES) == sorted(catalog.ORACLES)
    assert set(SURVEYED) <= set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.filterwarnings("ignore:no report file")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    frame = contract.queries()[name](spark, sf_dir)
    expected = duck.sql(contract.oracle_sql()[name])
    columns = sorted(frame.columns)
    assert columns == sorted(expected.columns)
    found = [tuple(row) for row in frame.select(*columns).collect()]
    wanted = expected.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert sorted(found, key=repr) == sorted(wanted, key=repr)
    assert found


def test_entry(spark):
    assert contract.entry(spark).count() == 1
