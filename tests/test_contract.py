"""Registered queries against their SQL on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

CHECKED = (
    "unit_panel element_panel period_entropy panel_lags ols season_windows period_index balance_seasons recent_slice "
    "forecast_shift fc_local_level fc_stoch_vol context_sets extract_rosters standing_to_roster parse_export "
    "dedupe_rosters duplicate_row_keys encode_tokens member_pool assign_codebook representatives_current knn_exact "
    "expected_winrate advantage_graph pairing_metrics stream_period_counts shift_table risers_fallers top_shares family_shares "
    "masked_examples fit_units fit_strength pca_project rate_rosters_detail horse_race loro_select custom_forecaster"
).split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["season", "unit", "current_share", "predicted_share", "delta", "pct_change"]
    assert df.count() > 0


def test_every_oracle_has_a_query_and_names_are_plain():
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 125


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    rel = con.execute(entry_point.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(got, df.columns) == rows_of(rel.fetchall(), names)


def test_package_reaches_the_workers(tmp_path):
    """A query with functions on the workers, started from another folder without the package on any path."""
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, %r); import __spark_entry__ as e; from fieldshift.session import local_session; "
        "s = local_session(2); print('ROWS', e.queries()['assign_codebook'](s, %r).count())"
    ) % (os.path.dirname(os.path.abspath(entry_point.__file__)), SF)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
