"""Physical plan shapes that matter at scale."""

from __future__ import annotations

import pytest

import brickline.catalog as catalog


def plan(spark, folder, name):
    return catalog.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["month_city_grid", "broadcast_national", "gdp_growth_by_city", "pivot_metrics", "prediction_grid", "fill_missing_members"]
)
def test_grids_and_copies_need_no_cross_join(spark, folder, name):
    text = plan(spark, folder, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_top_rows_are_limited_before_the_shuffle(spark, folder):
    text = plan(spark, folder, "latest3_headlines")
    assert text.index("Partial") > text.index("Exchange hashpartitioning") > text.index("WindowGroupLimit")


def test_scan_reads_only_the_needed_columns_and_pushes_the_filter(spark, folder):
    text = plan(spark, folder, "scan_pruned")
    assert "l_orderkey" in text and "l_extendedprice" not in text
    assert "GreaterThanOrEqual(l_shipdate" in text


@pytest.mark.parametrize("name", ["backtest_ar1", "zscore_by_city", "normalise_listings", "lexicon_sentiment", "stl_panel"])
def test_native_operators_stay_in_the_jvm(spark, folder, name):
    text = plan(spark, folder, name)
    assert "Python" not in text and "Pandas" not in text


def test_intermediate_tables_can_be_dropped(spark):
    import os

    from brickline import session

    kept, session._WRITTEN[:] = list(session._WRITTEN), []
    with session.scratch(spark):
        table = session.settle(spark.range(5), "scratch-test")
        path = session._WRITTEN[0]
        assert table.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
    session._WRITTEN[:] = kept


def test_python_functions_run_where_the_package_is_not_on_the_path(tmp_path):
    """A query with a Python function, from another directory, without the repository on the workers' path."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "import __spark_entry__ as e\nfrom brickline.session import local_session\n"
        "spark = local_session('2', 2)\n"
        "print('ROWS', e.queries()['detect_anomalies_forest'](spark, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
