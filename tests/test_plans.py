"""What the plans look like: one scan, one parse, no Python, no full-data sort."""

import re

import pytest
from conftest import final_plan

import hangstats as hs
from hangstats.catalog.event_lines import event_lines
from hangstats.operators.stats import prefix_fraction, upper_median
from hangstats.plans import clusters

ANALYSES = {
    "hang_clusters": hs.hang_clusters,
    "top_frames": clusters.top_frames,
    "top_stacks_per_frame": clusters.top_stacks_per_frame,
    "plugin_hang_stats": hs.plugin_hang_stats,
    "plugin_hang_median": hs.plugin_hang_median,
    "plugin_frames": hs.plugin_frames,
    "top_plugin_stacks": hs.top_plugin_stacks,
    "top_plugin_frames": hs.top_plugin_frames,
    "session_hangs": hs.session_hangs,
    "invalid_hangs": hs.invalid_hangs,
}


@pytest.fixture(scope="module")
def reports(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "lines")
    event_lines(spark, sf_dir).select("value").write.text(path)
    return hs.read_reports(spark.read.text(path))


@pytest.mark.parametrize("name", ANALYSES)
def test_one_scan_and_one_parse(reports, name):
    plan = final_plan(ANALYSES[name](reports))
    assert plan.count("FileScan text") == 1
    # The body is parsed once; the steps of odd bodies are in a branch of their own.
    assert plan.count("parseJson") == 0
    assert len(re.findall(r"AS _report#", plan)) == 1
    assert len(re.findall(r"AS _threads#", plan)) == 1
    assert not re.search(r"Python|ArrowEval|MapIn|CartesianProduct|NestedLoop", plan)


@pytest.mark.parametrize("read", [hs.read_reports, hs.parse_pings])
def test_dropping_malformed_lines_parses_once(spark, sf_dir, read):
    plan = final_plan(read(event_lines(spark, sf_dir), on_error="drop"))
    assert plan.count("parseJson") == (read is hs.parse_pings)
    assert len(re.findall(r"AS _report#", plan)) == (read is hs.read_reports)


def test_sessions_need_no_shuffle(reports):
    assert "Exchange" not in final_plan(hs.session_hangs(reports))


@pytest.mark.parametrize("name", ["hang_clusters", "top_stacks_per_frame"])
def test_hot_frames_are_cut_before_the_shuffle(reports, name):
    plan = final_plan(ANALYSES[name](reports))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_top_lists_keep_k_rows_per_task(reports):
    plan = hs.top_plugin_stacks(reports)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_median_reads_two_columns(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = final_plan(upper_median(rows, ["l_returnflag"], "l_extendedprice"))
    schemas = set(re.findall(r"ReadSchema: (\S+)", plan))
    assert schemas == {"struct<l_extendedprice:double,l_returnflag:string>"}


def test_prefix_fraction_is_a_filter_on_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = final_plan(prefix_fraction(rows, "l_orderkey", 0.1).select("l_orderkey"))
    assert "Join" not in plan.split("Subquery")[0]
