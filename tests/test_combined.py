"""All analyses from one pass, counts that come with an analysis, and what is left out."""

import random
import re

import pytest
from conftest import final_plan, lines_frame
from pyspark.sql import functions as F
from test_random_reports import make_body
from test_reports import MICRO, hang, line, report

import hangstats as hs
from hangstats.catalog.event_lines import event_lines
from hangstats.operators import quarantine as q


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


@pytest.fixture(scope="module")
def reports(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lines") / "lines")
    event_lines(spark, sf_dir).select("value").write.text(path)
    return hs.read_reports(spark.read.text(path))


def test_all_reports_scan_and_parse_once(reports):
    plan = final_plan(hs.all_reports(reports))
    assert plan.count("FileScan text") == 1
    assert len(re.findall(r"AS _report#", plan)) == 1
    assert "ReusedExchange" in plan
    assert not re.search(r"Python|ArrowEval|MapIn|CartesianProduct", plan)


def random_reports(spark, seed):
    rng = random.Random(seed)
    bodies = [make_body(rng, rng.choice([0, 0, 0.05])) for _ in range(300)]
    return hs.read_reports(lines_frame(spark, [line(i, body) for i, body in enumerate(bodies)] + MICRO))


@pytest.mark.parametrize("source", ["events", "random", "micro", "empty"])
def test_analyses_equal_the_single_ones(spark, reports, source):
    if source != "events":
        reports = {
            "random": lambda: random_reports(spark, 4),
            "micro": lambda: hs.read_reports(lines_frame(spark, MICRO)),
            "empty": lambda: hs.read_reports(lines_frame(spark, MICRO)).where("ping_id = 'none'"),
        }[source]()
    with hs.cached(reports) as kept:
        found = hs.analyses(kept)
        for name in (set(found) - {"session_hangs"}):
            assert rows(found[name]) == rows(getattr(hs, name)(kept)), name
        single = hs.session_hangs(kept).groupBy("hangs", "uptime").count()
        assert rows(found["session_hangs"]) == rows(single)


@pytest.mark.parametrize("name", ["hang_clusters", "plugin_hang_median", "session_hangs", "all_reports"])
def test_counts_come_with_an_analysis(reports, name):
    plain = rows(getattr(hs, name)(reports))
    frame, observation = hs.counted(reports, name)
    analysis = getattr(hs, name)(frame)
    assert rows(analysis) == plain
    seen = observation.get
    wanted = hs.invalid_hangs(reports.withColumn("uptime", F.lit(1))).first()
    counts = reports.selectExpr("count_if(well_formed)", "count_if(not well_formed)").first()
    assert (seen["pings_analyzed"], seen["malformed"]) == tuple(counts)
    assert (seen["hangs"], seen["invalid_hangs"]) == tuple(wanted)
    assert seen["large_counts"] == hs.quarantine(reports).where(f"cause = '{q.LARGE_COUNT}'").count() > 0
    again, _ = hs.counted(reports, f"{name}_plan")
    plan = final_plan(getattr(hs, name)(again))
    assert plan.count("FileScan text") == 1
    assert len(re.findall(r"AS _report#", plan)) == 1


def test_quarantine_of_small_reports(spark):
    odd = report(
        [
            hang(["a"], {"1": 2**63, "x": 3, "2": 1, "y": -1}),
            {"stack": 5, "histogram": {"values": {"1": -1}}},
            {"stack": ["b"]},
            hang([], {}),
            7,
        ],
        "no number",
    )
    found = hs.quarantine(hs.read_reports(lines_frame(spark, [*MICRO, line(10, odd)])))
    assert "Exchange" not in final_plan(found)
    ids = {f"{i:036d}": i for i in (2, 3, 9, 10)} | {"short": "short"}
    assert sorted((tuple([ids[r.ping_id], *r[1:]]) for r in found.collect()), key=repr) == sorted(
        [
            (2, q.NO_THREADS, None, None, None),
            (3, q.NO_UPTIME, None, None, None),
            ("short", q.MALFORMED, None, None, None),
            (9, q.MALFORMED, None, None, None),
            (10, q.NO_UPTIME, None, None, None),
            (10, q.LARGE_COUNT, 0, 0, "1"),
            (10, q.NO_NUMBER, 0, 0, "x"),
            (10, q.NO_STACK, 0, 1, None),
            (10, q.NOT_POSITIVE, 0, 1, None),
            (10, q.NO_HISTOGRAM, 0, 2, None),
            (10, q.NOT_POSITIVE, 0, 3, None),
            (10, q.NO_STACK, 0, 4, None),
            (10, q.NO_HISTOGRAM, 0, 4, None),
        ],
        key=repr,
    )
