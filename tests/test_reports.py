"""Small hand-written reports with results computed by hand."""

import json
import math

import pytest
from conftest import lines_frame
from pyspark.sql import functions as F

import hangstats as hs
from hangstats.operators.reports import ping_counts


def line(number, body):
    return f"{number:036d}\t" + (body if isinstance(body, str) else json.dumps(body))


def hang(stack, values):
    return {"stack": stack, "histogram": {"values": values}}


def report(hangs, uptime=10, name="Gecko", more=()):
    return {
        "simpleMeasurements": {"uptime": uptime},
        "threadHangStats": [{"name": name, "hangs": hangs}, *more],
    }


MICRO = [
    line(
        0,
        report(
            [
                hang(["main", "chrome://a.js:12"], {"1": 2, "2": 1}),
                hang(["main", "IPDL::PPluginInstance::Msg", "plug.js:9"], {"4": 3}),
            ]
        ),
    ),
    line(
        1,
        report(
            [hang([], {"8": 1})],
            20,
            more=[{"name": "Compositor", "hangs": [hang(["x"], {"1": 100})]}],
        ),
    ),
    line(2, {"simpleMeasurements": {"uptime": 5}}),
    line(3, report([hang(["main", "chrome://a.js:99"], {"16": 2, "32": "bad"})], "x")),
    "short",
    line(9, "{bad"),
]


@pytest.fixture(scope="module")
def reports(spark):
    return hs.read_reports(lines_frame(spark, MICRO))


def of(spark, *bodies):
    return hs.read_reports(lines_frame(spark, [line(i, b) for i, b in enumerate(bodies)]))


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def test_counts(reports):
    assert rows(ping_counts(reports)) == [(4, 2)]


def test_plugin_stats(reports):
    row = hs.plugin_hang_stats(reports).first()
    assert (row.pings_analyzed, row.n_total, row.n_plugin, row.n_other) == (4, 9, 3, 6)
    assert row.plugin_ratio == pytest.approx(1 / 3)
    assert (row.mean_plugin, row.se_plugin) == (6.0, 0.0)
    assert row.mean_other == 11.0
    assert row.se_other == pytest.approx(math.sqrt(97.25) / math.sqrt(6), rel=1e-15)
    assert row.mean_other_as_published == 14.0


def test_plugin_median(reports):
    row = hs.plugin_hang_median(reports).first()
    assert (row.pings_analyzed, row.n_plugin, row.n_other) == (4, 3, 6)
    assert (row.median_plugin, row.median_other) == (6.0, 12.0)
    assert row.plugin_ratio == pytest.approx(1 / 3)


def test_plugin_lists(reports):
    assert rows(hs.plugin_frames(reports)) == [("IPDL::PPluginInstance::Msg",)]
    stack = "main > IPDL::PPluginInstance::Msg > plug.js:9"
    assert rows(hs.top_plugin_stacks(reports)) == [(stack, 100.0)]
    assert rows(hs.top_plugin_frames(reports)) == [("plug.js:9", 100.0)]


def test_clusters(reports):
    stack = "main > IPDL::PPluginInstance::Msg > plug.js"
    assert rows(hs.hang_clusters(reports)) == [(2, "plug.js", 3, 0.375, 1, stack, 1.0)]
    full = hs.hang_clusters(reports, skip=0).orderBy("rank")
    assert [(r.rank, r.frame, r.n, r.share) for r in full.collect()] == [
        (1, "chrome://a.js", 5, 0.625),
        (2, "plug.js", 3, 0.375),
    ]
    nested = hs.hang_clusters_nested(reports).first()
    assert [tuple(entry) for entry in nested.stacks] == [(stack, 1.0)]


def test_sessions(reports):
    assert sorted(rows(hs.session_hangs(reports))) == [(1.0, 20), (6.0, 10)]


def test_empty_input(spark):
    empty = hs.read_reports(lines_frame(spark, ["x"]).where("value = 'y'"))
    stats = hs.plugin_hang_stats(empty).first()
    assert (stats.pings_analyzed, stats.n_total, stats.plugin_ratio) == (0, 0, None)
    assert (stats.mean_plugin, stats.se_other) == (None, None)
    median = hs.plugin_hang_median(empty).first()
    assert (median.pings_analyzed, median.n_other, median.median_other) == (0, 0, None)
    assert rows(hs.hang_clusters(empty)) == []


def test_one_class_only(spark):
    reports = of(spark, report([hang(["a"], {"2": 3})]))
    stats = hs.plugin_hang_stats(reports).first()
    assert (stats.n_plugin, stats.plugin_ratio, stats.mean_plugin) == (0, 0.0, None)
    assert (stats.mean_other, stats.mean_other_as_published) == (3.0, 3.0)
    assert hs.plugin_hang_median(reports).first().median_plugin is None


def test_counts_below_one(spark):
    reports = of(spark, report([hang(["a"], {"1": -5, "2": 0, "4": 3})]))
    assert [r.weight for r in hs.histogram_rows(hs.hang_rows(reports)).collect()] == [3]
    assert hs.plugin_hang_stats(reports).first().n_total == 3
    # The plain sum is -2, so the hang is invalid for the session report.
    assert rows(hs.session_hangs(reports)) == [(0.0, 10)]
    assert rows(hs.invalid_hangs(reports)) == [(1, 1)]
    with pytest.raises(Exception, match="without a positive count"):
        hs.session_hangs(reports, strict=True).collect()


def test_strict_sessions_pass_valid_hangs(spark):
    reports = of(spark, report([hang(["a"], {"1": 2}), hang(["b"], {"1": -1, "2": 3})]))
    assert rows(hs.session_hangs(reports, strict=True)) == [(4.0, 10)]


def test_label_that_is_no_number(spark):
    reports = of(spark, report([hang(["a"], {"abc": 1, "2": 2})]))
    assert hs.hang_clusters(reports, skip=0).first().n == 3
    assert rows(hs.session_hangs(reports)) == [(3.0, 10)]
    assert hs.plugin_hang_stats(reports).first().n_total == 2
    assert hs.plugin_hang_median(reports).first().n_other == 2


def test_wrong_count_types(spark):
    values = {"1": "7", "2": 2.0, "4": 2.5, "8": None, "16": [1], "32": 5, "64": 2**40, "128": 2**70}
    bins = hs.histogram_rows(hs.hang_rows(of(spark, report([hang(["a"], values)]))))
    assert [(r.bin, r.weight) for r in bins.collect()] == [(32, 5), (64, 2**40)]


def test_sessions_per_thread_entry(spark):
    second = {"name": "Gecko", "hangs": [hang(["b"], {"1": 4})]}
    reports = of(spark, report([], 7, more=[second, {"name": 5, "hangs": []}, {"name": "Gecko"}]))
    assert sorted(rows(hs.session_hangs(reports))) == [(0.0, 7), (4.0, 7)]


def test_session_counts_hangs_without_a_stack(spark):
    reports = of(spark, report([{"histogram": {"values": {"1": 2}}}, {"stack": ["a"]}]))
    assert rows(hs.session_hangs(reports)) == [(2.0, 10)]
    assert rows(hs.hang_rows(reports)) == []


@pytest.mark.parametrize("uptime", ["x", 1.5, None, 10**38, -(10**38), 1e30, "99999999999999999999", [1]])
def test_uptime_must_be_an_integer(spark, uptime):
    assert rows(hs.session_hangs(of(spark, report([], uptime)))) == []


@pytest.mark.parametrize("uptime", [2**63, 2**70, 10**38 - 1, -(10**38) + 1, 2**63 - 1, -(2**63), 0])
@pytest.mark.parametrize("odd", [False, True])
def test_uptimes_of_any_size(spark, uptime, odd):
    more = [5] if odd else []
    assert rows(hs.session_hangs(of(spark, report([], uptime, more=more)))) == [(0.0, uptime)]


@pytest.mark.parametrize("odd", [False, True])
def test_counts_of_any_size(spark, odd):
    values = {"1": 2**63, "2": 2**63 - 1, "4": 10**38, "8": "99999999999999999999", "16": 1e25, "32": -(2**64), "64": 3}
    reports = of(spark, report([hang(["a"], values), hang(5 if odd else ["b"], {"1": 10**37})]))
    # 10**38 has too many digits to be a usable number.
    assert rows(hs.session_hangs(reports)) == [(float(10**37), 10)]  # the first hang's counts add up to less than 0
    assert rows(hs.invalid_hangs(reports)) == [(2, 1)]
    alone = of(spark, report([hang(["a"], {"1": 2**63, "2": 2**63}), *([5] if odd else [])]))
    assert rows(hs.session_hangs(alone)) == [(float(2**64), 10)]
    # Durations and stacks have 64-bit counts; what is beyond is in the quarantine.
    assert [r.weight for r in hs.histogram_rows(hs.hang_rows(reports)).collect() if r.label == "64"] == [3]


def repeated(*parts):
    return line(0, '{"simpleMeasurements":{"uptime":1},"threadHangStats":[{"name":"Gecko","hangs":[%s]}]}' % ",".join(parts))


@pytest.mark.parametrize("duplicates", ["true", "false"])
@pytest.mark.parametrize("padding", [0, 20_000_000])
def test_repeated_keys_in_any_session(spark, duplicates, padding):
    """Usual and odd bodies, small and large ones: all entries of a histogram, the last value of another key."""
    hang_text = '{"stack":["no"],"stack":["a"],"histogram":{"values":{"1":2,"1":3}}}'
    odd = '{"stack":5,"histogram":{"values":{"1":2,"2":{"x":1,"x":2},"4":"7"}}}'
    lines = [repeated(hang_text), repeated(hang_text, odd)]
    if padding:
        lines = [text[:-1] + ',"padding":"%s"}' % ("x" * padding) for text in lines]
    before = spark.conf.get("spark.sql.variant.allowDuplicateKeys")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", duplicates)
    try:
        reports = hs.read_reports(lines_frame(spark, lines))
        assert rows(ping_counts(reports)) == [(2, 0)]
        assert sorted(rows(hs.session_hangs(reports))) == [(5.0, 1), (7.0, 1)]
        assert [r.stack for r in hs.hang_rows(reports).collect()] == [["a"], ["a"]]
    finally:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", before)


def test_bodies_that_are_no_object(spark):
    good = ["[1,2]", "5", '"x"', "null", "true", " [] ", '{"a":1} tail', "[{},5]"]
    bad = ["5 x", "1],[2", '1,"y":2', '{"a"', "", " ", "[1", "1}", "nul", "{'a':1}", "NaN", "1 2"]
    assert rows(ping_counts(of(spark, *good))) == [(len(good), 0)]
    assert rows(ping_counts(of(spark, *bad))) == [(0, len(bad))]
    for text in bad:
        with pytest.raises(Exception, match="malformed report line"):
            hs.read_reports(lines_frame(spark, [line(0, text)]), on_error="fail").collect()


@pytest.mark.parametrize("threads", [None, {}, 5, "x", [], [1, "x", None]])
def test_threads_of_another_shape(spark, threads):
    reports = of(spark, {"simpleMeasurements": {"uptime": 1}, "threadHangStats": threads})
    assert rows(hs.hang_rows(reports)) == []
    assert hs.plugin_hang_stats(reports).first().pings_analyzed == 1


def test_null_frame_is_no_plugin_frame(spark):
    reports = of(spark, report([hang([None, "a"], {"1": 1})]))
    assert hs.plugin_hang_stats(reports).first().n_other == 1


def test_positions_and_other_thread(spark):
    more = [{"name": "Gecko", "hangs": [hang(["b"], {"1": 1}), hang(["c"], {"1": 1})]}]
    reports = of(spark, report([hang(["x"], {"1": 1})], name="Other", more=more))
    found = hs.hang_rows(reports).select("thread_pos", "hang_pos", "stack").collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, ["b"]), (1, 1, ["c"])]
    other = hs.read_reports(lines_frame(spark, [line(0, report([], name="Other"))]), "Other")
    assert rows(hs.session_hangs(other)) == [(0.0, 10)]


def test_on_error(spark):
    lines = lines_frame(spark, MICRO)
    assert hs.parse_pings(lines, "drop").count() == 4
    assert hs.parse_pings(lines, "keep").count() == 6
    with pytest.raises(Exception):
        hs.parse_pings(lines, "fail").select(F.col("ping").cast("string")).collect()
    with pytest.raises(ValueError):
        hs.parse_pings(lines, "other")
    assert hs.read_reports(lines, on_error="drop").count() == 4
    assert hs.read_reports(lines).count() == 6
    with pytest.raises(Exception):
        hs.session_hangs(hs.read_reports(lines, on_error="fail")).collect()
    good = lines_frame(spark, MICRO[:4])
    assert hs.session_hangs(hs.read_reports(good, on_error="fail")).count() == 2


def test_repeated_keys_keep_the_report(spark):
    body = '{"threadHangStats":[],"a":1,"a":2}'
    assert rows(ping_counts(of(spark, body))) == [(1, 0)]
    odd = '{"threadHangStats":[5],"a":1,"a":2}'
    assert rows(ping_counts(of(spark, odd))) == [(1, 0)]


def test_repeated_labels_all_count(spark):
    body = json.dumps(report([hang(["a"], {"1": 2, "2": 3})])).replace('"2"', '"1"')
    assert hs.plugin_hang_stats(of(spark, body)).first().n_total == 5


@pytest.mark.parametrize("body", ["[]", "5", "null", '"x"', "{} x", "[{}]"])
def test_bodies_that_are_no_object(spark, body):
    reports = of(spark, body)
    assert rows(ping_counts(reports)) == [(1, 0)]
    assert rows(hs.hang_rows(reports)) == rows(hs.session_hangs(reports)) == []


@pytest.mark.parametrize("body", ["", " ", "{", "{'a': 1}", '{"a": NaN}', "{a: 1}", '{"a": 01}'])
def test_bodies_that_are_no_json(spark, body):
    assert rows(ping_counts(of(spark, body))) == [(0, 1)]


def test_cached_reports_give_the_same(spark, reports):
    with hs.cached(reports) as kept:
        assert rows(hs.plugin_hang_stats(kept)) == rows(hs.plugin_hang_stats(reports))
        assert rows(hs.hang_clusters(kept)) == rows(hs.hang_clusters(reports))
    assert not reports.is_cached


def test_raw_contains(spark):
    lines = lines_frame(spark, ["with flashVersion", "without"])
    assert rows(hs.raw_contains(lines, "flashVersion")) == [("with flashVersion",)]


def test_csv(spark, reports, tmp_path):
    hs.write_csv(hs.session_hangs(reports).orderBy("uptime"), f"{tmp_path}/out", single_file=True)
    (written,) = (tmp_path / "out").glob("*.csv")
    assert written.read_text() == "hangs,uptime\n6.0,10\n1.0,20\n"
    hs.write_csv(hs.session_hangs(reports), f"{tmp_path}/many")
    for part in (tmp_path / "many").glob("*.csv"):
        assert part.read_text().startswith("hangs,uptime\n")
