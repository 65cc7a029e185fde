import pytest
from pyspark.sql import functions as F

from hangstats.functions import histograms, stacks


def values(frame):
    return [row[0] for row in frame.collect()]


@pytest.mark.parametrize(
    "frame, expected",
    [
        ("chrome://a.js:12", "chrome://a.js"),
        ("a:1:2b", "a:1"),
        ("C:z", "C:z"),
        (":7", ""),
        ("x:9\n", "x:9\n"),
        ("a:1\nb:2", "a:1\nb:2"),
        ("", ""),
        ("a:1x y", "a"),
        (None, None),
    ],
)
def test_normalize_frame(spark, frame, expected):
    data = spark.createDataFrame([(frame,)], "f string")
    assert values(data.select(stacks.normalize_frame("f"))) == [expected]


def test_stack_functions(spark):
    data = spark.createDataFrame(
        [([],), (["a"],), (["a", None],), (["IPDL::PPluginX", "b:1"],), (None,)],
        "s array<string>",
    )
    assert values(data.select(stacks.last_frame("s"))) == [None, "a", None, "b:1", None]
    assert values(data.select(stacks.has_frame_prefix("s"))) == [False, False, False, True, False]
    assert values(data.select(stacks.frames_with_prefix("s")))[3] == ["IPDL::PPluginX"]
    assert values(data.select(stacks.normalize_frames("s")))[3] == ["IPDL::PPluginX", "b"]


def test_zip_arrays_stops_at_the_shortest(spark):
    data = spark.createDataFrame(
        [([1, 2, 3], ["a", "b"], [True, False, True, True]), ([], ["a"], [True])],
        "x array<int>, y array<string>, z array<boolean>",
    )
    zipped = values(data.select(stacks.zip_arrays(x="x", y="y", z="z")))
    assert [[tuple(e) for e in row] for row in zipped] == [[(1, "a", True), (2, "b", False)], []]
    assert [tuple(e) for e in values(data.select(stacks.zip_arrays(x="x")))[0]] == [(1,), (2,), (3,)]


def test_bins(spark):
    data = spark.createDataFrame([("8",), ("abc",), ("1.5",), ("99999999999",)], "label string")
    assert values(data.select(histograms.bin_edge("label"))) == [8, None, None, 99999999999]
    edges = data.select(histograms.bin_edge("label").alias("e"))
    assert values(edges.select(histograms.bin_midpoint("e"))) == [12.0, None, None, 149999999998.5]


def test_totals_in_the_row(spark):
    data = spark.createDataFrame(
        [([("1", 2), ("4", 3), ("abc", 1), ("8", -1)],), ([],)], histograms.HISTOGRAM.join(["bins ", ""])
    )
    found = data.select(
        histograms.hang_weight("bins"),
        histograms.count_total("bins"),
        F.to_json(histograms.hang_moments("bins")),
    )
    assert [tuple(row) for row in found.collect()] == [
        (6, 5.0, '{"n":5,"sum_t":21.0,"sum_t2":112.5}'),
        (0, 0.0, '{"n":0,"sum_t":0.0,"sum_t2":0.0}'),
    ]


def test_counts_beyond_the_integer_range_do_not_overflow(spark):
    big = 2**63 - 1
    data = spark.createDataFrame([([("1", big), ("2", big)],)], "bins " + histograms.HISTOGRAM)
    assert values(data.select(histograms.count_total("bins"))) == [2.0 * big]


def test_counts_and_labels_beyond_int_count(spark):
    data = spark.createDataFrame([([("1", 3_000_000_000), ("5000000000", 2)],)], "bins " + histograms.HISTOGRAM)
    assert values(data.select(histograms.hang_weight("bins"))) == [3_000_000_002]
    moments = data.select(histograms.hang_moments("bins").alias("m")).select("m.*").first()
    assert (moments.n, moments.sum_t) == (3_000_000_002, 1.5 * 3_000_000_000 + 2 * 7.5e9)
