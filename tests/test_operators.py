"""Operators against brute force in Python."""

import datetime
import random
import re
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import final_plan

from hangstats.operators import ranking, reports, setops, stats


def rows(frame):
    return [tuple(row) for row in frame.collect()]


def make_values(kind, rng, n):
    if kind == "int":
        return [rng.choice([rng.randrange(-5, 5), rng.randrange(-(2**31), 2**31)]) for _ in range(n)]
    if kind == "string":
        return ["".join(rng.choices("ab\u00e9\U0001f600 ", k=rng.randrange(4))) for _ in range(n)]
    if kind == "decimal(38,9)":
        return [Decimal(rng.randrange(-(10**37), 10**37) if rng.random() < 0.5 else rng.randrange(9)).scaleb(-9) for _ in range(n)]
    if kind == "date":
        return [datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(900)) for _ in range(n)]
    if kind == "bigint":
        return [rng.choice([rng.randrange(9), rng.randrange(-(2**63), 2**63)]) for _ in range(n)]
    return [
        rng.choice([0.0, rng.uniform(-1, 1), rng.gauss(0, 1e6), rng.expovariate(1e-3), 1e300, -7.5])
        for _ in range(n)
    ]


KINDS = ["int", "bigint", "double", "string", "decimal(38,9)", "date"]


@pytest.mark.parametrize("kind", KINDS)
def test_upper_median(spark, kind):
    rng = random.Random(7)
    data = []
    # Group sizes 1 to 40, and one group with a third of all rows.
    for group in range(40):
        data += [(group, v) for v in make_values(kind, rng, group + 1)]
    data += [(99, v) for v in make_values(kind, rng, 400)]
    data += [(None, v) for v in make_values(kind, rng, 6)] + [(0, None)]
    frame = spark.createDataFrame(data, f"g int, v {kind}")
    expected = {}
    for group in {g for g, _ in data}:
        # (texts sort by bytes, which is the order of code points)
        members = sorted(v for g, v in data if g == group and v is not None)
        expected[group] = (members[len(members) // 2], len(members))
    found = {r.g: (r["median"], r.n) for r in stats.upper_median(frame, ["g"], "v").collect()}
    assert found == expected


def test_median_of_odd_doubles(spark):
    values = [float("-inf"), -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1e308, float("inf"), float("nan")]
    for n in range(1, len(values) + 1):
        frame = spark.createDataFrame([(v,) for v in reversed(values[:n])], "v double")
        (row,) = rows(stats.upper_median(frame, [], "v"))
        assert repr(row) == repr((values[n // 2], n))


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_rank_does_not_depend_on_the_ranges(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(60), rng.randrange(-1, 4)) for _ in range(500)]
    frame = spark.createDataFrame(data, "g string, v int, w bigint")
    for shift in (0, 1, 7, 100_000):
        found = stats.value_at_rank(
            frame.where("w > 0"), ["g"], [F.col("v") % 10, F.col("v")], lambda n: n - 1 - shift, F.col("w"), ranges
        )
        expected = set()
        for group in ("a", "b", None):
            members = sorted((v % 10, v) for g, v, w in data for _ in range(w) if g == group)
            if shift < len(members):
                expected.add((group, *members[len(members) - 1 - shift], len(members)))
        assert set(rows(found)) == expected


def test_a_large_group_is_in_no_single_window(spark):
    """200,000 values of one group: no window task sees more than a few ranges of them."""
    frame = spark.range(200_000).selectExpr("'one' as g", "(id * 7919) % 200000 as v")
    found = stats.upper_median(frame, ["g"], "v", ranges=64)
    plan = final_plan(found)
    assert rows(found) == [("one", 100_000, 200_000)]
    assert plan.count("Range (0, 200000") == 1
    kept = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in kept
    # The rows that reach the join's output are those of the one range that holds the rank.
    sums = frame.groupBy("g", "v").count().repartitionByRange(64, "g", "v")
    largest = sums.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 10_000


def test_median_reads_its_input_once(spark, sf_dir):
    rows_ = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = final_plan(stats.upper_median(rows_, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_linenumber"))
    assert plan.count("FileScan") == 1
    assert "ReusedExchange" in plan


def test_prefix_reads_the_key_column_and_the_rows(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = final_plan(stats.prefix_fraction(frame, "l_orderkey", 0.1).select("l_orderkey", "l_linenumber"))
    schemas = Counter(re.findall(r"ReadSchema: (\S+)", plan))
    assert schemas == {"struct<l_orderkey:bigint>": 1, "struct<l_orderkey:bigint,l_linenumber:bigint>": 1} or (
        sum(schemas.values()) == 2 and "struct<l_orderkey:bigint>" in schemas
    )


def test_subtraction_counts_a_hot_row(spark):
    left = spark.createDataFrame([("a", None)] * 500 + [("b", 1)] * 3 + [("c", 2)], "x string, y int")
    right = spark.createDataFrame([("b", 1), ("b", 1), ("d", 1)], "x string, y int")
    found = setops.subtract_keep_dups(left, right)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("a", None)] * 500 + [("c", 2)], key=str)
    assert "Join" not in final_plan(found)


def test_upper_median_of_hot_values(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), 42.5) for _ in range(300)] + [
        (rng.choice("ab"), rng.uniform(40, 45)) for _ in range(600)
    ]
    frame = spark.createDataFrame(data, "g string, v double")
    for group, median, n in rows(stats.upper_median(frame, ["g"], "v")):
        members = sorted(v for g, v in data if g == group)
        assert (median, n) == (members[len(members) // 2], len(members))


def test_weighted_equals_replicated(spark):
    rng = random.Random(5)
    data = [
        (rng.randrange(4), rng.choice([1, 2, 4, 8, 16, 2**20]), rng.randrange(-2, 7))
        for _ in range(200)
    ]
    frame = spark.createDataFrame(data, "g int, v int, weight bigint")
    weighted = sorted(rows(stats.upper_median(frame, ["g"], "v", "weight")))
    copies = reports.replicate(frame, "weight")
    assert sorted(rows(stats.upper_median(copies, ["g"], "v"))) == weighted
    assert copies.count() == sum(max(w, 0) for _, _, w in data)


@pytest.mark.parametrize("fraction", [0.0, 0.004, 0.1, 0.5, 0.999, 1.0, 1.7])
def test_prefix_fraction(spark, fraction):
    rng = random.Random(2)
    data = [(rng.randrange(-500, 500), i) for i in range(900)] + [(None, -1)]
    frame = spark.createDataFrame(data, "k bigint, i int")
    keys = sorted({k for k, _ in data if k is not None})
    kept = set(keys[: int(len(keys) * fraction)])
    assert sorted(rows(stats.prefix_fraction(frame, "k", fraction))) == sorted(
        row for row in data if row[0] in kept
    )


def test_prefix_fraction_of_text(spark):
    frame = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)] * 2, "k string")
    kept = stats.prefix_fraction(frame, "k", 0.25)
    assert Counter(r.k for r in kept.collect()) == {f"k{i:03d}": 2 for i in range(12)}


@pytest.mark.parametrize("weight", [0, 1, 5, 65536, 65537, 200001, -3, None])
def test_replicate(spark, weight):
    frame = spark.createDataFrame([("a", weight)], "k string, w bigint")
    assert reports.replicate(frame, "w").count() == max(weight or 0, 0)


def test_subtract_keeps_duplicates(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (2,), (3,), (None,), (None,)], "a int")
    right = spark.createDataFrame([(2,), (2,), (None,)], "b int")
    assert sorted(rows(setops.subtract_keep_dups(left, right))) == [(1,), (1,), (3,)]
    none = right.where("b > 5")
    assert setops.subtract_keep_dups(left, none).count() == 7
    with pytest.raises(ValueError):
        setops.subtract_keep_dups(left, right.withColumn("c", F.lit(1)))


def test_subtract_on_a_shared_ancestor(spark):
    frame = spark.createDataFrame([(1, ["x"]), (1, ["x"]), (2, ["y"])], "a int, s array<string>")
    assert rows(setops.subtract_keep_dups(frame, frame.where("a = 1"))) == [(2, ["y"])]


def test_ranks_and_shares(spark):
    data = [("a", 5), ("b", 9), ("c", 5), ("d", 1), ("e", 2)]
    frame = spark.createDataFrame(data, "k string, n bigint")
    assert rows(ranking.rank_range(frame, 1, 3, "k").orderBy("rank")) == [(2, "a", 5), (3, "c", 5)]
    assert rows(ranking.top_k(frame, 2, "k")) == [("b", 9), ("a", 5)]
    shares = frame.select("k", ranking.percent("n", ranking.total(frame)).alias("p"))
    assert dict(rows(shares))["b"] == 100.0 * 9 / 22
    zero = frame.select(ranking.percent("n", F.lit(0)).alias("p")).first()
    assert zero.p is None


def test_top_k_per_group(spark):
    data = [("a", "x", 3), ("a", "y", 3), ("a", "z", 9), ("b", "x", 1)]
    frame = spark.createDataFrame(data, "g string, s string, n bigint")
    found = rows(ranking.top_k_per_group(frame, "g", 2, "s"))
    assert sorted(found) == [("a", "x", 3, 2), ("a", "z", 9, 1), ("b", "x", 1, 1)]
