"""One registered query per operator, all over whole tables.

Each function gets (spark, sf_dir). The SQL in its decorator is what DuckDB
computes from the tables for the same question; ``{hangs}`` stands for the
common table expressions of :func:`event_lines.hang_sql`, ``{sample}`` for those
of the first tenth of the selected files.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hangstats.catalog.event_lines import APP, event_lines, hang_sql, sample_sql
from hangstats.catalog.layouts import layout
from hangstats.constants import DIMENSIONS
from hangstats.functions import stacks, variants
from hangstats.functions.histograms import hang_moments
from hangstats.operators.quarantine import quarantine
from hangstats.operators.ranking import rank_range
from hangstats.operators.reports import (
    hang_rows,
    histogram_rows,
    parse_pings,
    ping_counts,
    raw_contains,
    read_reports,
    replicate,
)
from hangstats.operators.setops import subtract_keep_dups
from hangstats.operators.stats import prefix_fraction, upper_median
from hangstats.plans import clusters, combined, plugins, sessions
from hangstats.session import scratch_dir
from hangstats.sinks import write_csv
from hangstats.sources.files import read_lines
from hangstats.sources.selection import PingFilter

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_TEMPLATES: dict[str, str] = {}

_FRACTION = 0.1
_NIGHTLY = f"reason = 'saved-session' and appName = '{APP}' and appUpdateChannel = 'nightly'"

_STACKS = """
weighed as (
    select *, cast(coalesce(list_sum(list_transform(
        list_filter(bins, lambda e: e.cnt > 0), lambda e: e.cnt)), 0) as bigint) as w
    from hang),
stacks as (
    select plain[len(plain)] as frame, plain as stack, cast(sum(w) as bigint) as n
    from weighed where len(plain) > 0 and w > 0 group by all),
frames as (
    select frame, cast(sum(n) as bigint) as n from stacks group by frame),
shares as (
    select cast(row_number() over (order by n desc, frame) as int) as rank, frame, n,
           n::double / sum(n) over () as share
    from frames),
ranked_stacks as (
    select frame, stack, s.n, s.n::double / f.n as frequency,
        cast(row_number() over (partition by frame order by s.n desc, stack) as int) as stack_rank
    from stacks s join frames f using (frame))
"""

_PLUGIN = """
durations as (
    select stack, is_plugin, mid, weight from bin where mid is not null),
plugin_stacks as (
    select stack, cast(sum(weight) as bigint) as n from durations where is_plugin group by stack),
plugin_tops as (
    select stack[len(stack)] as frame, cast(sum(n) as bigint) as n from plugin_stacks group by all)
"""


def _without_shared(sql: str) -> str:
    """A query's SQL without the common tables, for use below a query that has them."""
    for shared in (_STACKS, _PLUGIN):
        sql = sql.replace(f", {shared}", "")
    sql = sql.replace("{hangs},", "{hangs}").strip()
    rest = sql.removeprefix("with {hangs}").strip()
    return rest if rest.startswith("select") else f"with {rest}"


def register(sql: str) -> Callable[[Query], Query]:
    """Register a function ``<name>_query`` as query ``<name>``."""

    def add(query: Query) -> Query:
        name = query.__name__.removesuffix("_query")
        QUERIES[name] = query
        _TEMPLATES[name] = sql
        sample = hang_sql(sample_sql(_NIGHTLY, _FRACTION))
        whole = sql
        for other, text in _TEMPLATES.items():
            whole = whole.replace(f"{{{other}}}", _without_shared(text))
        ORACLES[name] = whole.replace("{hangs}", hang_sql()).replace("{sample}", sample).strip()
        return query

    return add


#: Where report queries take their lines from; the benchmark puts report files here.
report_lines = event_lines


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_reports(report_lines(spark, sf_dir)).drop(*DIMENSIONS)


def _hangs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hang_rows(_reports(spark, sf_dir))


def _uptime_text(frame: DataFrame) -> DataFrame:
    """Uptimes of any size as text, which reads alike in both engines."""
    return frame.withColumn("uptime", F.col("uptime").cast("string"))


def _dimension_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("appVersion", "appBuildID", "submission_date").agg(
        F.count(F.lit(1)).alias("n")
    )


# --- sources ---------------------------------------------------------------


@register(f"""
with {{hangs}}
select appVersion, appBuildID, submission_date, count(*) as n from ping
where reason = 'saved-session' and appName = '{APP}' and appUpdateChannel = 'nightly'
  and appVersion = '36.0a1' and submission_date = '20240115'
group by all
""")
def ping_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = PingFilter(APP, "nightly", "36.0a1", "*", "20240115")
    return _dimension_counts(chosen.apply(event_lines(spark, sf_dir)))


@register(f"""
with {{hangs}}
select appVersion, appBuildID, submission_date, count(*) as n from ping
where reason = 'saved-session' and appName = '{APP}' and appUpdateChannel = 'nightly'
  and appVersion between '35.0' and '36.0a0'
  and appBuildID between '20240101000000' and '20240115999999'
  and submission_date between '20240105' and '20240112'
group by all
""")
def ping_filter_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = PingFilter(
        APP,
        "nightly",
        ("35.0", "36.0a0"),
        ("20240101000000", "20240115999999"),
        ("20240105", "20240112"),
    )
    return _dimension_counts(chosen.apply(event_lines(spark, sf_dir)))


@register(f"""
with {{hangs}}
select appVersion, appBuildID, submission_date, count(*) as n from ping
where reason = 'saved-session' and appName = '{APP}' and appUpdateChannel = 'release'
  and submission_date <= '20240120'
group by all
""")
def ping_filter_wildcard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = PingFilter(APP, "release", "*", ("*", "*"), ("*", "20240120"))
    return _dimension_counts(chosen.apply(event_lines(spark, sf_dir)))


@register(f"""
with {{hangs}}
select 'no such app' as selection, count(*) as n from ping where appName = 'NoSuchBrowser'
union all
select 'no such version', count(*) from ping where {_NIGHTLY} and appVersion = '99.0'
union all
select 'nightly', count(*) from ping where {_NIGHTLY}
union all
select 'until the tenth', count(*) from ping where {_NIGHTLY} and submission_date <= '20240110'
""")
def empty_selection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections without a match next to others of the same files."""
    root = layout(spark, sf_dir, "text")
    chosen = {
        "no such app": PingFilter("NoSuchBrowser", "nightly"),
        "no such version": PingFilter(APP, "nightly", "99.0"),
        "nightly": PingFilter(APP, "nightly"),
        "until the tenth": PingFilter(APP, "nightly", submission=("*", "20240110")),
    }
    counts = [
        read_lines(spark, root, one, compressed=False).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("selection"), "n"
        )
        for name, one in chosen.items()
    ]
    return functools.reduce(DataFrame.unionByName, counts)


@register(f"""
with {{hangs}}
select appVersion, appBuildID, submission_date, count(*) as n from ping
where reason = 'saved-session' and appName = '{APP}' and appUpdateChannel = 'nightly'
  and appVersion = '36.0a1' and submission_date between '20240112' and '20240118'
group by all
""")
def source_pruning_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = PingFilter(APP, "nightly", "36.0a1", "*", ("20240112", "20240118"))
    lines = read_lines(spark, layout(spark, sf_dir, "text"), chosen, compressed=False)
    return _dimension_counts(lines)


@register("""
with {hangs}
select case when state = 'short' then 'short' else ping_id end as ping_id, well_formed,
       reason, appUpdateChannel, appVersion, appBuildID, submission_date
from ping
""")
def lzma_text_scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_lines(spark, layout(spark, sf_dir, "lzma"))
    return parse_pings(lines).select(
        "ping_id",
        F.col("ping").isNotNull().alias("well_formed"),
        *[name for name in DIMENSIONS if name != "appName"],
    )


@register("""
with unit as (select distinct l_orderkey as key from lineitem),
kept as (
    select key, row_number() over (order by key) as r, count(*) over () as n from unit)
select l_orderkey, l_linenumber, l_extendedprice from lineitem
where l_orderkey in (select key from kept where r <= floor(n * 0.1::double))
""")
def prefix_fraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return prefix_fraction(rows, "l_orderkey", 0.1).select(
        "l_orderkey", "l_linenumber", "l_extendedprice"
    )


@register("""
with {hangs}
select submission_date, count(*) as n from ping where has_needle group by all
""")
def raw_contains_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw_contains(event_lines(spark, sf_dir), "flashVersion")
    return lines.groupBy("submission_date").agg(F.count(F.lit(1)).alias("n"))


# --- parsing ---------------------------------------------------------------


@register("""
with {hangs}
select case when state = 'short' then 'short' else ping_id end as ping_id, well_formed,
       case when well_formed then cast(uptime as varchar) end as uptime,
       case when state = 'good' then 2 + cast(event_type = 'purchase' as int) end as n_threads
from ping
""")
def ping_parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pings = parse_pings(event_lines(spark, sf_dir))
    return pings.select(
        "ping_id",
        F.col("ping").isNotNull().alias("well_formed"),
        variants.any_integer(F.try_variant_get("ping", "$.simpleMeasurements.uptime", "variant")).cast("string").alias("uptime"),
        F.array_size(variants.items("ping", "$.threadHangStats")).alias("n_threads"),
    )


@register("""
with {hangs}
select count(*) filter (where well_formed) as pings_analyzed,
       count(*) filter (where not well_formed) as malformed
from ping
""")
def malformed_pings_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ping_counts(_reports(spark, sf_dir))


@register("""
with {hangs}
select count(*) as pings_analyzed from ping where well_formed
""")
def pings_analyzed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ping_counts(_reports(spark, sf_dir)).select("pings_analyzed")


@register("""
with {hangs}
select ping_id, cast(uptime as varchar) as uptime, thread_pos, hang_pos, array_to_string(stack, ' > ') as stack,
       cast(len(bins) as int) as n_bins
from hang
""")
def hang_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hangs(spark, sf_dir).select(
        "ping_id",
        F.col("uptime").cast("string").alias("uptime"),
        "thread_pos",
        "hang_pos",
        stacks.stack_text("stack").alias("stack"),
        F.size("bins").alias("n_bins"),
    )


@register("""
with {hangs}
select ping_id, thread_pos, hang_pos, label, bin, mid, weight from bin
""")
def histogram_explode_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_rows(_hangs(spark, sf_dir)).select(
        "ping_id", "thread_pos", "hang_pos", "label", "bin", "mid", "weight"
    )


@register("""
with {hangs}
select ping_id, thread_pos, hang_pos, label from (
    select ping_id, thread_pos, hang_pos, label, unnest(range(weight)) as copy from bin)
""")
def weighted_replicate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histogram_rows(_hangs(spark, sf_dir)).select(
        "ping_id", "thread_pos", "hang_pos", "label", "weight"
    )
    return replicate(rows, "weight").drop("weight")


@register("""
with {hangs},
pair as (
    select ping_id, thread_pos, hang_pos, unnest(list_zip(stack,
        list_sort(list_transform(bins, lambda e: e.label)), true)) as p
    from hang)
select ping_id, thread_pos, hang_pos, p[1] as frame, p[2] as label from pair
""")
def zip_arrays_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_sort(F.col("bins.label"))
    pairs = _hangs(spark, sf_dir).select(
        "ping_id",
        "thread_pos",
        "hang_pos",
        F.explode_outer(stacks.zip_arrays(frame="stack", label=labels)).alias("pair"),
    )
    return pairs.where(F.col("pair").isNotNull()).select(
        "ping_id", "thread_pos", "hang_pos", "pair.frame", "pair.label"
    )


# --- stacks and histograms -------------------------------------------------


@register("""
with {hangs},
f as (select unnest(stack) as frame from hang)
select frame, regexp_replace(frame, '^(.*):[0-9].*$', '\\1') as plain, count(*) as n
from f group by all
""")
def normalize_frames_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _hangs(spark, sf_dir).select(F.explode("stack").alias("frame"))
    return (
        frames.groupBy("frame")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("frame", stacks.normalize_frame("frame").alias("plain"), "n")
    )


@register("""
with {hangs}
select last_frame, count(*) as n from hang group by all
""")
def last_frame_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _hangs(spark, sf_dir)
        .groupBy(stacks.last_frame("stack").alias("last_frame"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register("""
with {hangs}
select label, bin, mid, count(*) as n from bin group by all
""")
def bin_midpoint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = histogram_rows(_hangs(spark, sf_dir))
    return rows.groupBy("label", "bin", "mid").agg(F.count(F.lit(1)).alias("n"))


@register("""
with {hangs}
select is_plugin, count(*) as n from hang group by all
""")
def plugin_flag_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _hangs(spark, sf_dir)
        .groupBy(stacks.has_frame_prefix("stack").alias("is_plugin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(f"""
with {{hangs}}, {_STACKS}
select array_to_string(stack, ' > ') as stack, n from stacks
""")
def nonempty_stacks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = clusters.stack_counts(_reports(spark, sf_dir))
    return counts.select(stacks.stack_text("stack").alias("stack"), "n")


@register("""
with {hangs},
sums as (
    select ping_id, thread_pos, hang_pos, cast(sum(weight) as bigint) as n,
           sum(weight * mid) as sum_t, sum(weight * mid * mid) as sum_t2
    from bin where mid is not null group by all)
select ping_id, thread_pos, hang_pos, coalesce(n, 0) as n, coalesce(sum_t, 0) as sum_t,
       coalesce(sum_t2, 0) as sum_t2
from hang left join sums using (ping_id, thread_pos, hang_pos)
""")
def hang_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hangs(spark, sf_dir).select(
        "ping_id", "thread_pos", "hang_pos", hang_moments("bins").alias("m")
    )
    return rows.select("ping_id", "thread_pos", "hang_pos", "m.n", "m.sum_t", "m.sum_t2")


@register("""
with {hangs}
select count(*) as hangs, cast(sum(cast(total <= 0 as int)) as bigint) as invalid from (
    select coalesce(list_sum(list_transform(bins, lambda e: e.cnt)), 0) + large as total
    from any_hang where bins is not null and uptime is not null)
""")
def assert_positive_hangs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.invalid_hangs(_reports(spark, sf_dir))


# --- sets and statistics ---------------------------------------------------


@register("""
with {hangs}
select last_frame, hang_pos from hang h
where not exists (
    select 1 from hang p where p.is_plugin
      and p.last_frame is not distinct from h.last_frame and p.hang_pos = h.hang_pos)
""")
def subtract_keep_dups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hangs = _hangs(spark, sf_dir)
    keys = stacks.last_frame("stack").alias("last_frame"), F.col("hang_pos")
    plugin = hangs.where(stacks.has_frame_prefix("stack"))
    return subtract_keep_dups(hangs.select(*keys), plugin.select(*keys))


@register("""
with prices as (
    select l_returnflag, l_linestatus, l_extendedprice as price, sum(l_linenumber) as w
    from lineitem group by all),
running as (
    select *, sum(w) over (partition by l_returnflag, l_linestatus order by price) as upto,
           sum(w) over (partition by l_returnflag, l_linestatus) as n
    from prices)
select l_returnflag, l_linestatus, min(price) as median, cast(n as bigint) as n
from running where upto > n // 2 group by l_returnflag, l_linestatus, n
""")
def median_upper_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return upper_median(rows, ["l_returnflag", "l_linestatus"], "l_extendedprice", "l_linenumber")


@register(f"""
with {{hangs}}, {_STACKS}
select rank, frame, n from shares where rank between 2 and 15
""")
def rank_range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = clusters.frame_counts(clusters.stack_counts(_reports(spark, sf_dir)))
    return rank_range(frames, 1, 15, "frame")


@register(f"""
with {{hangs}}, {_STACKS}
select frame, n, share from shares where rank <= 15
""")
def top_frames_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.top_frames(_reports(spark, sf_dir))


@register(f"""
with {{hangs}}, {_STACKS}
select frame, stack_rank, array_to_string(stack, ' > ') as stack, n, frequency
from ranked_stacks where stack_rank <= 3
""")
def top_stacks_per_frame_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.top_stacks_per_frame(_reports(spark, sf_dir))


# --- analyses --------------------------------------------------------------


@register(f"""
with {{hangs}}, {_STACKS}
select rank, frame, f.n, share, stack_rank, array_to_string(stack, ' > ') as stack, frequency
from shares f join ranked_stacks s using (frame)
where rank between 2 and 15 and stack_rank <= 3
""")
def hang_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.hang_clusters(_reports(spark, sf_dir))


@register(f"""
with {{hangs}}, {_PLUGIN},
m as (
    select sum(weight) filter (where is_plugin) as pn,
           sum(weight * mid) filter (where is_plugin) as pt,
           sum(weight * mid * mid) filter (where is_plugin) as pq,
           sum(weight) filter (where not is_plugin) as n,
           sum(weight * mid) filter (where not is_plugin) as t,
           sum(weight * mid * mid) filter (where not is_plugin) as q
    from durations)
select (select count(*) from ping where well_formed) as pings_analyzed,
       cast(pn + n as bigint) as n_total, cast(pn as bigint) as n_plugin,
       cast(n as bigint) as n_other, pn::double / (pn + n) as plugin_ratio,
       pt / pn as mean_plugin,
       sqrt(greatest(pq / pn - (pt / pn) * (pt / pn), 0)) / sqrt(pn::double) as se_plugin,
       t / n as mean_other,
       sqrt(greatest(q / n - (t / n) * (t / n), 0)) / sqrt(n::double) as se_other,
       (pt + t) / n as mean_other_as_published
from m
""")
def plugin_hang_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.plugin_hang_stats(_reports(spark, sf_dir))


@register("""
with {hangs}
select distinct frame from (select unnest(stack) as frame from hang)
where starts_with(frame, 'IPDL::PPlugin')
""")
def plugin_frames_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.plugin_frames(_reports(spark, sf_dir))


@register(f"""
with {{hangs}}, {_PLUGIN},
running as (
    select is_plugin, mid, sum(sum(weight)) over (partition by is_plugin order by mid) as upto,
           sum(sum(weight)) over (partition by is_plugin) as n
    from durations group by is_plugin, mid),
medians as (
    select is_plugin, min(mid) as median, cast(n as bigint) as n
    from running where upto > n // 2 group by is_plugin, n)
select (select count(*) from ping where well_formed) as pings_analyzed,
       p.n as n_plugin, o.n as n_other, p.n::double / (p.n + o.n) as plugin_ratio,
       p.median as median_plugin, o.median as median_other
from (from medians where is_plugin) p, (from medians where not is_plugin) o
""")
def plugin_hang_median_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.plugin_hang_median(_reports(spark, sf_dir))


@register(f"""
with {{hangs}}, {_PLUGIN}
select array_to_string(stack, ' > ') as stack, percent from (
    select stack, 100.0::double * n / sum(n) over () as percent,
           row_number() over (order by n desc, stack) as r
    from plugin_stacks)
where r <= 10
""")
def top_plugin_stacks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.top_plugin_stacks(_reports(spark, sf_dir))


@register(f"""
with {{hangs}}, {_PLUGIN}
select frame, percent from (
    select frame, 100.0::double * n / sum(n) over () as percent,
           row_number() over (order by n desc, frame) as r
    from plugin_tops)
where r <= 10
""")
def top_plugin_frames_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.top_plugin_frames(_reports(spark, sf_dir))


@register("""
with {hangs},
counted as (
    select event_id, thread_pos,
           coalesce(list_sum(list_transform(bins, lambda e: e.cnt)), 0) + large as total
    from any_hang where bins is not null),
summed as (
    select event_id, thread_pos, sum(total) filter (where total > 0) as hangs
    from counted group by all)
select cast(coalesce(hangs, 0) as double) as hangs, cast(uptime as varchar) as uptime
from thread left join summed using (event_id, thread_pos)
where uptime is not null
""")
def session_hangs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uptime_text(sessions.session_hangs(_reports(spark, sf_dir)))



@register("""
with {hangs},
counted as (
    select event_id, thread_pos,
           coalesce(list_sum(list_transform(bins, lambda e: e.cnt)), 0) + large as total
    from any_hang where bins is not null),
summed as (
    select event_id, thread_pos, sum(total) filter (where total > 0) as hangs,
           count(*) filter (where total <= 0) as invalid
    from counted group by all)
select cast(coalesce(hangs, 0) as double) as hangs, cast(uptime as varchar) as uptime, coalesce(invalid, 0) as invalid
from thread left join summed using (event_id, thread_pos)
where uptime is not null
""")
def session_hangs_checked_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uptime_text(sessions.session_hangs_checked(_reports(spark, sf_dir)))


@register(_TEMPLATES["session_hangs"])
def sessions_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session report as CSV files with a header, read back."""
    folder = scratch_dir(spark, "sessions")
    write_csv(sessions.session_hangs(_reports(spark, sf_dir)), folder)
    return spark.read.option("header", True).csv(folder).select(F.col("hangs").cast("double").alias("hangs"), "uptime")


@register(f"""
with {{hangs}}, {_STACKS}
select rank, frame, any_value(f.n) as n, any_value(share) as share,
       string_agg(array_to_string(stack, ' > '), ' | ' order by stack_rank) as stacks,
       max(frequency) as first_frequency
from shares f join ranked_stacks s using (frame)
where rank between 2 and 15 and stack_rank <= 3
group by rank, frame
""")
def hang_clusters_nested_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested report, its array of stacks as text."""
    return clusters.hang_clusters_nested(_reports(spark, sf_dir)).select(
        "rank",
        "frame",
        "n",
        "share",
        F.array_join(F.transform("stacks", lambda s: s["stack"]), " | ").alias("stacks"),
        F.col("stacks")[0]["frequency"].alias("first_frequency"),
    )


@register("""
with {hangs},
t as (
    select *, coalesce(list_sum(list_transform(bins, lambda e: e.cnt)), 0) + large as total from any_hang),
unread as (
    select *, unnest(list_filter(bins, lambda e: e.cnt > 0 and try_cast(e.label as bigint) is null)) as e from t)
select case when state = 'short' then 'short' else ping_id end as ping_id, 'malformed line' as cause,
       null::int as thread_pos, null::int as hang_pos, null::varchar as label from ping where not well_formed
union all select ping_id, 'no thread list', null, null, null from ping where state = 'no_threads'
union all select ping_id, 'uptime is no integer', null, null, null from ping where state = 'good' and uptime is null
union all select ping_id, 'hang without a stack', thread_pos, hang_pos, null from t where stack is null
union all select ping_id, 'hang without a histogram', thread_pos, hang_pos, null from t where bins is null
union all select ping_id, 'hang without a positive count', thread_pos, hang_pos, null from t
    where bins is not null and total <= 0
union all select ping_id, 'count beyond 64 bits', thread_pos, hang_pos, '512' from t where bins is not null and large > 0
union all select ping_id, 'label that is no number', thread_pos, hang_pos, e.label from unread
""")
def quarantine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine(_reports(spark, sf_dir))


@register(f"""
with {{hangs}}, {_STACKS}, {_PLUGIN},
a1 as ({{hang_clusters}}), a2 as ({{plugin_hang_stats}}), a3 as ({{plugin_hang_median}}),
a4 as ({{session_hangs}}), f as ({{plugin_frames}}), s as ({{top_plugin_stacks}}), t as ({{top_plugin_frames}})
select 'hang_clusters' as report, rank, stack_rank, concat(frame, ' | ', stack) as text, 'frequency' as metric,
       frequency as value, n from a1
union all select 'plugin_hang_stats', null, null, null, metric, value, null
    from (unpivot (select columns(*)::double from a2) on columns(*) into name metric value value)
union all select 'plugin_frames', null, null, frame, null, null, null from f
union all select 'plugin_hang_median', null, null, null, metric, value, null
    from (unpivot (select columns(*)::double from a3) on columns(*) into name metric value value)
union all select 'top_plugin_stacks', null, null, stack, 'percent', percent, null from s
union all select 'top_plugin_frames', null, null, frame, 'percent', percent, null from t
union all select 'session_hangs', null, null, uptime, 'hangs', hangs, count(*) from a4 group by hangs, uptime
""")
def all_reports_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four analyses from one parse."""
    return combined.all_reports(_reports(spark, sf_dir))


# --- from files to report: selection, fraction of the files, LZMA, analysis -----


def _nightly_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = PingFilter(APP, "nightly")
    return read_lines(spark, layout(spark, sf_dir, "lzma"), chosen, fraction=_FRACTION)


def _nightly_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_reports(_nightly_lines(spark, sf_dir)).drop(*DIMENSIONS)


def _sampled(name: str) -> str:
    return _TEMPLATES[name].replace("{hangs}", "{sample}")


@register("""
with {sample}
select appVersion, appBuildID, submission_date, count(*) as n from ping group by all
""")
def file_fraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dimension_counts(_nightly_lines(spark, sf_dir))


@register(_sampled("hang_clusters"))
def nightly_hang_clusters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.hang_clusters(_nightly_reports(spark, sf_dir))


@register(_sampled("plugin_hang_stats"))
def nightly_plugin_hang_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.plugin_hang_stats(_nightly_reports(spark, sf_dir))


@register(_sampled("plugin_hang_median"))
def nightly_plugin_hang_median_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.plugin_hang_median(_nightly_reports(spark, sf_dir))


@register(_sampled("session_hangs"))
def nightly_session_hangs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uptime_text(sessions.session_hangs(_nightly_reports(spark, sf_dir)))
