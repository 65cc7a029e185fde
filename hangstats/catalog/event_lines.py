"""Report lines made from the ``events`` table.

Every event becomes one line, without grouping or shuffling. The attributes of
an event decide what its report holds, including the odd cases a parser has to
survive: damaged lines, missing parts, counts and labels of a wrong type.
``hang_sql`` states the same content as rows for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hangstats.constants import DIMENSIONS, PREFIX_LENGTH, REPORT_REASON, THREAD_NAME

APP = "ExampleBrowser"
#: Events of so many consecutive ids share a report file of their directory.
FILE_EVENTS = 100_000

# Event attributes and dimensions; valid in both engines.
_DIMENSION_SQL = f"""
    case when event_type = 'signup' then 'idle-daily' else '{REPORT_REASON}' end as reason,
    '{APP}' as appName,
    case when k < 50 then 'nightly' when k < 80 then 'release' else 'beta' end as appUpdateChannel,
    case when k >= 80 then '34.0' when k >= 50 then '35.0a2'
         when d < '20240111' then '35.0a1' else '36.0a1' end as appVersion,
    concat(substring(d, 1, 6), case when substring(d, 7, 2) < '16' then '01' else '16' end,
           '030203') as appBuildID,
    d as submission_date
"""

_BIN_SQL = """case when value < 2 then 1 when value < 4 then 2 when value < 8 then 4
    when value < 16 then 8 when value < 32 then 16 when value < 64 then 32 else 64 end"""

_LINE_STATE_SQL = """(case when k = 91 then 'cut' when k = 92 then 'short'
    when k in (93, 94) then 'no_threads' else 'good' end)"""

_NEEDLE = "flashVersion"
_LARGE = 2**64  # an integer beyond 64 bits
_TOO_LARGE = 10**39  # one of more digits than a DECIMAL has


def event_lines(spark: SparkSession, sf_dir: str, numbered: bool = False) -> DataFrame:
    """``value`` and the dimension columns, one row per event.

    ``numbered`` adds ``row``, the position in the table's file (unlike a number
    given to a row by a task, a repeated task gives the same one), and ``block``,
    the number of the report file within its directory.
    """
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = table.select("*", F.col("_metadata.row_index").alias("row"))
    base = events.selectExpr(
        "row",
        "event_id",
        "event_type",
        "value",
        "date_format(ts, 'yyyyMMdd') as d",
        "hour(ts) * 60 + minute(ts) as mn",
        "cast(get_json_object(props, '$.k') as int) as k",
    )
    # JSON text of hang number i: 0 to 2 belong to the first entry of the
    # thread (k % 4 of them), 3 to the additional entry of a purchase.
    script = """concat('"', event_type, (k + i) % 20, '.js:', cast(floor(value) as int), '"')"""
    stack = f"""case when (k + i) % 37 = 5 then '"stack":null,'
        when (k + i) % 47 = 11 then '"stack":5,'
        when (k + i) % 10 = 9 then '"stack":[],'
        when (k + i) % 4 = 0 then concat('"stack":["main","IPDL::PPlugin',
            case when (k + i) % 8 = 0 then 'Module' else 'Instance' end, '::Msg",', {script}, '],')
        when (k + i) % 7 = 3 then
            '"stack":["main","chrome://ui.js:10:5","IPDL::PPluginInstance::Call"],'
        else concat('"stack":["main",', {script}, '],') end"""
    bins = f"""concat(
        '"', {_BIN_SQL}, '":', case when (k + i) % 29 = 4 then 0 else 1 + k % 3 end,
        case when i > 0 then ',"128":2' else '' end,
        case when (k + i) % 7 = 0 then ',"1024":"bad"' else '' end,
        case when (k + i) % 17 = 0 then ',"2048":2.5' else '' end,
        case when (k + i) % 11 = 0 then ',"256":-1' else '' end,
        case when (k + i) % 13 = 0 then ',"abc":1' else '' end,
        case when (k + i) % 43 = 9 then concat(',"', {_BIN_SQL}, '":1') else '' end,
        case when (k + i) % 31 = 8 then ',"512":{_LARGE}' else '' end)"""
    hang = f"""concat('{{', {stack}, case when (k + i) % 41 = 6 then '"histogram":{{}}'
        else concat('"histogram":{{"values":{{', {bins}, '}}}}') end, '}}')"""
    hangs = f"""transform(array(0, 1, 2, 3), i -> case
        when i < k % 4 or (i = 3 and event_type = 'purchase') then {hang} end) as hangs"""
    threads = f"""concat(
        '[{{"name":"Compositor","hangs":[{{"stack":["x"],"histogram":{{"values":{{"1":100}}}}}}]}},',
        '{{"name":"{THREAD_NAME}","hangs":[', array_join(slice(hangs, 1, 3), ','), ']}}',
        case when event_type = 'purchase' then
            concat(',{{"name":"{THREAD_NAME}","hangs":[', hangs[3], ']}}') else '' end, ']')"""
    line = f"""concat(lpad(cast(event_id as string), {PREFIX_LENGTH - 1}, '0'), '\t',
        '{{"simpleMeasurements":{{"uptime":',
        case when k between 40 and 44 then '"n/a"' when k = 45 then '1.5'
             when k = 46 then '{_LARGE}' when k = 47 then '{_TOO_LARGE}' else cast(mn as string) end,
        '}}', case when k < 60 then ',"info":{{"{_NEEDLE}":"15.0"}}' else '' end,
        ',"threadHangStats":', case k when 93 then 'null' when 94 then '{{}}' else {threads} end,
        '}}') as line"""
    value_sql = f"""case {_LINE_STATE_SQL} when 'cut' then substring(line, 1, 60)
        when 'short' then 'short' else line end as text"""
    built = base.selectExpr("*", hangs).selectExpr("*", line).selectExpr("*", value_sql)
    # A generator, so that predicates on a line stay above its construction,
    # as they would above a file scan.
    kept = _split_columns(_DIMENSION_SQL) + (["row", f"event_id div {FILE_EVENTS} as block"] if numbered else [])
    return built.selectExpr("explode_outer(array(text)) as value", *kept)


def _split_columns(sql: str) -> list[str]:
    """The select list above, one expression per dimension."""
    found, rest = [], sql
    for name in DIMENSIONS:
        end = rest.index(f" as {name}") + len(f" as {name}")
        found.append(rest[:end].strip().lstrip(",").strip())
        rest = rest[end:]
    return found


def sample_sql(where: str, fraction: float) -> str:
    """CTEs that make ``ping`` of ``every_ping``: what the first files hold, by directory and name."""
    folders = ", ".join(f"concat('{name}=', {name})" for name in DIMENSIONS)
    path = f"concat_ws('/', {folders}, lpad(cast(event_id // {FILE_EVENTS} as varchar), 8, '0'))"
    return f"""
file as (
    select path, row_number() over (order by path) as r, count(*) over () as n
    from (select distinct {path} as path from every_ping where {where})),
ping as (
    from every_ping where {path} in (select path from file where r <= floor(n * {fraction}::double)))"""


def hang_sql(pings: str = "ping as (from every_ping)") -> str:
    """CTEs for DuckDB: base, thread, hang, bin - what the lines hold after parsing.

    ``pings``: CTEs that choose ``ping`` from ``every_ping``.
    """
    return f"""
base as (
    select event_id, event_type, value, strftime(ts, '%Y%m%d') as d,
           cast(hour(ts) * 60 + minute(ts) as bigint) as mn,
           cast(props::json->>'$.k' as int) as k
    from events),
every_ping as (
    select *, {_DIMENSION_SQL},
           lpad(cast(event_id as varchar), {PREFIX_LENGTH - 1}, '0') as ping_id,
           {_LINE_STATE_SQL} as state,
           {_LINE_STATE_SQL} in ('good', 'no_threads') as well_formed,
           cast(case when k between 40 and 45 or k = 47 then null when k = 46 then {_LARGE}::hugeint else mn end
                as decimal(38, 0)) as uptime,
           k < 60 and {_LINE_STATE_SQL} in ('good', 'no_threads') as has_needle
    from base),
{pings},
thread as (
    select *, 1 as thread_pos, 0 as first_hang, k % 4 as n_hangs from ping where state = 'good'
    union all
    select *, 2 as thread_pos, 3 as first_hang, 1 as n_hangs from ping
    where state = 'good' and event_type = 'purchase'),
numbered as (
    select *, cast(unnest(range(n_hangs)) as int) as hang_pos from thread),
varied as (
    select *, first_hang + hang_pos as i, k + first_hang + hang_pos as j,
           concat(event_type, (k + first_hang + hang_pos) % 20, '.js:',
                  cast(floor(value) as int)) as script
    from numbered),
any_hang as (
    select *,
        case when j % 37 = 5 or j % 47 = 11 then null
             when j % 10 = 9 then []::varchar[]
             when j % 4 = 0 then ['main', concat('IPDL::PPlugin',
                 case when j % 8 = 0 then 'Module' else 'Instance' end, '::Msg'), script]
             when j % 7 = 3 then ['main', 'chrome://ui.js:10:5', 'IPDL::PPluginInstance::Call']
             else ['main', script] end as stack,
        case when j % 41 = 6 then null else list_filter([
             {{'label': cast({_BIN_SQL} as varchar),
               'cnt': cast(case when j % 29 = 4 then 0 else 1 + k % 3 end as bigint)}},
             {{'label': '128', 'cnt': case when i > 0 then 2 end}},
             {{'label': '256', 'cnt': case when j % 11 = 0 then -1 end}},
             {{'label': 'abc', 'cnt': case when j % 13 = 0 then 1 end}},
             {{'label': cast({_BIN_SQL} as varchar), 'cnt': case when j % 43 = 9 then 1 end}}],
             lambda e: e.cnt is not null) end as bins,
        case when j % 31 = 8 then {_LARGE}::hugeint else 0 end as large
    from varied),
hang as (
    select *, list_transform(stack, lambda f: regexp_replace(f, '^(.*):[0-9].*$', '\\1')) as plain,
        stack[len(stack)] as last_frame,
        len(list_filter(stack, lambda f: starts_with(f, 'IPDL::PPlugin'))) > 0 as is_plugin
    from any_hang where stack is not null and bins is not null),
entry as (
    select *, unnest(bins) as e from hang),
bin as (
    select *, e.label as label, try_cast(e.label as int) as bin, e.cnt as weight,
        1.5::double * try_cast(e.label as int) as mid
    from entry where e.cnt > 0)
"""
