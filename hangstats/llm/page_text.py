"""Main text of web pages by template deduction over the pages of a host.

* A page is a sequence of tokens: tags and runs of text, each told apart by the
  path of elements it stands below. How often a token occurs on each page of the
  host is its occurrence vector; Spark adds up a digest of it.
* Tokens with the same vector form an equivalence class. Classes that occur on
  at least half of the pages, whose tokens keep one order and which nest in the
  class that occurs once a page (the skeleton) make up the template.
* What is left between template tokens are slots. Those in menus, forms, adverts,
  comments and the like are no main text; those of an article or main element
  are. The slots of a host without the latter are judged together: main are those
  in the innermost container that holds over half of the text outside of links.
* A page gives its blocks in main slots, less those that are template as a whole.
  Inside an article nothing counts as template, so that copies of one article on
  a host do not erase it.
"""

from __future__ import annotations

import html
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hangstats.llm.common import stage_table, steps

#: Templates are broadcast up to so many bytes (measured); more are joined by a shuffle, hot hosts split by Spark.
BROADCAST_BYTES = 16 << 20
#: Pages a host needs for runs of text, which may be copied, to count as template; for tags two are enough.
MIN_PAGES_FOR_TEXT = 8
#: Tokens that a task adds up in memory before it hands them on.
_HELD = 100_000

# Element names and name parts of the HTML vocabulary.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = "script style title textarea xmp iframe noembed noframes".split()
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr br nobr".split()
)
_CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}
_SAME |= {"th": {"td", "th"}, "option": {"option"}, "thead": set(), "tbody": {"thead", "tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
_BOILER = set(
    "nav footer aside form button select option menu dialog noscript template object svg math canvas audio video map "
    "head search fieldset legend datalist".split()
)
_CONTENT = {"article", "main"}
_BOILER_ROLE = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_BOILER_WORD = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification outbrain pagination pager popup promo promotion related replies reply respond share sharing shoutbox "
    "sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
_HEADER = {"header"}
#: Elements that are parts of a text; all other block elements are containers, told apart by their number among equals.
_TEXT_PARTS = set(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table caption colgroup thead tbody tfoot tr "
    "td th address hgroup hr html body".split()
)
#: Levels of containers that are told apart; what lies deeper belongs to the last of them.
_LEVELS = 64
#: ``has-sidebar`` and the like name what is beside an element.
_BESIDE = {"has", "with", "no", "without"}

_TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/][^<>]*\Z""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(f"</{name}", re.IGNORECASE) for name in _RAW}


class Place(NamedTuple):
    """An open element: name, hash of its path, whether a menu etc. or an article is around it, paths of containers."""

    name: str
    path: int
    boiler: bool
    content: bool
    containers: tuple[int, ...]


class Run(NamedTuple):
    """A run of text: token, containers, region (0 open, 1 article, 2 menu etc.), whether a link, raw text, block number."""

    token: int
    containers: tuple[int, ...]
    region: int
    link: bool
    text: str
    block: int


_ROOT = Place("", 0, False, False, (0,))


@lru_cache(maxsize=20_000)
def _inside(parent: Place, name: str, attributes: str, number: int) -> Place:
    """The place of a new element; ``number`` tells containers of one path apart."""
    named = {key.lower(): value.strip("\"'").lower() for key, value in _ATTRIBUTE.findall(attributes)}
    classes = " ".join(sorted(named.get("class", "").split()))
    role = named.get("role", "")
    words: set[str] = set()
    for one in f"{classes} {named.get('id', '')}".split():
        parts = set(_WORD.findall(one))
        if parts.isdisjoint(_BESIDE):
            words |= parts
    content = parent.content or name in _CONTENT or role in ("main", "article")
    boiler = (
        parent.boiler
        or name in _BOILER
        or (name in _HEADER and not content)
        or role in _BOILER_ROLE
        or "hidden" in named
        or (name not in ("html", "body", "article", "main") and not words.isdisjoint(_BOILER_WORD))
    )
    path = _hash(f"{parent.path}/{name}.{classes}:{number}")
    containers = parent.containers
    if name not in _TEXT_PARTS and len(containers) < _LEVELS:
        containers = (*containers, path)
    return Place(name, path, boiler, content, containers)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def page_tokens(source: str) -> list[int | Run]:
    """Tags as hashes and runs of text of a page, in order. Runs have the number of the block they belong to."""
    out: list[int | Run] = []
    stack = [_ROOT]
    open_names: dict[str, int] = {}
    numbers: dict[int, int] = {}
    links, block, at, end = 0, 0, 0, len(source)

    def text(piece: str) -> None:
        if not piece or piece.isspace():
            if piece and out and isinstance(out[-1], Run):
                out[-1] = out[-1]._replace(text=out[-1].text + " ")
            elif piece:
                out.append(Run(0, (), 2, False, " ", block))
            return
        place = stack[-1]
        region = 2 if place.boiler else 1 if place.content else 0
        token = _hash(f"{place.path}:{' '.join(piece.split())}")
        out.append(Run(token, place.containers, region, links > 0, piece, block))

    def close(until: int) -> None:
        while len(stack) > until:
            place = stack.pop()
            open_names[place.name] -= 1
            out.append(place.path ^ 1)

    while at < end:
        found = _TAG.search(source, at)
        if not found:
            break
        if found.start() > at:
            text(source[at : found.start()])
        at = found.end()
        if found[0] == "<!--":
            at = source.find("-->", at) + 3
            at = at if at >= 3 else end
            continue
        ending, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "a":
                links = 0 if ending else 1
            elif name == "br":
                text(" ")
            continue
        block += 1
        if ending:
            if open_names.get(name):
                depth = max(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name) if stack[-1].name != name else len(stack) - 1
                close(depth)
            continue
        links = 0
        if name in _CLOSES_P and open_names.get("p"):
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "p")
            close(depth)
        same = _SAME.get(name)
        if same:
            scope = _SCOPE.get(name, {"table", "select"})
            i = len(stack) - 1
            lowest = None
            while i > 0 and stack[i].name not in scope and len(stack) - i < 50:
                if stack[i].name in same:
                    lowest = i
                i -= 1
            if lowest is not None:
                close(lowest)
        place = _inside(stack[-1], name, attributes, 0)
        if name not in _TEXT_PARTS:
            number = numbers.get(place.path, 0)
            numbers[place.path] = number + 1
            if number:
                place = _inside(stack[-1], name, attributes, number)
        if name in _VOID or attributes.rstrip().endswith("/") and name not in _RAW and name not in _CLOSES_P:
            out.append(place.path)
            continue
        out.append(place.path)
        if name in _RAW_END:
            stop = _RAW_END[name].search(source, at)
            at = stop.start() if stop else end
            out.append(place.path ^ 1)
            if stop:
                tail = source.find(">", at)
                at = tail + 1 if tail >= 0 else end
            continue
        stack.append(place)
        open_names[name] = open_names.get(name, 0) + 1
    if at < end:
        text(source[at:])
    return out


class Template(NamedTuple):
    """Of one host: classes of tokens in order, tokens that occur once a page, all tokens, the main container."""

    classes: list[list[int]]
    skeleton: frozenset[int]
    tokens: frozenset[int]
    main: int | None


_NONE = Template([], frozenset(), frozenset(), None)


@lru_cache(maxsize=256)
def _template(text: str | None) -> Template:
    if not text:
        return _NONE
    read = json.loads(text)
    classes = [c["tokens"] for c in read["classes"]]
    skeleton = next((c["tokens"] for c in read["classes"] if c["once"]), [])
    return Template(classes, frozenset(skeleton), frozenset(t for c in classes for t in c), read.get("main"))


def _token(item: int | Run) -> int:
    return item if isinstance(item, int) else item.token


def _in_order(items: list[int | Run], tokens: list[int], skeleton: frozenset[int]) -> bool:
    """Whether the tokens of a class follow each other in rounds, each round between two skeleton tokens."""
    place = {t: i for i, t in enumerate(tokens)}
    following, inside = 0, tokens[0] in skeleton
    for item in items:
        t = _token(item)
        if t in place:
            if place[t] != following:
                return False
            following = (following + 1) % len(tokens)
        elif following and not inside and t in skeleton:
            return False
    return following == 0


def _main_container(items: list[int | Run], template: Template) -> int:
    """That of the host, else the innermost with over half of the page's own open text outside of links."""
    found: dict[int, int] = {0: 0}
    for item in items:
        if isinstance(item, Run) and item.region == 0 and item.containers:
            plain = 0 if item.link or item.token in template.tokens else len(item.text)
            for container in item.containers:
                found[container] = found.get(container, 0) + plain
    if template.main in found:
        return template.main
    return [container for container, n in found.items() if 2 * n > found[0] or not container][-1]


def main_text(source: str | None, template: Template = _NONE) -> str:
    """The main text of one page, blocks joined by line feeds."""
    items = page_tokens(source or "")
    runs = [item for item in items if isinstance(item, Run)]
    marked = any(run.region == 1 for run in runs)
    main = None if marked else _main_container(items, template)
    blocks: list[str] = []
    for _, block in itertools.groupby(runs, key=lambda run: run.block):
        whole = list(block)
        words = [run for run in whole if run.containers]
        if marked:
            taken = any(run.region == 1 for run in words)
        else:
            taken = any(run.region == 0 and main in run.containers for run in words)
            # A block that is all links is a menu, one that is all template says nothing about the page.
            taken = taken and not all(run.link for run in words)
            taken = taken and not all(run.token in template.tokens for run in words)
        if taken:
            text = " ".join(html.unescape("".join([run.text for run in whole])).split())
            if text:
                blocks.append(text)
    return "\n".join(blocks)


# --- Spark ---------------------------------------------------------------


def _host(url: Column) -> Column:
    """Host of an address in lower case; NULL if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(host != "", host)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch as Python values, converted some at a time."""
    table = pa.Table.from_batches([batch]).select(list(names))
    sizes = [n or 0 for n in pc.binary_length(table.column("html")).to_pylist()]
    for start, end in steps(sizes):
        yield from zip(*(table.column(i).slice(start, end - start).to_pylist() for i in range(len(names))))


_VECTORS = "host string, token bigint, is_text boolean, v1 bigint, v2 bigint, pages bigint, times bigint, place bigint"


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums over pages for each host and token: digests of the occurrence vector, pages, times, first places.

    Token 0 counts the pages of the host.
    """
    held: dict[tuple[str, int, bool], list[int]] = {}
    fields = [field.split() for field in _VECTORS.split(", ")]

    def flush() -> pa.RecordBatch:
        columns = [[], [], [], [], [], [], [], []]
        for key, sums in held.items():
            for column, value in zip(columns, (*key, *sums)):
                column.append(value)
        held.clear()
        types = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
        return pa.RecordBatch.from_arrays(
            [pa.array(c, types[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields]
        )

    for batch in batches:
        for host, source in _rows(batch, "host", "html"):
            items = page_tokens(source or "")
            page = xxhash.xxh64_intdigest((source or "").encode())
            times: dict[tuple[int, bool], list[int]] = {(0, False): [1, 0]}
            for place, item in enumerate(items):
                token = _token(item)
                if token:
                    times.setdefault((token, isinstance(item, Run)), [0, place])[0] += 1
            for (token, is_text), (n, place) in times.items():
                digest = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), page)
                sums = held.setdefault((host, token, is_text), [0, 0, 0, 0, 0])
                sums[0] += digest & 0xFFFFFFFF
                sums[1] += digest >> 32
                sums[2] += 1
                sums[3] += n
                sums[4] += place
        if len(held) >= _HELD:
            yield flush()
    yield flush()


def _classes(pages: DataFrame) -> DataFrame:
    """``(host, template)``: classes of tokens with one occurrence vector on at least half of the host's pages, as JSON."""
    sums = pages.mapInArrow(_vectors, _VECTORS).groupBy("host", "token", "is_text").agg(
        *[F.sum(name).alias(name) for name in ("v1", "v2", "pages", "times", "place")]
    )
    # What is on one page only is gone before hosts are looked at; a token may be on all pages of a hot host.
    tokens = stage_table(sums.where("pages >= 2"), "page-tokens")
    hosts = tokens.where("token = 0").select("host", F.col("pages").alias("n"))
    common = tokens.where("token != 0").join(hosts, "host").where(
        (2 * F.col("pages") >= F.col("n")) & (~F.col("is_text") | (F.col("n") >= MIN_PAGES_FOR_TEXT))
    )
    # At most twice as many tokens as a page has on average are on half of the pages, so the lists are short.
    classes = (
        common.groupBy("host", "v1", "v2", "pages", "times")
        .agg(F.sort_array(F.collect_list(F.struct("place", "token"))).alias("listed"))
        .where(F.size("listed") >= 2)
    )
    entry = F.struct(
        (-F.size("listed")).alias("order"),
        F.xxhash64("v1", "v2", "pages", "times").alias("class"),
        (F.col("pages") == F.col("times")).alias("once"),
        F.col("pages").alias("pages"),
        F.col("listed.token").alias("tokens"),
    )
    return classes.groupBy("host").agg(F.sort_array(F.collect_list(entry)).alias("classes"))


def _with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with the template of their host, if it has one."""
    size = templates.agg(F.sum(F.length("template"))).first()[0] or 0
    small = templates.withColumnRenamed("host", "_host")
    small = F.broadcast(small) if size <= BROADCAST_BYTES else small
    return pages.join(small, F.col("host") == F.col("_host"), "left").drop("_host")


_JUDGED = "host string, class bigint, container bigint, level int, bad bigint, chars bigint"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages on which a class is out of order, and how much open text outside of links the containers hold."""
    bad: dict[tuple[str, int], int] = {}
    held: dict[tuple[str, int, int], int] = {}
    names = [field.split()[0] for field in _JUDGED.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def flush() -> pa.RecordBatch:
        rows = [(host, known, None, None, n, 0) for (host, known), n in bad.items()]
        rows += [(host, None, container, level, 0, n) for (host, container, level), n in held.items()]
        bad.clear()
        held.clear()
        columns = zip(*rows) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        for host, source, text in _rows(batch, "host", "html", "template"):
            template, items = _template(text), page_tokens(source or "")
            for entry, tokens in zip(json.loads(text)["classes"], template.classes):
                if not _in_order(items, tokens, template.skeleton):
                    bad[host, entry["class"]] = bad.get((host, entry["class"]), 0) + 1
            for item in items:
                if isinstance(item, Run) and item.region == 0 and not item.link and item.token not in template.tokens:
                    for level, container in enumerate(item.containers):
                        held[host, container, level] = held.get((host, container, level), 0) + len(item.text)
        if len(bad) + len(held) >= _HELD:
            yield flush()
    yield flush()


def host_templates(pages: DataFrame) -> DataFrame:
    """``(host, template)`` as JSON for ``pages`` with ``host`` and ``html``; hosts without two like pages have none."""
    as_json = F.to_json(F.struct("classes")).alias("template")
    classes = stage_table(_classes(pages.where(F.col("host").isNotNull())), "page-classes")
    first = classes.select("host", as_json)
    known = pages.where(F.col("host").isNotNull()).join(classes.select(F.col("host").alias("_h")), F.col("host") == F.col("_h"), "left_semi")
    judged = _with_templates(known, first).select("host", "html", "template").mapInArrow(_judge, _JUDGED)
    judged = stage_table(
        judged.groupBy("host", "class", "container", "level").agg(F.sum("bad").alias("bad"), F.sum("chars").alias("chars")),
        "page-slots",
    )
    bad = judged.where("class is not null").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("class", "bad"))).alias("bad"))
    # Of the containers with over half of the text the innermost: there is at most one on each level.
    whole = judged.where("container = 0").select(F.col("host").alias("_h"), F.col("chars").alias("whole"))
    main = (
        judged.where("container is not null")
        .join(whole, F.col("host") == F.col("_h"))
        .where("2 * chars > whole")
        .groupBy("host")
        .agg(F.max_by("container", "level").alias("main"))
    )
    # A class that is out of order on more than one page in twenty is no part of the template.
    valid = F.filter("classes", lambda c: F.coalesce(F.try_element_at("bad", c["class"]), F.lit(0)) * 20 <= c["pages"])
    return (
        classes.join(bad, "host", "left")
        .join(main, "host", "left")
        .select("host", F.when(F.col("bad").isNull(), F.col("classes")).otherwise(valid).alias("classes"), "main")
        .select("host", F.to_json(F.struct("classes", "main")).alias("template"))
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(source, _template(text)) for source, text in _rows(batch, "html", "template")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` with the main text of each page.

    A row for each row of ``pages``: NULL and empty pages and pages without main
    text give an empty text, repeated rows and NULL ids stay. Pages whose
    address has no host (or is NULL) are read without a template. Copies of a
    page count as pages of their host. Other columns are left out.
    """
    read = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        _host(F.col("url")).alias("host"),
    )
    templates = stage_table(host_templates(read.select("host", "html")), "page-templates")
    return _with_templates(read, templates).select("page_id", "url", "html", "template").mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint"
    )
