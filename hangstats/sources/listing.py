"""Which files a selection holds, and how they are dealt to read tasks.

The dimension directories are walked level by level. Only directories whose
values the selection allows are listed, each once; no file is opened but the end
of an XZ file that is larger than a task's share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import SparkSession

from hangstats.constants import DIMENSIONS, FILES_PER_SLICE
from hangstats.sources import xz
from hangstats.sources.selection import PingFilter

LZMA_ENDINGS = (".lzma", ".xz")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_LISTERS = 16


class Directory(NamedTuple):
    """A directory of the last level and its dimension values."""

    path: str
    dimensions: tuple[str | None, ...]


class ReportFile(NamedTuple):
    path: str
    size: int
    dimensions: tuple[str | None, ...]


class FilePart(NamedTuple):
    """A file, or the blocks from ``first`` to before ``last`` of an XZ file."""

    path: str
    size: int
    dimensions: tuple[str | None, ...]
    first: int = 0
    last: int = -1


def arrow_uri(spark: SparkSession, path: str) -> str:
    """A path as Spark resolves it, in the spelling of Arrow's file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    uri = hadoop.getFileSystem(conf).makeQualified(hadoop).toString()
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri.replace("s3a://", "s3://", 1)


class ReportTree:
    """The directories below a root; ``listed`` names those that were looked into."""

    def __init__(self, uri: str):
        self.uri = uri
        self.files, base = fs.FileSystem.from_uri(uri)
        self.base = base.rstrip("/")
        self.listed: list[str] = []

    def _list(self, path: str) -> list[fs.FileInfo]:
        self.listed.append(path)
        found = self.files.get_file_info(fs.FileSelector(path))
        return [info for info in found if not info.base_name.startswith(("_", "."))]

    def _list_all(self, paths: Iterable[str]) -> Iterator[list[fs.FileInfo]]:
        with ThreadPoolExecutor(_LISTERS) as pool:
            yield from pool.map(self._list, paths)

    def directories(self, selection: PingFilter | None = None) -> list[Directory]:
        """Directories of the last level that the selection holds, in path order."""
        if self.files.get_file_info(self.base).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{self.uri} does not exist")
        level = [Directory(self.base, ())]
        for name in DIMENSIONS:
            below = []
            for parent, entries in zip(level, self._list_all([d.path for d in level])):
                for entry in entries:
                    key, _, text = entry.base_name.partition("=")
                    if entry.type != fs.FileType.Directory or key != name:
                        continue
                    value = None if text == _NO_VALUE else unquote(text)
                    if selection is None or selection.accepts(name, value):
                        below.append(Directory(entry.path, (*parent.dimensions, value)))
            level = below
        return sorted(level)

    def contents(self, directories: list[Directory], endings: tuple[str, ...] = ()) -> list[list[ReportFile]]:
        """The files of each directory, in no order."""
        return [
            [
                ReportFile(info.path, info.size, directory.dimensions)
                for info in entries
                if info.type == fs.FileType.File and (not endings or info.base_name.endswith(endings))
            ]
            for directory, entries in zip(directories, self._list_all([d.path for d in directories]))
        ]


def head(contents: list[list[ReportFile]], fraction: float) -> list[list[ReportFile]]:
    """The first ``floor(n * fraction)`` of all ``n`` files in (directory, name) order, by directory.

    Directories are in order; their sizes tell which of them are kept whole, so
    names are only compared within the one in which the prefix ends.
    """
    total = sum(map(len, contents))
    left = max(min(int(total * fraction), total), 0)
    kept = []
    for files in contents:
        if left <= 0:
            break
        kept.append(files if len(files) <= left else heapq.nsmallest(left, files))
        left -= len(files)
    return kept


def read_slices(files: int, default_parallelism: int) -> int:
    """How many slices a number of files is read in."""
    return max(files // FILES_PER_SLICE, default_parallelism)


def parts(tree: ReportTree, files: Iterable[ReportFile], share: float) -> Iterator[FilePart]:
    """Files as parts of about ``share`` bytes where their format can be entered in the middle."""
    for file in files:
        if file.size > share and file.path.endswith(".xz"):
            with tree.files.open_input_file(file.path) as stream:
                cuts = xz.cuts(xz.read_blocks(stream), share)
            if len(cuts) > 1:
                for first, last, size in cuts:
                    yield FilePart(file.path, size, file.dimensions, first, last)
                continue
        yield FilePart(*file)


def deal(whole: Iterable[FilePart], slices: int) -> list[list[FilePart]]:
    """Parts dealt by bytes: the largest that is left goes to the lightest slice. Slices without a part are left out."""
    heap = [(0, i) for i in range(slices)]
    dealt: list[list[FilePart]] = [[] for _ in range(slices)]
    for part in sorted(whole, key=lambda p: (-p.size, p)):
        load, i = heapq.heappop(heap)
        dealt[i].append(part)
        heapq.heappush(heap, (load + part.size, i))
    return [one for one in dealt if one]


def plan_slices(tree: ReportTree, files: list[ReportFile], default_parallelism: int) -> list[list[FilePart]]:
    """The slices in which files are read: one for each 16 files, at least one for each core, alike in bytes."""
    slices = read_slices(len(files), default_parallelism)
    share = max(sum(file.size for file in files) / slices, 1)
    return deal(parts(tree, files, share), slices)
