"""Lines of LZMA and XZ files, one partition for each slice of them.

The partitions are those of a range of slice numbers, whose tasks open the files
of their slice as streams: a task holds a few megabytes of text whatever the
size of a file, and no text is shuffled. (A Python data source could have the
same partitions, but Spark does not see that two uses of one are the same: every
analysis that reads its shuffle twice would read and parse the files twice.)
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from hangstats.constants import DIMENSIONS
from hangstats.sources import xz
from hangstats.sources.listing import FilePart, ReportTree

SCHEMA = ", ".join(["value string", *(f"`{name}` string" for name in DIMENSIONS)])
_CHUNK = 4 * 1024 * 1024


def split_lines(pieces: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Pieces of a text to lists of its lines. Line ends are ``\\n``, ``\\r\\n`` and ``\\r``."""
    begun: list[bytes] = []  # pieces of a line whose end has not come yet
    half = b""  # a final \r may be half of \r\n, so it waits
    for piece in pieces:
        piece = half + piece
        half = b"\r" if piece.endswith(b"\r") else b""
        piece = piece.removesuffix(half) if half else piece
        cut = max(piece.rfind(b"\n"), piece.rfind(b"\r")) + 1
        if cut:
            yield b"".join([*begun, piece[:cut]]).splitlines()
            begun = []
        if cut < len(piece):
            begun.append(piece[cut:])
    if begun or half:
        yield b"".join([*begun, half]).splitlines()


def line_array(lines: list[bytes]):
    """Lines as text; bytes that are not UTF-8 are replaced."""
    import pyarrow as pa

    raw = pa.array(lines, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([line.decode("utf-8", "replace") for line in lines], pa.string())


def _stream_pieces(stream, chunk: int) -> Iterator[bytes]:
    """The text of a whole file, piece by piece."""
    import lzma

    with lzma.open(stream) as text:
        while piece := text.read(chunk):
            yield piece


def part_lines(files, part: FilePart, chunk: int = _CHUNK) -> Iterator[list[bytes]]:
    """Lists of the lines that belong to a file or to a part of one."""
    if part.last < 0:
        with files.open_input_stream(part.path) as stream:
            yield from split_lines(_stream_pieces(stream, chunk))
        return
    with files.open_input_file(part.path) as stream:
        blocks = xz.read_blocks(stream)
        length = sum(b.text for b in blocks[part.first : part.last]) if part.last < len(blocks) else None
        text = xz.block_text(stream, blocks[part.first :])
        yield from split_lines(xz.owned(text, part.first == 0, length))


def slice_reader(uri: str, slices: list[list[FilePart]], chunk: int = _CHUNK) -> Callable:
    """Arrow batches of slice numbers to batches of lines with their dimensions."""
    packed = zlib.compress(json.dumps(slices).encode())

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        listed = json.loads(zlib.decompress(packed))
        files = ReportTree(uri).files
        for batch in batches:
            for number in batch.column(0).to_pylist():
                for path, size, dimensions, first, last in listed[number]:
                    values = [pa.scalar(value, pa.string()) for value in dimensions]
                    for lines in part_lines(files, FilePart(path, size, tuple(dimensions), first, last), chunk):
                        columns = [line_array(lines), *(pa.repeat(value, len(lines)) for value in values)]
                        yield pa.RecordBatch.from_arrays(columns, names=["value", *DIMENSIONS])

    return read


def read_parts(spark: SparkSession, uri: str, slices: list[list[FilePart]]) -> DataFrame:
    """Lines of the files in ``slices`` with their dimensions; each slice is read by one task."""
    n = len(slices)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(slice_reader(uri, slices), SCHEMA)
