"""Entering an XZ file in the middle: its index, its blocks, and lines across them.

An XZ file is a row of streams: header, blocks, index, footer. The index, found
from the end, has the size of each block, and a block is decoded on its own.
"""

from __future__ import annotations

import lzma
import re
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

# Fixed values of the format.
_HEADER_MAGIC, _FOOTER_MAGIC = b"\xfd7zXZ\x00", b"YZ"
_HEADER_SIZE = _FOOTER_SIZE = 12
_CHUNK = 1 << 20
_LINE_END = re.compile(rb"[\r\n]")


class Block(NamedTuple):
    """Where a block begins, its bytes with padding, its bytes of text, and the header of its stream."""

    offset: int
    size: int
    text: int
    header: bytes


class NotXZ(ValueError):
    """The file does not end as the format demands."""


def _numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """``n`` integers of seven bits a byte, the lowest first."""
    found = []
    for _ in range(n):
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                break
        found.append(value)
    return found, at


def _read(stream, offset: int, size: int) -> bytes:
    if offset < 0:
        raise NotXZ("truncated")
    stream.seek(offset)
    data = stream.read(size)
    if len(data) != size:
        raise NotXZ("truncated")
    return data


def read_blocks(stream) -> list[Block]:
    """The blocks of all streams of a seekable file, in order; only headers, indexes and footers are read."""
    streams: list[list[Block]] = []
    end = stream.seek(0, 2)
    end = stream.tell() if end is None else end
    while end > 0:
        footer = _read(stream, end - _FOOTER_SIZE, _FOOTER_SIZE)
        if footer[8:] == b"\0\0\0\0":  # padding between streams
            end -= 4
            continue
        if footer[-2:] != _FOOTER_MAGIC:
            raise NotXZ("no footer")
        index_size = (struct.unpack("<I", footer[4:8])[0] + 1) * 4
        index_at = end - _FOOTER_SIZE - index_size
        index = _read(stream, index_at, index_size)
        (n,), at = _numbers(index, 1, 1)
        sizes, _ = _numbers(index, at, 2 * n)
        padded = [(size + 3) // 4 * 4 for size in sizes[0::2]]
        begin = index_at - sum(padded)
        header = _read(stream, begin - _HEADER_SIZE, _HEADER_SIZE)
        if header[:6] != _HEADER_MAGIC or header[6:8] != footer[8:10]:
            raise NotXZ("no header")
        found, offset = [], begin
        for size, text in zip(padded, sizes[1::2]):
            found.append(Block(offset, size, text, header))
            offset += size
        streams.append(found)
        end = begin - _HEADER_SIZE
    return list(chain.from_iterable(reversed(streams)))


def cuts(blocks: list[Block], share: float) -> list[tuple[int, int, int]]:
    """``(first, last, bytes)``: runs of blocks of at least ``share`` bytes (the last may have fewer)."""
    found, first, size = [], 0, 0
    for i, block in enumerate(blocks):
        size += block.size
        if size >= share or i + 1 == len(blocks):
            found.append((first, i + 1, size))
            first, size = i + 1, 0
    return found


def block_text(stream, blocks: list[Block]) -> Iterator[bytes]:
    """The text of blocks, piece by piece."""
    for block in blocks:
        decoder = lzma.LZMADecompressor(format=lzma.FORMAT_XZ)
        decoder.decompress(block.header)
        stream.seek(block.offset)
        left, due = block.size, block.text
        while due > 0:
            data = b""
            if decoder.needs_input:
                data = stream.read(min(left, _CHUNK))
                left -= len(data)
                if not data:
                    raise lzma.LZMAError("a block ends before its text")
            piece = decoder.decompress(data, _CHUNK)
            due -= len(piece)
            if piece:
                yield piece


def _after_line_end(piece: bytes, start: int, rest: Iterator[bytes]) -> tuple[bytes, int | None]:
    """The first place behind a line end at or after ``start``; the piece grows when ``\\r`` may be half of ``\\r\\n``."""
    found = _LINE_END.search(piece, start)
    if not found:
        return piece, None
    end = found.end()
    if found[0] == b"\r":
        if end == len(piece):
            piece += next(rest, b"")
        if piece[end : end + 1] == b"\n":
            end += 1
    return piece, end


def owned(pieces: Iterator[bytes], first: bool, length: int | None) -> Iterator[bytes]:
    """Of a text that is read from one cut on, the lines that belong to it.

    A line belongs to the cut before its start; one that starts exactly at a cut
    belongs to the part in front. So all parts but the first leave out what
    comes before the first line end, and all but the last (``length`` None) read
    on from their end to the next line end.
    """
    pieces = iter(pieces)
    at = 0
    if not first:
        for piece in pieces:
            piece, end = _after_line_end(piece, 0, pieces)
            if end is not None:
                break
            at += len(piece)
        else:
            return
        at += end
        if length is not None and at > length:
            return
        pieces = chain([piece[end:]], pieces)
    for piece in pieces:
        if length is not None and at + len(piece) > length:
            piece, end = _after_line_end(piece, max(length - at, 0), pieces)
            if end is not None:
                yield piece[:end]
                return
        at += len(piece)
        yield piece
