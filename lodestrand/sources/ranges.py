"""Text files read by ranges of bytes: any name, any line end, gzip in blocks split too, unreadable files told apart."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a file that one task reads.
SPLIT = 64 << 20
#: Bytes read at one time.
CHUNK = 4 << 20
#: Bytes of a line that are kept; more than the longest line that counts can have.
MOST = 40_000_004
#: Places of line ends are looked for so far into a file to tell its kind. As ``files.SNIFF_BYTES``.
SNIFF = 100_000
#: Kinds of places that tasks open without Spark's readers.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")

_MAGIC = b"\x1f\x8b\x08\x04"
_ROWS = 200_000


def splits(files: DataFrame, size: int = SPLIT) -> DataFrame:
    """(file, from, to): the ranges of ``files`` (file, size); an empty file has one too."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))
    return files.select("file", "size", F.explode(starts).alias("from")).select("file", "from", F.least(F.col("from") + size, "size").alias("to"))


def place_of(file: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a file's full name, and its name there."""
    if file.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + file.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(quote(file, safe=":/?&=@%+"))


def _opened(file: str) -> pa.NativeFile:
    fs, path = place_of(file)
    return fs.open_input_file(path)


def _plain(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whether they are in the range), from ``start`` to the end of the file."""
    f.seek(start)
    at, step = start, 1 << 16
    while True:
        inside = at < stop
        data = f.read(min(CHUNK, stop - at) if inside else step)
        if not data:
            return
        yield data, inside
        at += len(data)
        step = step if inside else min(2 * step, CHUNK)


def _block_size(head: bytes) -> int | None:
    """The size of a gzip block that tells it in its header's extra field; None if it does not."""
    if head[:4] != _MAGIC or len(head) < 12:
        return None
    extra, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 4 <= len(extra):
        n = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at : at + 2] == b"BC" and n == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + n
    return None


def _first_block(f: pa.NativeFile, start: int, size: int) -> int | None:
    """The first place from ``start`` on where a block begins, and after it another or the end of the file."""
    if start == 0:
        return 0
    f.seek(start)
    window = f.read(1 << 17)
    at = window.find(_MAGIC)
    while at >= 0:
        n = _block_size(window[at : at + 512])
        if n and (start + at + n == size or window[at + n : at + n + 4] == _MAGIC):
            return start + at
        at = window.find(_MAGIC, at + 1)
    return None


def _blocks(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[bytes, bool]]:
    """The text of the blocks that begin in the range, then of those after it."""
    size = f.size()
    at = _first_block(f, start, size)
    while at is not None and at < size:
        f.seek(at)
        block = f.read(1 << 16)
        n = _block_size(block[:512])
        if n is None or n > len(block):
            raise EOFError(f"no whole block at byte {at}")
        data = zlib.decompress(block[:n], 31)
        if data:
            yield data, at < stop
        at += n


def _unpacked(f: pa.NativeFile) -> Iterator[tuple[bytes, bool]]:
    """The text of a whole gzip file, of one member or more."""
    unpack, fresh = zlib.decompressobj(31), True
    f.seek(0)
    while data := f.read(CHUNK):
        while data:
            fresh = False
            out = unpack.decompress(data, CHUNK)
            if out:
                yield out, True
            data = unpack.unconsumed_tail
            if unpack.eof:
                data = unpack.unused_data
                unpack, fresh = zlib.decompressobj(31), True
                if not data.strip(b"\0"):
                    data = b""
    if not fresh:
        raise EOFError("the compressed text ends in its middle")


def _parts(file: str, start: int, stop: int) -> Iterator[tuple[bytes, bool]]:
    """The text of one range; of a gzip file that is not in blocks, all for the first range and none for the others."""
    with _opened(file) as f:
        if not file.lower().endswith(".gz"):
            yield from _plain(f, start, stop)
        elif _block_size(f.read(512)) is not None:
            yield from _blocks(f, start, stop)
        elif start == 0:
            yield from _unpacked(f)


def lines_of(parts: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[list[bytes]]:
    """The lines of a range with their ends, run by run.

    A line that starts at the edge of two ranges belongs to the first: so all ranges but
    the first of a file leave out what goes before their first line end, and each goes on
    through the first line that starts at its end or after it. CR, LF
    and CRLF end lines, also where one falls on the edge.
    """
    held: list[bytes] = []
    at, stop, skip = 0, None, not first

    def run(data: bytes) -> Iterator[list[bytes]]:
        nonlocal at, skip
        lines = data.splitlines(True)
        if skip and lines:
            at += len(lines.pop(0))
            skip = False
        if stop is not None:
            kept = []
            for line in lines:
                if at > stop:
                    break
                kept.append(line)
                at += len(line)
            lines = kept
        else:
            at += sum(map(len, lines))
        if lines:
            yield lines

    position = 0
    for data, inside in parts:
        if stop is None and not inside:
            stop = position
        position += len(data)
        cut = max(data.rfind(b"\n"), data.rfind(b"\r"))
        if held and held[-1][-1:] == b"\r" and data[:1] != b"\n":  # a line ended with what was held
            yield from run(b"".join(held))
            held = []
        if cut < 0:
            held.append(data)
        else:
            whole = cut + 1 if data[cut] == 10 or cut + 1 < len(data) else 1 + max(data.rfind(b"\n"), data.rfind(b"\r", 0, cut))
            if whole:
                yield from run(b"".join([*held, data[:whole]]))
                held = [data[whole:]] if whole < len(data) else []
            else:
                held.append(data)
        if stop is not None and at > stop:
            return
    if held:
        yield from run(b"".join(held))


def _bare(line: bytes) -> bytes:
    return (line[:-2] if line[-2:] == b"\r\n" else line[:-1] if line[-1:] in b"\r\n" and line else line)[:MOST]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, start, stop, place in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            for lines in lines_of(_parts(file, start, stop), start == 0):
                for x in range(0, len(lines), _ROWS):
                    part = lines[x : x + _ROWS]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(range(place + 1, place + n + 1), pa.int64()), pa.array(list(map(_bare, part)), pa.binary())], names=["file", "line_no", "line"])
                    place += n


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, kind, ended, fault, seen = 0, None, None, None, b""
            try:
                for lines in lines_of(_parts(file, start, stop), start == 0):
                    if start == 0 and len(seen) < SNIFF:
                        seen += b"".join(lines)[: SNIFF + 2]
                    n += len(lines)
                    ended = lines[-1][-1:] in (b"\r", b"\n")
            except (OSError, EOFError, zlib.error) as problem:
                fault = f"{type(problem).__name__}: {problem}"
            if start == 0:
                cr, lf = (x if 0 <= (x := seen.find(c)) < SNIFF else len(seen) + 1 for c in (b"\r", b"\n"))
                kind = "CRLF" if cr == lf or cr + 1 == lf else "CR" if cr < lf else "LFCR" if seen[lf + 1 : lf + 2] == b"\r" else "LF"
            rows.append((file, start, n, kind, ended, fault))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()), strict=True)], names=["file", "from", "lines", "terminator", "ended", "fault"])


def _dealt(ranges: DataFrame) -> DataFrame:
    """A task for each few ranges, the ranges of a large file apart."""
    n = ranges.count()
    return ranges.repartition(max(1, min(n, 100_000)), "file", "from")


def range_sums(ranges: DataFrame) -> DataFrame:
    """(file, from, lines, terminator, ended, fault) of each range: what numbers lines and tells how a file ends.

    terminator (of the first range): CRLF, LF, CR or LFCR, by the first line end in the
    leading bytes; CRLF if there is none. ended: the range's last line has a line end;
    null without lines. fault: why it could not be read to its end.
    """
    return _dealt(ranges).mapInArrow(_sums, "file string, from long, lines long, terminator string, ended boolean, fault string")


def range_lines(ranges: DataFrame, sums: DataFrame) -> DataFrame:
    """(file, line_no, line) of every line, numbered from 1 in each file by the lines of the ranges before.

    sums: see ``range_sums``; files with a fault must be left out of both.

    A range is told the lines before it ahead of being read: lines joined with them
    later would look no larger than the ranges to the planner, which then broadcasts them.
    """
    before = sums.select("file", "from", F.expr("coalesce(sum(lines) OVER (PARTITION BY file ORDER BY `from` ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("before"))
    placed = ranges.join(before, ["file", "from"]).select("file", "from", "to", "before")
    raw = _dealt(placed).mapInArrow(_each, "file string, line_no long, line binary")
    text = F.make_valid_utf8(F.col("line").cast("string"))
    return raw.select("file", "line_no", F.when(F.col("line_no") == 1, F.regexp_replace(text, "^﻿", "")).otherwise(text).alias("line"))


def file_sums(sums: DataFrame) -> DataFrame:
    """(file, lines, terminator, ends_with_newline, fault) of each file; the last range with lines tells the end."""
    last = F.max(F.when(F.col("ended").isNotNull(), F.struct("from", "ended")))
    return sums.groupBy("file").agg(F.sum("lines").alias("lines"), F.max("terminator").alias("terminator"), last.alias("last"), F.min("fault").alias("fault")).select("file", "lines", "terminator", F.col("last.ended").alias("ends_with_newline"), "fault")
