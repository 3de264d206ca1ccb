"""Block-gzipped files (the usual form of .vcf.gz) read by splits, and a sink that writes them.

Such a file is a row of gzip members of at most 64 KB, each of which tells its own size.  A split of the compressed
file starts at the first member whose header is at or after its start: a place with the header's bytes at which the next
member begins where the size says.  A split leaves out what stands before its first line end, and reads on in the
members after its end until the line that it began, or one that begins exactly there, is complete.  So each line is in one split.

Tasks read ranges of bytes through pyarrow's file systems.  A file in a store that these don't reach
is left to Spark's own reader of gzip, which gives one task to each file.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

HEADER, MAGIC = 18, b"\x1f\x8b\x08\x04"
#: bytes of text of a member that is written, and of lines that are handed on at once
MEMBER, GIVEN = 0xFF00, 4 << 20
#: the member without text that ends a file, as the format fixes it
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def member_size(head: bytes) -> int | None:
    """The size that a member's header tells, or None if it is no such header."""
    if len(head) < HEADER or head[:4] != MAGIC or head[12:16] != b"BC\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def opened(uri: str):
    """(file system, path) for pyarrow, or None if it doesn't reach the file."""
    try:
        found, path = pafs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
        return (found, path) if found.get_file_info(path).type == pafs.FileType.File else None
    except (pa.ArrowException, OSError, ValueError):
        return None


def _first_member(file, at: int, size: int) -> int:
    """Where the first member at or after a place begins; the size of the file if there is none."""
    if at == 0:
        return 0
    file.seek(at)
    window = file.read(2 * (1 << 16) + HEADER)
    found = window.find(MAGIC)
    while found >= 0:
        n = member_size(window[found : found + HEADER])
        if n is not None:
            after = at + found + n
            if after == size:
                return at + found
            file.seek(after)
            if member_size(file.read(HEADER)) is not None:
                return at + found
        found = window.find(MAGIC, found + 1)
    return size


def _members(file, at: int, size: int):
    """(place, text) of the members from one on."""
    while at < size:
        file.seek(at)
        head = file.read(HEADER)
        n = member_size(head)
        if n is None:
            raise ValueError(f"no member of a block-gzipped file at {at}")
        data = file.read(n - HEADER)
        yield at, zlib.decompress(data[:-8], -15)
        at += n


def lines_of(file, size: int, start: int, end: int):
    """Lists of the lines that belong to the bytes from start to end of a compressed file."""
    rest, skip, given, held = b"", start > 0, [], 0
    for at, text in _members(file, _first_member(file, start, size), size):
        if at >= end:
            if skip:
                break
            line, cut, _ = text.partition(b"\n")
            rest += line
            if cut:
                given.append(rest)
                rest = b""
                break
            continue
        *lines, tail = text.split(b"\n")
        if skip:
            if not lines:
                continue
            lines, skip = lines[1:], False
            rest = b""
        elif lines:
            lines[0] = rest + lines[0]
            rest = b""
        rest += tail
        given += lines
        held += len(text)
        if held > GIVEN:
            yield given
            given, held = [], 0
    if rest and not skip:
        given.append(rest)
    yield given


def _strings(lines: list[bytes]) -> pa.Array:
    lines = [x[:-1] if x.endswith(b"\r") else x for x in lines]
    try:
        return pa.array(lines, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())


def read_splits(spark: SparkSession, files: list[tuple[int, str, int]], split: int) -> DataFrame:
    """(file, block, line, value) of (number, uri, size) files in order; a task for each `split` bytes."""
    splits = [(number, uri, size, at) for number, uri, size in files for at in range(0, size, split)]

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                number, uri, size, at = splits[k]
                found, path = opened(uri)
                line = 0
                with found.open_input_file(path) as file:
                    for lines in lines_of(file, size, at, min(size, at + split)):
                        n = len(lines)
                        yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array([at] * n, pa.int64()), pa.array(range(line, line + n), pa.int64()), _strings(lines)], ["file", "block", "line", "value"])
                        line += n

    return spark.range(0, len(splits), 1, len(splits)).mapInArrow(read, "file int, block long, line long, value string")


def write_bgzf(lines: DataFrame, path: str, order: list[str]) -> int:
    """Write sorted lines (value) as block-gzipped files part-00000.gz, ... whose names sort as the lines do; their number.

    A file appears under its name when it is complete, so a task that is run again leaves one.
    """
    if opened_folder(path) is None:
        raise ValueError(f"{path} can't be written by tasks")

    def write(batches):
        found, folder = opened_folder(path)
        name, attempt = f"part-{TaskContext.get().partitionId():05d}.gz", uuid.uuid4().hex
        rest, rows = b"", 0
        with found.open_output_stream(f"{folder}/_{attempt}") as out:
            for batch in batches:
                rest += b"".join(x.encode() + b"\n" for x in batch.column("value").to_pylist())
                rows += batch.num_rows
                whole = len(rest) - len(rest) % MEMBER
                for at in range(0, whole, MEMBER):
                    out.write(_member(rest[at : at + MEMBER]))
                rest = rest[whole:]
            if rest:
                out.write(_member(rest))
            out.write(END)
        if rows:
            found.move(f"{folder}/_{attempt}", f"{folder}/{name}")
        else:
            found.delete_file(f"{folder}/_{attempt}")
        yield pa.RecordBatch.from_arrays([pa.array([int(rows > 0)], pa.int64())], ["n"])

    found, folder = opened_folder(path)
    found.create_dir(folder)
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    return ordered.mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0


def opened_folder(path: str):
    """(file system, path) of a folder that may not be there yet."""
    try:
        return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))
    except (pa.ArrowException, OSError, ValueError):
        return None


def _member(text: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = made.compress(text) + made.flush()
    if len(data) + HEADER + 8 > 1 << 16:  # what doesn't shrink is stored
        made = zlib.compressobj(0, zlib.DEFLATED, -15)
        data = made.compress(text) + made.flush()
    return END[:16] + struct.pack("<H", len(data) + HEADER + 8 - 1) + data + struct.pack("<II", zlib.crc32(text), len(text))
