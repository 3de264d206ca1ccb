"""Lines of plain and compressed text files, with an order."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import os
import shutil
import sys
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from . import bgzf

MAGIC = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ\x00": "xz"}
_OPENERS = {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}
_BY_SUFFIX = {"gzip": ".gz", "bzip2": ".bz2"}
#: orders lines: file, start of the split in it, number of the line in the split
ORDER = "ord"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def expand(spark: SparkSession, paths: list[str]) -> list[str]:
    """A directory becomes its files (not those below, none that Spark takes for hidden), in order of name; - spools standard input."""
    out = []
    for path in paths:
        if path == "-":
            path = _spool(spark)
        p, fs = _path(spark, path)
        if fs.getFileStatus(p).isDirectory():
            out += sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
        else:
            out.append(fs.makeQualified(p).toString())
    return out


def _spool(spark: SparkSession) -> str:
    """Standard input as a file of the shared folder, as executors must read it."""
    handle, name = tempfile.mkstemp(prefix="stdin-")
    with os.fdopen(handle, "wb") as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    target, fs = _path(spark, f"{shared_folder(spark)}/{os.path.basename(name)}")
    fs.moveFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(name), target)
    return target.toString()


class _HadoopFile(io.RawIOBase):
    """Bytes of a file of any file system that Spark reads, from its beginning."""

    def __init__(self, spark: SparkSession, path: str):
        p, fs = _path(spark, path)
        self.stream = fs.open(p)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.readNBytes(min(len(buffer), 1 << 16))
        buffer[: len(data)] = data
        return len(data)

    def close(self):
        if not self.closed:
            self.stream.close()
        super().close()


def head_lines(spark: SparkSession, path: str):
    """The lines of a file from its first, decompressed; only as much is read as is asked for."""
    kind = compression(spark, path)
    with _HadoopFile(spark, path) as raw, io.BufferedReader(raw, 1 << 16) as plain:
        opened = _OPENERS[kind](plain, "rb") if kind else plain
        for line in opened:
            yield line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")


def numbered(lines: DataFrame, flag) -> DataFrame:
    """Adds rec: how many flagged lines there are up to a line, over all files in order.

    Lines are counted within their splits; only one row of totals for each split is ordered globally.
    """
    split = [F.col("ord.file").alias("file"), F.col("ord.block").alias("block"), F.expr("ord.line >> 33").alias("part")]
    lines = lines.select("*", *split).withColumn("flag", flag.cast("long"))
    within = Window.partitionBy("file", "block", "part").orderBy("ord.line").rowsBetween(Window.unboundedPreceding, 0)
    totals = lines.groupBy("file", "block", "part").agg(F.sum("flag").alias("n"))
    before = Window.orderBy("file", "block", "part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "block", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return lines.withColumn("own", F.sum("flag").over(within)).join(F.broadcast(totals), ["file", "block", "part"]).withColumn("rec", F.col("own") + F.col("base"))


def compression(spark: SparkSession, path: str) -> str | None:
    """gzip, bzip2 or xz by the first bytes, whatever the name says."""
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        head = bytes(b for b in (stream.read() for _ in range(6)) if b >= 0)
    finally:
        stream.close()
    return next((kind for magic, kind in MAGIC.items() if head.startswith(magic)), None)


def _block_size(spark: SparkSession, path: str) -> int:
    """The size of a block-gzipped file that tasks can open themselves, 0 of another."""
    with _HadoopFile(spark, path) as raw:
        head = io.BufferedReader(raw, bgzf.HEADER).read(bgzf.HEADER)
    if bgzf.member_size(head) is None or bgzf.opened(path) is None:
        return 0
    p, fs = _path(spark, path)
    return fs.getFileStatus(p).getLen()


def _split_bytes(spark: SparkSession) -> int:
    """The size of a split that Spark uses for files."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(ord, value) of all lines; sorting by ord gives the lines of the files in the order of the paths.

    Spark splits what it can read itself, and block-gzipped files are read by splits of the size that it uses.  Another
    file whose compression its name hides is read whole by one task; lines keep everything but their end.
    """
    files = expand(spark, [paths] if isinstance(paths, str) else list(paths))
    number, kinds = {f: k for k, f in enumerate(files)}, {f: compression(spark, f) for f in files}
    blocks = [(number[f], f, size) for f in files if kinds[f] == "gzip" and (size := _block_size(spark, f))]
    files = [f for f in files if f not in {b[1] for b in blocks}]
    plain = [f for f in files if kinds[f] is None and not f.endswith((".gz", ".bz2"))]
    native = plain + [f for f in files if kinds[f] and f.endswith(_BY_SUFFIX.get(kinds[f], "\0"))]
    hidden = [f for f in files if f not in native]
    parts = []
    if blocks:
        order = F.struct("file", "block", "line")
        parts.append(bgzf.read_splits(spark, blocks, _split_bytes(spark)).select(order.alias(ORDER), "value"))
    if native:
        name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
        index = F.create_map(*[x for f in native for x in (F.lit(_plain(f)), F.lit(number[f]))])
        order = F.struct(index[name].alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        parts.append(spark.read.text(native).select(order.alias(ORDER), "value"))
    for f in hidden:
        opener = _OPENERS.get(kinds[f])

        def unpack(batches, opener=opener):
            for batch in batches:
                for content in batch.column(0).to_pylist():
                    raw = io.BytesIO(content)
                    lines, at = [], 0
                    for line in opener(raw, "rb") if opener else raw:
                        lines.append(line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                        if len(lines) == 65536:
                            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], ["line", "value"])
                            at, lines = at + len(lines), []
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["line", "value"])

        lines = spark.read.format("binaryFile").load(f).select("content").mapInArrow(unpack, "line long, value string")
        order = F.struct(F.lit(number[f]).alias("file"), F.lit(0).cast("long").alias("block"), "line")
        parts.append(lines.select(order.alias(ORDER), "value"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _plain(path: str) -> str:
    import re

    return re.sub("^file:/+", "file:/", path)
