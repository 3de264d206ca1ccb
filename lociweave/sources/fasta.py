"""FASTA and FASTQ files as DataFrames.

A record begins at a line with > or @, its sequence goes on until the next record or the + line.  A FASTQ
quality may hold lines that look like headers.  It is told from them by the length of the sequence: the quality ends where it
has that length and a line with > or @, or the end of the file, follows; if it comes to no such place, it ends
at the first line with > or @.  Qualities hold no white space, so a header with some is never taken for a line of one, whatever
the lengths.  A quality that is too short or empty takes nothing from the next record;
`odd_qualities` lists those whose length differs.  A record with > has no quality; what follows its + line is left out.

Lines are numbered within their splits where they are read, in one pass, and written; a row of totals for each split says what to add.  Each line that may be a header opens a candidate.  Where a quality ends is a property of
its candidate alone, found by the running length of all lines; nearly always that is the next candidate.
The others are jumps over candidates.  Whether a jump is taken depends on those before it, so blocks of
candidates give the place where they are left for each place where they may be entered, these are composed in
order, one row for about a million candidates, and each block keeps the jumps that are taken.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import clean_name, short_name
from ..operators.shared import written
from .text import ORDER, read_lines

#: candidates of a block, as a power of two
BLOCK_BITS = 20

#: white space within a line
_SPACED = "[ \t][^ \t]"
_SPLIT = ["file", "block", "part"]
_LINE = "file long, block long, part long, cand long, g long, len long, mark string, sure long, spaced boolean, value string"


def _lines(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, bool]:
    """The lines that aren't blank, trimmed: file, cand (number of the last line that may be a header, or begins a file), g
    (length of all lines before), len, mark (first character if it is one of @ > +), spaced (a header with white space), sure (number of
    these before); and whether there is a + line.
    """
    split = F.struct(F.col("ord.file").cast("long").alias("file"), F.col("ord.block").alias("block"), F.expr("ord.line >> 33").alias("part"))
    lines = read_lines(spark, paths).select(split.alias("split"), F.trim("value").alias("value")).where("value <> ''")

    def number(batches):
        at, cand, g, sure = None, 0, 0, 0
        for batch in batches:
            value = batch.column("value")
            names = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.column("split").flatten()], axis=1)
            size = pc.utf8_length(value).to_numpy().astype(np.int64)
            mark = pc.utf8_slice_codeunits(value, 0, 1)
            heads = pc.is_in(mark, pa.array([">", "@"])).to_numpy(zero_copy_only=False)
            spaced = heads & pc.match_substring_regex(value, _SPACED).to_numpy(zero_copy_only=False)
            mark = pc.if_else(pc.is_in(mark, pa.array([">", "@", "+"])), mark, "")
            cands, gs, sures = (np.zeros(len(value), np.int64) for _ in range(3))
            edges = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1), [True]))) if len(value) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tuple(names[a]) != at:
                    at, cand, g, sure = tuple(names[a]), 0, 0, 0
                cands[a:b] = cand + np.cumsum(heads[a:b])
                gs[a:b] = g + np.cumsum(size[a:b]) - size[a:b]
                sures[a:b] = sure + np.cumsum(spaced[a:b]) - spaced[a:b]
                cand, g, sure = int(cands[b - 1]), int(gs[b - 1] + size[b - 1]), int(sures[b - 1] + spaced[b - 1])
            yield pa.RecordBatch.from_arrays([*(pa.array(names[:, k]) for k in range(3)), pa.array(cands), pa.array(gs), pa.array(size), mark, pa.array(sures), pa.array(spaced), value], [x.split()[0] for x in _LINE.split(", ")])

    # numbers within a split are written with it: a second scan might be split otherwise, as Spark looks at the cores there are
    own = written(lines.mapInArrow(number, _LINE))
    # one row for each split: its sums, and whether its first line is a header
    begins = F.bool_or((F.col("g") == 0) & F.col("mark").isin(">", "@"))
    totals = own.groupBy(*_SPLIT).agg(F.max("cand").alias("heads"), F.count_if(F.col("mark") == "+").alias("pluses"), F.max(F.col("sure") + F.col("spaced").cast("long")).alias("sures"), F.max(F.col("g") + F.col("len")).alias("size"), begins.alias("begins"))
    opens = ((F.row_number().over(Window.partitionBy("file").orderBy("block", "part")) == 1) & ~F.col("begins")).cast("long")
    counted = totals.withColumn("opens", opens).withColumn("cands", F.col("heads") + F.col("opens"))
    before = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    carried = written(counted.select(*_SPLIT, "pluses", (past("cands") + F.col("opens")).alias("cands"), past("size").alias("sizes"), past("sures").alias("sures")))
    whole = own.join(F.broadcast(carried.drop("pluses")), _SPLIT)  # a row a split
    lines = whole.select("file", (F.col("cand") + F.col("cands")).alias("cand"), (F.col("g") + F.col("sizes")).alias("g"), "len", "mark", (F.col("sure") + F.col("sures")).alias("sure"), "spaced", "value")
    return lines, not carried.where("pluses > 0").isEmpty()


def _candidates(lines: DataFrame) -> DataFrame:
    """One row a candidate: its file, first line, extent, and its first + line."""
    line = F.struct("g", "len", "mark")
    found = lines.groupBy("cand").agg(F.first("file").alias("file"), F.min(line).alias("first"), F.sum("len").alias("size"), F.min("sure").alias("sure"), F.bool_or("spaced").alias("spaced"), F.min(F.when(F.col("mark") == "+", line)).alias("plus"))
    start = F.col("first.g") + F.col("first.len")
    found = found.select("cand", "file", "sure", (F.col("sure") + F.col("spaced").cast("long")).alias("sure_after"), F.col("first.mark").alias("mark"), F.col("first.len").alias("header"), F.col("first.g").alias("g"), (F.col("first.g") + F.col("size")).alias("end"), start.alias("start"), F.coalesce("plus.g", F.col("first.g") + F.col("size")).alias("stop"), (F.col("plus.g") + F.col("plus.len")).alias("quality"))
    # where the quality has the length of the sequence
    return found.withColumn("full", F.when(F.col("mark") == "@", F.col("quality") + F.col("stop") - F.col("start")))


def _jumps(candidates: DataFrame) -> DataFrame:
    """(rec, to): candidates whose quality ends beyond the next candidate, at `to`, with no header between that has white space."""
    last = candidates.groupBy("file").agg(F.max("end").alias("full"), (F.max("cand") + 1).alias("to"), F.max("sure_after").alias("sure"))
    borders = candidates.select("file", F.col("g").alias("full"), F.col("cand").alias("to"), "sure").union(last.select("file", "full", "to", "sure"))
    beyond = candidates.where(F.col("full") > F.col("end")).select("file", "full", F.col("cand").alias("rec"), F.col("sure_after").alias("sure"))
    return beyond.join(borders, ["file", "full", "sure"]).select("rec", "to")


def _taken(jumps: DataFrame, bits: int) -> DataFrame:
    """Of the jumps those that are taken when candidates are followed from the first."""
    spark = jumps.sparkSession
    block = lambda c: F.shiftright(c, bits)
    crossing = jumps.where(block("rec") < block("to")).select(block("to").alias("block"), F.col("to").alias("rec"), F.lit(None).cast("long").alias("to"))
    kind = "block long, entry long, exit long, rec long, to long"

    def leave(table: pa.Table) -> pa.Table:
        b, rec, to = table.column("block")[0].as_py(), table.column("rec").to_pylist(), table.column("to").to_pylist()
        starts = dict(sorted((r, t) for r, t in zip(rec, to, strict=True) if t is not None))
        order, rows = list(starts), []
        for entry in {b << bits, *(r for r, t in zip(rec, to, strict=True) if t is None)}:
            at, k = entry, bisect.bisect_left(order, entry)
            while k < len(order):
                at = starts[order[k]]
                rows.append((b, entry, None, order[k], at))
                k = bisect.bisect_left(order, at)
            rows.append((b, entry, at, None, None))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["block", "entry", "exit", "rec", "to"])

    found = written(jumps.select(block("rec").alias("block"), "rec", "to").union(crossing.distinct()).groupBy("block").applyInArrow(leave, kind))
    at, entered = 0, []
    exits = {(r["block"], r["entry"]): r["exit"] for r in found.where("rec is null").select("block", "entry", "exit").collect()}
    for b in sorted({k[0] for k in exits}):
        if at >> bits <= b:
            entry = max(at, b << bits)
            entered.append((b, entry))
            at = max(at, exits[b, entry])
    return found.where("rec is not null").join(spark.createDataFrame(entered, "block long, entry long"), ["block", "entry"]).select("rec", "to")


def _records(spark: SparkSession, paths: list[str] | str) -> tuple[DataFrame, DataFrame]:
    """Lines with rec, the candidate of their record, and inside (in a quality that went beyond a candidate); and one row a record."""
    lines, qualities = _lines(spark, paths)
    candidates = _candidates(lines)
    if qualities:
        candidates = written(candidates)
        jumps = written(_jumps(candidates))
        if not jumps.isEmpty():
            taken = _taken(jumps, BLOCK_BITS)
            inner = written(taken.select(F.col("rec").alias("into"), "to", F.explode(F.expr("sequence(rec + 1, to - 1)")).alias("cand")))
            lines = lines.join(inner.select("cand", "into"), "cand", "left").select(F.coalesce("into", "cand").alias("rec"), F.col("into").isNotNull().alias("inside"), *lines.columns)
            ends = inner.groupBy(F.col("into").alias("cand")).agg(F.max("to").alias("to")).join(candidates.select((F.col("cand") + 1).alias("to"), F.col("end").alias("last")), "to")
            candidates = candidates.join(inner, "cand", "left_anti").join(ends.select("cand", "last"), "cand", "left").withColumn("end", F.coalesce("last", "end"))
    if "rec" not in lines.columns:
        lines = lines.select(F.col("cand").alias("rec"), F.lit(False).alias("inside"), *lines.columns)
    return lines, candidates.withColumnRenamed("cand", "rec")


def _good(records: DataFrame) -> DataFrame:
    """Records with a name and a sequence, numbered in order."""
    found = records.where((F.col("mark") != "") & (F.col("mark") != "+") & (F.col("header") > 1) & (F.col("stop") > F.col("start")))
    return _dense_ids(found, "rec")


def read_fasta(spark: SparkSession, paths: list[str] | str, keep_quality: bool = False) -> DataFrame:
    """seq_id (1.. in order), short_name, name, seq and, if asked for, qual; a sequence is one row."""
    lines, records = _records(spark, paths)
    good = _good(records).select("rec", F.col("dense").alias("seq_id"))
    whole = lines.groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("g", "inside", "mark", "value"))).alias("l"))
    whole = whole.select("rec", F.get("l", F.lit(0))["value"].alias("header"), F.expr("slice(l, 2, size(l))").alias("body"))
    plus = F.array_position(F.transform("body", lambda x: (x["mark"] == "+") & ~x["inside"]), F.lit(True)).cast("int")
    text = lambda part: F.array_join(F.transform(F.expr(part), lambda x: x["value"]), "")
    whole = whole.withColumn("plus", plus).select("rec", "header", text("if(plus > 0, slice(body, 1, plus - 1), body)").alias("seq"), F.when((F.col("plus") > 0) & F.col("header").startswith("@"), text("slice(body, plus + 1, size(body))")).alias("qual"))
    return whole.join(good, "rec").select("seq_id", short_name(F.col("header")).alias("short_name"), clean_name(F.col("header")).alias("name"), "seq", *[F.col("qual")] * keep_quality)


def read_sequence_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """seq_id, short_name, at, value: the lines of the sequences and how many bases of theirs are before each.

    For sequences that are too long for a row, as chromosomes are.
    """
    lines, records = _records(spark, paths)
    good = _good(records).select("rec", "start", "stop", F.col("dense").alias("seq_id"))
    headers = lines.where("mark in ('@', '>') and not inside").select("rec", "g", "value").join(good.select("rec", (F.col("start")).alias("s")), "rec").where(F.col("g") < F.col("s"))
    named = good.join(headers.select("rec", short_name(F.col("value")).alias("short_name")), "rec")
    inner = lines.where("not inside").join(named, "rec").where((F.col("g") >= F.col("start")) & (F.col("g") < F.col("stop")))
    return inner.select("seq_id", "short_name", (F.col("g") - F.col("start")).alias("at"), "value")


def odd_qualities(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """seq_id, bases, qualities of FASTQ records whose quality is shorter or longer than their sequence."""
    good = _good(_records(spark, paths)[1]).where("mark = '@'")
    bases, qualities = F.col("stop") - F.col("start"), F.col("end") - F.coalesce("quality", "end")
    return good.select(F.col("dense").alias("seq_id"), bases.alias("bases"), qualities.alias("qualities")).where("bases <> qualities")


def _dense_ids(df: DataFrame, key: str, block: int = 100_000) -> DataFrame:
    """dense 1.. in the order of key: counted within blocks of keys, plus the blocks' running totals."""
    df = df.withColumn("blk", F.floor(F.col(key) / block))
    totals = df.groupBy("blk").count()
    totals = totals.select("blk", F.coalesce(F.sum("count").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("blk").orderBy(key))
    return df.withColumn("own", own).join(F.broadcast(totals), "blk").withColumn("dense", (F.col("own") + F.col("base")).cast("int"))
