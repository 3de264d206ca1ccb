"""Genomic windows: tiles of base pairs, or runs of consecutive variants.

Rows need chrom, pos and ord.  Windows are evaluated in input order, as a reader of the file would:
a tile that positions leave and come back to is a window twice.

Rows that a file reader numbered stay in their splits: a first pass over chrom and pos gives one row of
totals for each split, these rows are carried on in order, and a second pass numbers each split's windows
from what was carried to it.  No row moves, and no task sees more than its split and one row for each
split.  Rows in any other order are first sorted in ranges, by all cores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .shared import materialised


@dataclass(frozen=True)
class WindowPolicy:
    """mode is bp or variants; only step == size is defined."""

    mode: str
    size: int
    step: int | None = None
    min_variants: int = 1

    def __post_init__(self):
        if self.mode not in ("bp", "variants"):
            raise ValueError("mode is bp or variants")
        if self.size <= 0 or (self.step is not None and self.step <= 0):
            raise ValueError("window size and step must be positive")
        if self.step not in (None, self.size):
            raise ValueError("sliding windows are not supported: step must equal size")
        if self.min_variants < 1:
            raise ValueError("min_variants must be at least 1")


def sorted_tiles(df: DataFrame, size: int) -> DataFrame:
    """Adds win_start for input sorted by position: no shuffle, no order."""
    return df.withColumn("win_start", (F.floor(F.col("pos") / size) * size).cast("int"))


_TOTALS = "file long, block long, part long, first_chrom string, first_tile long, last_chrom string, last_tile long, new long, first_run long, last_run long, whole boolean"
_CARRY = "file long, block long, part long, base long, chrom string, tile long, place long"


def _numbered(df: DataFrame) -> bool:
    """Whether a file reader numbered the rows."""
    order = df.schema["ord"].dataType
    return isinstance(order, StructType) and {"file", "block", "line"} <= set(order.names)


def _in_splits(df: DataFrame, contigs_together: bool) -> DataFrame:
    """Adds _split; its rows are together in one task, in order, and splits have the order of the input."""
    if _numbered(df):
        return df.withColumn("_split", F.struct(F.col("ord.file").cast("long").alias("file"), F.col("ord.block").alias("block"), F.expr("ord.line >> 33").alias("part")))
    keys = ["chrom", "ord"] if contigs_together else ["ord"]
    # written, so that both passes see the same ranges
    rows = materialised(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    return rows.withColumn("_split", F.struct(F.lit(0).cast("long").alias("file"), F.spark_partition_id().cast("long").alias("block"), F.lit(0).cast("long").alias("part")))


def _turns(policy: WindowPolicy, chroms: pa.Array, pos: np.ndarray, chrom: str | None, tile: int, place: int):
    """For rows that follow one of chrom and tile, the place-th of its contig's run: contig turns, window starts, tiles and places."""
    n = len(pos)
    turned = np.ones(n, bool)
    turned[0] = chroms[0].as_py() != chrom
    if n > 1:
        turned[1:] = pc.not_equal(chroms.slice(1), chroms.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    tiles = pos // policy.size
    if policy.mode == "bp":
        before = np.concatenate(([tile], tiles[:-1]))
        return turned, turned | (tiles != before), tiles, np.zeros(n, np.int64)
    begun = np.maximum.accumulate(np.where(turned, np.arange(n), -1))
    places = np.arange(n) - begun + np.where(begun < 0, place, 0) - (begun < 0)
    return turned, places % policy.size == 0, tiles, places


def _segments(batch: pa.RecordBatch, column: str):
    """(split, first row, end row) of the runs of rows of one split."""
    names = np.stack([f.to_numpy(zero_copy_only=False) for f in batch.column(batch.schema.get_field_index(column)).flatten()], axis=1)
    edges = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]).any(axis=1), [True]))) if len(names) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(names[a].tolist()), int(a), int(b)


def _split_totals(rows: DataFrame, policy: WindowPolicy) -> DataFrame:
    """One row for each split: its ends, its window starts and the lengths of its first and last runs of a contig."""
    schema = pa.schema([(n, pa.string() if "chrom" in n else pa.bool_() if n == "whole" else pa.int64()) for n in (x.split()[0] for x in _TOTALS.split(", "))])

    def total(batches):
        done, open_, at = [], None, None
        for batch in batches:
            for split, a, b in _segments(batch, "_split"):
                chroms, pos = batch.column("chrom").slice(a, b - a).fill_null(""), batch.column("pos").slice(a, b - a).to_numpy().astype(np.int64)
                fresh = split != at
                if fresh:
                    done += [open_] if open_ else []
                    at = split
                    open_ = dict(zip(("file", "block", "part"), split, strict=True)) | {"first_chrom": chroms[0].as_py(), "first_tile": int(pos[0] // policy.size), "last_chrom": None, "last_tile": 0, "new": 0, "first_run": 0, "last_run": 0, "whole": True}
                turned, new, tiles, places = _turns(policy, chroms, pos, open_["last_chrom"], open_["last_tile"], open_["last_run"])
                # what the first run holds depends on what is carried to it, so its windows are counted later
                first = fresh or open_["whole"]
                ends = np.flatnonzero(turned)[1 if fresh else 0 :] if first else np.zeros(0, np.int64)
                cut = int(ends[0]) if len(ends) else b - a if first else 0
                open_["first_run"] += cut
                open_["whole"] = first and not len(ends)
                open_["new"] += int(new[1 if fresh else 0 :].sum()) if policy.mode == "bp" else int(new[cut:].sum())
                open_["last_chrom"], open_["last_tile"] = chroms[b - a - 1].as_py(), int(tiles[-1])
                open_["last_run"] = int(places[-1]) + 1
        yield pa.RecordBatch.from_pylist(done + ([open_] if open_ else []), schema)

    return rows.select("_split", "chrom", "pos").mapInArrow(total, _TOTALS)


def _carried(totals: DataFrame, policy: WindowPolicy) -> DataFrame:
    """For each split the windows before it and the row before it; one task reads one row for each split."""
    size = policy.size

    def carry(rows: pd.DataFrame) -> pd.DataFrame:
        out, base, chrom, tile, place = [], 0, None, 0, 0
        for r in rows.sort_values(["file", "block", "part"]).itertuples(index=False):
            out.append((r.file, r.block, r.part, base, chrom, tile, place))
            goes_on = r.first_chrom == chrom
            if policy.mode == "bp":
                base += r.new + (not goes_on or r.first_tile != tile)
            else:
                had = place if goes_on else 0
                base += -(-(had + r.first_run) // size) - -(-had // size) + r.new
                place = had + r.first_run if r.whole else r.last_run
            chrom, tile = r.last_chrom, r.last_tile
        return pd.DataFrame(out, columns=[x.split()[0] for x in _CARRY.split(", ")])

    return totals.groupBy(F.lit(0).alias("all")).applyInPandas(carry, _CARRY)


def assign(df: DataFrame, policy: WindowPolicy, contigs_together: bool = True, positions: DataFrame | None = None) -> DataFrame:
    """Adds win_id, numbers that rise with the order; rows without a position are left out.

    Rows that a file reader numbered are taken in the files' order.  Others are taken by ord, and contigs
    apart from one another if contigs_together.  `positions`, written rows of ord, chrom and pos of the same numbered
    rows, spare the first of two passes over df.
    """
    names = [c for c in df.columns if c != "win_id"]
    rows = _in_splits(df.select(*names).where("pos is not null"), contigs_together)
    known = rows if positions is None or not _numbered(df) else _in_splits(positions.select("ord", "chrom", "pos").where("pos is not null"), contigs_together)
    carried = _carried(_split_totals(known, policy), policy).select(F.struct("file", "block", "part").alias("_split"), F.struct("base", "chrom", "tile", "place").alias("_carry"))
    found = rows.join(F.broadcast(carried), "_split").select(*names, "_split", "_carry")
    schema = StructType([*(df.schema[n] for n in names)]).add("win_id", LongType())

    def number(batches):
        at, base, chrom, tile, place = None, 0, None, 0, 0
        for batch in batches:
            ids, chroms, pos = [np.zeros(0, np.int64)], batch.column("chrom").fill_null(""), batch.column("pos").to_numpy().astype(np.int64)
            for split, a, b in _segments(batch, "_split"):
                if split != at:
                    at, given = split, batch.column("_carry")[a].as_py()
                    base, chrom, tile, place = given["base"], given["chrom"], given["tile"], given["place"]
                own = chroms.slice(a, b - a)
                _, new, tiles, places = _turns(policy, own, pos[a:b], chrom, tile, place)
                ids.append(base + np.cumsum(new))
                base, chrom, tile, place = int(ids[-1][-1]), own[b - a - 1].as_py(), int(tiles[-1]), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.concatenate(ids))], [*names, "win_id"])

    return found.mapInArrow(number, schema)


def bounds(df: DataFrame, policy: WindowPolicy) -> DataFrame:
    """(chrom, win_id, start, end, n) of assigned rows; half-open; n counts all lines with a position."""
    by_order = df.groupBy("chrom", "win_id").agg(F.min_by("pos", "ord").alias("first"), F.max_by("pos", "ord").alias("last"), F.count(F.lit(1)).alias("n"))
    if policy.mode == "bp":
        start = (F.floor(F.col("first") / policy.size) * policy.size).cast("int")
        out = by_order.select("chrom", "win_id", start.alias("start"), (start + policy.size).alias("end"), "n")
    else:
        out = by_order.select("chrom", "win_id", F.col("first").alias("start"), (F.col("last") + 1).alias("end"), "n")
    return out.where(F.col("n") >= policy.min_variants)
