"""Exact dedup by counting quotient filters and byte verification.

Every partition builds counting quotient filters over the 64-bit fingerprints of
its normalised texts: the high bits (quotient) pick a run, the low bits
(remainder) are kept sorted in their run, each with a count.  Filters of one
block of quotients merge without loss, as sorted remainders do, so a merged
filter holds the exact count of every fingerprint.  Only texts whose fingerprint
counts more than once are compared, by grouping on the text itself; partial
aggregation brings one copy per partition and text to the shuffle, however large
the group.

Null text counts as empty.  The row with the smallest doc_id stays.  `exact_dedup`
marks rows that repeat both doc_id and text alike; `keep_first_copies` leaves one, the row
whose columns sort first as JSON.  Rows without doc_id stay only when their whole group
has none.  Texts of any length are compared whole.  An empty table gives an empty result.
Columns of the documents may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed, one_of_equals, quoted, unused

#: fingerprints of one block of quotients, on average: the least and the most
BLOCK_ROWS, MAX_BLOCK_ROWS = 1 << 16, 1 << 22
#: blocks are made larger rather than more than these, so that a partial filter holds many fingerprints of each
BLOCKS = 1 << 12
#: fingerprints gathered before a partial filter is passed on
FLUSH_ROWS = 1 << 21
REMAINDER_BITS = 40
#: most repeated fingerprints that are broadcast (8 bytes each); more are joined by a shuffle
BROADCAST_ROWS = 500_000

_FILTER = "block long, quotients binary, run_lengths binary, remainders binary, counts binary"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space; single spaces are left alone for speed."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _pack(block: int, fingerprints: np.ndarray, counts: np.ndarray) -> dict:
    """A filter from sorted distinct fingerprints: runs by quotient, remainders sorted in each."""
    quotients, run_lengths = np.unique(fingerprints >> np.uint64(REMAINDER_BITS), return_counts=True)
    remainders = fingerprints & np.uint64((1 << REMAINDER_BITS) - 1)
    return {"block": block, "quotients": quotients.astype("<u4").tobytes(), "run_lengths": run_lengths.astype("<u4").tobytes(), "remainders": remainders.astype("<u8").tobytes(), "counts": counts.astype("<i8").tobytes()}


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    quotients, lengths = np.frombuffer(row["quotients"], "<u4").astype(np.uint64), np.frombuffer(row["run_lengths"], "<u4")
    return np.repeat(quotients << np.uint64(REMAINDER_BITS), lengths) | np.frombuffer(row["remainders"], "<u8"), np.frombuffer(row["counts"], "<i8")


def merge_filters(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Lossless merge: equal remainders of a quotient meet when sorted, and their counts add up."""
    fingerprints, counts = (np.concatenate(x) for x in zip(*filters, strict=True))
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], fingerprints[1:] != fingerprints[:-1])))
    return fingerprints[first], np.add.reduceat(counts, first)


def quotient_filters(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """Partial counting quotient filters of the single long column, by block of quotients."""
    schema = pa.schema([("block", pa.int64()), *((k, pa.binary()) for k in ("quotients", "run_lengths", "remainders", "counts"))])

    def flush(parts):
        found, counts = np.unique(np.concatenate(parts), return_counts=True)
        blocks = found >> np.uint64(64 - block_bits) if block_bits else np.zeros(len(found), np.uint64)
        edges = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1], [True])))
        rows = [_pack(int(blocks[a]), found[a:b], counts[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_pylist(rows, schema)

    def build(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                held += batch.num_rows
            if held >= FLUSH_ROWS:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return fingerprints.mapInArrow(build, _FILTER)


def repeated_fingerprints(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """(fp, copies) of the fingerprints that the merged filters count more than once."""

    def merged(table: pa.Table) -> pa.Table:
        found, counts = merge_filters([_unpack(r) for r in table.to_pylist()])
        more = counts > 1
        return pa.table({"fp": found[more].view(np.int64), "copies": counts[more]})

    return quotient_filters(fingerprints, block_bits).groupBy("block").applyInArrow(merged, "fp long, copies long")


def block_bits_for(rows: int) -> int:
    """Bits that name a block of quotients of so many fingerprints in all."""
    size = min(max(BLOCK_ROWS, rows // BLOCKS), MAX_BLOCK_ROWS)
    return min(24, (rows // size).bit_length())


def _repeated(text: DataFrame, rows: int, broadcast_rows: int):
    """The repeated fingerprints of column norm, and how to bring what follows from them to the rows."""
    found = checkpointed(repeated_fingerprints(text.select(F.xxhash64("norm").alias("fp")), block_bits_for(rows)).select("fp"))
    return found, F.broadcast if found.count() <= broadcast_rows else (lambda df: df)


def _groups(text: DataFrame, repeated: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) of each text that more than one row has."""
    return (
        text.withColumn("fp", F.xxhash64("norm"))
        .join(repeated, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    repeated, at_hand = _repeated(norm, docs.count(), broadcast_rows)
    text = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"))
    out = text.join(at_hand(_groups(norm, at_hand(repeated))), "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_first_copies(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that stay, with their own columns; of rows that repeat doc_id and text one stays."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    repeated, at_hand = _repeated(norm, docs.count(), broadcast_rows)
    fp, sha, keep, grouped = unused(docs.columns, "fp", "sha", "keep", "grouped")
    groups = _groups(norm, at_hand(repeated)).select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.lit(True).alias(grouped))
    repeated = at_hand(repeated.withColumnRenamed("fp", fp))
    text = normalised(F.col("text"))
    marked = docs.withColumn(fp, F.xxhash64(text))
    single = marked.join(repeated, fp, "left_anti").select(*map(quoted, docs.columns))
    # a text that only shares a fingerprint has no group, and is the only one of its kind
    shared = marked.join(repeated, fp, "left_semi").withColumn(sha, F.sha2(text, 256)).join(at_hand(groups), sha, "left")
    first = shared.where(F.col(grouped).isNull() | F.col("doc_id").eqNullSafe(F.col(keep)))
    return single.unionByName(one_of_equals(first, [sha], docs.columns))
