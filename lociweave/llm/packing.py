"""Best-fit packing of tokenised documents into fixed-length sequences.

A document becomes its token ids and an end id.  Only documents longer than a
sequence are cut; the first piece takes the odd rest, so each document leaves at
most one piece that is not full.  Pieces are dealt evenly into groups of bounded
size, and each group is packed by vector best-fit, largest first: a bin has
residual tokens, residual documents and residual attention cost (the sum of
squared lengths); a piece goes where all three suffice and the weighted norm of
what would remain is smallest, or the weighted dot product with the piece's needs
is largest.  Ties go to the oldest bin.

Null text counts as empty (its end id is its only token); rows without doc_id
and repeated rows are packed like any other; a very long text is encoded whole by one
task and cut; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed, text_slices
from .tokens import codec, piece_pattern, vocabulary

GROUP_PIECES = 1 << 14


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; by default only its length binds, as no document has under one token."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.1)
    rule: str = "norm"  # or "dot"


def token_pieces(docs: DataFrame, content: str, capacity: Capacity, end_id: int | None = 2, ranks: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and its ids on demand; ranks as in `codec`."""
    shared = docs.sparkSession.sparkContext.broadcast((content, ranks))
    size = capacity.tokens
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    tail = () if end_id is None else (end_id,)

    def cut_up(batches):
        encoder = codec(shared.value[0], "space", shared.value[1])
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(hi - lo)]
                ids, bounds = encoder.encode(texts, tail)
                ids = ids.astype("<u4")
                counts = np.diff(bounds)
                pieces = np.maximum(1, -(-counts // size))
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = counts - (pieces - 1) * size  # the first piece may be shorter
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * size)
                length = np.where(piece == 0, head[row], size)
                at = bounds[:-1][row] + start
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([ids[a : a + n].astype(np.int32) for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return docs.select("doc_id", "text").mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; vector best-fit with the largest pieces first."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    scale = np.array(capacity.weights) / full
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rest, names = np.zeros((3, max(1, len(lengths)))), np.zeros(max(1, len(lengths)), np.int64)
    opened, live = 0, 0
    smallest = lengths.min() if len(lengths) else 1
    for k in order:
        n = float(lengths[k])
        need = np.array([n, 1.0, n * n])
        if (need > full).any():
            raise ValueError(f"a piece of {int(n)} tokens exceeds the capacity of an empty sequence")
        own = rest[:, :live]
        fits = (own[0] >= need[0]) & (own[1] >= need[1]) & (own[2] >= need[2])
        if fits.any():
            if capacity.rule == "dot":
                value = np.where(fits, -(scale[:, None] * own * (scale * need)[:, None]).sum(axis=0), np.inf)
            else:
                left = (own - need[:, None]) * scale[:, None]
                value = np.where(fits, (left * left).sum(axis=0), np.inf)
            b = int(value.argmin())
        else:
            b = live
            rest[:, b], names[b] = full, opened
            opened, live = opened + 1, live + 1
        bins[k], offsets[k] = names[b], int(full[0] - rest[0, b])
        rest[:, b] -= need
        if rest[0, b] < smallest or rest[1, b] < 1:  # nothing fits any more; the order of the others stays
            rest[:, b : live - 1], names[b : live - 1] = rest[:, b + 1 : live].copy(), names[b + 1 : live].copy()
            live -= 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", capacity: Capacity = Capacity(), end_id: int | None = 2, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on demand)."""
    by_rank = (vocabulary(ranks), piece_pattern()) if ranks else None
    pieces = checkpointed(token_pieces(docs, vocabulary(tokenizer), capacity, end_id, by_rank, with_ids))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(groups)))

    def place(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py() if table.num_rows else 0
        bins, offsets = best_fit(table.column("length").to_numpy(), capacity)
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins + (group << 32))).append_column("offset", pa.array(offsets))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(place, schema)
