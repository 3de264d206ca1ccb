"""Substring dedup: remove every word of a repeated window of words.

Windows of `width` consecutive words are judged on the whole input.  Documents are dealt
into buckets of bounded size.  A first pass sketches the windows.  Each is represented by
its anchor, the run of ANCHOR words in it with the smallest hash: equal windows have equal
anchors, so an anchor is found at least as often as any of its windows, and neighbouring
windows share one, so that there are about fourteen times fewer.  A bucket's sketch is its
sparse count-min rows; sketches are merged shard by shard, cell by cell, and each bucket
learns which of its cells count two or more in all.  The merged sketch never gives less
than the true number of any window.

The second pass looks only at windows that the sketch estimates at two or more.
A bucket sends each distinct 128-bit hash of its candidate windows once, with a flag if it
has it twice, to the hash's shard.  A shard marks those that more buckets or a flag have,
and returns one bit for each.  A hot passage costs a bucket one entry.  The bucket
then forms the same candidates again, reads the bits and removes the words.

The sketch is never in one place: shards, their number and the buckets' size follow the
size of the input, and a bucket visits only shards that its own hashes name, so work and
shuffle are in proportion to the words.

Null text has no words.  Repeated rows, with or without doc_id, are copies like
any other, so all their windows are repeated, and they are spread over the buckets.  A very
long text is a row of its own size.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._text import mix, quoted, rolling, run_hashes, span_hashes, spans, text_slices

WIDTH = 35
ANCHOR = 8
ROWS = 2
#: bytes of a bucket's texts: least and most, and the number of buckets from which they grow
BUCKET_BYTES, MAX_BUCKET_BYTES, BUCKETS = 2 << 20, 32 << 20, 1 << 16
#: cells of a shard, and bits that name a shard: least and most
SHARD_CELLS = 1 << 20
MIN_SHARD_BITS, MAX_SHARD_BITS = 8, 16


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each anchor in a row of the sketch."""
    return mix(anchors + np.uint64(row + 1)) >> np.uint64(64 - bits)


@dataclass(frozen=True)
class Layout:
    """How an input of so many bytes is dealt: buckets, bits of a cell and bits of a shard."""

    buckets: int
    bits: int
    shard_bits: int

    @classmethod
    def of(cls, size: int) -> Layout:
        bucket = min(max(BUCKET_BYTES, size // BUCKETS), MAX_BUCKET_BYTES)
        bits = sketch_bits(size / 6)
        shard_bits = min(max(MIN_SHARD_BITS, bits - SHARD_CELLS.bit_length() + 1), MAX_SHARD_BITS, bits)
        return cls(max(1, -(-size // bucket)), min(bits, shard_bits + 32), shard_bits)


class Windows:
    """The windows of consecutive texts: which are whole, their anchors and where the words are."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.data, self.width, self.anchor_words = data, width, min(ANCHOR, width)
        self.starts, self.ends, self.first = spans(data, offsets)
        self.hashes = span_hashes(data, self.starts, self.ends)
        self.count = max(0, len(self.hashes) - width + 1)
        row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(self.first))
        self.row = row
        self.whole = row[width - 1 :] == row[: self.count] if self.count else np.zeros(0, bool)
        grams = run_hashes(self.hashes, self.anchor_words) | np.uint64(1)
        reach = width - self.anchor_words + 1
        self.grams = grams
        self.anchors = rolling(grams, reach) if self.count else np.zeros(0, np.uint64)

    def selected(self) -> np.ndarray:
        """Hashes of the places that are the anchor of some whole window, one for each place."""
        if not self.count:
            return np.zeros(0, np.uint64)
        reach = self.width - self.anchor_words + 1
        own = np.where(self.whole, self.anchors, np.uint64(0))
        padded = np.concatenate((np.zeros(reach - 1, np.uint64), own, np.zeros(reach - 1, np.uint64)))
        return self.grams[rolling(padded, reach, np.maximum) == self.grams]

    def candidates(self, anchors: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Places of whole windows whose anchor, of the sorted ones, is flagged."""
        at = np.flatnonzero(self.whole)
        return at[repeated[np.searchsorted(anchors, self.anchors[at])]]

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        """(n, 2) hashes of the windows at the given places."""
        second = span_hashes(self.data, self.starts, self.ends, lane=1)
        return np.stack([run_hashes(self.hashes, self.width)[at], run_hashes(second, self.width)[at]], axis=1)


def sketch_bits(words: float) -> int:
    """Cells for about two of each anchor, a fourteenth of the words."""
    return int(np.clip(int(max(1, words / 7)).bit_length(), 16, 48))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, the sum of each one's counts, and where each given key went."""
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, counts, len(found)), back


def _runs(shards: np.ndarray) -> np.ndarray:
    """Edges of the runs of equal values among sorted ones."""
    return np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))) if len(shards) else np.zeros(1, np.int64)


def _binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values[edges[k]:edges[k+1]] as bytes, one binary for each k."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * width).astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct rows of (n, 2) hashes, the number of each, and where each given row went."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(hashes[:, 0], kind="stable")
    ordered = hashes[order]
    tied = ordered[1:, 0] == ordered[:-1, 0]
    if (tied & (ordered[1:, 1] != ordered[:-1, 1])).any():
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        ordered = hashes[order]
    new = np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(axis=1)))
    first = np.flatnonzero(new)
    back = np.empty(len(hashes), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[first], np.diff(np.append(first, len(hashes))), back


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (its other words joined by one space)."""
    return _run(docs, width, ["doc_id"], whole=False).select("row.doc_id", "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents with their own columns; a text that loses words becomes its other words joined by one space.

    n_chars, where there is such a column, becomes the length of a changed text.
    """
    rest = [c for c in docs.columns if c != "text"]
    done = _run(docs, width, rest, whole=True)
    changed = F.col("n_removed") > 0

    def column(name: str):
        if name == "text":
            return F.col("kept_text")
        own = F.col("row").getField(f"c{rest.index(name)}") if name != "doc_id" else F.col("row.doc_id")
        return F.when(changed, F.length("kept_text")).otherwise(own).cast(docs.schema[name].dataType) if name == "n_chars" else own

    return done.select(*[column(c).alias(c) for c in docs.columns])


def _run(docs: DataFrame, width: int, carried: list[str], whole: bool) -> DataFrame:
    """row (a struct of the carried columns), n_words, n_removed, kept_text; whole: texts that lose no word stay as they are."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    layout = Layout.of((size["bytes"] or 0) + 64 * size["n"])
    bits, shard_bits = layout.bits, layout.shard_bits
    # any names may be carried: they are numbered in the struct
    row = F.struct(*[quoted(c).alias("doc_id" if c == "doc_id" else f"c{k}") for k, c in enumerate(carried)])
    # by content alone, so that a map task that runs again deals its rows alike for all passes
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(layout.buckets)).cast("int")
    dealt = docs.select(row.alias("row"), "text", bucket.alias("bucket"))

    def windows_of(table: pa.Table):
        """The bucket's texts by slice, and the sorted distinct anchors of all their windows."""
        slices = [(lo, hi, data, offsets, Windows(data, offsets, width)) for lo, hi, data, offsets in text_slices(table.column("text").combine_chunks())]
        return slices, np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.anchors[w.whole] for *_, w in slices)]))

    def cell_runs(anchors: np.ndarray, k: int, counts: np.ndarray):
        """Sorted cells of a row of the sketch, their counts, where each anchor's cell is, and the edges of shards."""
        cells, counts, back = _added(_cells(anchors, k, bits), counts)
        return cells, counts, back, _runs(cells >> np.uint64(bits - shard_bits))

    def sketch(table: pa.Table) -> pa.Table:
        """The bucket's sparse sketch, a row for each shard that it has cells in."""
        slices, _ = windows_of(table)
        anchors, places = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.selected() for *_, w in slices)]), return_counts=True)
        parts = []
        for k in range(ROWS):
            cells, counts, _, edges = cell_runs(anchors, k, places)
            shards = (cells[edges[:-1]] >> np.uint64(bits - shard_bits)).astype(np.int32) + (k << shard_bits)
            low = (cells & np.uint64((1 << (bits - shard_bits)) - 1)).astype("<u4")
            parts.append(pa.table({"shard": pa.array(shards), "bucket": pa.array(np.full(len(shards), table.column("bucket")[0].as_py() if len(shards) else 0, np.int32)), "cells": _binaries(low, edges), "counts": _binaries(np.minimum(counts, 255).astype(np.uint8), edges)}))
        return pa.concat_tables(parts)

    def estimate(table: pa.Table) -> pa.Table:
        """A shard's merged sketch, read for each bucket: one bit for each of its cells, set if it counts two or more."""
        held = [np.frombuffer(x, "<u4") for x in table.column("cells").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("counts").to_pylist()])
        _, sums, back = _added(np.concatenate(held), counts)
        return answers(table, sums[back] > 1, held)

    def answers(table: pa.Table, flags: np.ndarray, held: list) -> pa.Table:
        ends = np.cumsum([len(h) for h in held])
        packed = [np.packbits(flags[e - len(h) : e]).tobytes() for e, h in zip(ends.tolist(), held, strict=True)]
        return pa.table({"bucket": table.column("bucket"), "shard": table.column("shard"), "bits": pa.array(packed, pa.binary())})

    def read(verdicts: dict[int, bytes], first: int, shards: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The flags of sorted values whose shards have these edges."""
        names = (shards[edges[:-1]].astype(np.int64) + first).tolist()
        parts = [np.unpackbits(np.frombuffer(verdicts[n], np.uint8), count=b - a) for n, a, b in zip(names, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)

    def candidates(table: pa.Table, verdicts: dict[int, bytes]):
        """The slices with the places of their candidate windows, and all candidates' distinct hashes."""
        slices, anchors = windows_of(table)
        repeated = np.ones(len(anchors), bool)
        for k in range(ROWS):
            cells, _, back, edges = cell_runs(anchors, k, np.ones(len(anchors)))
            repeated &= read(verdicts, k << shard_bits, cells >> np.uint64(bits - shard_bits), edges)[back]
        found, hashes = [], [np.zeros((0, 2), np.uint64)]
        for lo, hi, data, offsets, w in slices:
            at = w.candidates(anchors, repeated)
            hashes.append(w.window_hashes(at))
            found.append((lo, hi, data, offsets, w.starts, w.first, at))
        return found, _distinct(np.concatenate(hashes))

    def by_shard(verdicts: pa.Table) -> dict[int, bytes]:
        return dict(zip(verdicts.column("shard").to_pylist(), verdicts.column("bits").to_pylist(), strict=True))

    def send(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("twice", pa.binary())])
        if not table.num_rows:
            return schema.empty_table()
        _, (values, counts, _) = candidates(table, by_shard(verdicts))
        edges = _runs(values[:, 0] >> np.uint64(64 - shard_bits))
        shards = (values[edges[:-1], 0] >> np.uint64(64 - shard_bits)).astype(np.int32) + (ROWS << shard_bits)
        buckets = np.full(len(shards), table.column("bucket")[0].as_py(), np.int32)
        return pa.Table.from_arrays([pa.array(shards), pa.array(buckets), _binaries(values, edges), _binaries((counts > 1).astype(np.uint8), edges)], schema=schema)

    def judge(table: pa.Table) -> pa.Table:
        held = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in table.column("hashes").to_pylist()]
        twice = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("twice").to_pylist()]).astype(bool)
        _, counts, back = _distinct(np.concatenate(held))
        more = counts > 1
        more[back[twice]] = True
        return answers(table, more[back], held)

    def remove(table: pa.Table, verdicts: pa.Table) -> pa.Table:
        texts = table.column("text")
        words, removed, kept = [], [], []
        if table.num_rows:
            verdicts = by_shard(verdicts)
            slices, (values, _, back) = candidates(table, verdicts)
            shards = values[:, 0] >> np.uint64(64 - shard_bits)
            repeated, seen = read(verdicts, ROWS << shard_bits, shards, _runs(shards))[back], 0
            for lo, hi, data, offsets, starts, first, at in slices:
                hit = at[repeated[seen : seen + len(at)]]
                seen += len(at)
                cover = np.bincount(hit, minlength=len(starts) + 1) - np.bincount(hit + width, minlength=len(starts) + 1)
                gone = np.cumsum(cover)[:-1] > 0
                sums = np.concatenate(([0], np.cumsum(gone)))
                for k in range(hi - lo):
                    a, b = first[k], first[k + 1]
                    words.append(b - a)
                    removed.append(sums[b] - sums[a])
                    if whole and not removed[-1]:
                        kept.append(texts[len(kept)].as_py())
                        continue
                    own = data[offsets[k] : offsets[k + 1]].tobytes().split()
                    if removed[-1]:
                        own = [w for w, g in zip(own, gone[a:b].tolist(), strict=True) if not g]
                    kept.append(b" ".join(own).decode())
        return pa.table({"row": table.column("row"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    answer = "bucket int, shard int, bits binary"
    estimates = dealt.groupBy("bucket").applyInArrow(sketch, "shard int, bucket int, cells binary, counts binary").groupBy("shard").applyInArrow(estimate, answer)
    sent = dealt.groupBy("bucket").cogroup(estimates.groupBy("bucket")).applyInArrow(send, "shard int, bucket int, hashes binary, twice binary")
    verdicts = estimates.unionByName(sent.groupBy("shard").applyInArrow(judge, answer))
    schema = StructType([dealt.schema["row"], *(StructField(n, LongType()) for n in ("n_words", "n_removed")), StructField("kept_text", StringType())])
    return dealt.groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(remove, schema)
