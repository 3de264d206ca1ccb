"""Prefix trie of conversations from sorted, padded matrices of turn ids.

A turn's id is a hash of its role and text.  Distinct conversations are dealt by ranges of their ids into
shards.  A shard pads its conversations to matrices of numbered turns, sorts them with lexsort and compares neighbours;
the changes, OR-accumulated along the columns, mark in which rows the nodes of each depth begin, and
reduceat sums every depth over its nodes, the deepest first.  Matrices are 32 columns wide and hold only the
conversations that go on so far, so one long conversation doesn't widen the others.

Only nodes on the first or last row of a shard can have rows in another shard.  They are added up by a hash of their
prefix.  All figures are sums but for what neighbouring shards both count, which follows from the prefix that
the last row of one shares with the first row of the next: one small row of corrections for each node of that prefix.

Rows are taken by turn (null first), then by turn id.  A null role or text is empty.  Rows without a conv_id are left out.  Repeated
rows are turns of their own.  An empty table gives no nodes, not even the root.  Further columns are not
read.  A conversation's turn ids (about 50 bytes a turn), not its texts, must fit a task.  Conversations that share over RANGE_TURNS
turns are in one shard; equal ones are one row there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import written

#: turns of a shard, about, and turns by which conversations are dealt to shards
SHARD_TURNS, LEAST_TURNS, RANGE_TURNS = 1 << 19, 1 << 12, 64
#: columns of a padded matrix
WIDTH = 32
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_FIGURES = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODES = "conv_id long, depth long, parent_conv_id long, key string, parent_key string, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_SHARD = f"{_NODES}, shard long, first_keys array<string>, last_keys array<string>, last_chars array<long>"


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (id, chars)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    code = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turn = F.struct(F.col("turn"), code.alias("id"), F.length(text).cast("long").alias("chars"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(seqs: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """Each conversation with its first turns replaced by those of the conversation whose number its own is rounded to."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    first = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    joined = seqs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": h}).join(first, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), own)).alias("turns"))


def _ends(keyed: DataFrame) -> DataFrame:
    """(key, ends): hash of the ascending conv_ids of each key, streamed."""

    def stream(batches):
        now, sha = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        keys.append(now)
                        hashes.append(sha.hexdigest())
                    now, sha = key, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], ["key", "ends"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["key", "ends"])

    return keyed.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(stream, "key string, ends string")


def _block(turn_ids, offsets, lengths, rows, b):
    """Padded matrix of columns b * WIDTH .. of some rows; 0 pads."""
    at = b * WIDTH + np.arange(WIDTH)
    inside = at < lengths[rows][:, None]
    out = np.zeros((len(rows), WIDTH), np.int32)
    out[inside] = turn_ids[(offsets[rows][:, None] + at)[inside]]
    return out


def sorted_rows(turn_ids, offsets, lengths):
    """Rows in lexicographic order, shorter ones first, by blocks of columns from the last."""
    order = np.zeros(0, np.int64)
    for b in range(-(-int(lengths.max(initial=0)) // WIDTH) - 1, -1, -1):
        order = np.concatenate([np.flatnonzero((lengths > b * WIDTH) & (lengths <= (b + 1) * WIDTH)), order])
        order = order[np.lexsort(_block(turn_ids, offsets, lengths, order, b).T[::-1])]
    return np.concatenate([np.flatnonzero(lengths == 0), order])


def node_starts(turn_ids, offsets, lengths, order):
    """For each depth from 0 the sorted rows that are at least so long, and which of them begin a node."""
    length = lengths[order]
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    out = [(np.arange(len(order)), changed.copy())]
    for b in range(-(-int(lengths.max(initial=0)) // WIDTH)):
        rows = np.flatnonzero(length > b * WIDTH)
        own = _block(turn_ids, offsets, lengths, order[rows], b)
        before = np.zeros_like(own)
        follows = np.flatnonzero(np.diff(rows, prepend=-2) == 1)
        before[follows] = own[follows - 1]
        differ = own != before
        differ[:, 0] |= changed[rows]
        differ = np.logical_or.accumulate(differ, axis=1)
        changed[rows] = differ[:, -1]
        for col in range(min(WIDTH, int(length.max()) - b * WIDTH)):
            there = length[rows] > b * WIDTH + col
            out.append((rows[there], differ[there, col]))
    return out


def _prefix_keys(ids):
    """Keys of the prefixes of a row of turn ids, from the empty one."""
    out = [""]
    for x in ids:
        out.append(hashlib.sha256(out[-1].encode() + x).hexdigest()[:32])
    return out


def _shard(batches):
    """The nodes of a shard's rows, and the prefixes of its first and last row."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    turns = table.column("turns").combine_chunks()
    offsets = turns.offsets.to_numpy().astype(np.int64)
    lengths, flat = np.diff(offsets), turns.values
    codes = np.array(flat.field("id").to_numpy(zero_copy_only=False), dtype="S32") if len(flat) else np.zeros(0, "S32")
    chars = flat.field("chars").to_numpy()
    turn_ids = np.unique(codes, return_inverse=True)[1].astype(np.int32) + 1
    offsets = offsets[:-1]
    order = sorted_rows(turn_ids, offsets, lengths)
    depths = node_starts(turn_ids, offsets, lengths, order)
    n, least = (table.column(c).to_numpy()[order] for c in ("n", "least"))
    ends = table.column("ends").combine_chunks().take(pa.array(order))
    length, start_of = lengths[order], offsets[order]
    last = len(order) - 1
    keys = [_prefix_keys(codes[start_of[r] : start_of[r] + length[r]]) for r in (0, last)]
    begins, leaves, saved = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    found = [None] * len(depths)
    for d in range(len(depths) - 1, -1, -1):
        rows, starts = depths[d]
        at = np.flatnonzero(starts)
        head = rows[at]
        over = lambda x, f=np.add, rows=rows, at=at: f.reduceat(x[rows], at)
        convs, low, children = over(n), over(least, np.minimum), over(begins)
        leaves[head] += children == 0
        if d:
            saved[head] += (convs - 1) * chars[start_of[head] + d - 1]
        found[d] = (head, low, convs, children, over(leaves), over(saved))
        begins[:] = 0
        begins[head] = 1
    shard = TaskContext.get().partitionId()
    for d, (head, low, convs, children, n_leaves, n_saved) in enumerate(found):
        own, above, parent = np.full(len(head), None, object), np.full(len(head), None, object), np.full(len(head), None, object)
        for k, r, here in ((0, 0, 0), (1, last, len(head) - 1)):
            if length[r] >= d:
                own[here] = keys[k][d]
        if d:
            up = np.searchsorted(found[d - 1][0], head, side="right") - 1
            parent[:] = found[d - 1][1][up]
            for k, r in ((0, 0), (1, last)):
                if length[r] >= d - 1:
                    above[up == (0 if k == 0 else len(found[d - 1][0]) - 1)] = keys[k][d - 1]
            parent[above != None] = None  # noqa: E711
        size = len(head)
        columns = [pa.array(low), pa.array(np.full(size, d)), pa.array(parent.tolist(), pa.int64()), pa.array(own.tolist(), pa.string()), pa.array(above.tolist(), pa.string())]
        columns += [pa.array(x) for x in (convs, children, n_leaves, n_saved)]
        columns += [ends.take(pa.array(head, mask=length[head] != d)), pa.nulls(size, pa.int64()), *[pa.nulls(size, pa.list_(k)) for k in (pa.string(), pa.string(), pa.int64())]]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SHARD.split(", ")])
    final = chars[start_of[last] : start_of[last] + length[last]].tolist()
    row = dict.fromkeys([x.split()[0] for x in _SHARD.split(", ")]) | {"shard": shard, "first_keys": keys[0], "last_keys": keys[1], "last_chars": final}
    yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _arrow_schema()], [f.name for f in _arrow_schema()])


def _arrow_schema():
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _SHARD.split(", ")])


def _corrections(pairs):
    """What two neighbouring shards count twice, for each node that both have."""
    for batch in pairs:
        out = {c: [] for c in ("key", "depth", *_FIGURES)}
        for row in batch.to_pylist():
            left, right, chars = row["last_keys"], row["next_keys"], row["last_chars"]
            shared = sum(a == b for a, b in zip(left, right, strict=False)) - 1
            sums = np.concatenate([np.cumsum(np.array([0, *chars[:shared]])[::-1])[::-1], [0]])
            for d in range(shared + 1):
                for c, v in zip(out, (left[d], d, 0, -(d < shared), -(shared == len(left) - 1), int(sums[max(d, 0)])), strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c == "key" else pa.int64()) for c, v in out.items()], list(out))


def trie(seqs: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of (conv_id, turns) as `sequences` gives them; conv_id of a node is the smallest of its members."""
    key = F.substring(F.sha2(F.array_join(F.transform("turns", lambda t: t["id"]), ""), 256), 1, 32)
    keyed = seqs.select("conv_id", "turns", key.alias("key"))
    distinct = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns"))
    distinct = written(distinct.join(_ends(keyed), "key").select("n", "least", "turns", "ends"))
    if shards is None:
        total = distinct.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
        cores = distinct.sparkSession.sparkContext.defaultParallelism
        shards = max(1, -(-total // SHARD_TURNS), min(cores, -(-total // LEAST_TURNS)))
    ranged = distinct.withColumn("r", F.slice(F.transform("turns", lambda t: t["id"]), 1, RANGE_TURNS)).repartitionByRange(shards, "r").drop("r")
    found = written(ranged.mapInArrow(_shard, _SHARD))
    nodes = found.where("shard is null")
    following = F.lead("first_keys").over(Window.orderBy("shard")).alias("next_keys")
    pairs = found.where("shard is not null").select("last_keys", "last_chars", following).where("next_keys is not null")
    twice = pairs.mapInArrow(_corrections, "key string, depth long, " + ", ".join(f"{c} long" for c in _FIGURES))
    null = lambda kind: F.lit(None).cast(kind)
    parts = nodes.where("key is not null").select("key", "depth", "conv_id", "parent_key", "ends", *_FIGURES).union(twice.select("key", "depth", null("long"), null("string"), null("string"), *_FIGURES))
    edges = parts.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.max("ends").alias("ends"), *[F.sum(c).alias(c) for c in _FIGURES])
    edges = written(edges)
    own = ("conv_id", "depth", "parent_conv_id", "parent_key", *_FIGURES, "ends")
    every = nodes.where("key is null").select(*own).union(edges.withColumn("parent_conv_id", null("long")).select(*own))
    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    named = every.join(above, "parent_key", "left")
    return named.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), *_FIGURES, F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
