"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most `radius` bits share a variant within half
the radius of each.  Every distinct fingerprint therefore emits all its variants
within half the radius; equal variants meet in one shuffle bucket; members of one
variant are linked to its first, checked bit by bit, and their links deduplicated.
Members of a variant are within the radius of one another by the triangle
inequality, so a star joins exactly what all pairs would, without their number.

Variants travel in short form.  The bucket of a variant is a linear code of its
bits, so the flips that take a fingerprint to a given bucket follow from the two
codes; a partition sends each bucket the fingerprints that have variants there,
and the bucket forms those variants.  Up to 2**11 buckets that is a fraction of the
volume of all variants, beyond it is the same.

Null and empty texts have fingerprint zero, linked like any other.  Equal texts
share a fingerprint, so repeated rows and copies cost nothing more.  Long texts are
hashed in blocks of shingles.  A component whose rows have no doc_id at all gets null;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._text import LOWER, WORD_BYTES, checkpointed, one_of_equals, quoted, spans, text_slices, unused

SHINGLE = 4
RADIUS = 4
SEED = 42
#: variants formed at once in a bucket, about
BUCKET_VARIANTS = 4_000_000
#: bits of a bucket's code at most, and fingerprints whose buckets are formed at once
MAX_BITS = 40
SEND_ROWS = 1024
#: most dropped ids and names of components that are broadcast (16 bytes each at most); more are joined by a shuffle
BROADCAST_ROWS = 500_000


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if over half of its shingles' XXH64 have it."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    starts, ends, first = spans(data, offsets)
    lengths = ends - starts
    # the words of the slice, lower case, each followed by one space
    lows = np.cumsum(lengths + 1) - lengths - 1
    text = np.full(int((lengths + 1).sum()), 32, np.uint8)
    at = np.repeat(lows - starts, lengths)
    word = np.flatnonzero(WORD_BYTES[data])
    text[word + at] = LOWER[data[word]]
    text = text.tobytes()
    highs = lows + lengths
    out = np.zeros(len(offsets) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for k in range(len(out)):
        a, b = first[k], first[k + 1]
        if a == b:
            continue
        width = min(shingle, b - a)
        ones, n = np.zeros(64, np.int64), int(b - a - width + 1)
        for lo in range(a, a + n, 1 << 16):
            hi = min(lo + (1 << 16), a + n)
            hashes = np.array([digest(text[s:e], SEED) for s, e in zip(lows[lo:hi].tolist(), highs[lo + width - 1 : hi + width - 1].tolist(), strict=True)], dtype=">u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = weights[2 * ones > n].sum(dtype=np.uint64)
    return out


def fingerprints(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The columns, all numbers but for text, with fp long for text: its fingerprint's bits as a signed number."""
    carried = [c for c in texts.columns if c != "text"]
    schema = pa.schema([(c, pa.int64()) for c in (*carried, "fp")])

    def run(batches):
        for batch in batches:
            parts = [np.zeros(0, np.uint64)] + [fingerprints_of(data, offsets, shingle) for _, _, data, offsets in text_slices(batch.column("text"))]
            own = [batch.column(c).cast(pa.int64()) for c in carried]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.concatenate(parts).view(np.int64))], schema=schema)

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in (*carried, "fp")))


class Ball:
    """All flips of up to `half` bits, by the bucket code that they add; adds are the distinct codes."""

    def __init__(self, half: int, bits: int):
        flips = [sum(1 << i for i in c) for n in range(half + 1) for c in itertools.combinations(range(64), n)]
        self.masks = np.array(flips, np.uint64)
        self.columns = np.random.default_rng(64).integers(0, 1 << MAX_BITS, 64) & ((1 << bits) - 1)
        codes = self.code(self.masks)
        order = np.argsort(codes, kind="stable")
        self.masks = self.masks[order]
        self.adds, first = np.unique(codes[order], return_index=True)
        self.edges = np.append(first, len(codes))

    def code(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for k in range(64):
            out ^= np.where((values >> np.uint64(k)) & np.uint64(1), self.columns[k], 0)
        return out

    def flips(self, code: int) -> np.ndarray:
        k = min(int(np.searchsorted(self.adds, code)), len(self.adds) - 1)
        return self.masks[self.edges[k] : self.edges[k + 1]] if self.adds[k] == code else self.masks[:0]


def star_links(found: np.ndarray, bucket: int, ball: Ball, radius: int) -> np.ndarray:
    """(n, 2) links among distinct fingerprints through the variants that fall into the bucket."""
    codes = ball.code(found)
    variants, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], codes[order][1:] != codes[order][:-1], [True]))) if len(found) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        flips, own = ball.flips(int(codes[order[a]]) ^ bucket), order[a:b].astype(np.int32)
        variants.append((found[own][:, None] ^ flips[None, :]).ravel())
        owners.append(np.repeat(own, len(flips)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    variants, owners = variants[order], owners[order]
    same = np.concatenate(([False], variants[1:] == variants[:-1])) if len(variants) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(variants)))) if len(variants) else np.zeros(0, np.int64)
    keys = np.unique(owners[head[same]].astype(np.int64) * max(1, len(found)) + owners[same])
    pairs = np.stack(np.divmod(keys, max(1, len(found))), axis=1)
    pairs = pairs[np.bitwise_count(found[pairs[:, 0]] ^ found[pairs[:, 1]]) <= radius]
    return found[forest(pairs, len(found))]


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """Fewer pairs that join the same nodes: each linked node and the smallest that it reaches."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        for side in (0, 1):
            np.minimum.at(label, before[pairs[:, side]], low)
            np.minimum.at(label, pairs[:, side], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return np.stack([moved, label[moved]], axis=1)


def links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b) links among the distinct fingerprints of column fp."""
    if radius % 2:
        raise ValueError("the radius must be even: the star of a variant joins all that differ in twice its half")
    half = radius // 2
    total = count * sum(math.comb(64, n) for n in range(half + 1))
    bits = min(MAX_BITS, max(3, (total // BUCKET_VARIANTS).bit_length()))
    schema = pa.schema([("bucket", pa.int64()), ("found", pa.binary())])

    def send(batches):
        ball, parts = Ball(half, bits), []
        for batch in batches:
            parts.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        found = np.concatenate([np.zeros(0, np.uint64), *parts])
        if len(ball.adds) == 1 << bits:  # every bucket gets every fingerprint
            for lo in range(0, len(found), 1 << 15):
                some = found[lo : lo + (1 << 15)].astype("<u8").tobytes()
                for bucket in range(1 << bits):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([some], pa.binary())], schema=schema)
            return
        for lo in range(0, len(found), SEND_ROWS):
            own = found[lo : lo + SEND_ROWS]
            buckets = (ball.code(own)[:, None] ^ ball.adds[None, :]).ravel()
            order = np.argsort(buckets, kind="stable")
            buckets = buckets[order]
            edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1], [True])))
            held = pa.py_buffer(own[order // len(ball.adds)].astype("<u8").tobytes())
            packed = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((8 * edges).astype("<i4").tobytes()), held])
            yield pa.RecordBatch.from_arrays([pa.array(buckets[edges[:-1]]), packed], schema=schema)

    def meet(table: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in table.column("found").to_pylist()]))
        pairs = star_links(found, table.column("bucket")[0].as_py(), Ball(half, bits), radius)
        return pa.table({"a": pairs[:, 0].view(np.int64), "b": pairs[:, 1].view(np.int64)})

    return distinct.select("fp").mapInArrow(send, "bucket long, found binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def _roots(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, root) of the fingerprints that links join with others."""
    joined = components(links(distinct, distinct.count(), radius)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    return joined.union(joined.select(F.col("root").alias("fp"), "root").distinct())


def _lookup(marked: DataFrame, least: Column, radius: int) -> DataFrame:
    """(fp, least) of each fingerprint: the least of `least` over all rows of its component."""
    distinct = checkpointed(marked.groupBy("fp").agg(F.min(least).alias("least")))
    # only linked fingerprints need their component's; for the others it is their own
    linked = _roots(distinct, radius)
    names = checkpointed(linked.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("name")))
    named = linked.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, "root").select("fp", "name")
    # a name may be null, so whether a fingerprint is linked is told by the flag
    lookup = distinct.join(named.withColumn("is_linked", F.lit(True)), "fp", "left").select("fp", F.when(F.col("is_linked"), F.col("name")).otherwise(F.col("least")).alias("least"))
    # written first, so that the join with the documents has two plain sides and a hot fingerprint can be split
    return checkpointed(lookup)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp long, component_id (the smallest doc_id that links reach)."""
    marked = checkpointed(fingerprints(docs.select("doc_id", "text"), shingle))
    return marked.join(_lookup(marked, F.col("doc_id"), radius), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest doc_id, none coming last.

    Where a doc_id is repeated in a component, the row whose hashes of doc_id and text are smallest stays,
    and of rows that repeat both the one whose columns sort first as JSON.  Rows are told apart by those
    hashes, so a repeated doc_id never drops a text of another component.  Texts are not shuffled when
    the dropped rows are few.
    """
    keys = [F.xxhash64("doc_id", "text"), F.xxhash64(F.lit("second"), "text", "doc_id")]
    named = docs.select("doc_id", "text", keys[0].alias("k1"), keys[1].alias("k2"))
    marked = checkpointed(fingerprints(named, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    told = marked.join(_lookup(marked, place, radius), "fp")
    stays = (F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2"))
    # what the final pass must know: rows that go, and rows that stay but are repeated
    special = checkpointed(told.groupBy("k1", "k2", stays.alias("stays")).count().where("not stays or count > 1").select("k1", "k2", "stays"))
    at_hand = F.broadcast if special.count() <= BROADCAST_ROWS else (lambda df: df)
    k1, k2, flag = unused(docs.columns, "k1", "k2", "stays")
    special = special.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("stays").alias(flag))
    keyed = docs.withColumns({k1: keys[0], k2: keys[1]})
    single = keyed.join(at_hand(special), [k1, k2], "left_anti").select(*map(quoted, docs.columns))
    repeated = keyed.join(at_hand(special.where(F.col(flag))), [k1, k2], "left_semi")
    return single.unionByName(one_of_equals(repeated, [k1, k2], docs.columns))
