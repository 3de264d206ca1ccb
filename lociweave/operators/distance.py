"""Cosine distances between samples from genotype counts.

Two forms give the same counts.  `pair_counts` joins long-form calls with themselves on
(variant, hap, allele): plain, and fit for few samples.  `block_counts` works on wide rows: each
partition multiplies 0/1 matrices of its variants and hands on one row of sums per sample, so genotypes
are not shuffled and the shuffle's size depends on samples, windows and partitions only.  Where the sums of
all samples and replicates are too large for a worker, each partition packs its genotypes into bits, by blocks of samples, and sends
a block to the tiles of two blocks that need it; a tile's task has a range of variants.  Either way the variants are read once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bootstrap import variant_pair, weights_of

BLOCK_VARIANTS = 2048
#: sums that a worker holds at once
BLOCK_BYTES = 256 << 20
#: samples of a block, a multiple of eight, bytes of a tile's sums, and variants of a tile's task, about
SAMPLE_BLOCK, TILE_BYTES, TILE_VARIANTS = 256, 64 << 20, 1 << 17
#: vectors of a block
VECTOR_BLOCK = 1024


def pair_frame(samples: DataFrame) -> DataFrame:
    """All (i, j, name_i, name_j) with i <= j of samples numbered 0.. in idx, without a cross join."""
    n = samples.agg((F.max("idx") + 1).alias("n")).first()["n"] or 0
    left = samples.select(F.col("idx").alias("i"), F.col("name").alias("name_i"), F.explode(F.expr(f"sequence(idx, {n - 1})")).alias("j"))
    return left.join(samples.select(F.col("idx").alias("j"), F.col("name").alias("name_j")), "j").select("i", "j", "name_i", "name_j")


def cosine_distance(dot: Column, norm_i: Column, norm_j: Column, same: Column) -> Column:
    """1 - dot / (sqrt(ni) * sqrt(nj)), at least 0; 1 if a norm is 0, but 0 on the diagonal."""
    dist = F.when((norm_i == 0) | (norm_j == 0), F.when(same, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(1 - dot / (F.sqrt(norm_i) * F.sqrt(norm_j)))
    return F.greatest(dist, F.lit(0.0))


def pair_counts(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., i, j, dot) for i <= j from distinct calls (by..., variant, idx, hap, allele)."""
    by = by or []
    key = [*by, "variant", "hap", "allele"]
    a = calls.select(*key, F.col("idx").alias("i"))
    b = calls.select(*key, F.col("idx").alias("j"))
    return a.join(b, key).where("i <= j").groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("dot"))


def distances(pairs: DataFrame, frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., i, j, name_i, name_j, dist) of the whole frame; pairs without a common allele have dot 0."""
    by = by or []
    norms = pairs.where("i = j").select(*by, F.col("i").alias("s"), F.col("dot").alias("norm"))
    if by:
        # each group's frame is unfolded from one row a group; only the names, one row a sample, are broadcast
        n = frame.agg((F.max("j") + 1).alias("n")).first()["n"] or 0
        names = frame.where("i = j").select("i", F.col("name_i").alias("name"))
        unfolded = pairs.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(*by, "i", F.explode(F.expr(f"sequence(i, {n - 1})")).alias("j"))
        for side in ("i", "j"):
            unfolded = unfolded.join(F.broadcast(names.select(F.col("i").alias(side), F.col("name").alias(f"name_{side}"))), side)
        frame = unfolded
    full = frame.join(pairs, [*by, "i", "j"], "left")
    for side in ("i", "j"):
        full = full.join(norms.withColumnRenamed("s", side).withColumnRenamed("norm", f"norm_{side}"), [*by, side], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    dist = cosine_distance(zero("dot"), zero("norm_i"), zero("norm_j"), F.col("i") == F.col("j"))
    return full.select(*by, "i", "j", "name_i", "name_j", dist.alias("dist"))


def genotype_codes(column: pa.Array, n: int) -> tuple[np.ndarray, list[str | None]]:
    """(rows, n) numbers of the genotype texts of a list column, and the texts by number; 0 is none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    coded = column.flatten().dictionary_encode()
    flat = coded.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    sizes = pc.list_value_length(column).fill_null(0).to_numpy().astype(np.int64)
    if len(flat) == n * len(column) and (sizes == n).all():
        return flat.reshape(-1, n), [None, *coded.dictionary.to_pylist()]
    out = np.zeros((len(column), n), np.int64)
    row, at = np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < n], at[at < n]] = flat[at < n]
    return out, [None, *coded.dictionary.to_pylist()]


def _one_hot(column: pa.Array, n: int, ploidy: int, max_alleles: int) -> np.ndarray:
    """0/1 matrix (variants, samples, ploidy * max_alleles); each distinct genotype text is read once."""
    codes, texts = genotype_codes(column, n)
    bits = np.zeros((len(texts), ploidy * max_alleles), np.float32)
    for k, text in enumerate(texts):
        if text and "." not in text:
            for hap, allele in enumerate(text.replace("|", "/").split("/")[:ploidy]):
                if allele.isdigit() and int(allele) < max_alleles:
                    bits[k, hap * max_alleles + int(allele)] = 1
    return bits[codes]


def list_matrix(column, dtype) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def identity(variants: DataFrame) -> Column:
    """What a variant's bootstrap weights follow from: its own columns where it has them, so that splits don't matter."""
    own = [c for c in ("chrom", "pos", "id", "ref", "alt") if c in variants.columns]
    return F.concat_ws("|", *[F.col(c).cast("string") for c in own]) if {"chrom", "pos"} <= set(own) else F.col("ord").cast("string")


def fits(n: int, replicates: int) -> bool:
    """Whether a worker holds the sums of all samples and replicates at once."""
    return 8 * n * n * (replicates + 1) <= BLOCK_BYTES


def block_counts(variants: DataFrame, n: int, ploidy: int, max_alleles: int, group: str | None = None, replicates: int = 0, seed: int = 1) -> DataFrame:
    """(grp, rep, i, dots array<bigint>) of n samples from rows with gts; dots[i] is the sample's norm.

    group is a long column that tells windows apart.  rep 0 weighs all variants alike, rep 1.. weigh each
    by its Poisson(1) bootstrap weight, the same for all samples.
    """
    pair = variant_pair(identity(variants), seed) if replicates else F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    rows = variants.select((F.col(group) if group else F.lit(0)).cast("long").alias("grp"), "gts", pair["a"].alias("a"), pair["b"].alias("b"))
    return (_worker_counts if fits(n, replicates) else _tile_counts)(rows, n, ploidy, max_alleles, range(replicates + 1))


_COUNTS = "grp long, rep int, i int, dots array<bigint>"


def _listed(dots: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(dots) + 1, dtype=np.int32) * dots.shape[1]), pa.array(dots.ravel()))


def _added(table: pa.Table) -> pa.Table:
    """One row of the sums of the dots of all."""
    total = list_matrix(table.column("dots"), np.int64).sum(axis=0, keepdims=True)
    return table.slice(0, 1).set_column(table.schema.get_field_index("dots"), "dots", _listed(total))


def _parts(batch: pa.RecordBatch):
    """(group, rows) of runs of one group, BLOCK_VARIANTS rows at most."""
    groups = batch.column("grp").to_numpy()
    edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True]))) if len(groups) else [0]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        for a in range(int(lo), int(hi), BLOCK_VARIANTS):
            yield int(groups[lo]), batch.slice(a, min(BLOCK_VARIANTS, int(hi) - a))


def _weighted_dots(left: np.ndarray, right: np.ndarray, weights: np.ndarray, bits: int, rep: int) -> np.ndarray:
    """Sums over variants of the common ones of two (variants * bits, samples) matrices; blocks are small enough to be exact in float32."""
    if rep:
        left = left * np.repeat(weights.astype(np.float32), bits)[:, None]
    return (left.T @ right).astype(np.int64)


def _worker_counts(rows: DataFrame, n: int, ploidy: int, max_alleles: int, reps: range) -> DataFrame:
    schema = pa.schema([("grp", pa.int64()), ("rep", pa.int32()), ("i", pa.int32()), ("dots", pa.list_(pa.int64()))])
    bits = ploidy * max_alleles

    def partial(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}

        def rows_of(keys):
            for g, r in keys:
                m = sums.pop((g, r))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g)), pa.array(np.full(n, r, np.int32)), pa.array(np.arange(n, dtype=np.int32)), _listed(m)], schema=schema)

        for batch in batches:
            last = None
            for last, part in _parts(batch):
                hot = _one_hot(part.column("gts"), n, ploidy, max_alleles).transpose(0, 2, 1).reshape(-1, n)
                drawn = weights_of(part.column("a").to_numpy(), part.column("b").to_numpy(), reps)
                for rep in reps:
                    found = _weighted_dots(hot, hot, drawn[:, rep], bits, rep)
                    sums[last, rep] = sums[last, rep] + found if (last, rep) in sums else found
            # windows come in order: all but the last of the batch are over in this partition
            yield from rows_of([k for k in sums if k[0] != last])
        yield from rows_of(list(sums))

    return rows.mapInArrow(partial, _COUNTS).groupBy("grp", "rep", "i").applyInArrow(_added, _COUNTS)


def _tile_counts(rows: DataFrame, n: int, ploidy: int, max_alleles: int, reps: range) -> DataFrame:
    size = SAMPLE_BLOCK
    blocks, bits, per = -(-n // size), ploidy * max_alleles, max(1, TILE_BYTES // (8 * size * size))
    # splits of the input whose variants a task takes together, by the size of a line
    splits = max(1, TILE_VARIANTS * 4 * n // int(rows.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    packed = "grp long, v long, id long, block int, ones binary, a array<bigint>, b array<bigint>"

    def pack(batches):
        split, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for grp, part in _parts(batch):
                hot = _one_hot(part.column("gts"), n, ploidy, max_alleles).astype(bool).transpose(0, 2, 1)
                hot = np.pad(hot, ((0, 0), (0, 0), (0, blocks * size - n)))
                pairs = [_listed(part.column(c).to_numpy()[None, :]) for c in ("a", "b")]
                for s in range(blocks):
                    ones = np.packbits(hot[:, :, s * size : (s + 1) * size], axis=2).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([split // splits]), pa.array([split << 32 | k]), pa.array([s], pa.int32()), pa.array([ones]), *pairs], [x.split()[0] for x in packed.split(", ")])
                k += 1

    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    part = F.explode(F.sequence(F.lit(0), F.lit((len(reps) - 1) // per))).alias("part")
    sent = rows.mapInArrow(pack, packed).select("*", other).select("*", part)
    sent = sent.select("grp", "v", "id", "block", "ones", "a", "b", "part", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    kind = "grp long, rep int, i int, segment int, dots array<bigint>"

    def measure(table: pa.Table) -> pa.Table:
        p, q, part = (table.column(c)[0].as_py() for c in ("p", "q", "part"))
        own = reps[part * per : (part + 1) * per]
        ids, block = table.column("id").to_pylist(), table.column("block").to_pylist()
        at = {(i, b): k for k, (i, b) in enumerate(zip(ids, block, strict=True))}
        sums: dict[tuple[int, int], np.ndarray] = {}
        ones = lambda k: np.unpackbits(np.frombuffer(table.column("ones")[k].as_buffer(), np.uint8).reshape(-1, size // 8), axis=1).astype(np.float32)
        for i in dict.fromkeys(ids):
            k = at[i, p]
            left, right = ones(k), ones(at[i, q])
            drawn = weights_of(*(np.array(table.column(c)[k].as_py(), np.int64) for c in ("a", "b")), own)
            for r, rep in enumerate(own):
                key = (table.column("grp")[k].as_py(), rep)
                found = _weighted_dots(left, right, drawn[:, r], bits, rep)
                sums[key] = sums[key] + found if key in sums else found
        out = []
        for (grp, rep), m in sums.items():
            for first, second, dots in ((p, q, m), (q, p, m.T))[: 1 + (p != q)]:
                dots = dots[: min(size, n - first * size)]
                k = len(dots)
                out.append(pa.table([np.full(k, grp), np.full(k, rep, np.int32), (first * size + np.arange(k)).astype(np.int32), np.full(k, second, np.int32), _listed(np.ascontiguousarray(dots))], ["grp", "rep", "i", "segment", "dots"]))
        return pa.concat_tables(out)

    found = sent.groupBy("p", "q", "part", "v").applyInArrow(measure, kind).groupBy("grp", "rep", "i", "segment").applyInArrow(_added, kind)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("segment", "dots"))), lambda x: x["dots"]))
    return found.groupBy("grp", "rep", "i").agg(F.slice(whole, 1, n).alias("dots"))


def block_distances(counts: DataFrame, samples: list[str]) -> DataFrame:
    """(grp, rep, i, j, name_i, name_j, dist) for i <= j from block counts."""
    names = F.array(*[F.lit(s) for s in samples])
    norms = counts.groupBy("grp", "rep").agg(F.sort_array(F.collect_list(F.struct("i", F.get("dots", F.col("i")).alias("norm")))).alias("norms"))
    rows = counts.join(norms, ["grp", "rep"]).select("grp", "rep", "i", F.get("norms", F.col("i"))["norm"].alias("ni"), F.posexplode(F.arrays_zip("dots", "norms")).alias("j", "x"))
    dist = cosine_distance(F.col("x.dots").cast("double"), F.col("ni").cast("double"), F.col("x.norms.norm").cast("double"), F.col("i") == F.col("j"))
    return rows.where("i <= j").select("grp", "rep", "i", "j", F.get(names, F.col("i")).alias("name_i"), F.get(names, F.col("j")).alias("name_j"), dist.alias("dist"))


def vector_products(vectors: DataFrame, by: list[str], key: str, vec: str = "v") -> DataFrame:
    """(by..., key_i, key_j, n_i, n_j, dot) for key_i <= key_j of the vectors of each group, by products of blocks of rows.

    Vectors are dealt into blocks by a hash of the key; a task multiplies two blocks, and a vector is sent once for each block.
    """
    most = vectors.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-most // VECTOR_BLOCK))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    rows = vectors.select(*by, F.col(key).alias("_k"), F.col(vec).alias("_v"), own.alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_other"))
    rows = rows.select(*by, "_k", "_v", "_own", F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"))
    named = [f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in by]
    kind = vectors.schema[key].dataType.simpleString()

    def multiply(table: pa.Table) -> pa.Table:
        a, b = table.column("_a")[0].as_py(), table.column("_b")[0].as_py()
        keys, block = table.column("_k").combine_chunks(), table.column("_own").to_numpy()
        x = list_matrix(table.column("_v"), np.float64)
        norm = (x * x).sum(axis=1)
        left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
        rank = np.empty(len(keys), np.int64)
        rank[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
        dots = x[left] @ x[right].T
        i, j = np.nonzero(rank[left][:, None] <= rank[right][None, :] if a == b else np.ones(dots.shape, bool))
        dot, i, j = dots[i, j], left[i], right[j]
        i, j = np.where(rank[i] <= rank[j], i, j), np.where(rank[i] <= rank[j], j, i)
        first = table.slice(0, 1)
        fixed = [first.column(c).combine_chunks().take(pa.array(np.zeros(len(i), np.int64))) for c in by]
        return pa.table([*fixed, keys.take(pa.array(i)), keys.take(pa.array(j)), norm[i], norm[j], dot], [*by, f"{key}_i", f"{key}_j", "n_i", "n_j", "dot"])

    out = ", ".join([*named, f"{key}_i {kind}", f"{key}_j {kind}", "n_i double", "n_j double", "dot double"])
    return rows.groupBy(*by, "_a", "_b").applyInArrow(multiply, out)
