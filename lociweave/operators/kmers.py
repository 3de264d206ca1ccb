"""k-mer profiles and D2 statistics.

Sequences are rows of (seq_id, seq), or lines of sequences of any length, (seq_id, at, value), which are put
together to overlapping segments, never to a whole.  k-mers are counted as codes in slices of about a megabyte; no
array of all k-mers exists.  Counts of the forward strand are aggregated first and only then
mirrored, so the reverse strand costs one row more for each distinct k-mer.  Pairs of sequences are
measured by blocks of sequences and ranges of k-mers: no join on a k-mer, which all sequences may have, and no
task holds a whole profile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

#: sequences of a block, rows of profiles of a task, about, and k-mers of a matrix
BLOCK_SEQUENCES, BLOCK_ROWS, CHUNK_KMERS = 64, 1 << 18, 1 << 12
#: bases of a segment of a long sequence, and bytes that are counted at once
SEGMENT, SLICE = 1 << 18, 1 << 20
BASES = ("A", "T", "C", "G")

#: code of each byte, 4 for what is no base
_DIGIT = np.full(256, 4, np.uint8)
for _k, _b in enumerate(BASES):
    _DIGIT[[ord(_b), ord(_b.lower())]] = _k


def rolling_codes(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of the k bytes from each place, and whether they all are bases."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    digits = _DIGIT[data]
    bad = np.concatenate([[0], np.cumsum(digits == 4)])
    codes, done, part, width = np.zeros(n, np.int64), 0, digits.astype(np.int64) & 3, 1
    while True:  # codes of 1, 2, 4, ... bases; those of which k is made are put together
        if k & width:
            codes = (codes << (2 * width)) | part[done : done + n]
            done += width
        if done == k:
            return codes, bad[k:] == bad[:n]
        part = (part[: len(part) - width] << (2 * width)) | part[width:]
        width *= 2


def _counted(k: int, by: str):
    """Batches of (by, seq) to (by, code, cnt), counted slice by slice."""

    def count(batches):
        for batch in batches:
            names, text = batch.column(by), batch.column("seq").cast(pa.large_binary())
            text = pc.fill_null(text, b"")
            _, offsets, data = text.buffers()
            offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            coded = names.dictionary_encode()
            own = coded.indices.to_numpy(zero_copy_only=False)
            own = np.where(np.isnan(own), -1, own).astype(np.int64) if own.dtype.kind == "f" else own.astype(np.int64)
            first, end = int(offsets[0]) if len(text) else 0, int(offsets[-1]) if len(text) else 0
            for lo in range(first, end, SLICE):
                hi = min(end, lo + SLICE)
                codes, good = rolling_codes(data[lo : min(end, hi + k - 1)], k)
                at = np.arange(lo, lo + len(codes))
                row = np.searchsorted(offsets, at, side="right") - 1
                good &= at + k <= offsets[row + 1]
                codes, row = codes[good], own[row[good]]
                order = np.lexsort((codes, row))
                codes, row = codes[order], row[order]
                new = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])])) if len(codes) else np.zeros(0, np.int64)
                taken = coded.dictionary.take(pa.array(row[new], mask=row[new] < 0))
                yield pa.RecordBatch.from_arrays([taken, pa.array(codes[new]), pa.array(np.diff(np.append(new, len(codes))))], [by, "code", "cnt"])

    return count


def segments(lines: DataFrame, k: int, by: str = "seq_id") -> DataFrame:
    """(by, seq): pieces of SEGMENT bases and the k - 1 that follow, from (by, at, value) lines of one sequence each."""
    kind = lines.schema[by].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            value, at = batch.column("value"), batch.column("at").to_numpy()
            size = pc.binary_length(value).to_numpy()
            low, high = np.maximum(0, at - k + 1) // SEGMENT, (at + np.maximum(size, 1) - 1) // SEGMENT
            same = np.flatnonzero(low == high)
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(same)), pa.array(low[same]), pa.array(at[same]), value.take(pa.array(same))], [by, "segment", "at", "value"])
            for r in np.flatnonzero(low != high).tolist():
                text, start = value[r].as_py(), int(at[r])
                for s in range(int(low[r]), int(high[r]) + 1):
                    a, b = max(start, s * SEGMENT), min(start + len(text), (s + 1) * SEGMENT + k - 1)
                    if a < b:
                        yield pa.RecordBatch.from_arrays([batch.column(by).slice(r, 1), pa.array([s]), pa.array([a]), pa.array([text[a - start : b - start]])], [by, "segment", "at", "value"])

    ascii_only = lines.select(by, F.col("at").cast("long").alias("at"), F.regexp_replace("value", r"[^\x00-\x7F]", "N").alias("value"))
    pieces = ascii_only.mapInArrow(cut, f"{by} {kind}, segment long, at long, value string")
    whole = pieces.groupBy(by, "segment").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("l"))
    return whole.select(by, F.array_join(F.transform("l", lambda x: x["value"]), "").alias("seq"))


def count_forward(seqs: DataFrame, k: int, by: str = "seq_id") -> DataFrame:
    """(by, kmer, cnt) of ACGT-only k-mers as they stand in the sequence; rows have seq, or at and value of lines."""
    S.check_k(k)
    if "seq" not in seqs.columns:
        seqs = segments(seqs, k, by)
    kind = seqs.schema[by].dataType.simpleString()
    counts = seqs.select(by, "seq").mapInArrow(_counted(k, by), f"{by} {kind}, code long, cnt long").groupBy(by, "code").agg(F.sum("cnt").alias("cnt"))
    return counts.select(by, S.decode_kmer(F.col("code"), k).alias("kmer"), "cnt")


def count_both(seqs: DataFrame, k: int, by: str = "seq_id") -> DataFrame:
    """(by, kmer, cnt) over both strands."""
    strands = F.explode(F.array("kmer", S.reverse_complement(F.col("kmer")))).alias("kmer")
    return count_forward(seqs, k, by).select(by, strands, "cnt").groupBy(by, "kmer").agg(F.sum("cnt").alias("cnt"))


def add_profiles(profiles: DataFrame, by: str) -> DataFrame:
    """Profiles of the same `by` added up."""
    return profiles.groupBy(by, "kmer").agg(F.sum("cnt").alias("cnt"))


def base_totals(counts: DataFrame, by: str = "seq_id") -> DataFrame:
    """(by, total, base_A, base_T, base_C, base_G): number of k-mers, and their bases."""
    return counts.groupBy(by).agg(F.sum("cnt").alias("total"), *[F.sum(F.col("cnt") * S.base_count(F.col("kmer"), b)).alias(f"base_{b}") for b in BASES])


def probabilities(counts: DataFrame, by: str = "seq_id", normalise: bool = False) -> DataFrame:
    """(by, kmer, cnt, total, prob): background probability, the product of its bases' shares."""
    totals = base_totals(counts, by).withColumn("bases", sum((F.col(f"base_{b}") for b in BASES), F.lit(0)))
    joined = counts.join(totals, by)
    prob = F.lit(1.0)
    for b in BASES:
        prob = prob * F.pow(F.col(f"base_{b}").cast("double") / F.col("bases"), S.base_count(F.col("kmer"), b))
    out = joined.select(by, "kmer", "cnt", "total", prob.alias("prob"))
    if normalise:
        norms = out.groupBy(by).agg(F.sqrt(F.sum(F.col("prob") * F.col("prob"))).alias("norm"))
        out = out.join(norms, by).select(by, "kmer", "cnt", "total", F.when(F.col("norm") > 0, F.col("prob") / F.col("norm")).otherwise(F.col("prob")).alias("prob"))
    return out


def _terms(profiles: DataFrame, by: str, star: bool) -> tuple[DataFrame, DataFrame]:
    """(id, sequence) of all sequences, and (a, b, i, j, d, nx, ny): sums over one range of k-mers of what pairs of two blocks add to D2.

    A profile's row is sent once for each block of sequences; ranges of k-mers keep a task at about BLOCK_ROWS rows.
    """
    ids = profiles.select(F.col(by).alias("seq")).distinct().withColumn("id", F.row_number().over(Window.orderBy("seq")) - 1)  # the result has their square
    size = profiles.agg(F.count_distinct(by).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    n, blocks = size["n"], max(1, -(-size["n"] // BLOCK_SEQUENCES))
    ranges = max(1, -(-2 * size["rows"] // (blocks * BLOCK_ROWS)))
    c, e = F.col("cnt") - F.col("total") * F.col("prob"), F.sqrt(F.col("total") * F.col("prob"))
    rows = profiles.select(F.col(by).alias("seq"), "kmer", c.cast("double").alias("c"), e.cast("double").alias("e")).join(ids, "seq")
    own = F.floor(F.col("id") / BLOCK_SEQUENCES).cast("int")
    rows = rows.select("id", "kmer", "c", "e", own.alias("own"), F.pmod(F.xxhash64("kmer"), F.lit(ranges)).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    rows = rows.select("id", "kmer", "c", "e", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "r")
    floor = lambda x: np.where(x < 1e-15, 1.0, x)

    def measure(table: pa.Table) -> pa.Table:
        a, b = table.column("a")[0].as_py(), table.column("b")[0].as_py()
        names = [np.arange(x * BLOCK_SEQUENCES, min(n, (x + 1) * BLOCK_SEQUENCES)) for x in ({a, b} if a == b else (a, b))]
        names = np.concatenate(names)
        left, right = np.flatnonzero(names // BLOCK_SEQUENCES == a), np.flatnonzero(names // BLOCK_SEQUENCES == b)
        seq = np.searchsorted(names, table.column("id").to_numpy())
        coded = table.column("kmer").combine_chunks().dictionary_encode()
        kmer = coded.indices.to_numpy().astype(np.int64)
        values = {x: table.column(x).to_numpy() for x in ("c", "e")}
        d, nx, ny = (np.zeros((len(left), len(right))) for _ in range(3))
        order = np.argsort(kmer, kind="stable")
        cuts = np.searchsorted(kmer[order], np.arange(0, len(coded.dictionary) + CHUNK_KMERS, CHUNK_KMERS))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = order[lo:hi]
            wide = {x: np.zeros((len(names), CHUNK_KMERS)) for x in values}
            for x, v in values.items():
                wide[x][seq[at], kmer[at] % CHUNK_KMERS] = v[at]
            cj, ej = wide["c"][right], wide["e"][right]
            for i in range(len(left)):
                ci, ei = wide["c"][left[i]], wide["e"][left[i]]
                q = floor(ei * ej) if star else floor(np.sqrt(ci * ci + cj * cj))
                d[i] += (ci * cj / q).sum(axis=1)
                nx[i] += (ci * ci / (floor(ei**2) if star else q)).sum(axis=-1)
                ny[i] += (cj * cj / (floor(ej**2) if star else q)).sum(axis=1)
        i, j = np.nonzero(names[left][:, None] <= names[right][None, :])
        return pa.table({"a": np.full(len(i), a, np.int32), "b": np.full(len(i), b, np.int32), "i": names[left][i].astype(np.int32), "j": names[right][j].astype(np.int32), "d": d[i, j], "nx": nx[i, j], "ny": ny[i, j]})

    return ids, rows.groupBy("a", "b", "r").applyInArrow(measure, "a int, b int, i int, j int, d double, nx double, ny double")


def _d2(profiles: DataFrame, by: str, star: bool) -> DataFrame:
    """(i, j, dist) for i <= j from the sums over all ranges of k-mers."""
    ids, parts = _terms(profiles, by, star)
    sums = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("d", "nx", "ny")])
    norm = F.sqrt("nx") * F.sqrt("ny")
    dist = F.when((F.col("i") == F.col("j")) | (norm == 0), 0.0).otherwise(0.5 * (1 - F.col("d") / norm))
    found = sums.select("i", "j", F.when((F.abs(dist) < 1e-15) | (dist < 0), 0.0).otherwise(dist).alias("dist"))
    for side in ("i", "j"):
        found = found.join(ids.select(F.col("id").alias(side), F.col("seq").alias(f"seq_{side}")), side)
    return found.select(F.col("seq_i").alias("i"), F.col("seq_j").alias("j"), "dist")


def d2s(profiles: DataFrame, by: str = "seq_id") -> DataFrame:
    """(i, j, dist) for i <= j from profiles with cnt, total and prob: terms over sqrt(cx cx + cy cy)."""
    return _d2(profiles, by, star=False)


def d2star(profiles: DataFrame, by: str = "seq_id") -> DataFrame:
    """(i, j, dist): D2* with denominators sqrt(Nx px) sqrt(Ny py)."""
    return _d2(profiles, by, star=True)


def ranks(counts: DataFrame, by: str = "seq_id") -> DataFrame:
    """(by, code, kmer, cnt, rank): 0-based, frequent first, then by code."""
    coded = counts.withColumn("code", S.encode_kmer(F.col("kmer")))
    return coded.select(by, "code", "kmer", "cnt", (F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cnt"), "code")) - 1).alias("rank"))


def in_vocabulary(counts: DataFrame, k: int, by: str = "seq_id") -> DataFrame:
    """(by, code, kmer, cnt) for every word of k bases; absent ones count 0."""
    words = counts.select(by).distinct().select(by, F.explode(F.expr(f"sequence(0L, {4 ** S.check_k(k) - 1}L)")).alias("code"))
    full = words.select(by, "code", S.decode_kmer(F.col("code"), k).alias("kmer"))
    return full.join(counts, [by, "kmer"], "left").select(by, "code", "kmer", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def vector_norm(weights: DataFrame, by: str) -> DataFrame:
    """Unit vectors of sparse (by, code, weight) rows; a zero vector stays."""
    norms = weights.groupBy(by).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weights.join(norms, by).withColumn("weight", F.when(F.col("norm") > 0, F.col("weight") / F.col("norm")).otherwise(F.col("weight")))


def poisson_posterior(rates: DataFrame, by: str) -> DataFrame:
    """(by, cluster, posterior) from (by, cluster, n, rate): shares of the Poisson likelihoods, infinite ones 0."""
    top = rates.withColumn("l", F.col("n") * F.ln("rate") - F.col("rate"))
    most = top.groupBy(by).agg(F.max("l").alias("m"))
    like = top.join(most, by).withColumn("w", F.exp(F.col("l") - F.col("m")))
    total = like.groupBy(by).agg(F.sum("w").alias("t"))
    post = F.col("w") / F.col("t")
    return like.join(total, by).select(by, "cluster", F.when(post.isNull() | F.isnan(post) | (post == float("inf")), 0.0).otherwise(post).alias("posterior"))
