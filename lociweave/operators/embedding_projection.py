"""Sample vectors from variant embeddings: H[sample] = sum of dosage * weight * embedding, then cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import VariantKey, dosage, variant_key
from .bootstrap import variant_pair, weights_of
from .distance import BLOCK_BYTES, identity, list_matrix, vector_products

#: embeddings of up to so many bytes are broadcast
BROADCAST_BYTES = 64 << 20


def with_embeddings(variants: DataFrame, embeddings: DataFrame, kind: VariantKey = VariantKey.CHROM_POS_REF_ALT, dim: int | None = None) -> DataFrame:
    """Variants that have GT, a key and an embedding; the embeddings are broadcast only if they are small."""
    keyed = variants.withColumn("key", variant_key(kind, *[F.col(c) for c in ("chrom", "pos", "id", "ref", "alt")])).where("key is not null and gts is not null")
    width = F.size("vec")
    found = embeddings.agg(F.sum(width.cast("long") * 8).alias("bytes"), F.min(width).alias("least"), F.max(width).alias("most")).first()
    if found["least"] != found["most"] or (dim is not None and found["most"] not in (None, dim)):
        raise ValueError(f"embeddings must have one width; found {found['least']} to {found['most']}")
    return keyed.join(F.broadcast(embeddings) if (found["bytes"] or 0) <= BROADCAST_BYTES else embeddings, "key")


def counters(variants: DataFrame, matched: DataFrame) -> dict[str, int]:
    """How many variants were read, used and skipped."""
    total, used = variants.count(), matched.count()
    return {"processed": total, "used": used, "skipped": total - used}


def _blocks(n: int, dim: int, replicates: int, limit: int) -> tuple[int, int]:
    """Samples and replicates of a task, whose sums are under a limit of bytes (or one row)."""
    if 8 * n * dim * (replicates + 1) <= limit:
        return n, replicates + 1
    samples = max(1, min(n, limit // (8 * dim * min(replicates + 1, 16))))
    return samples, max(1, min(replicates + 1, limit // (8 * dim * samples)))


def project(matched: DataFrame, n: int, dim: int, replicates: int = 0, seed: int = 1, limit: int = BLOCK_BYTES) -> DataFrame:
    """(rep, idx, vec array<double>) from rows with gts and vec; each partition adds up its own, by matrix products.

    Where all sums are over the limit, a partition's rows go to a task for each part of samples and replicates, again by
    splits of the input; they are read once either way.
    """
    pair = variant_pair(identity(matched), seed) if replicates else F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    samples, reps = _blocks(n, dim, replicates, limit)
    parts, turns = -(-n // samples), -(-(replicates + 1) // reps)
    part, turn = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn")
    rows = matched.select("gts", "vec", pair["a"].alias("a"), pair["b"].alias("b"), F.spark_partition_id().alias("split"))
    rows = rows.select("*", part).select("*", turn) if parts * turns > 1 else rows.select("*", F.lit(0).alias("part"), F.lit(0).alias("turn"))
    places = F.sequence(F.col("part") * samples, F.least((F.col("part") + 1) * samples, F.lit(n)) - 1)
    rows = rows.select(F.transform(places, lambda k: F.coalesce(dosage(F.get("gts", k)), F.lit(0))).alias("d"), "vec", "a", "b", "part", "turn", "split")
    kind = "rep int, idx int, vec array<double>"

    def add_up(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                p, t = batch.column("part")[0].as_py(), batch.column("turn")[0].as_py()
                own = range(t * reps, min((t + 1) * reps, replicates + 1))
                d, e = list_matrix(batch.column("d"), float), list_matrix(batch.column("vec"), float)
                w = weights_of(*(batch.column(c).to_numpy() for c in ("a", "b")), own)
                total = np.zeros((len(own), d.shape[1], dim)) if total is None else total
                for r in range(len(own)):
                    total[r] += (d * w[:, r : r + 1]).T @ e
        if total is not None:
            r, k = np.divmod(np.arange(len(own) * total.shape[1]), total.shape[1])
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * dim), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array((r + own[0]).astype(np.int32)), pa.array((k + p * samples).astype(np.int32)), vec], ["rep", "idx", "vec"])

    if parts * turns == 1:
        found = rows.mapInArrow(add_up, kind)
    else:
        found = rows.groupBy("split", "part", "turn").applyInArrow(lambda t: pa.Table.from_batches(list(add_up(t.combine_chunks().to_batches()))), kind)
    added = found.select("rep", "idx", F.posexplode("vec").alias("dim", "x")).groupBy("rep", "idx", "dim").agg(F.sum("x").alias("x"))
    return added.groupBy("rep", "idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("vec"))


def project_long(dosages: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The same in DataFrame form from (idx, key, dosage): (idx, dim, value); dosages of 0 and less add nothing."""
    used = dosages.where("dosage > 0").join(embeddings, "key")
    return used.select("idx", "dosage", F.posexplode("vec").alias("dim", "x")).groupBy("idx", "dim").agg(F.sum(F.col("dosage") * F.col("x")).alias("value"))


def vector_distances(vectors: DataFrame, by: list[str] | None = None, name: str = "idx") -> DataFrame:
    """(by..., i, j, dist) for i <= j, cosine over vec, cut to 0..2; zero vectors as in genotype distances."""
    by = by or []
    v = vectors.select(*by, F.col(name).alias("k"), F.col("vec").cast("array<double>").alias("v"))
    pairs = vector_products(v, by, "k")
    same = F.col("k_i") == F.col("k_j")
    dist = F.when((F.col("n_i") == 0) | (F.col("n_j") == 0), F.when(same, 0.0).otherwise(1.0)).otherwise(1 - F.col("dot") / (F.sqrt("n_i") * F.sqrt("n_j")))
    return pairs.select(*by, F.col("k_i").alias("i"), F.col("k_j").alias("j"), F.least(F.greatest(dist, F.lit(0.0)), F.lit(2.0)).alias("dist"))
