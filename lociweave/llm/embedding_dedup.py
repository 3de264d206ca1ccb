"""Near-duplicate embeddings: spherical k-means deals vectors into cells, blocked products compare within cells.

Equal vectors are compared once.  Centroids come from a bounded sample; every vector is then in its nearest
cell, its home, and is a guest of those cells of lower number whose border is so near that a neighbour may be at
home there.  A cell is cut into blocks of rows by a hash, so that a crowded cell is many tasks, and each pair of
blocks is one matrix product.  A task gives the number of links of each of its rows and a spanning forest of
its links, never all pairs.

A pair of angle t across the border of two cells is seen if the guest is no further than ``deviations / sqrt(dim)``
of sin(t) from the border.  The bound is exact if that is 1 or more (up to nine dimensions by default); beyond, a pair
is lost only if its difference is further along the normal of the border than that many standard
deviations of a random direction.  ``deviations=float("inf")`` loses none.

Rows.  A vector that is null, empty, zero, or holds null or non-finite components has no links.  Vectors of
different length have no links with each other.  Rows with the same vec_id are vectors of their own;
equal vectors are linked.  A null vec_id is the last in order: it names a component only if all ids of it are null.
An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import written
from . import _graph
from ._text import chosen

COSINE = 0.95
#: rows and bytes of the sample that the centroids are fitted on, at most
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
#: vectors of a cell, about, and cells of one length of vectors, at most
CELL_ROWS, MAX_CELLS, ROUNDS = 2048, 1024, 10
#: lengths of vectors that get cells; each other length is one cell
LENGTHS = 16
DEVIATIONS = 3.0
#: rows of a block, about
BLOCK_ROWS = 4096
#: values of a product that are held at once
PRODUCT = 1 << 22


def _linkable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _hash(v: Column) -> Column:
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), v)), 16, "0") for seed in (1, 2)])


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    """Rows of `dim` values as unit vectors in double precision, whatever their magnitude."""
    x = flat.reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _by_length(column: pa.Array):
    """(length, rows of that length, their unit vectors) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values, sizes = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, unit_rows(values[(offsets[rows][:, None] + np.arange(dim)).ravel()], dim)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """k unit centroids of unit rows; one that loses all its rows stays where it was."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        order = np.argsort(home, kind="stable")
        own, starts = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(x[order], starts, axis=0)
        norms = np.sqrt((sums * sums).sum(axis=1))
        centres[own[norms > 0]] = sums[norms > 0] / norms[norms > 0][:, None]
    return centres


def fit(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centroids of each of the commonest lengths with over CELL_ROWS vectors, from (key, embedding) without bad vectors."""
    counts = vectors.groupBy(F.size("embedding").alias("dim")).count().where(F.col("count") > CELL_ROWS)
    out = {}
    for dim, n in counts.orderBy(F.desc("count"), "dim").limit(LENGTHS).collect():
        rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
        sample = vectors.where((F.size("embedding") == dim) & chosen(min(1.0, rows / n), 12, "key")).select("embedding").limit(2 * rows).toArrow()
        if sample.num_rows:
            x = np.concatenate([unit for _, _, unit in _by_length(sample.column(0))])
            out[dim] = spherical_kmeans(x, max(1, min(MAX_CELLS, -(-n // CELL_ROWS), len(x) // 8)))
    return out


def assign(vectors: DataFrame, centroids: dict[int, np.ndarray], cosine: float = COSINE, deviations: float = DEVIATIONS) -> DataFrame:
    """(dim, cell, home, node, mult, embedding): a row for the home of each vector and for each cell that it is a guest of."""
    sine = float(np.sqrt(max(0.0, 1 - cosine * cosine)))
    kind = vectors.schema["embedding"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            rows, dims, cells, homes = [], [], [], []
            for dim, at, x in _by_length(batch.column("embedding")):
                if dim not in centroids:
                    row, cell, own = np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                else:
                    centres = centroids[dim]
                    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))
                    slack = min(1.0, deviations / np.sqrt(dim)) * sine * gaps + 1e-12
                    near = x @ centres.T
                    own = near.argmax(axis=1)
                    inside = near >= near.max(axis=1)[:, None] - slack[own]
                    inside &= np.arange(len(centres)) <= own[:, None]
                    row, cell = np.nonzero(inside)
                rows.append(at[row])
                dims.append(np.full(len(row), dim))
                cells.append(cell)
                homes.append(cell == own[row])
            if rows:
                rows, dims, cells, homes = (np.concatenate(v) for v in (rows, dims, cells, homes))
                picked = batch.select(["node", "mult", "embedding"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(homes), *picked.columns], ["dim", "cell", "home", "node", "mult", "embedding"])

    return vectors.select("node", "mult", "embedding").mapInArrow(deal, f"dim int, cell int, home boolean, node string, mult long, embedding {kind}")


def spanning_forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of links of a boolean matrix that connect what all of its links connect."""
    rows, cols = links.any(axis=1), links.any(axis=0)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for first in np.flatnonzero(rows):
        if not rows[first]:
            continue
        rows[first], front = False, np.array([first])
        while len(front):
            hit = links[front] & cols
            new = np.flatnonzero(hit.any(axis=0))
            out.append((front[hit[:, new].argmax(axis=0)], new))
            cols[new] = False
            hit = links[:, new] & rows[:, None]
            front = np.flatnonzero(hit.any(axis=1))
            out.append((front, new[hit[front].argmax(axis=1)] if len(front) else front))
            rows[front] = False
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def cell_links(dealt: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, other, n) from rows of `assign`: links to n vectors where other is null, else one link of a forest."""
    sizes = dealt.groupBy("dim", "cell").agg(F.count_if("home").alias("at_home"), F.count_if(~F.col("home")).alias("guests")).where("at_home > 0")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block_rows)).cast("int")
    rows = dealt.join(sizes.select("dim", "cell", blocks("at_home").alias("h"), blocks("guests").alias("g")), ["dim", "cell"])
    pick = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    own = F.when(F.col("home"), pick(F.col("h"))).otherwise(F.col("h") + pick(F.greatest("g", F.lit(1))))
    last = F.when(F.col("home"), F.col("h") + F.col("g")).otherwise(F.col("h")) - 1
    tiles = rows.select("dim", "cell", "node", "mult", "embedding", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    tiles = tiles.select("dim", "cell", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "mult", "embedding")

    def measure(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        own, mult, nodes = (table.column(c).combine_chunks() for c in ("own", "mult", "node"))
        own, mult = own.to_numpy(), mult.to_numpy()
        _, _, unit = next(_by_length(table.column("embedding")))
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        links = np.zeros((len(left), len(right)), bool)
        step = max(1, PRODUCT // max(1, len(right)))
        for lo in range(0, len(left), step):
            links[lo : lo + step] = unit[left[lo : lo + step]] @ unit[right].T >= cosine
        found = np.zeros(len(own), np.int64)
        if p == q:
            np.fill_diagonal(links, False)
        else:
            found[right] = mult[left] @ links
        found[left] += links @ mult[right]
        some = np.flatnonzero(found)
        a, b = spanning_forest(links)
        node = pa.concat_arrays([nodes.take(pa.array(some)), nodes.take(pa.array(left[a]))])
        other = pa.concat_arrays([pa.nulls(len(some), nodes.type), nodes.take(pa.array(right[b]))])
        return pa.table({"node": node, "other": other, "n": np.concatenate([found[some], np.zeros(len(a), np.int64)])})

    return tiles.groupBy("dim", "cell", "p", "q").applyInArrow(measure, "node string, other string, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, deviations: float = DEVIATIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    value = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding"))
    rows = rows.withColumn("key", F.when(_linkable(F.col("embedding")), _hash(F.col("embedding"))))
    least = F.min("vec_id")
    ordered = F.when(least.isNull(), "~").otherwise(F.lpad(F.hex(least.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    groups = rows.where("key is not null").groupBy("key")
    # nodes sort as their smallest vec_id does
    distinct = written(groups.agg(F.concat(ordered, F.lit("-"), F.col("key")).alias("node"), least.alias("least"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding")))
    dealt = written(assign(distinct, fit(distinct), cosine, deviations))
    found = written(cell_links(dealt, cosine))
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    roots = _graph.components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = roots.join(distinct.select(F.col("node").alias("b"), F.col("least").alias("root")), "b").select(F.col("a").alias("node"), "root")
    known = distinct.select("key", "node", "least", "mult").join(counts, "node", "left").join(named, "node", "left")
    known = known.select("key", (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "least").alias("component"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
