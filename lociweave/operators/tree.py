"""Agglomerative clustering of one distance matrix, trees as Newick, clade support.

For many matrices, of windows or bootstrap replicates, Spark parallelises over the matrices: each is a group.
One matrix of more than GROUP_SAMPLES samples is clustered in rounds, see `agglomerate`.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import format_distance
from .shared import materialised

LINKAGES = ("complete", "average", "single")
#: samples up to which one matrix is clustered by one task (8 bytes for each pair, a few times)
GROUP_SAMPLES = 4096


@dataclass
class Node:
    label: str | None = None
    length: float = 0.0
    support: int = -1
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[str]:
        return [self.label] if not self.children else [x for c in self.children for x in c.leaves()]


def join_order(whole: np.ndarray, sizes: np.ndarray, linkage: str):
    """(kept, gone, distance) of all joins of clusters of some sizes by their symmetric matrix, which is changed; inf is never joined.

    The pair with the smallest distance is joined, the first in row order among equals; the larger cluster (the one
    with the smaller number if they are as large) keeps its number.
    """
    n, sizes = len(sizes), np.array(sizes)
    alive = np.ones(n, bool)
    # of each row the least cell left of the diagonal and its first place
    least, first = np.full(n, np.inf), np.zeros(n, int)

    def look(rows):
        for r in rows:
            if alive[r] and r:
                row = np.where(alive[:r], whole[r, :r], np.inf)
                first[r] = row.argmin()
                least[r] = row[first[r]]
            else:
                least[r] = np.inf

    look(range(n))
    for _ in range(n - 1):
        i = int(least.argmin())
        j, at = int(first[i]), least[i]
        if not np.isfinite(at):
            raise ValueError("no pair of clusters has a distance")
        gone, kept = (i, j) if sizes[i] <= sizes[j] else (j, i)
        yield kept, gone, at
        a, b = whole[kept], whole[gone]
        if linkage == "complete":
            merged = np.maximum(a, b)
        elif linkage == "single":
            merged = np.minimum(a, b)
        else:
            merged = (sizes[kept] * a + sizes[gone] * b) / (sizes[kept] + sizes[gone])
        whole[kept], whole[:, kept] = merged, merged
        alive[gone] = False
        sizes[kept] += sizes[gone]
        below = np.arange(kept + 1, n)
        closer = below[alive[below] & ((merged[below] < least[below]) | ((merged[below] == least[below]) & (first[below] > kept)))]
        least[closer], first[closer] = merged[closer], kept
        changed = np.isin(first, (kept, gone)) & alive
        changed[closer] = False
        changed[[kept, gone]] = True
        look(np.flatnonzero(changed).tolist())


def cluster(matrix: np.ndarray, labels: list[str], linkage: str = "complete") -> Node:
    """The tree of all joins; negative and NaN cells are never joined.  The cluster that keeps its number comes first in the new node."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {LINKAGES}")
    n = len(labels)
    if n < 2:
        raise ValueError("a tree needs two samples at least")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * n + 1000))  # a tree may be as deep as it has leaves
    d = np.array(matrix, float)
    d = np.where(np.tri(n, k=-1, dtype=bool), d, np.nan)
    d[~(d >= 0)] = np.inf
    nodes, heights, kept = [Node(x) for x in labels], np.zeros(n), 0
    for kept, gone, at in join_order(np.minimum(d, d.T), np.ones(n, int), linkage):
        for k in (kept, gone):
            length = at - heights[k]
            if length < -1e-9:
                raise ValueError("a branch length is negative")
            nodes[k].length = max(0.0, length)
        nodes[kept], heights[kept] = Node(children=[nodes[kept], nodes[gone]]), at
    return nodes[kept]


def newick(node: Node) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 20))

    def write(x: Node, root: bool) -> str:
        out = ""
        if x.children:
            out = "(" + ",".join(write(c, False) for c in x.children) + ")" + (str(x.support) if x.support > 0 else "")
        return out if root else out + (x.label or "") + ":" + format_distance(x.length)

    return write(node, True) + ";"


def label_order(tree: str) -> list[str]:
    """Leaves of a Newick text, left to right."""
    return re.findall(r"(?<=[(,])([^(),:;]+)(?=:)", tree)


def clades(node: Node) -> list[tuple[str, ...]]:
    """Sorted leaves of every inner node that has more than one and fewer than all."""
    total, out = len(node.leaves()), []

    def walk(x: Node):
        if x.children:
            own = tuple(sorted(x.leaves()))
            if 1 < len(own) < total:
                out.append(own)
            for c in x.children:
                walk(c)

    walk(node)
    return out


def annotate(node: Node, counts: dict[tuple[str, ...], int], replicates: int) -> Node:
    """Sets every clade's support in percent, rounded half up."""
    own = tuple(sorted(node.leaves()))
    if node.children:
        if own in counts:
            node.support = int(np.floor(100 * counts[own] / replicates + 0.5))
        for c in node.children:
            annotate(c, counts, replicates)
    return node


def matrix_of(rows: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """The symmetric matrix and the labels of i, j, name_i, name_j, dist rows."""
    names = dict(zip(rows["i"], rows["name_i"], strict=True)) | dict(zip(rows["j"], rows["name_j"], strict=True))
    order = sorted(names)
    at = {k: p for p, k in enumerate(order)}
    m = np.full((len(order), len(order)), np.nan)
    i, j = rows["i"].map(at).to_numpy(), rows["j"].map(at).to_numpy()
    m[i, j] = m[j, i] = rows["dist"].to_numpy(float)
    return m, [str(names[k]) for k in order]


def trees(dist: DataFrame, by: list[str], linkage: str = "complete") -> DataFrame:
    """(by..., newick, clades array<array<string>>) of each group's distances."""
    fields = ", ".join(f"`{c}` {dist.schema[c].dataType.simpleString()}" for c in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        root = cluster(*matrix_of(rows), linkage)
        out = rows.loc[rows.index[:1], by].reset_index(drop=True)
        return out.assign(newick=[newick(root)], clades=[[list(c) for c in clades(root)]])

    return dist.groupBy(*by).applyInPandas(run, f"{fields}, newick string, clades array<array<string>>")


def clade_counts(replicate_trees: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., clade, n): in how many of the trees each clade is found."""
    by = by or []
    return replicate_trees.select(*by, F.explode(F.array_distinct("clades")).alias("clade")).groupBy(*by, "clade").agg(F.count(F.lit(1)).alias("n"))


def clade_support(trees_by_rep: DataFrame, replicates: int) -> DataFrame:
    """(clade, n, support) of the clades of tree rep 0 among the trees of rep 1.."""
    own = trees_by_rep.where("rep = 0").select(F.explode("clades").alias("clade"))
    counts = clade_counts(trees_by_rep.where("rep > 0"))
    n = F.coalesce("n", F.lit(0))
    return own.join(counts, "clade", "left").select("clade", n.alias("n"), F.floor(100 * n / replicates + 0.5).cast("int").alias("support"))


def supported_tree(dist: DataFrame, replicates: int, linkage: str = "complete") -> DataFrame:
    """(rep, newick) of rep 0 with the support of the other replicates' trees."""
    dist = materialised(dist)
    support = {tuple(r["clade"]): r["n"] for r in clade_support(trees(dist, ["rep"], linkage), replicates).collect()}  # one row a clade, fewer than samples

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        root = annotate(cluster(*matrix_of(rows), linkage), support, replicates)
        return pd.DataFrame({"rep": [0], "newick": [newick(root)]})

    return dist.where("rep = 0").groupBy("rep").applyInPandas(run, "rep int, newick string")


def cut(node: Node, height: float, min_size: int = 1) -> dict[int, list[str]]:
    """Clusters below a height, numbered by size (largest first, then by name); 0 holds those smaller than min_size."""
    found: list[list[str]] = []

    def top(x: Node) -> float:
        return 0.0 if not x.children else max(c.length + top(c) for c in x.children)

    def walk(x: Node):
        if not x.children or top(x) <= height:
            found.append(sorted(x.leaves()))
        else:
            for c in x.children:
                walk(c)

    walk(node)
    large = sorted((c for c in found if len(c) >= min_size), key=lambda c: (-len(c), c))
    small = sorted(x for c in found if len(c) < min_size for x in c)
    return ({0: small} if small else {}) | {k + 1: c for k, c in enumerate(large)}


def clusters(dist: DataFrame, by: list[str], height: float, min_size: int = 1, linkage: str = "complete") -> DataFrame:
    """(by..., cluster_id, name, size) of each group's tree, cut at a height."""
    fields = "".join(f"`{c}` {dist.schema[c].dataType.simpleString()}, " for c in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = cut(cluster(*matrix_of(rows), linkage), height, min_size)
        flat = [(k, name, len(names)) for k, names in got.items() for name in names]
        out = pd.DataFrame(flat, columns=["cluster_id", "name", "size"])
        for c in reversed(by):
            out.insert(0, c, rows[c].iloc[0])
        return out

    return dist.groupBy(*by).applyInPandas(run, f"{fields}cluster_id int, name string, size long")


def cluster_strings(found: DataFrame) -> DataFrame:
    """`id size name name...` of each cluster."""
    return found.groupBy("cluster_id").agg(F.sort_array(F.collect_set("name")).alias("names")).select("cluster_id", F.concat_ws(" ", F.col("cluster_id").cast("string"), F.size("names").cast("string"), F.concat_ws(" ", "names")).alias("line"))


def reordered(dist: DataFrame, tree: str) -> DataFrame:
    """Distances with i and j as places of the tree's leaves; labels meet trimmed and in lower case."""
    spark = dist.sparkSession
    places = spark.createDataFrame([(x.strip().lower(), k) for k, x in enumerate(label_order(tree))], "label string, place int")
    for side in ("i", "j"):
        own = places.select(F.col("label").alias(f"label_{side}"), F.col("place").alias(f"place_{side}"))
        dist = dist.join(F.broadcast(own), F.lower(F.trim(f"name_{side}")) == F.col(f"label_{side}"))
    return dist.select(F.col("place_i").alias("i"), F.col("place_j").alias("j"), "name_i", "name_j", "dist")
