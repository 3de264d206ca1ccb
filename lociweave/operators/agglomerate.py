"""Agglomerative clustering of large distance matrices, in rounds of Spark joins, and what follows from the joins.

A pair of clusters of which each is the other's nearest is joined by the one-by-one algorithm sooner or
later, whatever it joins before, if a joined cluster is never nearer than its parts were (complete and
average linkage).  So every round joins all such pairs at once and brings the distances up to date by one
aggregation; there are few rounds where there are many such pairs.  Ties are broken by the clusters'
numbers, as the one-by-one algorithm does, and a joined cluster keeps the number that it gives it; the
tree is the same.  Single linkage, where a tie's place can change with joins elsewhere, has rounds of its own (`single_linkage`).  Matrices of several replicates go through the rounds together.  What few clusters are left of a
matrix, its task joins one by one.  No task holds a large matrix.

Clades are compared by fingerprints: each sample has a 128-bit value, a clade the XOR of its samples'.  They are added
up over the tree of joins by pointer doubling, as are the clusters that a cut leaves, so rounds follow the logarithm of the
tree's depth and rows the number of samples.  Two clades of different samples have the same fingerprint with a
probability of 2^-128.
"""

from __future__ import annotations

from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import single_linkage, tree
from .shared import remove_folder, stored, written
from .tree import LINKAGES, Node, newick

_JOINS = "rep int, round int, kept int, gone int, height double, size long"


def _last_joins(pairs: DataFrame, sizes: DataFrame, turn: int, linkage: str) -> DataFrame:
    """The joins of what is left of each replicate's clusters, one by one in a task each."""
    rows = sizes.select("rep", F.lit(None).cast("int").alias("i"), F.col("id").alias("j"), F.lit(None).cast("double").alias("d"), "n")
    rows = rows.unionByName(pairs.select("rep", "i", "j", "d", F.lit(None).cast("long").alias("n")))

    def join(table: pd.DataFrame) -> pd.DataFrame:
        own = table[table["n"].notna()].sort_values("j")
        ids = own["j"].to_numpy()
        whole = np.full((len(ids), len(ids)), np.inf)
        cells = table[table["n"].isna()]
        i, j = (np.searchsorted(ids, cells[c].to_numpy(int)) for c in ("i", "j"))
        whole[i, j] = whole[j, i] = cells["d"].to_numpy()
        size, out = own["n"].to_numpy(int).copy(), []
        with suppress(ValueError):  # clusters without a distance are left; the caller counts
            for k, (kept, gone, at) in enumerate(tree.join_order(whole, size.copy(), linkage)):
                size[kept] += size[gone]
                out.append((table["rep"].iloc[0], turn + k, ids[kept], ids[gone], at, size[kept]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _JOINS.split(", ")])

    return rows.groupBy("rep").applyInPandas(join, _JOINS)


def merges(dist: DataFrame, linkage: str = "complete", finish: int = tree.GROUP_SAMPLES, height: float | None = None) -> DataFrame:
    """(rep, round, kept, gone, height, size) of all joins, from (i, j, dist) rows with i <= j, of one matrix or of each rep.

    Negative and missing distances are never joined; an error tells if clusters are left without one.  Matrices
    of which no more than `finish` clusters are left are finished one by one.

    With a height (complete linkage only) the joins up to it are given, the same as of the whole tree: two clusters with a pair of samples
    beyond it never meet below it, so such pairs are dropped at once and need not be given.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {LINKAGES}")
    if height is not None and linkage != "complete":
        raise ValueError("joins up to a height are those of complete linkage")
    spark = dist.sparkSession
    rep = F.col("rep").cast("int") if "rep" in dist.columns else F.lit(0)
    far = float("inf")
    good = F.when((F.col("dist") >= 0) & ~F.isnan("dist"), F.col("dist").cast("double")).otherwise(far)
    pairs, pairs_at = stored(dist.where("i < j").select(rep.alias("rep"), F.col("j").cast("int").alias("i"), F.col("i").cast("int").alias("j"), good.alias("d"), F.lit(1.0).alias("w")).where(F.lit(True) if height is None else F.col("d") <= height))
    sizes, sizes_at = stored(dist.where("i = j").select(rep.alias("rep"), F.col("i").cast("int").alias("id"), F.lit(1).cast("long").alias("n")))
    if linkage == "single":
        joins = (sizes.count() or 1) - (sizes.select("rep").distinct().count() or 1)
        out = single_linkage.merges(pairs.where(F.col("d") < far), joins, finish)
        for path in (pairs_at, sizes_at):
            remove_folder(spark, path)
        return out
    turn, done, old = 0, [], []
    while True:
        counted = sizes.groupBy("rep").count().agg(F.max("count").alias("most"), F.sum(F.col("count") - 1).alias("joins")).first()
        left = counted["most"] or 0
        for path in old:
            remove_folder(spark, path)
        if left <= max(1, finish) or (height is not None and pairs.isEmpty()):
            break
        order = F.struct("d", "i", "j").alias("p")
        nearest = pairs.where(F.col("d") < far).select("rep", F.explode(F.array("i", "j")).alias("id"), order).groupBy("rep", "id").agg(F.min("p").alias("p"))
        both = nearest.groupBy("rep", "p").count().where("count = 2").select("rep", "p.i", "p.j", "p.d")
        named = both.join(sizes.select("rep", F.col("id").alias("i"), F.col("n").alias("ni")), ["rep", "i"]).join(sizes.select("rep", F.col("id").alias("j"), F.col("n").alias("nj")), ["rep", "j"])
        first = F.col("ni") > F.col("nj")
        joined = written(named.select("rep", F.lit(turn).alias("round"), F.when(first, F.col("i")).otherwise(F.col("j")).alias("kept"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("gone"), F.col("d").alias("height"), (F.col("ni") + F.col("nj")).alias("size")))
        if joined.isEmpty():
            raise ValueError("no pair of clusters has a distance")
        done.append(joined)
        turn, old = turn + 1, [pairs_at, sizes_at]
        renamed = joined.select("rep", F.col("gone").alias("id"), F.col("kept").alias("to"))
        moved = pairs
        for side in ("i", "j"):
            moved = moved.join(renamed.select("rep", F.col("id").alias(side), F.col("to").alias(f"to_{side}")), ["rep", side], "left")
        moved = moved.select("rep", F.coalesce("to_i", "i").alias("x"), F.coalesce("to_j", "j").alias("y"), "d", "w").where("x <> y")
        value = F.max("d") if linkage == "complete" else F.sum(F.col("d") * F.col("w")) / F.sum("w")
        met = moved.groupBy("rep", F.greatest("x", "y").alias("i"), F.least("x", "y").alias("j")).agg(value.alias("d"), F.sum("w").alias("w"))
        grown = joined.select("rep", F.col("kept").alias("id"), "size")
        sizes, sizes_at = stored(sizes.join(joined.select("rep", F.col("gone").alias("id")), ["rep", "id"], "left_anti").join(grown, ["rep", "id"], "left").select("rep", "id", F.coalesce("size", "n").alias("n")))
        if height is not None:  # all pairs of samples of two clusters must be there
            for side in ("i", "j"):
                met = met.join(sizes.select("rep", F.col("id").alias(side), F.col("n").alias(f"n_{side}")), ["rep", side])
            met = met.where(F.col("w") == F.col("n_i") * F.col("n_j"))
        pairs, pairs_at = stored(met.select("rep", "i", "j", "d", "w"))
    if 1 < left <= max(1, finish):
        done.append(written(_last_joins(pairs, sizes, turn, linkage)))
        if height is None and done[-1].count() < counted["joins"]:
            raise ValueError("no pair of clusters has a distance")
    for path in (pairs_at, sizes_at):
        remove_folder(spark, path)
    out = None
    for part in done:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _JOINS)


def nodes_of(joins: DataFrame, leaves: DataFrame) -> DataFrame:
    """(rep, node, up, id, height, size): the leaves (rep, id) and joins as nodes, each with the join above it (null at the root).

    A node is a struct of the round of its join (-1: a leaf) and the number of its cluster.
    """
    node = F.struct("round", F.col("id").alias("cluster")).alias("node")
    own = joins.select("rep", "round", F.col("kept").alias("id"), F.col("kept").alias("above"), "height", "size")
    gone = joins.select("rep", "round", F.col("gone").alias("id"), F.col("kept").alias("above"), F.lit(None).cast("double").alias("height"), F.lit(None).cast("long").alias("size"))
    single = leaves.select(F.col("rep").cast("int").alias("rep"), F.lit(-1).alias("round"), F.col("id").cast("int").alias("id"), F.lit(None).cast("int").alias("above"), F.lit(0.0).alias("height"), F.lit(1).cast("long").alias("size"))
    # a cluster's part in joins, in order: the one after a node is the one above it
    line = Window.partitionBy("rep", "id").orderBy("round")
    after = F.lead(F.struct("round", F.col("above").alias("cluster"))).over(line)
    every = single.unionByName(own).unionByName(gone)
    return every.select("rep", node, after.alias("up"), "id", "height", "size").where("height is not null")


def _doubled(nodes: DataFrame, round_of) -> DataFrame:
    """Repeat a step on written nodes, whose pointers `up` it doubles, until all pointers are null."""
    spark, path = nodes.sparkSession, None
    while True:
        old = path
        nodes, path = stored(nodes)
        if old:
            remove_folder(spark, old)
        if nodes.where("up is not null").isEmpty():
            return nodes
        above = nodes.select("rep", F.col("node").alias("up"), F.col("up").alias("next"))
        nodes = round_of(nodes, nodes.join(above, ["rep", "up"], "left"))


def clade_prints(joins: DataFrame, leaves: DataFrame) -> DataFrame:
    """(rep, round, kept, size, f1, f2): fingerprint of the samples under each join; leaves are (rep, id, name)."""
    names = leaves.select(F.col("rep").cast("int").alias("rep"), F.struct(F.lit(-1).alias("round"), F.col("id").cast("int").alias("cluster")).alias("node"), *[F.xxhash64(F.lit(s), "name").alias(f"f{s}") for s in (1, 2)])
    nodes = nodes_of(joins, leaves).join(names, ["rep", "node"], "left")
    nodes = nodes.select("rep", "node", "up", "size", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("f1", "f2")])

    def step(nodes, joined):
        below = nodes.where("up is not null").groupBy("rep", F.col("up").alias("node")).agg(F.bit_xor("f1").alias("g1"), F.bit_xor("f2").alias("g2"))
        zero = F.lit(0).cast("long")
        added = joined.join(below, ["rep", "node"], "left")
        return added.select("rep", "node", F.col("next").alias("up"), "size", *[F.col(f"f{s}").bitwiseXOR(F.coalesce(f"g{s}", zero)).alias(f"f{s}") for s in (1, 2)])

    done = _doubled(nodes, step)
    return done.where("node.round >= 0").select("rep", "node.round", F.col("node.cluster").alias("kept"), "size", "f1", "f2")


def clade_support(prints: DataFrame, samples: int, replicates: int) -> DataFrame:
    """(round, kept, size, n, support): in how many of the trees rep 1.. each clade of tree rep 0 is found, and the percentage."""
    inner = prints.where((F.col("size") > 1) & (F.col("size") < samples))
    found = inner.where("rep > 0").groupBy("f1", "f2", "size").agg(F.count_distinct("rep").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return inner.where("rep = 0").join(found, ["f1", "f2", "size"], "left").select("round", "kept", "size", n.alias("n"), F.floor(100 * n / replicates + 0.5).cast("int").alias("support"))


def cut_clusters(joins: DataFrame, leaves: DataFrame, height: float, min_size: int = 1) -> DataFrame:
    """(cluster_id, name, size) of one tree's clusters below a height, numbered by size (largest first, then by first name).

    0 holds the samples of those smaller than min_size.
    """
    nodes = nodes_of(joins, leaves)
    low = nodes.where(F.col("height") <= height).select("rep", F.col("node").alias("up"), F.lit(True).alias("low"))
    nodes = nodes.join(low, ["rep", "up"], "left").select("rep", "node", F.when(F.col("low"), F.col("up")).alias("up"), F.col("node").alias("top"))

    def step(nodes, joined):
        tops = nodes.select("rep", F.col("node").alias("up"), F.col("top").alias("higher"))
        joined = joined.join(tops, ["rep", "up"], "left")
        return joined.select("rep", "node", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top"))

    tops = _doubled(nodes, step).where("node.round = -1").select("rep", F.col("node.cluster").alias("id"), "top")
    members = tops.join(leaves.select(F.col("rep").cast("int").alias("rep"), F.col("id").cast("int").alias("id"), "name"), ["rep", "id"])
    return _numbered(members, min_size)


def _numbered(members: DataFrame, min_size: int) -> DataFrame:
    """(cluster_id, name, size) of (top, name): clusters numbered by size (largest first, then by first name), 0 those smaller than min_size."""
    sizes = written(members.groupBy("top").agg(F.count(F.lit(1)).alias("size"), F.min("name").alias("least")))
    large = sizes.where(F.col("size") >= min_size).select("top", "size", F.row_number().over(Window.orderBy(F.desc("size"), "least")).alias("cluster_id"))  # a row a cluster
    few = sizes.where(F.col("size") < min_size).agg(F.sum("size")).first()[0]
    named = members.join(large, "top", "left")
    return named.select(F.coalesce("cluster_id", F.lit(0)).cast("int").alias("cluster_id"), "name", F.coalesce("size", F.lit(few)).cast("long").alias("size"))


def tree_of(rows: pd.DataFrame, names: dict[int, str]) -> Node:
    """The tree of all joins: parts are joined before the whole, as its height is no lower and its round is later."""
    nodes, heights, root = {k: Node(x) for k, x in names.items()}, dict.fromkeys(names, 0.0), None
    for r in rows.sort_values(["round", "height"]).itertuples(index=False):
        for k in (r.kept, r.gone):
            nodes[k].length = max(0.0, r.height - heights[k])
        root = nodes[r.kept] = Node(children=[nodes[r.kept], nodes.pop(r.gone)], support=int(r.support))
        heights[r.kept] = r.height
    return root


def _leaves(dist: DataFrame) -> DataFrame:
    rep = F.col("rep").cast("int") if "rep" in dist.columns else F.lit(0)
    return dist.where("i = j").select(rep.alias("rep"), F.col("i").cast("int").alias("id"), F.col("name_i").alias("name"))


def _text(joins: DataFrame, leaves: DataFrame) -> DataFrame:
    """(newick) of joins with support; the text is written by one task from one row a sample."""
    null = F.lit(None).cast("int")
    rows = joins.select("round", "kept", "gone", "height", "support", F.lit(None).cast("string").alias("name"))
    names = leaves.select(F.lit(-1).alias("round"), F.col("id").alias("kept"), null.alias("gone"), F.lit(0.0).alias("height"), null.alias("support"), "name")

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["round"] < 0]
        found = rows[rows["round"] >= 0].fillna({"support": -1}).astype({"gone": int})
        return pd.DataFrame({"newick": [newick(tree_of(found, dict(zip(own["kept"], own["name"], strict=True))))]})

    return rows.unionByName(names).groupBy(F.lit(0).alias("all")).applyInPandas(write, "newick string")


def large_tree(dist: DataFrame, linkage: str = "complete", finish: int = tree.GROUP_SAMPLES) -> DataFrame:
    """(newick): the tree of one matrix of (i, j, name_i, name_j, dist)."""
    dist = written(dist.select("i", "j", "name_i", "name_j", "dist"))
    return _text(merges(dist, linkage, finish).withColumn("support", F.lit(None).cast("int")), _leaves(dist))


def large_supported_tree(dist: DataFrame, replicates: int, linkage: str = "complete", finish: int = tree.GROUP_SAMPLES) -> DataFrame:
    """(newick) of rep 0 with the support of the other replicates' trees, from (rep, i, j, name_i, name_j, dist)."""
    dist = written(dist.select("rep", "i", "j", "name_i", "name_j", "dist"))
    leaves = written(_leaves(dist))
    joins = written(merges(dist, linkage, finish))
    support = clade_support(clade_prints(joins, leaves), leaves.where("rep = 0").count(), replicates)
    return _text(joins.where("rep = 0").join(support.select("round", "kept", "support"), ["round", "kept"], "left"), leaves.where("rep = 0"))


def large_clusters(dist: DataFrame, height: float, min_size: int = 1, linkage: str = "complete", finish: int = tree.GROUP_SAMPLES) -> DataFrame:
    """(cluster_id, name, size) of one matrix's tree, cut at a height.

    Complete and single linkage need no pairs beyond the height: they may be left out, and only the others are stored.  Clusters
    of single linkage are what the others connect, so of these too any may be left out whose ends others connect at no greater distance.
    """
    dist = dist.select("i", "j", "name_i", "name_j", "dist")
    if linkage == "average":
        dist = written(dist)
        return cut_clusters(written(merges(dist, linkage, finish)), _leaves(dist), height, min_size)
    dist = written(dist.where((F.col("i") == F.col("j")) | (F.col("dist") <= height)))
    if linkage == "single":
        tops = single_linkage.components(dist.where("i < j and dist >= 0").select(F.col("i").cast("int").alias("a"), F.col("j").cast("int").alias("b")))
        return _numbered(_leaves(dist).join(tops, "id", "left").select(F.coalesce("top", "id").alias("top"), "name"), min_size)
    return cut_clusters(written(merges(dist, linkage, finish, height)), _leaves(dist), height, min_size)
