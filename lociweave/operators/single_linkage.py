"""Single linkage of large distance matrices: a minimum spanning forest by rounds of Spark joins, then its edges in order.

The forest is found by Borůvka's rounds: every cluster takes its least edge, clusters that are linked so become one, and of
the edges between two clusters the least stays.  Rounds follow the logarithm of the number of samples, also where one cluster
takes in sample after sample.  The forest has one row a sample; joined in order of its distances it is the tree.

Equal distances need more, as the one-by-one algorithm takes the pair that is first in row order by the clusters' numbers at the
time.  Among clusters that meet at one distance it joins by ascending rows: when row i comes, i and all clusters of former rows that it
touches are joined, these in order of their numbers.  So only what is linked among the first i rows matters, for each i,
and that is what a minimum spanning forest by (row, column) tells.  Where three or more clusters meet at one distance, their edges of
the forest are therefore replaced by those of a second forest, by the same rounds, once their numbers are known.  Groups that
don't lie in each other are settled together, so the number of such passes is the depth to which groups of ties are nested.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tree
from .shared import remove_folder, stored, written

_EDGES = "grp long, i int, j int, d double"
_WALKED = "open boolean, rep int, round int, kept int, gone int, height double, size long"


def _last_edges(rows: pd.DataFrame) -> pd.DataFrame:
    """The least forest of a group of edges between few clusters a and b, by (d, i, j); Prim's search over a matrix of ranks."""
    rows = rows.sort_values(["d", "i", "j"], ignore_index=True)
    ids, ends = np.unique(rows[["a", "b"]].to_numpy(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    n, none = len(ids), len(rows)
    rank = np.full((n, n), none, np.int64)
    rank[ends[:, 0], ends[:, 1]] = rank[ends[:, 1], ends[:, 0]] = np.arange(none)
    best, todo, taken = np.full(n, none), np.ones(n, bool), []
    for _ in range(n):
        k = int(np.where(todo, best, none + 1).argmin())
        todo[k] = False
        if best[k] < none:
            taken.append(best[k])
        np.minimum(best, rank[k], out=best)
    return rows.loc[taken, ["grp", "i", "j", "d"]]


def _tops(pointers: DataFrame) -> DataFrame:
    """(grp, c, up) with pointers doubled until each leads to one that points to itself."""
    spark, path = pointers.sparkSession, None
    while True:
        old = path
        higher = pointers.select("grp", F.col("c").alias("up"), F.col("up").alias("next"))
        pointers, path = stored(pointers.join(higher, ["grp", "up"]).select("grp", "c", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        if old:
            remove_folder(spark, old)
        if pointers.where("moved").isEmpty():
            return pointers.drop("moved")


def spanning_forest(edges: DataFrame, finish: int = tree.GROUP_SAMPLES) -> DataFrame:
    """The rows of (grp, i, j, d) that are each group's least spanning forest by (d, i, j); (i, j) is unique in a group.

    Groups go through the rounds together; when all have `finish` clusters at most, a task each finds the rest.
    """
    spark, found, old = edges.sparkSession, [], None
    left, path = stored(edges.select("grp", F.col("i").alias("a"), F.col("j").alias("b"), "d", "i", "j"))
    while True:
        least = left.select("grp", F.explode(F.array("a", "b")).alias("c"), F.struct("d", "i", "j", "a", "b").alias("p")).groupBy("grp", "c").agg(F.min("p").alias("p"))
        least, least_path = stored(least)
        most = least.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
        if old:
            remove_folder(spark, old)
        if most <= max(2, finish):
            break
        # an edge that both its clusters take has two rows: they become the smaller of them
        picked = written(least.groupBy("grp", "p").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")))
        found.append(picked.select("grp", "p.i", "p.j", "p.d"))
        low, high = F.least("p.a", "p.b"), F.greatest("p.a", "p.b")
        one = picked.select("grp", "c", F.when(F.col("n") == 2, F.col("c")).when(F.col("c") == low, high).otherwise(low).alias("up"))
        two = picked.where("n = 2").select("grp", high.alias("c"), low.alias("up"))
        tops = _tops(one.unionByName(two))
        moved = left
        for side in ("a", "b"):
            moved = moved.join(tops.select("grp", F.col("c").alias(side), F.col("up").alias(f"top_{side}")), ["grp", side])
        x, y = F.greatest("top_a", "top_b").alias("x"), F.least("top_a", "top_b").alias("y")
        kept = moved.where("top_a <> top_b").groupBy("grp", x, y).agg(F.min(F.struct("d", "i", "j")).alias("p"))
        old = path
        left, path = stored(kept.select("grp", F.col("x").alias("a"), F.col("y").alias("b"), "p.d", "p.i", "p.j"))
        remove_folder(spark, least_path)
    out = written(left.groupBy("grp").applyInPandas(_last_edges, _EDGES))
    for used in (path, least_path):
        remove_folder(spark, used)
    for part in found:
        out = out.unionByName(part.select("grp", "i", "j", "d"))
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, top) of all ends of links (a, b): one number for all that are connected.

    In a round every number points to the least of it and its neighbours, and what leads to one top becomes one.  After two
    rounds all that have links are joined with another, so rounds follow the logarithm of the number of samples.
    """
    spark, found = links.sparkSession, None
    links, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tops = _tops(both.groupBy(F.lit(0).cast("long").alias("grp"), F.col("a").alias("c")).agg(F.min("b").alias("up")).select("grp", "c", F.least("c", "up").alias("up"))).select("c", "up")
        if found is None:
            found = tops.select(F.col("c").alias("id"), F.col("up").alias("top"))
        else:
            found = written(found.join(tops, F.col("top") == F.col("c"), "left").select("id", F.coalesce("up", "top").alias("top")))
        moved = links
        for side in ("a", "b"):
            moved = moved.join(tops.select(F.col("c").alias(side), F.col("up").alias(f"top_{side}")), side)
        old, (links, path) = path, stored(moved.where("top_a <> top_b").select(F.greatest("top_a", "top_b").alias("a"), F.least("top_a", "top_b").alias("b")).distinct())
        remove_folder(spark, old)
    remove_folder(spark, path)
    return found if found is not None else spark.createDataFrame([], "id int, top int")


class _Clusters:
    """What joins have made of the samples: the number that a cluster keeps, its members, whether its number is known."""

    def __init__(self, samples):
        self.number = {k: k for k in samples}
        self.members = {k: [k] for k in samples}
        self.known = dict.fromkeys(samples, True)
        self.home = {k: k for k in samples}

    def join(self, a: int, b: int) -> tuple[int, int, int, int]:
        """(home, kept, gone, size) of two clusters, which are named by homes; the larger keeps its number, the lower of equals."""
        i, j = sorted((a, b), key=lambda k: -self.number[k])
        gone, kept = (i, j) if len(self.members[i]) <= len(self.members[j]) else (j, i)
        numbers = self.number[kept], self.number[gone]
        into, out = (a, b) if len(self.members[a]) >= len(self.members[b]) else (b, a)
        moved = self.members.pop(out)
        for k in moved:
            self.home[k] = into
        self.members[into] += moved
        self.number[into] = numbers[0]
        self.known[into] = self.known[a] and self.known[b]
        return into, *numbers, len(self.members[into])


def _parts(links: list[tuple[int, int, bool]]):
    """(clusters, settled, neighbours) of each connected part of links."""
    near: dict[int, list[int]] = {}
    loose = set()
    for a, b, settled in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
        if not settled:
            loose.add(a)
    seen = set()
    for start in near:
        if start in seen:
            continue
        seen.add(start)
        part = [start]
        for k in part:
            for other in near[k]:
                if other not in seen:
                    seen.add(other)
                    part.append(other)
        yield part, loose.isdisjoint(part), near


def walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Joins of one matrix's forest in order, as far as ties are settled; and of the groups to settle next the members (open rows).

    An open row gives the group's number as round, a sample as kept and its cluster's number as gone.
    """
    rows = rows.sort_values("d", kind="stable")
    held, out = _Clusters(np.unique(rows[["i", "j"]].to_numpy()).tolist()), []
    rep, turn, group = int(rows["rep"].iloc[0]), 0, 0
    edges = zip(rows["d"].tolist(), rows["i"].tolist(), rows["j"].tolist(), rows["settled"].tolist(), strict=True)
    for at, level in itertools.groupby(edges, lambda e: e[0]):
        for part, settled, near in _parts([(held.home[i], held.home[j], done) for _, i, j, done in level]):
            known = all(held.known[k] for k in part)
            if known and (settled or len(part) == 2):
                row = {k: held.number[k] for k in part}
                for k in sorted(part, key=row.get):
                    own = held.home[k]
                    touched = {held.home[x] for x in near[k] if row[x] < row[k]}
                    for other in sorted(touched, key=held.number.get):
                        own, kept, gone, size = held.join(own, other)
                        out.append((False, rep, turn, kept, gone, at, size))
                        turn += 1
                continue
            if known:
                out += [(True, rep, group, sample, held.number[k], at, len(part)) for k in part for sample in held.members[k]]
                group += 1
            own = part[0]
            for other in part[1:]:
                own = held.join(own, other)[0]
            held.known[own] = False
    return pd.DataFrame(out, columns=[x.split()[0] for x in _WALKED.split(", ")])


def merges(pairs: DataFrame, joins: int, finish: int = tree.GROUP_SAMPLES) -> DataFrame:
    """(rep, round, kept, gone, height, size) of all joins from written (rep, i, j, d), i > j, of all finite distances.

    `joins` is the number of joins that all matrices have together; an error tells if clusters are left without a distance.
    A matrix's forest, one row a sample, is walked by one task.
    """
    spark = pairs.sparkSession
    forest = spanning_forest(pairs.select(F.col("rep").cast("long").alias("grp"), "i", "j", "d"), finish)
    forest, path = stored(forest.select(F.col("grp").cast("int").alias("rep"), "i", "j", "d", F.lit(False).alias("settled")))
    if forest.count() < joins:
        raise ValueError("no pair of clusters has a distance")
    while True:
        walked, walked_path = stored(forest.groupBy("rep").applyInPandas(walk, _WALKED))
        members = walked.where("open").select("rep", F.col("round").alias("part"), F.col("kept").alias("id"), F.col("gone").alias("number"), "height")
        if members.isEmpty():
            remove_folder(spark, path)
            return walked.where("not open").select("rep", "round", "kept", "gone", "height", "size")

        def within(edges: DataFrame) -> DataFrame:
            """Edges of two clusters that meet in a group, with the clusters' numbers."""
            for side in ("i", "j"):
                own = members.select("rep", "part", "height", F.col("id").alias(side), F.col("number").alias(f"number_{side}"))
                edges = edges.join(own, [*(["rep", "part", "height"] if side == "j" else ["rep"]), side])
            return edges.where("d = height and number_i <> number_j")

        grp = (F.shiftleft(F.col("rep").cast("long"), 32) + F.col("part")).alias("grp")
        tied = within(pairs).select(grp, F.greatest("number_i", "number_j").alias("i"), F.least("number_i", "number_j").alias("j"), F.lit(0.0).alias("d")).distinct()
        heights = members.select(grp, "rep", "height").distinct()
        new = spanning_forest(tied, finish).drop("d").join(heights, "grp").select("rep", "i", "j", F.col("height").alias("d"), F.lit(True).alias("settled"))
        rest = forest.join(within(forest).select("rep", "i", "j"), ["rep", "i", "j"], "left_anti")
        old, (forest, path) = path, stored(rest.select("rep", "i", "j", "d", "settled").unionByName(new))
        for used in (old, walked_path):
            remove_folder(spark, used)
