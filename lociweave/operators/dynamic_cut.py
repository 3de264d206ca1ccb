"""Dynamic hybrid cut of a tree, after the published description of adaptive branch cutting.

Branches grow from the lowest joins up. Where two branches meet, each is tested: it must have enough
members, its core (its earliest members) must be tight, and the join must lie well above the core. If
both pass they are closed as clusters of their own; otherwise they go on as one branch. Members left over
may be assigned to the nearest cluster afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import tree

#: core scatter allowed at each depth of splitting, as a share of the heights' range (fixed values)
CORE_SCATTER = (0.64, 0.73, 0.82, 0.91, 0.95)
#: the reference height is that of the join at this share of all joins, from below
REFERENCE = 0.05


@dataclass
class Limits:
    cut: float
    scatter: float
    gap: float
    size: int
    split: float = 0.0


@dataclass
class Branch:
    members: list[int]
    closed: list[list[int]] = field(default_factory=list)  # clusters that were closed below


def joins(root: tree.Node) -> list[tuple[float, tree.Node]]:
    """(height, node) of every inner node, children before parents."""
    out: list[tuple[float, tree.Node]] = []

    def walk(x: tree.Node) -> float:
        if not x.children:
            return 0.0
        height = max(c.length + walk(c) for c in x.children)
        out.append((height, x))
        return height

    walk(root)
    return out


def limits(heights: list[float], cut_height: float | None, depth: int, min_size: int, split: float) -> Limits:
    """Limits from the joins' heights; without a cut height it is 99 % of the range above the reference."""
    ordered = sorted(heights)
    reference = ordered[max(0, round(REFERENCE * len(ordered)) - 1)]
    cut = 0.99 * (ordered[-1] - reference) + reference if cut_height is None else min(cut_height, ordered[-1])
    share = CORE_SCATTER[depth]
    room = max(0.0, cut - reference)
    return Limits(cut, reference + share * room, 0.75 * (1 - share) * room, min_size, split)


def core_scatter(members: list[int], d: np.ndarray, min_size: int) -> float:
    """Mean distance among the first members of a branch, about the square root of those beyond the least size."""
    base = min_size // 2 + 1
    n = base if len(members) <= base else min(len(members), base + int(np.sqrt(len(members) - base)))
    core = members[:n]
    if len(core) < 2:
        return 0.0
    part = d[np.ix_(core, core)]
    return float(part.sum() / (len(core) * (len(core) - 1)))


def passes(branch: Branch, top: float, d: np.ndarray, lim: Limits) -> bool:
    """Whether a branch that joins another at height top is a cluster; composite branches already hold clusters."""
    if branch.closed:
        return True
    scatter = core_scatter(branch.members, d, lim.size)
    return len(branch.members) >= lim.size and scatter < lim.scatter and top - scatter > lim.gap


def dynamic_cut(root: tree.Node, d: np.ndarray, labels: list[str], cut_height: float | None = None, min_size: int = 1, depth: int = 1, min_split: float = 0.0, assign: bool = True) -> dict[int, list[str]]:
    """Clusters by number, largest first; 0 holds what belongs to none.

    min_split keeps two branches together if they meet below that height.
    """
    found = joins(root)
    lim = limits([h for h, _ in found], cut_height, depth, max(1, min_size), min_split)
    at = {x: k for k, x in enumerate(labels)}
    branches: dict[int, Branch] = {}
    loose: list[Branch] = []

    def of(node: tree.Node) -> Branch | None:
        return branches.pop(id(node), None) if node.children else Branch([at[node.label]])

    for height, node in found:
        below = [b for b in map(of, node.children) if b is not None]
        if height > lim.cut:  # above the cut nothing joins any more
            loose += below
            continue
        below.sort(key=lambda b: -len(b.members))
        joined = below[0]
        for other in below[1:]:
            if len(joined.members) > 1 and len(other.members) > 1 and height >= lim.split and passes(joined, height, d, lim) and passes(other, height, d, lim):
                parts = [c for b in (joined, other) for c in (b.closed or [b.members])]
                joined = Branch(joined.members + other.members, parts)
            else:
                joined = Branch(joined.members + other.members, joined.closed + other.closed)
        branches[id(node)] = joined
    loose += branches.values()
    clusters = []
    for b in loose:
        if b.closed:
            clusters += b.closed
        elif len(b.members) >= lim.size and core_scatter(b.members, d, lim.size) < lim.scatter:
            clusters.append(b.members)
    held = {k for c in clusters for k in c}
    rest = [k for k in range(len(labels)) if k not in held]
    if assign and clusters:
        grown = [list(c) for c in clusters]
        left = []
        for k in rest:
            means = [d[k, c].mean() for c in clusters]
            best = int(np.argmin(means))
            if means[best] <= lim.cut:
                grown[best].append(k)
            else:
                left.append(k)
        clusters, rest = grown, left
    named = sorted((sorted(labels[k] for k in c) for c in clusters), key=lambda c: (-len(c), c))
    return ({0: sorted(labels[k] for k in rest)} if rest else {}) | {k + 1: c for k, c in enumerate(named)}


def dynamic_clusters(dist: DataFrame, by: list[str], cut_height: float | None = None, min_size: int = 1, depth: int = 1, min_split: float = 0.0, linkage: str = "complete") -> DataFrame:
    """(by..., cluster_id, name, size) of each group's distances; groups are worked on in parallel."""
    fields = "".join(f"`{c}` {dist.schema[c].dataType.simpleString()}, " for c in by)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        d, labels = tree.matrix_of(rows)
        got = dynamic_cut(tree.cluster(d, labels, linkage), d, labels, cut_height, min_size, depth, min_split)
        out = pd.DataFrame([(k, name, len(names)) for k, names in got.items() for name in names], columns=["cluster_id", "name", "size"])
        for c in reversed(by):
            out.insert(0, c, rows[c].iloc[0])
        return out

    return dist.groupBy(*by).applyInPandas(run, f"{fields}cluster_id int, name string, size long")
