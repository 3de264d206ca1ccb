import numpy as np

from lociweave.operators import dynamic_cut as D
from lociweave.operators import tree


def blobs(rng, sizes, spread, apart):
    points = np.concatenate([rng.normal(k * apart, spread, (n, 2)) for k, n in enumerate(sizes)])
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))


def test_separate_groups_are_found():
    rng = np.random.default_rng(2)
    d = blobs(rng, (20, 12, 8), 0.5, 20)
    labels = [f"x{k:02}" for k in range(40)]
    got = D.dynamic_cut(tree.cluster(d, labels), d, labels, min_size=4, depth=0)
    assert [len(c) for k, c in sorted(got.items()) if k] == [20, 12, 8] and 0 not in got
    assert got[1] == labels[:20] and got[2] == labels[20:32] and got[3] == labels[32:]


def test_small_groups_are_left_or_assigned():
    rng = np.random.default_rng(3)
    d = blobs(rng, (15, 15, 2), 0.3, 15)
    labels = [f"x{k:02}" for k in range(32)]
    root = tree.cluster(d, labels)
    got = D.dynamic_cut(root, d, labels, cut_height=5, min_size=5, assign=False)
    assert got[0] == labels[30:] and [len(got[1]), len(got[2])] == [15, 15]
    every = sorted(x for c in D.dynamic_cut(root, d, labels, min_size=5).values() for x in c)
    assert every == labels


def test_one_member_clusters_and_pairs():
    d = np.array([[0.0, 1.0], [1.0, 0.0]])
    got = D.dynamic_cut(tree.cluster(d, ["a", "b"]), d, ["a", "b"], cut_height=2.0)
    assert sorted(x for c in got.values() for x in c) == ["a", "b"]


def test_clusters_of_groups(spark):
    rng = np.random.default_rng(4)
    d = blobs(rng, (6, 6), 0.2, 9)
    rows = [(g, i, j, f"s{i:02}", f"s{j:02}", float(d[i, j])) for g in (0, 1) for i in range(12) for j in range(i, 12)]
    df = spark.createDataFrame(rows, "grp int, i int, j int, name_i string, name_j string, dist double")
    got = D.dynamic_clusters(df, ["grp"], min_size=3).collect()
    assert {(r["grp"], r["cluster_id"], r["size"]) for r in got} == {(g, k, 6) for g in (0, 1) for k in (1, 2)}
