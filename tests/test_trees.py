import collections
import glob
import itertools
import operator
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lociweave import cli
from lociweave.functions import genotype as G
from lociweave.operators import agglomerate, single_linkage, stats, tree
from lociweave.operators.shared import shared_folder
from lociweave.operators.windows import WindowPolicy
from lociweave.plans import commands as C
from lociweave.sources.matrix import matrix_lines, read_matrix
from lociweave.streaming import windows as streams

from .test_genotypes import HEAD, vcf_text  # noqa: F401

FIVE = "0 2 2.83 4.24 5 / 2 0 2 5.83 6.4 / 2.83 2 0 5.1 5.38 / 4.24 5.83 5.1 0 1 / 5 6.4 5.38 1 0"
NAMES = ["one", "two", "three", "four", "five"]
MATRIX = np.array([[float(x) for x in row.split()] for row in FIVE.split("/")])
GOLDEN = "(((one:2,two:2):0.83,three:2.83):3.57,(four:1,five:1):5.4);"


def test_complete_linkage_golden():
    root = tree.cluster(MATRIX, NAMES)
    assert tree.newick(root) == GOLDEN
    assert tree.label_order(GOLDEN) == NAMES
    assert set(tree.clades(root)) == {("one", "two"), ("one", "three", "two"), ("five", "four")}


@pytest.mark.parametrize("linkage", tree.LINKAGES)
def test_linkages_against_brute_force(linkage):
    rng = np.random.default_rng(1)
    for _ in range(5):
        n = 8
        m = rng.random((n, n))
        m = np.triu(m, 1) + np.triu(m, 1).T
        groups, height = [[k] for k in range(n)], 0.0
        how = {"complete": np.max, "single": np.min, "average": np.mean}[linkage]
        heights = []
        while len(groups) > 1:
            d, a, b = min((how(m[np.ix_(x, y)]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
            heights.append(d)
            groups[a] = groups[a] + groups[b]
            del groups[b]
        root = tree.cluster(m, [str(k) for k in range(n)], linkage)

        def top(x):
            return 0.0 if not x.children else x.children[0].length + top(x.children[0])

        def inner(x):
            return [top(x)] + [h for c in x.children for h in inner(c)] if x.children else []

        assert sorted(inner(root)) == pytest.approx(sorted(heights)) and height == 0


def test_nan_and_negative_cells_are_never_joined():
    m = np.array([[0, -1, 0.3], [-1, 0, 0.4], [0.3, 0.4, 0]])
    with pytest.raises(ValueError):
        tree.cluster(m[:1, :1], ["a"])
    assert tree.newick(tree.cluster(m, list("abc"), "single")).count("(") == 2


def test_cut_and_annotate():
    root = tree.cluster(MATRIX, NAMES)
    assert tree.cut(root, 3) == {1: ["one", "three", "two"], 2: ["five", "four"]}
    assert tree.cut(root, 1.5, 2) == {0: ["one", "three", "two"], 1: ["five", "four"]}
    assert ")67" in tree.newick(tree.annotate(root, {("five", "four"): 2}, 3))


def test_matrix_file(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("5\n" + "\n".join(f"{n}\t" + "\t".join(r.split()) for n, r in zip(NAMES, FIVE.split("/"), strict=True)).replace("6.4", "oops", 1) + "\n")
    cells = {(r["i"], r["j"]): r["dist"] for r in read_matrix(spark, str(path)).collect()}
    assert cells[1, 4] == 1.0 and cells[0, 3] == 4.24 and len(cells) == 25
    (tmp_path / "w.txt").write_text("# window chrom=1\n2\t1\n")
    with pytest.raises(ValueError):
        read_matrix(spark, str(tmp_path / "w.txt"))


def test_matrix_text(spark):
    dist = spark.createDataFrame([(0, 0, "a", "a", 0.0), (0, 1, "a", "b", 1 / 3), (1, 1, "b", "b", 0.0)], "i int, j int, name_i string, name_j string, dist double")
    assert [r["value"] for r in matrix_lines(dist, "'2'").orderBy("line_no").collect()] == ["2", "a\t0\t0.3333333", "b\t0.3333333\t0"]
    moved = tree.reordered(dist, "(B:0.1,a:0.2);")
    assert {(r["name_i"], r["i"]) for r in moved.collect()} == {("a", 1), ("b", 0)}


def test_histogram_and_least_missing(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.5, 1.0, float("nan"))], "dist double")
    assert {r["bin"]: r["n"] for r in stats.histogram(df, 2).collect()} == {0: 1, 1: 2}
    members = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.1), (1, "c", 0.2), (1, "d", 0.1)], "cluster_id int, name string, miss double")
    assert {tuple(r) for r in stats.least_missing(members).collect()} == {(0, "a"), (0, "b"), (1, "d")}


def test_commands(spark, tmp_path, capsys):
    vcf = tmp_path / "a.vcf"
    vcf.write_text(vcf_text([("chr1", p) for p in (100, 200, 300, 400, 500)]))
    run = lambda *a: (cli.run(list(a), spark), capsys.readouterr().out.splitlines())[1]
    out = run("VCF2DIST", str(vcf))
    assert out == ["3\t5", "s1\t0\t0.7\t0.7", "s2\t0.7\t0\t0.6", "s3\t0.7\t0.6\t0"]
    assert run("VCF2TREE", "-i", str(vcf)) == ["((s2:0.6,s3:0.6):0.1,s1:0.7);"]
    assert len(run("VCF2DIST", str(vcf), "--window-bp", "200", "--long")) == 10
    assert sum(x.startswith("# window") for x in run("VCF2TREE", str(vcf), "--window-bp", "200")) == 3
    assert run("VCF2ISTATS", str(vcf))[1].startswith("s1\t5\t")
    (tmp_path / "m").write_text("\n".join(out) + "\n")
    assert run("DIST2TREE", str(tmp_path / "m")) == ["((s2:0.6,s3:0.6):0.1,s1:0.7);"]
    assert run("DIST2Clusters", str(tmp_path / "m"), "-c", "0.65", "--method", "height")[2:] == ["s2\t1\t2", "s3\t1\t2", "s1\t2\t1"]
    assert len(run("DIST2Clusters", str(tmp_path / "m"), "-e")) == 5
    assert len(run("DIST2Hist", str(tmp_path / "m"))) == 3
    (tmp_path / "keep").write_text("s3 x\n")
    assert run("VCFKeepSamples", str(vcf), "-s", str(tmp_path / "keep"))[3].endswith("GT\t1/1")
    assert run("VCFNonrelated", str(vcf), "-c", "0.65")[2].endswith("FORMAT\ts1\ts2")
    assert run("VCFNonrelated", str(vcf), "-c", "0.65", "-h")[2].endswith("FORMAT\ts1\ts2\ts3")  # they share no heterozygous call
    assert run("VCFRemoveClones", str(vcf), "-g", "-e", "-t", "2")[2].startswith("#CHROM")
    with pytest.raises(ValueError):
        cli.run(["VCFRemoveClones", str(vcf), "-g", "-h"], spark)
    (tmp_path / "a.fa").write_text(">s1\nACGTACGTACGTACGTACGT\n>s2\nAAAATTTTGGGGCCCCAAAA\n")
    assert run("FASTA2DIST", str(tmp_path / "a.fa"))[0] == "2"
    with pytest.raises(SystemExit):
        cli.run(["VCF2TREE", str(vcf), "--window-bp", "200", "-b", "5"], spark)
    with pytest.raises(SystemExit):
        cli.run(["VCF2TREE", str(vcf), "--window-bp", "2", "--window-variants", "5"], spark)


def test_heterozygous_genotypes(spark):
    gts = spark.createDataFrame([(["0/1", "1|1", "./.", None, "1", "0/1/1"],)], "gts array<string>")
    row = gts.select(G.hets_only(F.col("gts"), True).alias("only"), G.hets_only(F.col("gts"), False).alias("without")).first()
    assert row["only"] == ["0/1", None, None, None, None, "0/1/1"] and row["without"] == [None, "1|1", "./.", None, "1", None]


def test_streamed_variant_windows_equal_batch(spark, tmp_path):
    schema = "chrom string, pos long, gts array<string>"
    rows = [("chr1", p, g) for p, g in zip((100, 200, 300, 400, 500), [["0/0", "0/1"], ["0/1", "1/1"], ["1/1", "0/0"], ["0/0", "1/1"], ["1/1", "0/1"]], strict=True)] + [("chr1", None, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = streams.stream_variant_windows(stream, WindowPolicy("bp", 200), 2, 2, 2)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["start"], r["n"], r["i"], r["j"]): r["dot"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0, 1, 0, 1] == 1 and got[200, 2, 0, 0] == 4 and len(got) == 9


def slow_cluster(d, labels, linkage):
    """The whole lower triangle is searched at every join."""
    d, n = np.array(d, float), len(labels)
    text, height, size, alive = list(labels), [0.0] * n, [1] * n, set(range(n))
    while len(alive) > 1:
        at, i, j = min((d[i, j], i, j) for i in alive for j in alive if j < i)
        gone, kept = (i, j) if size[i] <= size[j] else (j, i)
        text[kept] = "(" + ",".join(f"{text[k]}:{tree.format_distance(at - height[k])}" for k in (kept, gone)) + ")"
        for k in alive - {kept, gone}:
            a, b = d[kept, k], d[gone, k]
            new = {"complete": max(a, b), "single": min(a, b), "average": (size[kept] * a + size[gone] * b) / (size[kept] + size[gone])}[linkage]
            d[kept, k] = d[k, kept] = new
        height[kept], size[kept] = at, size[kept] + size[gone]
        alive.remove(gone)
    return text[alive.pop()] + ";"


@pytest.mark.parametrize("linkage", tree.LINKAGES)
def test_clusters_with_many_ties_equal_a_plain_search(linkage):
    rng = np.random.default_rng(3)
    for n in (2, 3, 9, 25):
        for most in (3, 1000):
            d = rng.integers(1, most + 1, (n, n)).astype(float)
            d = np.tril(d, -1) + np.tril(d, -1).T
            labels = [f"s{k}" for k in range(n)]
            assert tree.newick(tree.cluster(d, labels, linkage)) == slow_cluster(d, labels, linkage)


@pytest.mark.parametrize("linkage", agglomerate.LINKAGES)
@pytest.mark.parametrize("n,most", [(2, 5), (11, 4)])
def test_rounds_of_joins_give_the_same_tree(spark, linkage, n, most):
    """With many ties (whole numbers, exact for averages of few) and with none."""
    rng = np.random.default_rng(n)
    d = np.tril(rng.integers(1, most + 1, (n, n)) * (1.0 if linkage == "complete" or most > 6 else 720720.0), -1)
    if linkage == "average" and most <= 6:
        n, d = min(n, 6), d[:6, :6]
    d, labels = d + d.T, [f"s{k}" for k in range(n)]
    rows = [(i, j, labels[i], labels[j], float(d[i, j])) for i in range(n) for j in range(i, n)]
    dist = spark.createDataFrame(rows, "i int, j int, name_i string, name_j string, dist double").repartition(3)
    for finish in (1, 4, 100):
        assert agglomerate.large_tree(dist, linkage, finish).first()["newick"] == tree.newick(tree.cluster(d, labels, linkage))


def _settled(d):
    """The tree by forests, without Spark: ties are settled pass by pass as `single_linkage.merges` does; and the number of passes."""
    n, passes = len(d), 0
    i, j = np.tril_indices(n, -1)
    pairs = pd.DataFrame({"grp": 0, "a": i, "b": j, "i": i, "j": j, "d": d[i, j]})
    forest = single_linkage._last_edges(pairs).assign(rep=0, settled=False)
    while True:
        rows = single_linkage.walk(forest)
        members = rows[rows["open"]].set_index("kept")
        if members.empty:
            return tree.newick(agglomerate.tree_of(rows.assign(support=-1), {k: f"s{k}" for k in range(n)})), passes
        passes += 1
        meets = lambda e: e[["i", "j"]].isin(members.index).all(axis=1) & (e["i"].map(members["round"]) == e["j"].map(members["round"])) & (e["i"].map(members["height"]) == e["d"]) & (e["i"].map(members["gone"]) != e["j"].map(members["gone"]))
        tied = pairs[meets(pairs)]
        x, y = tied["i"].map(members["gone"]), tied["j"].map(members["gone"])
        tied = pd.DataFrame({"grp": tied["i"].map(members["round"]), "i": np.maximum(x, y), "j": np.minimum(x, y), "d": tied["d"]}).drop_duplicates()
        new = [single_linkage._last_edges(t.assign(a=t["i"], b=t["j"])).assign(rep=0, settled=True) for _, t in tied.groupby("grp")]
        forest = pd.concat([forest[~meets(forest)], *new])


def test_single_linkage_by_forests_equals_a_plain_search():
    """Few distinct distances, so that groups of ties lie in each other."""
    rng, deepest = np.random.default_rng(2), 0
    for k in range(60):
        n, most = int(rng.integers(2, 25)), int(rng.choice([1, 2, 3, 6, 20, 1000]))
        x = rng.integers(0, 8, (n, 2))
        d = np.abs(x[:, None] - x[None]).sum(axis=2).astype(float) if k % 3 == 0 else np.tril(rng.integers(0, most, (n, n)).astype(float), -1)
        d = np.maximum(d, d.T)
        got, passes = _settled(d)
        deepest = max(deepest, passes)
        assert got == slow_cluster(d, [f"s{j}" for j in range(n)], "single")
    assert deepest > 1


def test_single_linkage_of_a_chain_and_of_replicates(spark):
    """A cluster that takes in sample after sample needs few rounds; replicates and a hot group of clones go through them together."""
    n, rng = 60, np.random.default_rng(4)
    chain = np.cumsum(rng.permutation(n) + 1.0)
    clones = np.where(np.arange(n) < n // 3, 0.0, chain)
    rows, want = [], []
    for rep, x in enumerate((chain, clones)):
        d = np.abs(x[:, None] - x[None])
        rows += [(rep, i, j, f"s{i}", f"s{j}", float(d[i, j])) for i in range(n) for j in range(i, n)]
        want.append(slow_cluster(d, [f"s{k}" for k in range(n)], "single"))
    dist = spark.createDataFrame(rows, "rep int, i int, j int, name_i string, name_j string, dist double").repartition(3)
    for finish in (1, 10):
        joins = agglomerate.merges(dist, "single", finish).toPandas().assign(support=-1)
        for rep in (0, 1):
            assert tree.newick(agglomerate.tree_of(joins[joins["rep"] == rep], {k: f"s{k}" for k in range(n)})) == want[rep]


@pytest.mark.parametrize("linkage", agglomerate.LINKAGES)
def test_rounds_of_joins_of_odd_matrices(spark, linkage):
    one = spark.createDataFrame([(0, 0, "a", "a", 0.0)], "i int, j int, name_i string, name_j string, dist double")
    assert agglomerate.merges(one, linkage).count() == 0
    assert agglomerate.merges(one.limit(0), linkage).count() == 0
    bad = spark.createDataFrame([(0, 0, "a", "a", 0.0), (1, 1, "b", "b", 0.0), (0, 1, "a", "b", float("nan"))], one.schema)
    with pytest.raises(ValueError):
        agglomerate.merges(bad, linkage).count()


def _replicates(n, reps, seed=5):
    rng = np.random.default_rng(seed)
    base, rows, matrices = rng.random((n, 3)), [], []
    for rep in range(reps + 1):
        x = base + 0.2 * (rep > 0) * rng.random((n, 3))
        d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 2)  # with ties
        matrices.append(d)
        rows += [(rep, i, j, f"s{i:02d}", f"s{j:02d}", float(d[i, j])) for i in range(n) for j in range(i, n)]
    return matrices, rows, "rep int, i int, j int, name_i string, name_j string, dist double"


def test_support_by_fingerprints(spark, monkeypatch):
    """Matrices of all replicates in rounds, clades by fingerprints: the tree that one task for each matrix gives."""
    n, reps = 23, 4
    matrices, rows, schema = _replicates(n, reps)
    labels = [f"s{i:02d}" for i in range(n)]
    counts = collections.Counter(c for m in matrices[1:] for c in set(tree.clades(tree.cluster(m, labels))))
    want = tree.newick(tree.annotate(tree.cluster(matrices[0], labels), counts, reps))
    assert re.search(r"\)\d+:", want)
    dist = spark.createDataFrame(rows, schema).repartition(3)
    for finish in (1, 6, 100):
        assert agglomerate.large_supported_tree(dist, reps, finish=finish).first()["newick"] == want
    monkeypatch.setattr(tree, "GROUP_SAMPLES", 5)
    assert C.supported_tree(dist, reps, n).first()["newick"] == want


@pytest.mark.parametrize(("height", "least"), [(0.0, 1), (0.3, 1), (0.45, 3), (9.0, 2)])
def test_cut_by_doubled_pointers(spark, height, least):
    n = 31
    (d,), rows, schema = _replicates(n, 0)
    want = tree.cut(tree.cluster(d, [f"s{i:02d}" for i in range(n)]), height, least)
    got = agglomerate.large_clusters(spark.createDataFrame(rows, schema), height, least, finish=8)
    assert {(r["cluster_id"], r["name"], r["size"]) for r in got.collect()} == {(k, x, len(v)) for k, v in want.items() for x in v}


def test_a_chain_of_joins(spark):
    """A tree as deep as it has leaves takes rounds by the logarithm of its depth."""
    n = 40
    joins = spark.createDataFrame([(0, k, 0, k + 1, float(k + 1), k + 2) for k in range(n - 1)], agglomerate._JOINS)
    leaves = spark.createDataFrame([(0, k, f"s{k}") for k in range(n)], "rep int, id int, name string")
    prints = {r["round"]: (r["f1"], r["size"]) for r in agglomerate.clade_prints(joins, leaves).collect()}
    hashes = [r[0] for r in leaves.orderBy("id").selectExpr("xxhash64(1, name)").collect()]
    want = list(itertools.accumulate(hashes, operator.xor))
    assert prints == {k: (want[k + 1], k + 2) for k in range(n - 1)}
    got = {r["name"]: r["cluster_id"] for r in agglomerate.cut_clusters(joins, leaves, 20.0).collect()}
    assert {k for k, v in got.items() if v == 1} == {f"s{k}" for k in range(21)}


def test_past_rounds_are_deleted(spark):
    home = shared_folder(spark)
    before = set(glob.glob(f"{home}/table-*"))
    _, rows, schema = _replicates(12, 0)
    joins = agglomerate.merges(spark.createDataFrame(rows, schema), finish=1)
    assert len(set(glob.glob(f"{home}/table-*")) - before) == joins.select("round").distinct().count()


@pytest.mark.parametrize("finish", [1, 8])
def test_a_cut_needs_no_pair_beyond_its_height(spark, finish):
    """Where those pairs are left out the clusters are the same, also where some pairs of two clusters are beyond the height and others are not."""
    n, height = 31, 0.45
    (d,), rows, schema = _replicates(n, 0)
    near = [r for r in rows if r[1] == r[2] or r[5] <= height]
    assert n < len(near) < len(rows)
    want = tree.cut(tree.cluster(d, [f"s{i:02d}" for i in range(n)]), height, 2)
    got = agglomerate.large_clusters(spark.createDataFrame(near, schema), height, 2, finish=finish)
    assert {(r["cluster_id"], r["name"], r["size"]) for r in got.collect()} == {(k, x, len(v)) for k, v in want.items() for x in v}


def test_single_linkage_cut_by_what_links_connect(spark):
    """Of a chain, copies and single samples; without the pairs beyond the height, and with copies linked to the first of them alone."""
    rng, n, height = np.random.default_rng(8), 40, 1.5
    x = np.where(np.arange(n) % 4 == 0, 7.0, rng.permutation(n) * 1.3)
    x[[5, 9]] += 500
    x[9] += 50
    d, names = np.abs(x[:, None] - x[None]), [f"s{k:02d}" for k in range(n)]
    want = {(k, name, len(v)) for k, v in tree.cut(tree.cluster(d, names, "single"), height, 2).items() for name in v}
    assert len({k for k, _, _ in want}) > 3 and {"s05", "s09"} <= {name for k, name, _ in want if k == 0}
    pairs = [(i, j, names[i], names[j], float(d[i, j])) for i in range(n) for j in range(i, n)]
    first = {v: int(np.flatnonzero(x == v)[0]) for v in x}
    few = [r for r in pairs if r[0] == r[1] or (r[4] <= height and r[0] == first[x[r[0]]] and (r[4] == 0 or r[1] == first[x[r[1]]]))]
    assert len(few) < sum(r[4] <= height for r in pairs)
    for rows in (pairs, few):
        got = agglomerate.large_clusters(spark.createDataFrame(rows, "i int, j int, name_i string, name_j string, dist double"), height, 2, "single")
        assert {tuple(r) for r in got.select("cluster_id", "name", "size").collect()} == want
