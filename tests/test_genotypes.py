import bz2
import gzip
import json
import lzma

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import genotype as G
from lociweave.operators import bootstrap, distance, stats, tree, windows
from lociweave.operators import embedding_projection as emb
from lociweave.plans import commands as C
from lociweave.sources import embeddings
from lociweave.sources.text import read_lines
from lociweave.sources.vcf import kept_lines

HEAD = "##fileformat=VCFv4.2\n##contig=<ID=chr1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\ts3\n"
GTS = [["0/0", "0/1", "1/1"], ["0/1", "1/1", "0/0"], ["1/1", "0/0", "0/1"], ["0/0", "1/1", "0/1"], ["1/1", "0/1", "0/0"]]


def vcf_text(places, gts=GTS, fmt="GT"):
    return HEAD + "".join(f"{c}\t{p}\t.\tA\tT\t.\tPASS\t.\t{fmt}\t" + "\t".join(g) + "\n" for (c, p), g in zip(places, gts, strict=False))


@pytest.fixture()
def vcf_path(tmp_path):
    path = tmp_path / "a.vcf"
    path.write_text(vcf_text([("chr1", p) for p in (100, 200, 300, 400, 500)]))
    return str(path)


def test_global_distances_and_tree(spark, vcf_path):
    vcf = C.read_vcf(spark, vcf_path)
    assert (vcf.samples, vcf.ploidy, vcf.max_alleles) == (["s1", "s2", "s3"], 2, 2)
    dist = {(r["name_i"], r["name_j"]): r["dist"] for r in C.vcf_distances(vcf).collect()}
    assert dist == pytest.approx({("s1", "s1"): 0, ("s2", "s2"): 0, ("s3", "s3"): 0, ("s1", "s2"): 0.7, ("s1", "s3"): 0.7, ("s2", "s3"): 0.6}, abs=1e-12)
    grown = tree.trees(C.vcf_distances(vcf), ["rep"]).first()
    assert grown["newick"] == "((s2:0.6,s3:0.6):0.1,s1:0.7);"


def test_windowed_distances(spark, vcf_path):
    vcf = C.read_vcf(spark, vcf_path)
    dist = C.windowed_distances(vcf, windows.WindowPolicy("bp", 200))
    rows = {(r["start"], r["end"], r["n"], r["name_i"], r["name_j"]): r["dist"] for r in dist.where("i < j").collect()}
    want = {(0, 200, 1): (0.5, 1, 0.5), (200, 400, 2): (0.75, 0.5, 0.75), (400, 600, 2): (0.75, 0.75, 0.5)}
    assert rows == pytest.approx({(*w, a, b): d for w, ds in want.items() for (a, b), d in zip((("s1", "s2"), ("s1", "s3"), ("s2", "s3")), ds, strict=True)}, abs=1e-12)
    trees = {r["start"]: r["newick"] for r in tree.trees(dist, ["start"]).collect()}
    assert trees == {0: "((s1:0.5,s2:0.5):0.5,s3:1);", 200: "((s1:0.5,s3:0.5):0.25,s2:0.75);", 400: "((s2:0.5,s3:0.5):0.25,s1:0.75);"}
    one = C.windowed_distances(vcf, windows.WindowPolicy("variants", 1000))
    whole = {(r["i"], r["j"]): r["dist"] for r in C.vcf_distances(vcf).collect()}
    assert {(r["i"], r["j"]): r["dist"] for r in one.collect()} == pytest.approx(whole)
    assert C.long_lines(dist).count() == 9
    lines = [r["value"] for r in C.windowed_matrix_lines(dist, 3).orderBy("start", "line_no").collect()]
    assert lines[0] == "# window chrom=chr1 start=0 end=200 nvariants=1 nsamples=3" and lines[1] == "3\t1" and lines[2] == "s1\t0\t0.5\t1"


def test_contigs_split_variant_windows(spark, tmp_path):
    path = tmp_path / "b.vcf"
    path.write_text(vcf_text([("chr1", 100), ("chr1", 200), ("chr2", 100), ("chr2", 200)]))
    vcf = C.read_vcf(spark, str(path))
    policy = windows.WindowPolicy("variants", 1000)
    found = windows.bounds(windows.assign(vcf.variants, policy), policy).collect()
    assert sorted((r["chrom"], r["n"]) for r in found) == [("chr1", 2), ("chr2", 2)]


@pytest.mark.parametrize(
    "mode,size,places,want",
    [
        ("bp", 100, [("chr1", 50), ("chr1", 150), ("chr1", 250)], [("chr1", 0, 100, 1), ("chr1", 100, 200, 1), ("chr1", 200, 300, 1)]),
        ("variants", 3, [("chr1", 10), ("chr1", 20), ("chr1", 30), ("chr1", 40)], [("chr1", 10, 31, 3), ("chr1", 40, 41, 1)]),
        ("bp", 10000, [("chr1", 100), ("chr1", 200), ("chr2", 100)], [("chr1", 0, 10000, 2), ("chr2", 0, 10000, 1)]),
        ("variants", 100, [("chr1", 100), ("chr1", 200), ("chr2", 50)], [("chr1", 100, 201, 2), ("chr2", 50, 51, 1)]),
        ("bp", 100, [("chr1", 50), ("chr1", 150), ("chr1", 60)], [("chr1", 0, 100, 1), ("chr1", 0, 100, 1), ("chr1", 100, 200, 1)]),
    ],
)
def test_window_policy(spark, mode, size, places, want):
    df = spark.createDataFrame([(k, c, p) for k, (c, p) in enumerate(places)], "ord int, chrom string, pos int")
    policy = windows.WindowPolicy(mode, size)
    found = windows.bounds(windows.assign(df, policy), policy).collect()
    assert sorted((r["chrom"], r["start"], r["end"], r["n"]) for r in found) == sorted(want)


def brute_windows(places, mode, size):
    """(chrom, start, end, n) of a reader that closes a window when the next row is not in it."""
    out, now = [], None
    for chrom, pos in places:
        inside = now and chrom == now[0] and (now[1] <= pos < now[2] if mode == "bp" else now[3] < size)
        if not inside:
            out += [now] if now else []
            now = [chrom, pos // size * size, pos // size * size + size, 0] if mode == "bp" else [chrom, pos, pos + 1, 0]
        if mode == "variants":
            now[2] = pos + 1
        now[3] += 1
    return sorted(map(tuple, out + ([now] if now else [])))


@pytest.mark.parametrize("mode,size", [("bp", 50), ("variants", 7), ("variants", 1)])
def test_windows_over_many_splits(spark, tmp_path, mode, size):
    """Files in small splits, unsorted positions, contigs that end anywhere and one row without a position."""
    rng = np.random.default_rng(size)
    places = [(f"chr{k // 130 + 1}", int(k % 130 * 5 + rng.integers(0, 40))) for k in range(700)]
    halves = [places[:333], places[333:]]
    for k, own in enumerate(halves):
        text = vcf_text(own, [GTS[0]] * len(own)).replace("PASS", "P" * 90)
        (tmp_path / f"{k}.vcf").write_text(text + "chr9\tnone\t.\tA\tT\n" * (k == 0))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        vcf = C.read_vcf(spark, [str(tmp_path / f"{k}.vcf") for k in range(2)])
        assert vcf.variants.rdd.getNumPartitions() > 6
        policy = windows.WindowPolicy(mode, size)
        got = windows.bounds(windows.assign(vcf.variants, policy), policy).collect()
        assert sorted((r["chrom"], r["start"], r["end"], r["n"]) for r in got) == brute_windows(places, mode, size)
        plan = C.windowed_distances(vcf, policy)._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange" in line and "gts" in line for line in plan.splitlines())
        shuffled = spark.createDataFrame([(k, c, p) for k, (c, p) in enumerate(places)], "ord int, chrom string, pos int").repartition(5)
        for together in (True, False):
            got = windows.bounds(windows.assign(shuffled, policy, together), policy).collect()
            assert sorted((r["chrom"], r["start"], r["end"], r["n"]) for r in got) == brute_windows(places, mode, size)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_window_validation():
    for args in (("bp", 100, 50), ("bp", 0), ("variants", 2, None, 0), ("tiles", 5)):
        with pytest.raises(ValueError):
            windows.WindowPolicy(*args)


def test_blocks_equal_joins_and_brute_force(spark):
    rng = np.random.default_rng(5)
    pool = ["0/0", "0/1", "1/0", "1|1", "./.", "0", "1/1/0", "x/1", "2/1", "0/.", None]
    n, gts = 7, [[pool[rng.integers(len(pool))] for _ in range(7)] for _ in range(60)]
    df = spark.createDataFrame([(k, g) for k, g in enumerate(gts)], "ord int, gts array<string>")

    def bits(g):
        if not g or "." in g:
            return set()
        return {(h, a) for h, a in enumerate(g.replace("|", "/").split("/")[:2]) if a.isdigit() and int(a) < 2}

    want = np.array([[sum(len(bits(g[i]) & bits(g[j])) for g in gts) for j in range(n)] for i in range(n)])
    blocks = {r["i"]: r["dots"] for r in distance.block_counts(df.repartition(3), n, 2, 2).collect()}
    assert np.array_equal(np.array([blocks[i] for i in range(n)]), want)
    calls = df.select(F.col("ord").alias("variant"), F.posexplode("gts").alias("idx", "gt")).select("variant", "idx", F.inline(G.one_hot_calls(F.col("gt"), 2, 2)))
    pairs = {(r["i"], r["j"]): r["dot"] for r in distance.pair_counts(calls).collect()}
    assert pairs == {(i, j): want[i, j] for i in range(n) for j in range(i, n) if want[i, j]}


def test_zero_norm_sample(spark):
    df = spark.createDataFrame([(0, ["0/1", "./."])], "ord int, gts array<string>")
    dist = {(r["i"], r["j"]): r["dist"] for r in distance.block_distances(distance.block_counts(df, 2, 2, 2), ["a", "b"]).collect()}
    assert dist == pytest.approx({(0, 0): 0.0, (0, 1): 1.0, (1, 1): 0.0}, abs=1e-12)


def test_bootstrap_weights(spark):
    w = spark.range(20000).select(F.explode(bootstrap.poisson_weights(F.col("id"), 3, 1)).alias("w"))
    mean, var = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(1, abs=0.03) and var == pytest.approx(1, abs=0.05)
    again = spark.range(20000).repartition(7).select(F.explode(bootstrap.poisson_weights(F.col("id"), 3, 1)).alias("w"))
    assert w.agg(F.sum("w")).first() == again.agg(F.sum("w")).first()


def test_bootstrap_tree(spark, vcf_path):
    vcf = C.read_vcf(spark, vcf_path)
    text = tree.supported_tree(C.vcf_distances(vcf, replicates=10), 10).first()["newick"]
    assert text.startswith("((s2:0.6,s3:0.6)") and text.endswith(":0.1,s1:0.7);")


def test_individual_stats(spark, tmp_path):
    path = tmp_path / "c.vcf"
    path.write_text(vcf_text([("c", k) for k in range(5)], [["0/0", "./.", "1/2"], ["0/1", "0/.", "1/1"], ["1|0", "1", "0/0"], ["1/1", "x/1", "0/1"], ["0/0", "0/0", "0"]], "GT") + "short\tline\n")
    found, samples = C.individual_stats(spark, str(path))
    rows = {r["indiv"]: r for r in found.collect()}
    assert [rows["s1"][c] for c in ("n_sites", "n_het", "n_alt", "n_ref", "n_miss")] == [5, 2, 1, 2, 0]
    assert [rows["s2"][c] for c in ("n_sites", "n_het", "n_alt", "n_ref", "n_miss")] == [5, 0, 0, 1, 4]
    assert [rows["s3"][c] for c in ("n_sites", "n_het", "n_alt", "n_ref", "n_miss")] == [5, 2, 1, 1, 1]
    assert rows["s2"]["p_miss"] == pytest.approx(0.8)
    lines = {r["indiv"]: r["value"] for r in C.stats_lines(found).collect()}
    assert lines["s1"] == "s1\t5\t2\t1\t2\t0\t0.4000\t0.2000\t0.4000\t0.0000"


def test_ratio_of_nothing_is_nan(spark):
    calls = spark.createDataFrame([("a", -1, -1)], "name string, a1 int, a2 int")
    row = stats.individual_counts(calls).first()
    assert row["p_het"] != row["p_het"] and row["p_miss"] == 1.0


@pytest.mark.parametrize("suffix,pack", [(".gz", gzip.compress), ("", gzip.compress), (".bz2", bz2.compress), (".xz", lzma.compress), (".vcf", bz2.compress), (".vcf", bytes)])
def test_compressions(spark, tmp_path, suffix, pack):
    path = tmp_path / f"d{suffix}"
    path.write_bytes(pack(vcf_text([("chr1", p) for p in (100, 200, 300)]).encode()))
    lines = read_lines(spark, str(path))
    assert [r["value"][:6] for r in lines.orderBy("ord").collect()] == ["##file", "##cont", "#CHROM"] + ["chr1\t1", "chr1\t2", "chr1\t3"]
    assert len(C.read_vcf(spark, str(path)).samples) == 3


def test_files_keep_their_order(spark, tmp_path):
    for k, name in enumerate(("z", "a", "m")):
        (tmp_path / name).write_text("".join(f"{k}-{i}\n" for i in range(50)))
    lines = read_lines(spark, [str(tmp_path / n) for n in ("z", "a", "m")])
    assert [r["value"] for r in lines.orderBy("ord").collect()] == [f"{k}-{i}" for k in range(3) for i in range(50)]


def test_headers_must_agree(spark, tmp_path):
    (tmp_path / "a").write_text(vcf_text([("c", 1)]))
    (tmp_path / "b").write_text(vcf_text([("c", 1)]).replace("s3", "s4"))
    with pytest.raises(ValueError):
        C.read_vcf(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_missing_sub_field_is_missing(spark, tmp_path):
    (tmp_path / "a").write_text(vcf_text([("c", 1), ("c", 2)], [["1:0/1", "2:1/1", "3"], ["1:0/0", "1:0/1", "4:1/1"]], "DP:GT"))
    vcf = C.read_vcf(spark, str(tmp_path / "a"))
    assert [r["gts"] for r in vcf.variants.orderBy("ord").collect()] == [["0/1", "1/1", None], ["0/0", "0/1", "1/1"]]


def test_keep_samples(spark):
    df = spark.createDataFrame([(0, ["0/1", "1/1", "./."])], "ord int, gts array<string>")
    rows, names = stats.keep_samples(df, ["a", "b", "c"], ["c", "a"], ignore_hets=True)
    assert names == ["a", "c"] and rows.first()["gts"] == ["./.", "./."]


def test_filtered_file_keeps_everything_else(spark, tmp_path):
    (tmp_path / "a").write_text(vcf_text([("c", 1), ("c", 2), ("c", 3)], [["1:0/1:x", "2:1/1:y", "3:0/0:z"], ["1:./.:x", "2:1:y", "4"], ["9:1|1:q", "8:0/1:r", "7:1/0:s"]], "DP:GT:XX"))
    lines = lambda hets: [r["value"] for r in kept_lines(spark, str(tmp_path / "a"), ["s3", "s1", "other"], hets).orderBy("kind", "ord").collect()]
    head = ["##fileformat=VCFv4.2", "##contig=<ID=chr1>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts3"]
    rest = "\t.\tA\tT\t.\tPASS\t.\tDP:GT:XX\t"
    assert lines(False) == [*head, f"c\t1{rest}1:0/1:x\t3:0/0:z", f"c\t2{rest}./.\t./.", f"c\t3{rest}9:1|1:q\t7:1/0:s"]
    assert lines(True) == [*head, f"c\t1{rest}./.\t3:0/0:z", f"c\t2{rest}./.\t./.", f"c\t3{rest}9:1|1:q\t./."]


@pytest.mark.parametrize("group", [None, "win"])
def test_tiles_give_the_same_sums_and_read_once(spark, monkeypatch, group):
    """Blocks of samples, parts of replicates and ranges of variants; rows are counted where they are read."""
    rng = np.random.default_rng(8)
    n = 21
    pool = ["0/0", "0/1", "1|1", "./.", "1", "2/0", None]
    rows = [(k, k // 15, [pool[rng.integers(len(pool))] for _ in range(n)] if k % 9 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "ord int, win long, gts array<string>").repartitionByRange(4, "ord").sortWithinPartitions("ord")
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    source = df.mapInArrow(watched, df.schema)
    monkeypatch.setattr(distance, "SAMPLE_BLOCK", 8)
    monkeypatch.setattr(distance, "TILE_BYTES", 8 * 8 * 8 * 2)
    monkeypatch.setattr(distance, "BLOCK_VARIANTS", 5)
    found = []
    for size in (1 << 20, 64):
        monkeypatch.setattr(distance, "BLOCK_BYTES", size)
        read.value = 0
        found.append({(r["grp"], r["rep"], r["i"]): r["dots"] for r in distance.block_counts(source, n, 2, 3, group, replicates=4).collect()})
        assert read.value == len(rows)
    assert not distance.fits(n, 4) and len(found[0]) == (1 if group is None else 4) * 5 * n
    assert found[0] == found[1]


def test_weights_of_tasks_are_those_of_columns(spark):
    rows = spark.range(500).select(bootstrap.variant_pair(F.col("id"), 7).alias("p"), bootstrap.poisson_weights(F.col("id"), 9, 7).alias("w")).collect()
    a, b = (np.array([r["p"][k] for r in rows]) for k in range(2))
    assert bootstrap.weights_of(a, b, range(1, 10)).tolist() == [r["w"] for r in rows]
    assert (bootstrap.weights_of(a, b, range(2))[:, 0] == 1).all()


def test_projection_in_parts_and_products_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    gts = [[f"{rng.integers(2)}/{rng.integers(2)}" for _ in range(9)] for _ in range(30)]
    vecs = rng.standard_normal((30, 4))
    df = spark.createDataFrame([(k, g, v.tolist()) for k, (g, v) in enumerate(zip(gts, vecs, strict=True))], "ord int, gts array<string>, vec array<double>").repartition(3)
    whole, parts = ({(r["rep"], r["idx"]): r["vec"] for r in emb.project(df, 9, 4, 5, limit=limit).collect()} for limit in (1 << 20, 8 * 4 * 3 * 6))
    assert len(whole) == 54 and emb._blocks(9, 4, 5, 8 * 4 * 3 * 6) == (3, 6)
    want = np.array([[sum(map(int, g.split("/"))) for g in row] for row in gts]).T @ vecs
    for k, v in whole.items():
        assert v == pytest.approx(parts[k])
    assert np.array([whole[0, i] for i in range(9)]) == pytest.approx(want)
    monkeypatch.setattr(distance, "VECTOR_BLOCK", 3)
    rows = [(g, f"k{k}", v.tolist()) for g in (1, None) for k, v in enumerate([*rng.standard_normal((10, 4)), np.zeros(4)])]
    found = emb.vector_distances(spark.createDataFrame(rows, "g int, idx string, vec array<double>"), ["g"]).collect()
    assert len(found) == 2 * 66
    by = {(r[0], r[1]): np.array(r[2]) for r in rows}
    for r in found:
        x, y = by[r["g"], r["i"]], by[r["g"], r["j"]]
        size = np.sqrt((x @ x) * (y @ y))
        assert r["i"] <= r["j"] and r["dist"] == pytest.approx(1 - x @ y / size if size else float(r["i"] != r["j"]), abs=1e-12)


def test_windowed_distances_read_the_file_twice(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_text(vcf_text([("c", k) for k in range(1, 41)], [["0/1", "1/1", "0/0"]] * 40))
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def count(df):
        return df.mapInArrow(watched, df.schema)

    vcf = C.read_vcf(spark, str(tmp_path / "a"), 2, 2, transform=count)
    read.value = 0
    found = C.windowed_distances(vcf, windows.WindowPolicy("variants", 10)).collect()
    assert len(found) == 4 * 6 and {r["n"] for r in found} == {10}
    assert read.value == 2 * len((tmp_path / "a").read_text().splitlines())


def test_json_embeddings_last_wins_and_widths(spark, tmp_path, vcf_path):
    for k, text in enumerate(('{"variants":[{"id":"a","embedding":[1,2.5]},{"id":"a","embedding":[3]},{"id":"b","embedding":[7]}]}', '{"a":[1,2.5],"a":[3],"b":[7]}')):
        (tmp_path / f"{k}.json").write_text(text)
        assert sorted(tuple(r) for r in C.read_embeddings(spark, str(tmp_path / f"{k}.json")).collect()) == [("a", [3.0]), ("b", [7.0])]
    mixed = spark.createDataFrame([("chr1:100:A:T", [1.0]), ("chr1:200:A:T", [1.0, 2.0])], "key string, vec array<double>")
    with pytest.raises(ValueError):
        C.embedding_distances(C.read_vcf(spark, vcf_path), mixed)


def test_dosage_and_keys(spark):
    df = spark.createDataFrame([("0/1",), ("1|1",), ("./1",), ("x/1",), ("1/2/0",), (None,)], "g string")
    assert [r[0] for r in df.select(G.dosage(F.col("g"))).collect()] == [1, 2, None, None, 2, None]
    assert G.VariantKey.parse("chrom-pos") is G.VariantKey.CHROM_POS and G.VariantKey.parse("id") is G.VariantKey.VARIANT_ID
    with pytest.raises(ValueError):
        G.VariantKey.parse("other")


def test_embeddings(spark, tmp_path, vcf_path):
    tsv = tmp_path / "e.tsv"
    tsv.write_text("# note\n\nchr1:100:A:T\t1\t0\nchr1:200:A:T\t0\t1\nbad\t1\nworse\tx\t1\nchr1:200:A:T\t0\t2\n")
    e = C.read_embeddings(spark, str(tsv))
    assert {r["key"]: r["vec"] for r in e.collect()} == {"chr1:100:A:T": [1.0, 0.0], "chr1:200:A:T": [0.0, 2.0]}
    dist, count = C.embedding_distances(C.read_vcf(spark, vcf_path), e)
    # vectors: s1 (0, 2), s2 (1, 4), s3 (2, 0)
    want = {(0, 0): 0, (1, 1): 0, (2, 2): 0, (0, 1): 1 - 4 / np.sqrt(17), (0, 2): 1, (1, 2): 1 - 1 / np.sqrt(17)}
    assert {(r["i"], r["j"]): r["dist"] for r in dist.collect()} == pytest.approx(want, abs=1e-12)
    assert count == {"processed": 5, "used": 2, "skipped": 3}
    for k, text in enumerate(('{"variants":[{"id":"a","embedding":[1,2.5]}]}', '{"a":[1,2.5]}')):
        (tmp_path / f"{k}.json").write_text(text)
        assert [tuple(r) for r in C.read_embeddings(spark, str(tmp_path / f"{k}.json")).collect()] == [("a", [1.0, 2.5])]


@pytest.mark.parametrize("nested", [True, False])
def test_json_embeddings_by_splits(spark, tmp_path, nested):
    """Pieces of files equal the whole texts, wherever splits end; files of any other layout are read whole."""
    rows = [(f"k{k % 40}", [k / 7, -1e-5 * k, 0.0]) for k in range(50)] + [("kö ,:", []), ("", [1.0])]
    pairs = [{"id": k, "embedding": v} for k, v in rows]
    text = json.dumps({"variants": pairs}, ensure_ascii=False, indent=1) if nested else "{" + ",\n ".join(f"{json.dumps(k, ensure_ascii=False)}: {v}" for k, v in rows) + "}\n"
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(text.replace("k3", "h3").encode()))
    path = str(tmp_path / "*.json*")
    read = lambda df: {r["key"]: r["vec"] for r in df.groupBy("key").agg(F.max_by("vec", F.struct("file", "place")).alias("vec")).collect()}
    want, old = read(embeddings._whole_texts(spark, path)), spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert want["k0"] == [40 / 7, -1e-5 * 40, 0.0] and len(want) == 53
    try:
        for size in (37, 64, 1001, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found = embeddings.json_entries(spark, path)
            assert found.count() == 2 * len(rows) and read(found) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for bad in ('{"variants":[{"id":"a","n":2,"embedding":[1]}]}', '{"a]":[1]}', '{"a\\"":[1]}', '{"a":[1, "x"]}', '{"a":[1 2]}', '{"variants":[{"id":"a","embedding":[1]}], "more":[2]}'):
        (tmp_path / "c.json").write_text(bad)
        assert embeddings.json_entries(spark, str(tmp_path / "c.json")) is None
    (tmp_path / "d.json").write_text('{"variants":[{"id":"a]","n":2,"embedding":[1]}]}' if nested else '{"a]":[1]}')
    assert [tuple(r) for r in C.read_embeddings(spark, str(tmp_path / "d.json")).collect()] == [("a]", [1.0])]
