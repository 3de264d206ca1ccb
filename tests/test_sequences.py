import collections
import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.functions import sequence as S
from lociweave.operators import kmers, tree
from lociweave.plans import commands as C

FASTA = ">s1\nACGTACGTACGTACGTACGT\n>s2\nAAAATTTTGGGGCCCCAAAA\n>s3\nCCGGCCGGTTAACCGGAATT\n"


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_codes(spark):
    enc = lambda s: value(spark, S.encode_kmer(F.lit(s)))
    assert [enc(s) for s in ("ATCG", "AAAA", "GGGG", "atcg", "ATNG", "----")] == [27, 0, 255, 27, -1, -1]
    rc = lambda s: value(spark, S.reverse_complement(F.lit(s)))
    assert [rc(s) for s in ("ATCG", "AAGT", "ACGT", "ANT")] == ["CGAT", "ACTT", "ACGT", "AT"]
    assert value(spark, S.decode_pair(F.lit(27), 4)) == "ATCG/CGAT"
    assert enc("G" * 31) == 4**31 - 1
    assert S.vocabulary(spark, 2).count() == 16
    for k in (0, 32):
        with pytest.raises(ValueError):
            S.check_k(k)


def test_packing_of_texts(spark):
    seq, qual = S.split_quality(F.lit("ACGT+!!+!"))
    assert value(spark, F.concat_ws(" ", seq, qual)) == "ACGT !!+!"
    assert value(spark, S.unpacked_text(S.packed_text(F.lit("ACé")))) == "ACé"


def test_d2s_golden(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    seqs = C.read_fasta(spark, str(tmp_path / "a.fa"))
    both = kmers.count_both(seqs, 4)
    totals = {r["seq_id"]: r.asDict() for r in kmers.base_totals(both).collect()}
    assert [totals[k]["total"] for k in (1, 2, 3)] == [34, 34, 34]
    assert [(totals[k]["base_A"], totals[k]["base_C"]) for k in (1, 2, 3)] == [(34, 34), (36, 32), (26, 42)]
    assert sorted(r["count"] for r in both.groupBy("seq_id").count().collect()) == [4, 16, 18]
    dist = C.sequence_distances(seqs, 4)
    found = {(r["name_i"], r["name_j"]): r["dist"] for r in dist.collect()}
    assert found == pytest.approx({("s1", "s1"): 0, ("s2", "s2"): 0, ("s3", "s3"): 0, ("s1", "s2"): 0.5, ("s1", "s3"): 0.5, ("s2", "s3"): 0.4572755}, abs=1e-7)
    root = tree.cluster(*tree.matrix_of(dist.toPandas()))
    assert tree.newick(root) == "((s2:0.4572755,s3:0.4572755):0.0427245,s1:0.5);"
    for other in (C.sequence_distances(seqs, 4, normalise=True), C.sequence_distances(seqs, 4, statistic="d2star")):
        assert all(0 <= r["dist"] <= 1 for r in other.collect())


def test_equal_sequences_have_distance_zero(spark):
    seqs = spark.createDataFrame([(1, "a", "ACGTTGCAACGGT"), (2, "b", "ACGTTGCAACGGT")], "seq_id int, short_name string, seq string")
    assert all(abs(r["dist"]) < 1e-12 for r in C.sequence_distances(seqs, 3).collect())


@pytest.mark.parametrize(
    "text,want",
    [
        (">seq1\nACGT\n>seq2\nTTTT\n", [("seq1", "ACGT", ""), ("seq2", "TTTT", "")]),
        (">a\nACGT\nACGT\nACGT\n>b\nTT\nTT\n", [("a", "ACGTACGTACGT", ""), ("b", "TTTT", "")]),
        ("@seq1\nACGT\n+\n!!!!\n@seq2\nTTTT\n+\nIIII\n", [("seq1", "ACGT", "!!!!"), ("seq2", "TTTT", "IIII")]),
        ("@seq1\nACGT\n+\n@!!!\n@seq2\nTTTT\n+\nIIII\n", [("seq1", "ACGT", "@!!!"), ("seq2", "TTTT", "IIII")]),
        ("junk\n\n>a\n\nAC\n\n>b x\nGT\n", [("a", "AC", ""), ("b", "GT", "")]),
        (">empty\n>a\nAC\n", [("a", "AC", "")]),
        ("", []),
    ],
)
def test_records(spark, tmp_path, text, want):
    (tmp_path / "a.fa").write_text(text)
    rows = C.read_fasta(spark, str(tmp_path / "a.fa"), keep_quality=True).orderBy("seq_id").collect()
    assert [(r["short_name"], r["seq"], r["qual"] or "") for r in rows] == want
    assert [r["seq_id"] for r in rows] == list(range(1, len(want) + 1))


def test_quality_at_the_edge_of_100_000_records(spark, tmp_path):
    n = 100_002
    (tmp_path / "a.fq").write_text("".join(f"@r{k}\nACGT\n+\n{'@III' if k % 50_000 < 3 else '>III' if k == n - 1 else 'IIII'}\n" for k in range(n)))
    rows = C.read_fasta(spark, str(tmp_path / "a.fq"), keep_quality=True)
    assert rows.count() == n and rows.where("length(qual) <> 4 or seq <> 'ACGT' or short_name <> concat('r', seq_id - 1)").count() == 0
    assert rows.where("startswith(qual, '@')").count() == 8


def test_gzip_and_two_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(gzip.compress(b">a1\nACGT\n"))
    (tmp_path / "b").write_text(">b1\nAA\n>b2 more words\nCC\n")
    rows = C.read_fasta(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).orderBy("seq_id").collect()
    assert [(r["short_name"], r["name"]) for r in rows] == [("a1", "a1"), ("b1", "b1"), ("b2", "b2 more words")]


def test_ranks_and_vectors(spark):
    counts = spark.createDataFrame([(1, "AC", 5), (1, "AT", 5), (1, "GG", 9)], "seq_id int, kmer string, cnt long")
    got = {r["kmer"]: r["rank"] for r in kmers.ranks(counts).collect()}
    assert got == {"GG": 0, "AT": 1, "AC": 2}
    assert kmers.in_vocabulary(counts, 2).count() == 16
    unit = kmers.vector_norm(spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0)], "seq_id int, code int, weight double"), "seq_id")
    assert sorted(r["weight"] for r in unit.collect()) == pytest.approx([0.6, 0.8])
    post = kmers.poisson_posterior(spark.createDataFrame([(1, 0, 2, 1.0), (1, 1, 2, 2.0)], "k int, cluster int, n int, rate double"), "k")
    assert sum(r["posterior"] for r in post.collect()) == pytest.approx(1)


def test_codes_of_all_places():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("ACGTacgtNéx"), 400, p=[0.2] * 4 + [0.03] * 4 + [0.03, 0.03, 0.02]))
    data = np.frombuffer(text.encode(), np.uint8)
    for k in (1, 2, 3, 7, 8, 21, 31):
        codes, good = kmers.rolling_codes(data, k)
        want = [bytes(data[i : i + k]).upper() for i in range(len(data) - k + 1)]
        assert good.tolist() == [set(w) <= set(b"ACGT") for w in want]
        assert [c for c, g in zip(codes.tolist(), good, strict=True) if g] == [sum("ATCG".index(chr(b)) * 4 ** (k - 1 - i) for i, b in enumerate(w)) for w in want if set(w) <= set(b"ACGT")]
    assert len(kmers.rolling_codes(data[:3], 4)[0]) == 0


def test_counts_of_rows_and_of_lines_are_the_same(spark, monkeypatch):
    """Slices, segments and lines of any length cut nothing off and count nothing twice."""
    monkeypatch.setattr(kmers, "SEGMENT", 16)
    monkeypatch.setattr(kmers, "SLICE", 32)
    rng = random.Random(2)
    seqs = {f"s{n}": "".join(rng.choice("ACGTNa") for _ in range(n)) for n in (0, 1, 3, 4, 15, 16, 17, 100, 333)} | {None: "ACGTACGT"}
    lines = []
    for name, seq in seqs.items():
        at = 0
        while at < len(seq):
            n = rng.choice([1, 2, 3, 10, 60])
            lines.append((name, at, seq[at : at + n]))
            at += n
    want = collections.Counter()
    for name, seq in seqs.items():
        want.update((name, seq[i : i + 4].upper()) for i in range(len(seq) - 3) if set(seq[i : i + 4].upper()) <= set("ACGT"))
    rows = spark.createDataFrame(list(seqs.items()), "name string, seq string").repartition(2)
    cut = spark.createDataFrame(lines, "name string, at long, value string").repartition(3)
    for df in (rows, cut):
        assert {(r["name"], r["kmer"]): r["cnt"] for r in kmers.count_forward(df, 4, "name").collect()} == want


def test_d2_by_blocks_and_ranges(spark, monkeypatch):
    """Many blocks and ranges give the distances of one; a row is sent once for each block of sequences."""
    rng = random.Random(1)
    seqs = spark.createDataFrame([(k, f"s{k}", "".join(rng.choice("ACGT") for _ in range(40 if k else 4))) for k in range(1, 12)], "seq_id int, short_name string, seq string")
    profiles = kmers.probabilities(kmers.count_both(seqs.select("seq_id", "seq"), 3))
    found = lambda f: {(r["i"], r["j"]): r["dist"] for r in f(profiles).collect()}
    want = {f: found(f) for f in (kmers.d2s, kmers.d2star)}
    assert len(want[kmers.d2s]) == 66
    monkeypatch.setattr(kmers, "BLOCK_SEQUENCES", 4)
    monkeypatch.setattr(kmers, "BLOCK_ROWS", 32)
    for f in want:
        assert found(f) == pytest.approx(want[f], abs=1e-12)
    _, parts = kmers._terms(profiles, "seq_id", False)
    assert parts.select("a", "b").distinct().count() == 6 and parts.where("i = 1 and j = 1").count() > 3


def test_distances_of_lines(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA.replace("ACGTACGT", "ACGT\nACGT"))
    found = {(r["name_i"], r["name_j"]): r["dist"] for r in C.sequence_distances(C.read_sequence_lines(spark, str(tmp_path / "a.fa")), 4).collect()}
    assert found["s2", "s3"] == pytest.approx(0.4572755, abs=1e-7) and found["s1", "s3"] == pytest.approx(0.5)
