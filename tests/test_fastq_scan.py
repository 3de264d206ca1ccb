"""FASTQ and FASTA records by the parallel scan, against a reader that goes line by line."""

import random
import re

import pytest

from lociweave.sources import fasta


def plain(texts):
    """Records of files by one pass with lookahead: (name, sequence, quality)."""
    out = []
    for text in texts:
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        head = lambda k, lines=lines: k == len(lines) or lines[k][0] in "@>"
        k = 0
        while k < len(lines):
            if not head(k):
                k += 1
                continue
            header, seq, qual = lines[k], "", ""
            k += 1
            while not head(k) and lines[k][0] != "+":
                seq, k = seq + lines[k], k + 1
            if not head(k) and header[0] == "@":
                k += 1
                first = k
                while not head(first):
                    first += 1
                end, size = k, 0
                while end < len(lines) and size < len(seq):
                    size, end = size + len(lines[end]), end + 1
                end = end if size == len(seq) and end >= first and head(end) else first
                qual, k = "".join(lines[k:end]), end
            if len(header) > 1 and seq:
                out.append((" ".join(re.sub(r"[^A-Za-z0-9_.+\-=|]", " ", header.split()[0][1:]).split()), seq, qual))
    return out


def read(spark, paths):
    rows = fasta.read_fasta(spark, paths, keep_quality=True).orderBy("seq_id").collect()
    assert [r["seq_id"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["short_name"], r["seq"], r["qual"] or "") for r in rows]


CASES = {
    "short": "@s1\nACGT\n+\nIII\n@s2\nTTTT\n+\nIIII\n@s3\nGG\n+\nII\n",
    "empty": "@s1\nACGT\n+\n\n@s2\nTTTT\n+\nIIII\n@s3\nGG\n+\nII\n",
    "many lines": "@s1\nACGT\nACGT\n+\n@III\nJJJJ\n@s2\nTTTT\n+\nIIII\n",
    "header-like lines": "@s1\nACGTACGT\n+\n@III\n>JJJ\n@s2\nTTTT\n+\n+III\n@s3\nA\n+\n@\n",
    "two in a row": "@s1\nACGT\n+\n@I@I\n@s2\nTTTT\n+\n@@@@\n",
    "too long": "@s1\nAC\n+\nIII\nJJ\n@s2\nTTTT\n+\nIIII\n",
    "plus of fasta": ">s1\nACGT\n+\nIIII\n>s2\nAA\n",
    "cut": "@s1\nACGT\n+\nII",
    "no quality": "@s1\nACGT\n@s2\nGG\n+\n@@",
    "next record fits": "@s1\nACGTACG\n+\n@s2\nTTTT\n+\nIIII\n",
}


def test_cases(spark, tmp_path):
    for k, text in enumerate(CASES.values()):
        (tmp_path / f"{k}.fq").write_text(text)
    assert read(spark, [str(tmp_path / f"{k}.fq") for k in range(len(CASES))]) == plain(CASES.values())
    assert [r[0] for r in plain([CASES["short"]])] == [r[0] for r in plain([CASES["empty"]])] == ["s1", "s2", "s3"]
    assert plain([CASES["many lines"]])[0] == ("s1", "ACGTACGT", "@IIIJJJJ")
    rows = fasta.odd_qualities(spark, [str(tmp_path / f"{k}.fq") for k in (0, 1, 5)]).orderBy("seq_id").collect()
    assert [tuple(r) for r in rows] == [(1, 4, 3), (4, 4, 0), (7, 2, 5)]


@pytest.mark.parametrize("size", [17, 40])
def test_every_split_gives_the_same_records(spark, tmp_path, size):
    text = "junk\n" + "\n".join(CASES.values())
    (tmp_path / "a.fq").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", str(len(text) // size))
    try:
        assert read(spark, str(tmp_path / "a.fq")) == plain([text])
    finally:
        for c in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{c}")


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_random_files_and_blocks_of_candidates(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(fasta, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    texts = []
    for k in range(3):
        parts = ["noise\n"] * (k == 1)
        for n in range(150):
            seq = ["".join(rng.choice("ACGT") for _ in range(rng.choice([2, 4, 4, 6]))) for _ in range(rng.randrange(1, 4))]
            qual = ["".join(rng.choice("@>+I") for _ in x) for x in seq]
            fault = rng.random()
            qual = qual[:-1] if fault < 0.05 else [*qual, "II"] if fault < 0.1 else qual
            parts.append("\n".join([f"@r{n}", *seq, "+", *qual]) + "\n")
        texts.append("".join(parts))
        (tmp_path / f"{k}").write_text(texts[-1])
    assert read(spark, [str(tmp_path / f"{k}") for k in range(3)]) == plain(texts)


def test_lines_of_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 x\nACGT\nAC\n\nG\n>empty\n>s2\nTT\n")
    (tmp_path / "b.fq").write_text("@s3\nACGT\nGG\n+\n@IIIII\n")
    rows = fasta.read_sequence_lines(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fq")]).orderBy("seq_id", "at").collect()
    assert [tuple(r) for r in rows] == [(1, "s1", 0, "ACGT"), (1, "s1", 4, "AC"), (1, "s1", 6, "G"), (2, "s2", 0, "TT"), (3, "s3", 0, "ACGT"), (3, "s3", 4, "GG")]


def test_a_header_with_white_space_is_no_quality(spark, tmp_path):
    """A short quality takes no record whose header has white space, though the lengths would fit; header-like lines without stay in it."""
    text = "@s1\n" + "ACGTACGTACGT\n" + "+\nII\n@s2 x\nTT\n+\n>I\n@s3 yy\nACGTACGT\n+\n@III\n>JJJ\n@s4 z\nGG\n+\n@I\n"
    (tmp_path / "a.fq").write_text(text)
    assert read(spark, str(tmp_path / "a.fq")) == [("s1", "ACGTACGTACGT", "II"), ("s2", "TT", ">I"), ("s3", "ACGTACGT", "@III>JJJ"), ("s4", "GG", "@I")]
    assert [tuple(r) for r in fasta.odd_qualities(spark, str(tmp_path / "a.fq")).collect()] == [(1, 12, 2)]


def test_splits_that_change_during_a_query(spark, tmp_path, monkeypatch):
    """Spark splits files by the cores it has when a job begins; executors that come or go meanwhile change no record."""
    text = "".join(f"@s{k} x\n{'ACGT' * (k % 5 + 1)}\n+\n{'@' + 'I' * (4 * (k % 5) + 3)}\n" for k in range(400))
    (tmp_path / "a.fq").write_text(text)
    splits, turn, write = (3, 11, 2, 7), iter(range(1000)), fasta.written

    def elsewhere(df):
        spark.conf.set("spark.sql.files.minPartitionNum", str(splits[next(turn) % len(splits)]))
        return write(df)

    monkeypatch.setattr(fasta, "written", elsewhere)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert read(spark, str(tmp_path / "a.fq")) == plain([text])
    finally:
        for c in ("openCostInBytes", "minPartitionNum"):
            spark.conf.unset(f"spark.sql.files.{c}")
