"""Block-gzipped files: every split size gives the lines of the plain file."""

import gzip
import io
import random

import pytest

from lociweave.sources import bgzf
from lociweave.sources.text import read_lines
from lociweave.sources.vcf import read_vcf


def packed(text: bytes, sizes):
    out, at = b"", 0
    while at < len(text):
        n = next(sizes)
        out += bgzf._member(text[at : at + n])
        at += n
    return out + bgzf.END


@pytest.mark.parametrize("text", [b"a\nbb\n\nccc\r\nd" * 40, b"", b"\n", b"x" * 5000 + b"\n" + b"y" * 3, b"no end", b"\n\n\n", b"".join(b"%d\tvalue\n" % k for k in range(900))])
def test_every_split_gives_each_line_once(text):
    rng = random.Random(len(text))
    data = packed(text, iter(lambda: rng.choice([1, 5, 60, 400]), 0))
    assert gzip.decompress(data) == text
    want = text.split(b"\n")
    want = want[:-1] if want[-1] == b"" else want
    for split in (1, 2, 29, 30, 64, 257, 1 << 20):
        got = []
        for at in range(0, len(data), split):
            for lines in bgzf.lines_of(io.BytesIO(data), len(data), at, min(len(data), at + split)):
                got += lines
        assert got == want, split


def test_a_header_inside_a_member_is_passed_over():
    """Stored text that looks like a member's header doesn't begin a split."""
    text = (bgzf.END[:16] + b"\x30\x00" + b"\n") * 40
    made = bgzf.zlib.compressobj(0, bgzf.zlib.DEFLATED, -15)
    stored = made.compress(text) + made.flush()
    member = bgzf.END[:16] + bgzf.struct.pack("<H", len(stored) + 25) + stored + bgzf.struct.pack("<II", bgzf.zlib.crc32(text), len(text))
    data = member * 3 + bgzf.END
    assert bgzf._first_member(io.BytesIO(data), 5, len(data)) == len(member)


def test_a_large_file_is_many_tasks(spark, tmp_path):
    rows = [f"chr1\t{k}\t.\tA\tT\t.\tPASS\t.\tGT\t{k % 2}/1\t0/{k % 2}" for k in range(20_000)]
    head = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"]
    text = "\n".join(head + rows) + "\n"
    (tmp_path / "a.vcf.gz").write_bytes(packed(text.encode(), iter(lambda: 3000, 0)))
    (tmp_path / "plain.vcf").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        lines = read_lines(spark, str(tmp_path / "a.vcf.gz"))
        assert lines.rdd.getNumPartitions() > 5
        assert [r["value"] for r in lines.orderBy("ord").collect()] == head + rows
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        a, b = (read_vcf(spark, str(tmp_path / x)).variants.orderBy("pos").drop("ord").collect() for x in ("a.vcf.gz", "plain.vcf"))
        assert a == b and len(a) == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_written_files_are_read_again(spark, tmp_path):
    df = spark.range(0, 5000).selectExpr("id", "repeat(cast(id as string), 20) as value")
    assert bgzf.write_bgzf(df, str(tmp_path / "out"), ["id"]) >= 1
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("part-*")))
    want = [str(k) * 20 for k in range(5000)]
    assert text.decode().split("\n")[:-1] == want
    assert [r["value"] for r in read_lines(spark, str(tmp_path / "out")).orderBy("ord").collect()] == want
    assert bgzf.write_bgzf(df.where("id < 0"), str(tmp_path / "none"), ["id"]) == 0
