"""VCF files as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as G
from .text import ORDER, expand, head_lines, read_lines

FIXED = 9
INFER_SAMPLES = 8


@dataclass(frozen=True)
class Vcf:
    """variants: ord, chrom, pos (null if no number), id, ref, alt, qual, filter, info, format, gts array<string>.

    gts holds the samples' GT in the order of `samples`; null where a sample has none, and null as a
    whole where FORMAT has no GT.
    """

    variants: DataFrame
    samples: list[str]
    ploidy: int
    max_alleles: int


@dataclass(frozen=True)
class Head:
    """What stands before the data: ## lines, sample names and the first data line, if there is one."""

    comments: list[str]
    samples: list[str]
    first: str | None


def read_head(spark: SparkSession, files: list[str]) -> Head:
    """From the beginnings of the files, no job runs.  The first must have a header; others may, with the same samples."""
    comments, samples, first = [], None, None
    for file in files:
        own = None
        for line in head_lines(spark, file):
            if line.startswith("##"):
                comments.append(line)
            elif line.startswith("#CHROM"):
                own = line.split("\t")[FIXED:]
            elif not line.startswith("#") and (own is not None or line.strip()):
                first = line if first is None else first
                break
        if own is None and samples is None:
            raise ValueError("no #CHROM header line")
        if own == []:
            raise ValueError("no samples in the header")
        if own and samples not in (None, own):
            raise ValueError("the files have different headers")
        samples = own or samples
    return Head(comments, samples or [], first)


def parse(lines: DataFrame, samples: list[str]) -> DataFrame:
    """Data lines as columns; lines without tabs keep their place, with nulls."""
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k))
    gt = G.gt_field(at(8))
    raw = F.transform(F.slice(f, FIXED + 1, len(samples)), lambda s: G.sample_gt(s, gt))
    padded = F.when(gt.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: F.get(raw, i)))
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"]
    data = lines.where(~F.col("value").startswith("#"))
    return data.select(ORDER, *[at(k).try_cast("int").alias(n) if n == "pos" else at(k).alias(n) for k, n in enumerate(names)], padded.alias("gts"))


def infer_shape(gts: list[str | None] | None) -> tuple[int, int]:
    """(ploidy, number of alleles) from the first line's first samples, missing ones skipped."""
    tokens = [g.replace("|", "/").split("/") for g in (gts or [])[:INFER_SAMPLES] if g and "." not in g]
    numbers = [int(a) for t in tokens for a in t if a.isdigit()]
    if not tokens or not numbers:
        raise ValueError("ploidy and alleles can't be inferred from the first line")
    return max(map(len, tokens)), max(numbers) + 1


def _first_gts(line: str | None) -> list[str | None]:
    fields = (line or "").split("\t")
    names = fields[8].split(":") if len(fields) > FIXED else []
    if "GT" not in names:
        return []
    at = names.index("GT")
    return [dict(enumerate(f.split(":"))).get(at) for f in fields[FIXED : FIXED + INFER_SAMPLES]]


def read_vcf(spark: SparkSession, paths: list[str] | str, ploidy: int | None = None, max_alleles: int | None = None, transform=None) -> Vcf:
    """Files in order; `transform` maps the lines' DataFrame before it is parsed."""
    files = expand(spark, [paths] if isinstance(paths, str) else list(paths))
    head, lines = read_head(spark, files), read_lines(spark, files)
    variants = parse(transform(lines) if transform else lines, head.samples)
    if ploidy is None or max_alleles is None:
        if transform:
            first = variants.orderBy(ORDER).select("gts").limit(1).first()
            found = infer_shape(first and first["gts"])
        else:
            found = infer_shape(_first_gts(head.first))
        ploidy, max_alleles = ploidy or found[0], max_alleles or found[1]
    return Vcf(variants, head.samples, ploidy, max_alleles)


def kept_lines(spark: SparkSession, paths: list[str] | str, keep: list[str], ignore_hets: bool = False) -> DataFrame:
    """(kind, ord, value): the ## lines, the header and the data lines with the listed samples only.

    All fields stay as they are, but a sample without two called alleles, or with two different ones if
    hets are ignored, becomes ./. .
    """
    files = expand(spark, [paths] if isinstance(paths, str) else list(paths))
    head = read_head(spark, files)
    wanted = [k for k, s in enumerate(head.samples) if s in set(keep)]
    f = F.split("value", "\t")
    gt = G.gt_field(F.get(f, F.lit(8)))

    def clean(sample):
        called = G.sample_gt(sample, gt)
        bad = G.is_missing(called) | (F.size(G.alleles(called)) != 2)
        if ignore_hets:
            bad = bad | (F.size(F.array_distinct(G.alleles(called))) > 1)
        return F.when(F.coalesce(bad, F.lit(True)), "./.").otherwise(sample)

    samples = F.transform(F.array(*[F.get(f, F.lit(FIXED + k)) for k in wanted]).cast("array<string>"), clean)
    data = read_lines(spark, files).where(~F.col("value").startswith("#") & (F.size(f) > FIXED))
    body = data.select(F.lit(2).alias("kind"), ORDER, F.concat_ws("\t", F.concat_ws("\t", F.slice(f, 1, FIXED)), samples).alias("value"))
    names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(head.samples[k] for k in wanted)]
    tops = spark.createDataFrame([(0, k, c) for k, c in enumerate(head.comments)] + [(1, 0, "\t".join(names))], "kind int, n long, value string")
    zero = F.lit(0)
    order = F.struct(zero.cast("int").alias("file"), zero.cast("long").alias("block"), F.col("n").alias("line"))
    return tops.select("kind", order.alias(ORDER), "value").unionByName(body)
