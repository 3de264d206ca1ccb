"""Per-individual statistics, sample selection and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import alleles, is_missing
from ..functions.numbers import ratio_or_nan


def individual_counts(calls: DataFrame) -> DataFrame:
    """Statistics by name from (name, a1, a2): null or negative alleles are missing; only two alleles count."""
    missing = F.col("a1").isNull() | F.col("a2").isNull() | (F.col("a1") < 0)
    het = ~missing & (F.col("a1") != F.col("a2"))
    ref = ~missing & (F.col("a1") == 0) & (F.col("a2") == 0)
    flags = {"n_het": het, "n_alt": ~missing & ~het & ~ref, "n_ref": ref, "n_miss": missing}
    counts = calls.groupBy("name").agg(F.count(F.lit(1)).alias("n_sites"), *[F.count_if(f).alias(n) for n, f in flags.items()])
    called = F.col("n_het") + F.col("n_alt") + F.col("n_ref")
    ratios = [ratio_or_nan(F.col(f"n_{x}"), called).alias(f"p_{x}") for x in ("het", "alt", "ref")]
    return counts.select(F.col("name").alias("indiv"), "n_sites", *flags, *ratios, ratio_or_nan(F.col("n_miss"), called + F.col("n_miss")).alias("p_miss"))


def genotype_calls(variants: DataFrame, samples: list[str]) -> DataFrame:
    """(name, a1, a2) of every line and sample; genotypes that don't parse or are haploid are missing."""
    names = F.array(*[F.lit(s) for s in samples])
    rows = variants.select(F.posexplode(F.coalesce("gts", F.array_repeat(F.lit(None).cast("string"), len(samples)))).alias("k", "gt"))
    part = lambda k: F.get(alleles(F.col("gt")), F.lit(k)).try_cast("int")
    return rows.select(F.get(names, F.col("k")).alias("name"), part(0).alias("a1"), part(1).alias("a2"))


def keep_samples(variants: DataFrame, samples: list[str], keep: list[str], ignore_hets: bool = False) -> tuple[DataFrame, list[str]]:
    """Variants with the listed samples only; missing genotypes, and heterozygous ones if asked, become ./. ."""
    wanted = [k for k, s in enumerate(samples) if s in set(keep)]

    def clean(g: Column) -> Column:
        bad = is_missing(g)
        if ignore_hets:
            bad = bad | (F.size(F.array_distinct(alleles(g))) > 1)
        return F.when(bad, "./.").otherwise(g)

    kept = F.transform(F.array(*[F.get("gts", F.lit(k)) for k in wanted]), clean)
    return variants.withColumn("gts", F.when(F.col("gts").isNotNull(), kept)), [samples[k] for k in wanted]


def keep_list(lines: DataFrame) -> DataFrame:
    """First word of each line of a keep list."""
    return lines.select(F.get(F.split(F.trim("value"), r"[\s,=]+"), F.lit(0)).alias("name")).where("name <> ''").distinct()


def least_missing(members: DataFrame) -> DataFrame:
    """(cluster_id, name) of (cluster_id, name, miss): all of cluster 0, of any other the one that misses least."""
    best = members.where("cluster_id <> 0").groupBy("cluster_id").agg(F.min_by("name", F.struct("miss", "name")).alias("name"))
    return members.where("cluster_id = 0").select("cluster_id", "name").unionByName(best)


def histogram(dist: DataFrame, bins: int = 100, value: str = "dist") -> DataFrame:
    """(bin, low, high, n) of equal bins from the least to the largest value; NaN is dropped, the largest falls in the last."""
    good = dist.where(~F.isnan(value) & F.col(value).isNotNull())
    ends = good.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    placed = good.select(value, F.lit(0).alias("_p")).join(F.broadcast(ends.withColumn("_p", F.lit(0))), "_p")
    return placed.groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")
