"""Column functions on genotype strings such as 0/1, 1|0 and ./. ."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F


class VariantKey(Enum):
    CHROM_POS = "CHROM_POS"
    CHROM_POS_REF_ALT = "CHROM_POS_REF_ALT"
    VARIANT_ID = "VARIANT_ID"

    @classmethod
    def parse(cls, name: str | None) -> VariantKey:
        """Any case, - for _, ID for VARIANT_ID; nothing means CHROM_POS_REF_ALT."""
        if name is None:
            return cls.CHROM_POS_REF_ALT
        name = name.strip().upper().replace("-", "_")
        try:
            return cls("VARIANT_ID" if name == "ID" else name)
        except ValueError:
            raise ValueError(f"unknown variant key {name!r}; known: {', '.join(k.value for k in cls)}") from None


def variant_key(kind: VariantKey, chrom: Column, pos: Column, ident: Column, ref: Column, alt: Column) -> Column:
    """The key by which a variant meets its embedding; null where an identifier is a dot."""
    if kind is VariantKey.VARIANT_ID:
        return F.nullif(ident, F.lit("."))
    parts = [chrom, pos.cast("string")] + [ref, alt] * (kind is VariantKey.CHROM_POS_REF_ALT)
    return F.concat_ws(":", *parts)


def gt_field(fmt: Column) -> Column:
    """0-based place of GT in a FORMAT string, null if there is none."""
    at = F.array_position(F.split(fmt, ":"), "GT")
    return F.when(at > 0, at.cast("int") - 1)


def sample_gt(sample: Column, field: Column) -> Column:
    """The GT of a sample's sub-fields; null if the sub-field is absent."""
    return F.get(F.split(sample, ":"), field)


def alleles(gt: Column) -> Column:
    return F.split(gt, r"[/|]")


def is_missing(gt: Column) -> Column:
    return gt.isNull() | gt.contains(".")


def is_het(gt: Column) -> Column:
    """Whether a called genotype has different alleles; false for a missing one."""
    return ~is_missing(gt) & (F.size(F.array_distinct(alleles(gt))) > 1)


def hets_only(gts: Column, wanted: bool) -> Column:
    """The genotypes with all but the heterozygous ones missing, or with those missing."""
    return F.transform(gts, lambda g: F.when(F.coalesce(is_het(g), F.lit(False)) == wanted, g))


def dosage(gt: Column) -> Column:
    """Number of non-reference alleles; null if any allele is missing or not a number."""
    numbers = F.transform(alleles(gt), lambda a: a.try_cast("int"))
    return F.when(~is_missing(gt) & ~F.exists(numbers, lambda a: a.isNull()), F.size(F.filter(numbers, lambda a: a > 0)))


def one_hot_calls(gt: Column, ploidy: int, max_alleles: int) -> Column:
    """array<struct<hap, allele>>: kept alleles by place; empty if any is missing; order matters (0/1 is not 1/0)."""
    placed = F.transform(alleles(gt), lambda a, hap: F.struct(hap.alias("hap"), a.try_cast("int").alias("allele")))
    kept = F.filter(placed, lambda c: (c["hap"] < ploidy) & c["allele"].isNotNull() & (c["allele"] >= 0) & (c["allele"] < max_alleles))
    return F.when(is_missing(gt), F.array().cast("array<struct<hap:int,allele:int>>")).otherwise(kept)


def one_hot_bits(gt: Column, ploidy: int, max_alleles: int) -> Column:
    """The kept alleles as bits hap * max_alleles + allele of a long (ploidy * max_alleles up to 63)."""
    if ploidy * max_alleles > 63:
        raise ValueError("more than 63 bits; use one_hot_calls")
    bits = F.transform(one_hot_calls(gt, ploidy, max_alleles), lambda c: F.lit(1).cast("long") * F.pow(F.lit(2.0), c["hap"] * max_alleles + c["allele"]).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))


def shared_bits(a: Column, b: Column) -> Column:
    """Number of common alleles of two bit sets."""
    return F.bit_count(a.bitwiseAND(b)).cast("long")
