"""Column functions on nucleotide sequences and k-mers.  Codes are base 4 with A 0, T 1, C 2, G 3."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_K = 31


def check_k(k: int) -> int:
    """A code of k bases must fit a positive long."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}, not {k}")
    return k


def upper_bases(seq: Column) -> Column:
    """ACGT in upper case; other characters are left as they are."""
    return F.translate(seq, "acgt", "ACGT")


def reverse_complement(seq: Column) -> Column:
    """Reverse complement; characters other than ACGT are dropped."""
    return F.reverse(F.translate(F.regexp_replace(upper_bases(seq), "[^ACGT]", ""), "ACGT", "TGCA"))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of ACGT only, overlapping, in order; linear in the sequence."""
    return F.regexp_extract_all(upper_bases(seq), F.lit(f"(?=([ACGT]{{{check_k(k)}}}))"), F.lit(1))


def encode_kmer(kmer: Column) -> Column:
    """The code, or -1 if a character is not a base."""
    upper = upper_bases(kmer)
    digits = F.conv(F.translate(upper, "ATCG", "0123"), 4, 10).cast("bigint")
    return F.when(upper.rlike("^[ACGT]+$"), digits).otherwise(F.lit(-1).cast("bigint"))


def decode_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), check_k(k), "0"), "0123", "ATCG")


def decode_pair(code: Column, k: int) -> Column:
    """forward/reverse complement."""
    forward = decode_kmer(code, k)
    return F.concat_ws("/", forward, reverse_complement(forward))


def vocabulary(spark, k: int):
    """All 4**k codes with their k-mers, made by Spark."""
    return spark.range(4 ** check_k(k)).select(F.col("id").alias("code"), decode_kmer(F.col("id"), k).alias("kmer"))


def base_count(kmer: Column, base: str) -> Column:
    return F.length(kmer) - F.length(F.replace(kmer, F.lit(base), F.lit("")))


def clean_name(header: Column) -> Column:
    """A record's name: the header without its marker, odd characters as spaces, spaces collapsed."""
    body = F.regexp_replace(header, r"^[>@]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"[^A-Za-z0-9_.+\-=|]", " "), " +", " "))


def short_name(header: Column) -> Column:
    """The first word of the header, cleaned."""
    return clean_name(F.get(F.split(F.trim(header), r"\s+"), F.lit(0)))


def split_quality(text: Column) -> tuple[Column, Column]:
    """(sequence, quality) of a text that joins them by its first +; no + leaves no quality."""
    parts = F.split(text, r"\+", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def packed_text(text: Column) -> Column:
    """Two bytes for each character."""
    return F.encode(text, "UTF-16BE")


def unpacked_text(data: Column) -> Column:
    return F.decode(data, "UTF-16BE")
