"""Variant embeddings from TSV or JSON: (key, vec array<double>)."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ORDER, read_lines


class EmbeddingFormat(Enum):
    TSV = "TSV"
    HUGGINGFACE = "HUGGINGFACE"

    @classmethod
    def of(cls, path: str, name: str | None = None) -> EmbeddingFormat:
        """An explicit name, else .json (before .gz) means JSON and anything else TSV."""
        if name:
            return cls(name.strip().upper())
        return cls.HUGGINGFACE if path.lower().removesuffix(".gz").endswith(".json") else cls.TSV


def read_embeddings(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    if EmbeddingFormat.of(path, name) is EmbeddingFormat.TSV:
        return read_tsv(spark, path)
    return read_json(spark, path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """key, numbers...; # and blank lines are skipped, as are rows of another width or with bad numbers; the last row of a key stays."""
    lines = read_lines(spark, path).select(ORDER, F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 2).select(ORDER, F.get(parts, F.lit(0)).alias("key"), F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda x: F.trim(x).try_cast("double")).alias("vec"))
    first = rows.orderBy(ORDER).select(F.size("vec")).limit(1).first()
    good = rows.where((F.size("vec") == (first[0] if first else 0)) & ~F.exists("vec", lambda x: x.isNull()))
    return good.groupBy("key").agg(F.max_by("vec", ORDER).alias("vec"))


_KEY, _NUMBERS = r'"([^"\\]*)"', r"\[([-+0-9.eE,\s]*)"
#: what stands before the `]` of an entry, and after the last one: of {"variants": [...]}, and of {key: [...]}
_ENTRY = {
    True: rf'^\s*(?:\{{\s*"variants"\s*:\s*\[|\}}\s*,)\s*\{{\s*"id"\s*:\s*{_KEY}\s*,\s*"embedding"\s*:\s*{_NUMBERS}$',
    False: rf"^\s*(?:\{{|,)\s*{_KEY}\s*:\s*{_NUMBERS}$",
}
_REST = r"^\s*\}?\s*$"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """{"variants": [{"id", "embedding"}]} or {key: [numbers]}; one JSON text a file; the last entry of a key stays.

    Files whose entries hold nothing but a key and its numbers, as tools write them, are read by splits, an entry a row.  If any
    piece looks otherwise (further fields, escapes or brackets in keys, text among numbers), each file is one row, of 2 GB at most.
    """
    entries = json_entries(spark, path)
    if entries is None:
        entries = _whole_texts(spark, path)
    return entries.groupBy("key").agg(F.max_by("vec", F.struct("file", "place")).alias("vec"))


def json_entries(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, place, key, vec) of the pieces between `]`, or None if a piece isn't a plain entry.

    place is the start of the split and the number of the piece in it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("place")
    pieces = spark.read.option("lineSep", "]").text(path).select("value", F.col("_metadata.file_path").alias("file"), place)
    nested, flat = (F.col("value").rlike(_ENTRY[k]) for k in (True, False))
    part = lambda k: F.when(nested, F.regexp_extract("value", _ENTRY[True], k)).when(flat, F.regexp_extract("value", _ENTRY[False], k))
    rows = pieces.select("file", "place", "value", part(1).alias("key"), F.from_json(F.concat(F.lit("["), part(2), F.lit("]")), "array<double>").alias("vec"))
    odd = rows.where("vec is null").where(~F.col("value").rlike(_REST))
    # a file has one form, and one piece that opens it
    opens = F.count_if(F.col("value").rlike(r"^\s*\{")).alias("opens")
    forms = pieces.groupBy("file").agg(opens, F.count_if(nested).alias("nested"), F.count_if(flat).alias("flat"))
    if odd.isEmpty() and forms.where("opens <> 1 or (nested > 0 and flat > 0)").isEmpty():
        return rows.where("key is not null").select("file", "place", "key", "vec")
    return None


def _whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, key, vec) of JSON texts of any layout, a row each."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    is_nested = F.col("value").contains('"variants"')
    entries = F.from_json("value", "struct<variants:array<struct<id:string,embedding:array<double>>>>")["variants"]
    nested = text.where(is_nested).select("file", F.posexplode(entries).alias("place", "v")).select("file", "place", F.col("v.id").alias("key"), F.col("v.embedding").alias("vec"))
    flat = text.where(~is_nested).select("file", F.posexplode(F.from_json("value", "map<string,array<double>>")).alias("place", "key", "vec"))
    return nested.unionByName(flat).where("key is not null and vec is not null")
