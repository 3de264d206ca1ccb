"""Distance matrices as text: N (and the number of variants) on the first line, then name and N numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import distance_text
from .text import expand, head_lines, numbered, read_lines


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(i, name, j, dist); a cell that is no number is 1.0.  Rows are numbered by Spark and stay there."""
    files = expand(spark, [path])
    head = next((line for file in files for line in head_lines(spark, file) if line.strip()), "")
    size = (head.replace(",", " ").split() or [""])[0]
    if not size.isdigit():
        raise ValueError("the first line of a matrix begins with its size; files of several windows can't be read as one matrix")
    n = int(size)
    lines = numbered(read_lines(spark, files).where("trim(value) <> ''"), F.lit(True))
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = lines.select((F.col("rec") - 2).cast("int").alias("i"), parts.alias("parts")).where(F.col("i").between(0, n - 1))
    found = rows.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("parts")).alias("least")).first()
    if found["rows"] < n or (n and found["least"] < n + 1):
        raise ValueError(f"a matrix of {n} needs {n} rows of a name and {n} numbers")
    cells = rows.select("i", F.get("parts", F.lit(0)).alias("name"), F.posexplode(F.slice("parts", 2, n)).alias("j", "cell"))
    return cells.select("i", "name", "j", F.coalesce(F.col("cell").try_cast("double"), F.lit(1.0)).alias("dist"))


def matrix_pairs(cells: DataFrame) -> DataFrame:
    """(i, j, name_i, name_j, dist) for i <= j of a matrix's cells; the part below the diagonal counts."""
    names = cells.where("i = j").select(F.col("i").alias("at"), F.col("name").alias("named"))
    upper = cells.where("i >= j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("name").alias("name_j"), "dist")
    return upper.join(names, upper.i == names.at).select("i", "j", F.col("named").alias("name_i"), "name_j", "dist")


def matrix_lines(dist: DataFrame, head: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Text rows (by..., line_no, value) of symmetric matrices given as i <= j rows of name_i, name_j and dist."""
    by = by or []
    both = dist.select(*by, "i", "j", F.col("name_i").alias("name"), "dist").union(dist.where("i < j").select(*by, F.col("j"), F.col("i"), F.col("name_j"), "dist"))
    cells = both.groupBy(*by, "i", "name").agg(F.sort_array(F.collect_list(F.struct("j", distance_text(F.col("dist")).alias("t")))).alias("c"))
    rows = cells.select(*by, (F.col("i") + 1).alias("line_no"), F.concat_ws("\t", "name", F.transform("c", lambda x: x["t"])).alias("value"))
    if head is None:
        return rows
    top = dist.groupBy(*by).agg(F.expr(head).alias("value")) if by else dist.agg(F.expr(head).alias("value"))
    return top.select(*by, F.lit(0).alias("line_no"), "value").unionByName(rows)


def write_lines(lines: DataFrame, path: str, order: list[str], together: int | None = None) -> None:
    """Sorted text; one file for each range of the order, so that names sort as lines do.

    Lines that are alike in the first `together` columns of the order are in one file, as a record's must be.
    """
    lines.repartitionByRange(*order[:together]).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)
