"""Number formats and small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: up to seven decimals, half-even
DISTANCE_FORMAT = "#.#######"
STATS_FORMAT = "#0.0000"


def distance_text(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit(DISTANCE_FORMAT))


def stats_text(x: Column) -> Column:
    return F.call_function("format_number", x, F.lit(STATS_FORMAT))


def format_distance(x: float) -> str:
    """The same as distance_text for one number."""
    if x != x:
        return "NaN"
    from decimal import ROUND_HALF_EVEN, Decimal

    out = format(Decimal(repr(float(x))).quantize(Decimal("1e-7"), ROUND_HALF_EVEN), "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


def ratio_or_nan(a: Column, b: Column) -> Column:
    """a / b as double; 0 / 0 is NaN."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a.cast("double") / b)


def round_half_away(x: Column) -> Column:
    return F.round(x).cast("int")


def similarity_to_distance(x: Column) -> Column:
    return 1 - x


def log_poisson(rate: Column, n: Column) -> Column:
    """Logarithm of rate**n * e**-rate, without the factorial."""
    return n * F.ln(rate) - rate
