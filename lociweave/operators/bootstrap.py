"""Poisson bootstrap: weights that depend on seed, variant and replicate only, whatever the partitions.

A variant is hashed once, to two numbers a and b; replicate r's uniform number is (a + r b) mod PRIME over
PRIME.  Those of different variants are independent, and so are those of any two replicates of a variant.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 31) - 1
#: P(X <= k) of Poisson(1) for k = 0..11 as whole numbers under PRIME; what lies beyond rounds to 1
CUMULATIVE = [math.floor(PRIME * sum(math.exp(-1) / math.factorial(x) for x in range(k + 1))) for k in range(12)]


def _poisson(uniform: Column) -> Column:
    """Inverse distribution function at a whole number under PRIME; two comparisons on average."""
    out = F.when(uniform < CUMULATIVE[0], 0)
    for k, bound in enumerate(CUMULATIVE[1:], 1):
        out = out.when(uniform < bound, k)
    return out.otherwise(len(CUMULATIVE))


def variant_pair(variant: Column, seed: int) -> Column:
    """struct of the numbers a and b of a variant, whose identity is a text or number."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), variant.cast("string")).cast("binary"))
    number = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("long")
    return F.struct((number(1) % PRIME).alias("a"), (number(13) % PRIME).alias("b"))


def weights_of(a: np.ndarray, b: np.ndarray, replicates) -> np.ndarray:
    """(variants, replicates) weights of the pairs a and b; replicate 0 weighs all alike."""
    reps = np.asarray(replicates, np.int64)
    drawn = np.searchsorted(np.array(CUMULATIVE), (a[:, None] + reps * b[:, None]) % PRIME, side="right")
    return np.where(reps == 0, 1, drawn)


def poisson_weights(variant: Column, replicates: int, seed: int) -> Column:
    """array of the weights of replicates 1..replicates of a variant, whose identity is a text or number."""
    # the pair is bound once, as the argument of the outer function, and not hashed for each replicate
    pair = F.array(variant_pair(variant, seed))
    all_of = lambda p: F.transform(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long")), lambda r: (p["a"] + r * p["b"]) % PRIME)
    return F.transform(F.get(F.transform(pair, all_of), F.lit(0)), _poisson)
