"""Vectorised helpers over Arrow text columns.

Texts are handled as UTF-8 bytes.  A batch is cut into slices of about one
megabyte (a longer document is a slice of its own), so that memory follows the
slice and the longest document, not the batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.shared import materialised as checkpointed  # noqa: F401

SLICE_BYTES = 1 << 20
#: bytes of a column after whose slices freed memory goes back to the system
LARGE_BYTES = 4 << 20

_MULT = 0x9E3779B97F4A7C15
_MULT_INVERSE = pow(_MULT, -1, 1 << 64)
_MASK = (1 << 64) - 1

#: bytes of a word: everything but space and \t \n \v \f \r
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[32, 9, 10, 11, 12, 13]] = False

#: bytes of letters and digits; every byte of a non-ASCII character counts
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[48:58] = ALNUM_BYTES[65:91] = ALNUM_BYTES[97:123] = ALNUM_BYTES[128:] = True

#: a byte's lower case, A-Z only
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, n at least."""
    if len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _MULT), ("down", _MULT_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def byte_table(lane: int) -> np.ndarray:
    """Random 64-bit values of the 256 bytes; another table for each lane."""
    return np.random.default_rng(7919 + lane).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the len+1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory goes back to the system: workers live on between tasks, and the C library and Arrow keep what they had."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(first row, end row, bytes, offsets) of consecutive runs of rows of about `limit` bytes."""
    data, offsets = column_bytes(column)
    rows, lo = len(offsets) - 1, 0
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 65536, rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    if len(data) > LARGE_BYTES:
        give_back()


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTES):
    """Starts and ends of the maximal runs of `inside` bytes, and the first run of each row."""
    held = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(held), np.empty_like(held)
    if len(held):
        before[0], before[1:] = False, held[:-1]
        after[-1], after[:-1] = False, held[1:]
    starts = np.flatnonzero(held & (~before | edge[:-1]))
    ends = np.flatnonzero(held & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of byte runs; equal runs hash alike wherever they stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_table(lane)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of each `width` consecutive values (len - width + 1 of them)."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    n = len(values) - width + 1
    return mix((sums[width:] - sums[:n]) * down[:n])


def rolling(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """pick (minimum or maximum) over each `width` consecutive values."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def chosen(share: float, seed: int, *key) -> Column:
    """Whether a row is among a share of all, by a hash of its key; any share above 0 chooses some of enough rows."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 62)) < F.lit(max(1, int(share * (1 << 62))))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for own columns, like the given ones but unlike any of the table's, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str):
    """A column by its exact name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def one_of_equals(rows, key: list[str], columns: list[str]):
    """Of the rows of each key the one whose columns sort first as JSON, with these columns."""
    whole = F.struct(*[quoted(c) for c in columns])
    best = rows.groupBy(*key).agg(F.min_by(whole, F.to_json(whole)).alias("best"))
    return best.select(*[F.col("best").getField(c).alias(c) for c in columns])
