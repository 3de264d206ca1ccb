"""Window statistics over streams, with state kept by Spark.

`stream_tiles` and `stream_sessions` use event time and watermarks.  `stream_variant_windows` follows
the order in which a contig's rows arrive: a window closes as soon as the contig's next one begins (for a window of a number of
rows, with the row after its last); its pair counts are the only state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.distance import _one_hot
from ..operators.windows import WindowPolicy


def stream_tiles(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """(by, start, end, n, total) of time windows, tumbling or sliding; rows later than the watermark are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(window, by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def stream_sessions(events: DataFrame, gap: str, late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """(by, start, end, n): sessions that end after a gap without rows."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


_PAIRS = "chrom string, start long, end long, n long, i int, j int, dot long"
#: genotypes that are turned into bits at once
BLOCK_CELLS = 1 << 22


class _OpenWindow(StatefulProcessor):
    """The open window of a contig: its ends, the number of its rows, and the samples' common alleles so far."""

    def __init__(self, policy: WindowPolicy, samples: int, ploidy: int, max_alleles: int, idle_ms: int | None):
        self.policy, self.samples, self.shape, self.idle_ms = policy, samples, (ploidy, max_alleles), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, last long, n long, dots binary")

    def _closed(self, chrom, start: int, last: int, n: int, dots: np.ndarray) -> pd.DataFrame:
        i, j = np.triu_indices(self.samples)
        end = start + self.policy.size if self.policy.mode == "bp" else last + 1
        found = pd.DataFrame({"chrom": chrom, "start": start, "end": end, "n": n, "i": i.astype(np.int32), "j": j.astype(np.int32), "dot": dots[i, j]})
        return found if n >= self.policy.min_variants else found.iloc[:0]

    def _dots(self, gts: list) -> np.ndarray:
        """Common alleles of all pairs of samples over rows of genotypes, block by block."""
        total, step = np.zeros((self.samples, self.samples), np.int64), max(1, BLOCK_CELLS // self.samples)
        for lo in range(0, len(gts), step):
            hot = _one_hot(pa.array(gts[lo : lo + step], pa.list_(pa.string())), self.samples, *self.shape).transpose(0, 2, 1).reshape(-1, self.samples)
            total += np.rint(hot.T.astype(np.float64) @ hot).astype(np.int64)
        return total

    def handleInputRows(self, key, rows, timerValues):
        state = self.open.get()
        start, last, n = (int(x) for x in state[:3]) if state is not None else (0, 0, 0)
        dots = np.frombuffer(state[3], np.int64).reshape(self.samples, self.samples) if state is not None else np.zeros((self.samples, self.samples), np.int64)
        size, out = self.policy.size, []
        frames = list(rows)
        table = pd.concat(frames) if len(frames) > 1 else frames[0]
        if "ord" in table:
            table = table.sort_values("ord", kind="stable")
        pos, gts = table["pos"], [None if g is None else list(g) for g in table["gts"]]
        ends = pos.isna().to_numpy()
        place = pos.fillna(0).to_numpy().astype(np.int64)
        at = 0
        while at < len(place):
            if ends[at]:
                if n:
                    out.append(self._closed(key[0], start, last, n, dots))
                n, dots, at = 0, np.zeros_like(dots), at + 1
                continue
            if n == 0:
                start = place[at] // size * size if self.policy.mode == "bp" else int(place[at])
            stop = np.flatnonzero(ends[at:])
            stop = at + int(stop[0]) if len(stop) else len(place)
            if self.policy.mode == "bp":
                away = np.flatnonzero((place[at:stop] < start) | (place[at:stop] >= start + size))
                stop = at + int(away[0]) if len(away) else stop
            else:
                stop = min(stop, at + size - n)
            if stop > at:
                dots, n, last = dots + self._dots(gts[at:stop]), n + stop - at, int(place[stop - 1])
            if stop < len(place) and not ends[stop]:  # the row that follows opens the next window
                out.append(self._closed(key[0], start, last, n, dots))
                n, dots = 0, np.zeros_like(dots)
            at = stop
        if n:
            self.open.update((int(start), last, n, dots.astype(np.int64).tobytes()))
        else:
            self.open.clear()
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        state = self.open.get()
        if state is not None:
            self.open.clear()
            yield self._closed(key[0], int(state[0]), int(state[1]), int(state[2]), np.frombuffer(state[3], np.int64).reshape(self.samples, self.samples))

    def close(self) -> None:
        pass


def stream_variant_windows(variants: DataFrame, policy: WindowPolicy, samples: int, ploidy: int, max_alleles: int, idle_ms: int | None = None) -> DataFrame:
    """(chrom, start, end, n, i, j, dot) of closed windows of a stream of (chrom, pos, gts) in order of arrival.

    Rows of a batch with an ord are taken by it.  The open window of each contig waits in the state; a row without pos closes it,
    and so does a contig from which nothing has come for idle_ms, if that is given.  Rows are counted in blocks, by
    matrix products.  The session needs the RocksDB state store.
    """
    chosen = variants.select("chrom", F.col("pos").cast("long").alias("pos"), "gts", *[c for c in ("ord",) if c in variants.columns])
    processor = _OpenWindow(policy, samples, ploidy, max_alleles, idle_ms)
    return chosen.groupBy("chrom").transformWithStateInPandas(processor, _PAIRS, "Append", "None" if idle_ms is None else "ProcessingTime")
