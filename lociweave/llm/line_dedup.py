"""Line dedup: drop boilerplate lines that many sites share.

Lines are the \\n-split parts of a text; those that are empty after trimming spaces
and tabs are never boilerplate.  A HyperLogLog sketch of the sites is kept for each
line hash, merged by aggregation, so a line's shuffle volume is one small sketch per
partition.  Lines whose estimate lies in a wide band around the threshold get an
exact distinct count of their sites; those beyond are decided by the estimate.

A site is a row's source; rows without source count as one unnamed site.  Null text
has no line.  Copies on one site count once; repeated rows are judged alike.  A very long
text is split whole, line by line.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed

MIN_SITES = 5
LG_K = 10
#: estimates between these multiples of the threshold are counted exactly
BAND = (0.5, 2.0)
#: most boilerplate lines that are broadcast (16 bytes each); more are joined by a shuffle
BROADCAST_ROWS = 500_000


def _key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit("second"), line).alias("k2")]


def _lines(docs: DataFrame) -> DataFrame:
    line = F.explode(F.split("text", "\n")).alias("line")
    return docs.select(F.coalesce("source", F.lit("")).alias("site"), line).where(F.trim(F.translate("line", "\t\r", "  ")) != "").select("site", *_key(F.col("line")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(k1, k2) hashes of the lines found on min_sites sites or more."""
    lines = _lines(docs)
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    spread = checkpointed(spread.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= BAND[0] * min_sites))
    near = spread.where(F.col("sites") <= BAND[1] * min_sites).select("k1", "k2")
    # a hot line meets its key once for each site and partition, never once for each row
    if near.count() <= broadcast_rows:
        held = lines.join(F.broadcast(near), ["k1", "k2"], "left_semi").distinct()
    else:
        held = lines.distinct().join(near, ["k1", "k2"], "left_semi")
    exact = held.groupBy("k1", "k2").count().where(F.col("count") >= min_sites)
    return spread.where(F.col("sites") > BAND[1] * min_sites).select("k1", "k2").union(exact.select("k1", "k2"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_text."""
    common = checkpointed(boilerplate(docs, min_sites, broadcast_rows))
    text = docs.select("doc_id", "text")
    if common.count() <= broadcast_rows:
        pairs = common.select("k1", "k2").toPandas().sort_values(["k1", "k2"])  # 16 bytes each
        known = docs.sparkSession.sparkContext.broadcast((pairs["k1"].to_numpy(np.int64), pairs["k2"].to_numpy(np.int64)))
        hashed = text.withColumn("keys", F.transform(F.split("text", "\n"), lambda x: F.struct(*_key(x))))

        def mark(batches):
            first, second = known.value
            for batch in batches:
                keys = batch.column("keys")
                flat = keys.flatten()
                k1, k2 = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                gone, at = np.zeros(len(k1), bool), np.searchsorted(first, k1)
                live = np.flatnonzero(at < len(first))
                while len(live := live[first[at[live]] == k1[live]]):  # more than once only where first hashes are equal
                    gone[live] = second[at[live]] == k2[live]
                    live = live[~gone[live]]
                    at[live] += 1
                    live = live[at[live] < len(first)]
                yield batch.drop_columns(["keys"]).append_column("gone", _bools(gone, keys))

        def _bools(gone, keys):
            sizes = np.array([0 if n is None else n for n in pc.list_value_length(keys).to_pylist()], np.int64)
            return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(gone))

        marked = hashed.mapInArrow(mark, "doc_id long, text string, gone array<boolean>")
        pairs = F.arrays_zip(F.split("text", "\n").alias("line"), F.col("gone").alias("gone"))
    else:
        # which lines go depends on the text alone, so equal texts are looked up once
        rows = text.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"))
        held = rows.select("t1", "t2", F.explode(F.split("text", "\n")).alias("line")).select("t1", "t2", *_key(F.col("line"))).distinct()
        gone = held.join(common, ["k1", "k2"], "left_semi").groupBy("t1", "t2").agg(F.collect_set(F.struct("k1", "k2")).alias("gone"))
        marked = rows.join(gone, ["t1", "t2"], "left")
        pairs = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.coalesce(F.array_contains("gone", F.struct(*_key(x))), F.lit(False)).alias("gone")))
    kept = F.filter(pairs, lambda x: ~x["gone"])
    n = F.coalesce(F.size(pairs), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n)
    kept_n = F.when(F.col("text").isNull(), 0).otherwise(F.size(kept))
    return marked.select("doc_id", n.cast("long").alias("n_lines"), (n - kept_n).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), F.lit("")).alias("kept_text"))
