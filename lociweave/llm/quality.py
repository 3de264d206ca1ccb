"""Quality rules: base statistics and a calibrated hashed n-gram classifier.

A logistic regression over hashed words, pairs of words and character (byte) 4-grams,
all as shares of a text, is fitted on at most TRAIN_ROWS labelled rows; one in
five of them is held back to calibrate its scores as probabilities (Platt).
All rows are scored in Arrow batches, and thresholds are fixed.

Null and empty texts have no words and fail the base rule.  Without labelled
rows of both classes every document gets probability 1 and only the base rules
decide.  A repeated row is judged like any other; in the sample a repeated doc_id counts
once.  Very long texts are read whole, each in a slice of its own.  An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._linear import Sparse, fit_logistic, fit_platt, gathered, sample_labelled, sigmoid
from ._text import WORD_BYTES, checkpointed, run_hashes, span_hashes, spans, text_slices

#: bounds of the labelled sample: rows, and bytes of their features (about 10 kB a row, so the rows bind)
TRAIN_ROWS, TRAIN_BYTES = 3000, 48 << 20
#: features of each kind: hashed words, then 4-grams, then pairs of words
KIND_BITS = 16
KINDS = 3
#: documents whose probability of good quality is below are rejected
MIN_PROBABILITY = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[128:192] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_score double"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive offsets."""
    sums = np.concatenate((np.zeros(1, flags.dtype if flags.dtype.kind == "f" else np.int64), np.cumsum(flags, dtype=np.float64 if flags.dtype.kind == "f" else np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashed byte 4-grams, one for each position that has four bytes."""
    b = data.astype(np.uint32)
    code = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - KIND_BITS)).astype(np.int64)


def _word_features(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - KIND_BITS)).astype(np.int64)


def features(data: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sparse features of one text, counts of its words, its 4-grams and its pairs of words, and how many there are of each kind."""
    found, sizes = [], []
    for kind, index in enumerate((_word_features(hashes), _grams(data) if len(data) > 3 else np.zeros(0, np.int64), _word_features(run_hashes(hashes, 2)))):
        some, counts = np.unique(index, return_counts=True)
        found.append((some + (kind << KIND_BITS), counts))
        sizes.append(len(index))
    return np.concatenate([i for i, _ in found]), np.concatenate([v for _, v in found]), sizes


def shares(index: np.ndarray, counts: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Counts as shares of all of their kind."""
    return (counts / np.maximum(1, np.array(sizes))[index >> KIND_BITS]).astype(np.float32)


def base_statistics(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    n = np.diff(first)
    word = WORD_BYTES[data]
    out = {"n_words": n, "word_chars": _per_row(word & ~_CONTINUED[data], offsets), "n_symbols": _per_row(SYMBOLS[data], offsets)}
    lines = np.zeros(len(n), np.int64)
    for k in range(len(n)):
        found = [x for x in data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n") if x.strip()]
        lines[k] = len(found) - len(set(found))
    out["n_dup_lines"] = lines
    row = np.repeat(np.arange(len(n)), n)
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        whole = np.flatnonzero(row[2:] == row[:-2])
        keys = run_hashes(hashes, 3)[whole] ^ (row[whole].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(order) else np.zeros(0, bool)
        at = whole[order[twice]]
        for step in range(3):
            repeated[at + step] = True
    out["n_repeat_words"] = _per_row(repeated, first)
    return out


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> dict | None:
    """The model: weights of all features, bias, the two numbers of its calibration, and the number of rows that it was fitted on."""
    sample = sample_labelled(docs, labels, "quality", train_rows, seed=3)

    def featurise(batches):
        for batch in batches:
            rows = []
            ids, label = batch.column("doc_id").to_pylist(), batch.column("label").to_pylist()
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = spans(data, offsets)
                hashes = span_hashes(data, starts, ends)
                for k in range(hi - lo):
                    index, value, sizes = features(data[offsets[k] : offsets[k + 1]], hashes[first[k] : first[k + 1]])
                    rows.append({"doc_id": ids[lo + k], "label": label[lo + k], "index": index.astype("<i4").tobytes(), "value": np.minimum(value, 65535).astype("<u2").tobytes(), "sizes": sizes})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("index", pa.binary()), ("value", pa.binary()), ("sizes", pa.list_(pa.int64()))]))

    rows = gathered(checkpointed(sample.mapInArrow(featurise, "doc_id long, label int, index binary, value binary, sizes array<long>")), train_bytes, "index", "value")
    y = (rows["label"] == 1).to_numpy(dtype=float)
    if len(y) == 0 or y.min() == y.max():
        return None
    x = [(i := np.frombuffer(a, "<i4"), shares(i, np.frombuffer(v, "<u2"), list(n))) for a, v, n in zip(rows["index"], rows["value"], rows["sizes"], strict=True)]
    held = np.arange(len(y)) % 5 == 4
    if len({*y[held]}) < 2 or len({*y[~held]}) < 2:
        held[:] = False
    dim = KINDS << KIND_BITS
    train = Sparse.of([p for p, h in zip(x, held, strict=True) if not h])
    calibrate = Sparse.of([p for p, h in zip(x, held, strict=True) if h]) if held.any() else Sparse.of(x)
    del rows, x  # the driver holds the features once
    scale = 1 / np.sqrt(train.back(np.ones(train.rows), dim) / train.rows + 1e-4)
    train.value *= scale[train.index].astype(np.float32)
    weights, bias = fit_logistic(train, y[~held], dim, l2=1e-4, steps=120)
    weights = weights * scale
    slope, offset = fit_platt(calibrate.dot(weights) + bias, y[held] if held.any() else y)
    return {"weights": weights.astype(np.float32), "bias": bias, "slope": slope, "offset": offset, "rows": len(y)}


def quality_rules(docs: DataFrame, labels: DataFrame, min_probability: float = MIN_PROBABILITY, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, its base statistics, base_failed, kept and the calibrated quality_score."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(docs.sparkSession, fit(docs, labels, train_rows), min_probability), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, min_probability: float = MIN_PROBABILITY, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    judge = _scorer(docs.sparkSession, fit(docs, labels, train_rows), min_probability)
    doc, text = (docs.columns.index(c) for c in ("doc_id", "text"))

    def keep(batches):
        for batch in batches:
            judged = pa.RecordBatch.from_arrays([batch.column(doc), batch.column(text)], ["doc_id", "text"])
            for verdict in judge([judged]):
                yield batch.filter(verdict.column("kept"))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # names with dots can't be mapped
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def _scorer(spark, model: dict | None, min_probability: float):
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality_score", pa.float64())])

    def probability(data, offsets, first, hashes):
        model = shared.value
        if model is None:
            return np.ones(len(offsets) - 1)
        weights = model["weights"]
        total = np.full(len(offsets) - 1, model["bias"])
        total += _per_row(weights[_word_features(hashes)].astype(np.float64), first) / np.maximum(1, np.diff(first))
        for kind, index, edges, width in ((1, _grams(data) if len(data) > 3 else [], offsets, 4), (2, _word_features(run_hashes(hashes, 2)), first, 2)):
            lengths = np.diff(edges) - width + 1
            whole = lengths > 0
            if whole.any():
                sums = np.concatenate(([0.0], np.cumsum(weights[(kind << KIND_BITS) + index], dtype=np.float64)))
                lo = edges[:-1][whole]
                total[whole] += (sums[lo + lengths[whole]] - sums[lo]) / lengths[whole]
        return sigmoid(model["slope"] * total + model["offset"])

    def score(batches):
        for batch in batches:
            parts = []
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                starts, ends, first = spans(data, offsets)
                hashes = span_hashes(data, starts, ends)
                found = base_statistics(data, offsets, starts, first, hashes)
                failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])
                p = probability(data, offsets, first, hashes)
                columns = [batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), *(pa.array(x) for x in found.values()), pa.array(failed), pa.array(~failed & (p >= min_probability)), pa.array(p)]
                parts.append(pa.RecordBatch.from_arrays(columns, schema=schema))
            yield pa.Table.from_batches(parts, schema).combine_chunks().to_batches()[0] if parts else pa.RecordBatch.from_pylist([], schema)

    return score
