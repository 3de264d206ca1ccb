"""Toxicity: a logistic classifier regularised by counterfactual identity swaps.

Features are the presence of hashed words, word pairs and word beginnings of PREFIXES
bytes, which catch inflected forms that were never seen.  Those that many
labelled texts have and that go with the label are kept; their log ratio between
the classes scales them.  For each labelled text that mentions a group, the
mention is swapped for other groups, and differences between the scores of the
text and of its swapped forms are penalised; a mention alone then says little.

The model is fitted on at most TRAIN_ROWS rows.  Scores become probabilities by a
calibration on those that models fitted, features chosen, without a fold give to that
fold's rows.  Null and empty texts get the score of a text without any
known feature.  Without rows of both labels every score is the share of toxic labels
(0 if there is none).  Repeated rows are scored like any other; in the sample a repeated
doc_id counts once.  Very long texts are read whole.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import Sparse, fit_logistic, fit_platt, gathered, sample_labelled, sigmoid
from ._text import ALNUM_BYTES, LOWER, checkpointed, mix, run_hashes, span_hashes, spans, text_slices

#: bounds of the labelled sample: rows, and bytes of their kept features
TRAIN_ROWS, TRAIN_BYTES = 8000, 32 << 20
#: parts of the labelled rows, each of which is left out once to calibrate scores on rows that a model hasn't seen
FOLDS = 4
THRESHOLD = 0.7
BITS = 20
#: a feature is used if so many texts have it and its z value is so large
MIN_TEXTS, MIN_Z = 3, 4.0
PAIR_WEIGHT = 1.0
SWAPS = 3
PREFIXES = (3, 4, 5)

# Group terms of which one may stand for another.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "natives", "refugees", "foreigners"],
    ["immigrant", "native", "refugee", "foreigner"],
    ["disabled", "blind", "deaf", "autistic"],
    ["old", "young", "elderly"],
]


def groups_of(terms: list[list[str]]) -> dict[bytes, list[bytes]]:
    """What may stand for each term; terms are words as _tokens has them (letters A-Z in lower case)."""
    lower = [[LOWER[np.frombuffer(t.encode(), np.uint8)].tobytes() for t in group] for group in terms]
    return {t: [x for x in group if x != t] for group in lower for t in group if len(set(group)) > 1}


_GROUP = groups_of(IDENTITY_TERMS)


def _tokens(data: np.ndarray, offsets: np.ndarray):
    lower = LOWER[data]
    return lower, *spans(lower, offsets, ALNUM_BYTES)


def _features(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray):
    """(row, feature) of all words, pairs of neighbours in a row, and beginnings of longer words."""
    hashes = span_hashes(lower, starts, ends)
    rows, found = [row], [hashes]
    if len(hashes) > 1:
        inside = np.flatnonzero(row[1:] == row[:-1])
        rows.append(row[inside])
        found.append(run_hashes(hashes, 2)[inside])
    for n in PREFIXES:
        longer = ends - starts > n
        rows.append(row[longer])
        found.append(mix(span_hashes(lower, starts[longer], starts[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def text_features(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    lower, starts, ends, _ = _tokens(data, np.array([0, len(data)]))
    return np.unique(_features(lower, starts, ends, np.zeros(len(starts), np.int64))[1])


def counterfactuals(text: bytes, groups: dict[bytes, list[bytes]] = _GROUP) -> list[bytes]:
    """The text with each mention of a group swapped for another of its kind, SWAPS forms at most."""
    data = np.frombuffer(text, np.uint8)
    lower, starts, ends, _ = _tokens(data, np.array([0, len(data)]))
    lower = lower.tobytes()
    found = [(s, e, groups[w]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if (w := lower[s:e]) in groups]
    forms = []
    for turn in range(SWAPS if found else 0):
        out, at = [], 0
        for s, e, others in found:
            out += [lower[at:s], others[turn % len(others)]]
            at = e
        forms.append(b"".join([*out, lower[at:]]))
    return forms


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: list[list[str]] = IDENTITY_TERMS, pair_weight: float = PAIR_WEIGHT) -> dict:
    """Weights of the kept features (feature numbers sorted), bias and calibration; terms: lists of words that may stand for one another."""
    groups = groups_of(terms)
    sample = sample_labelled(docs, labels, "toxic", train_rows, seed=9)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("form", pa.int32()), ("index", pa.binary())])
    fields = "doc_id long, label int, form int, index binary"

    def featurise(batches):
        for batch in batches:
            for doc, label, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "label", "text")), strict=True):
                text = text.encode()
                rows = [{"doc_id": doc, "label": label, "form": form, "index": text_features(x).astype("<i4").tobytes()} for form, x in enumerate([text, *counterfactuals(text, groups)])]
                yield pa.RecordBatch.from_pylist(rows, schema)

    features = checkpointed(sample.mapInArrow(featurise, fields)).withColumn("fold", F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(FOLDS)).cast("int"))
    size = np.zeros((FOLDS, 2), np.int64)
    for r in features.where("form = 0").groupBy("fold", (F.col("label") == 1).alias("toxic")).count().collect():  # two rows a fold
        size[r["fold"], int(r["toxic"])] = r["count"]
    n0, n1 = size.sum(axis=0).tolist()
    nothing = {"index": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": 0.0, "slope": 1.0, "offset": 0.0}
    if not n1 or not n0:
        return nothing | {"bias": 40.0 if n1 else -40.0}
    tally = _tally(features.where("form = 0"), size)
    if tally.empty:
        return nothing | {"bias": float(np.log(n1 / n0))}
    index, counts = tally["feature"].to_numpy(), tally.drop(columns="feature").to_numpy().reshape(-1, FOLDS, 2)
    known = docs.sparkSession.sparkContext.broadcast(index)

    def reduce(batches):
        """The informative features of each text, by their places among all such; the others never reach the driver."""
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                found = np.frombuffer(r["index"], "<i4")
                at = np.minimum(np.searchsorted(known.value, found), len(known.value) - 1)
                r["index"] = at[known.value[at] == found].astype("<i4").tobytes()
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*schema, ("fold", pa.int32())]))

    rows = gathered(features.mapInArrow(reduce, f"{fields}, fold int"), TRAIN_BYTES, "index")
    own = rows[rows["form"] == 0]
    swapped = rows[rows["form"] > 0].merge(own[["doc_id", "index"]], on="doc_id", suffixes=("", "_own"))
    truth, fold = (own["label"] == 1).to_numpy(dtype=float), own["fold"].to_numpy()

    def fitted(left_out: int | None) -> tuple[np.ndarray, float]:
        """Weights and bias from all folds but one; a feature that is not informative there has no weight."""
        used = counts.sum(axis=1) - (0 if left_out is None else counts[:, left_out])
        n0, n1 = (size.sum(axis=0) - (0 if left_out is None else size[left_out])).tolist()
        ratio = np.where(informative(used[:, 1], used[:, 0], n1, n0, np.sqrt), np.log((used[:, 1] + 0.5) / (n1 + 1)) - np.log((used[:, 0] + 0.5) / (n0 + 1)), 0.0)
        sparse = lambda column: Sparse.of([(n, ratio[n]) for n in (np.frombuffer(x, "<i4") for x in column)])
        others, pairs = swapped[swapped["fold"] != left_out], None
        if len(others):
            a, b = sparse(others["index"]), sparse(others["index_own"])
            pairs = Sparse(np.concatenate((a.row, b.row)), np.concatenate((a.index, b.index)), np.concatenate((a.value, -b.value)), a.rows)
        within = fold != left_out
        weights, bias = fit_logistic(sparse(own["index"][within]), truth[within], len(index), l2=1e-4, steps=300, pairs=pairs, pair_weight=pair_weight)
        return weights * ratio, bias

    def scored(of: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        parts = [np.frombuffer(x, "<i4") for x in own["index"][of]]
        return Sparse.of([(n, np.ones(len(n))) for n in parts]).dot(weights) + bias

    weights, bias = fitted(None)
    scores = scored(np.ones(len(own), bool), weights, bias)
    if (size.sum(axis=0) - size).min() > 0:  # else too few rows to leave a fold out
        for k in np.unique(fold):
            scores[fold == k] = scored(fold == k, *fitted(int(k)))
    slope, offset = fit_platt(scores, truth)
    return {"index": index, "weights": weights, "bias": bias, "slope": slope, "offset": offset}


def informative(toxic, clean, n1, n0, root):
    """Whether features that so many of n1 toxic and n0 clean texts have go with the label; for columns and for arrays."""
    p = (toxic + clean) / (n1 + n0)
    z = (toxic / n1 - clean / n0) / root(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    return (toxic + clean >= MIN_TEXTS) & ((z >= MIN_Z) | (z <= -MIN_Z))


def _tally(features: DataFrame, size: np.ndarray):
    """feature and, by fold, in how many clean and in how many toxic texts it is; of features informative in all folds or without one."""
    names = [f"f{k}_{y}" for k in range(FOLDS) for y in (0, 1)]
    schema = pa.schema([("feature", pa.int32()), *((c, pa.int64()) for c in names)])

    def tally(batches):
        counts = np.zeros((FOLDS, 2, 1 << BITS), np.int32)
        for batch in batches:
            for fold, label, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[fold, int(label == 1), np.frombuffer(index, "<i4")] += 1
        found = np.flatnonzero(counts.any(axis=(0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), *(pa.array(x[found].astype(np.int64)) for x in counts.reshape(-1, 1 << BITS))], schema=schema)

    per = features.select("fold", "label", "index").mapInArrow(tally, "feature int, " + ", ".join(f"{c} long" for c in names))
    per = per.groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])
    wanted = F.lit(False)
    for left_out in (None, *range(FOLDS)):
        n0, n1 = (size.sum(axis=0) - (0 if left_out is None else size[left_out])).tolist()
        clean, toxic = (sum((F.col(f"f{k}_{y}") for k in range(FOLDS) if k != left_out), F.lit(0)) for y in (0, 1))
        if n0 and n1:
            wanted = wanted | informative(toxic, clean, n1, n0, F.sqrt)
    return per.where(wanted).toPandas().sort_values("feature", ignore_index=True)


def toxicity(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(batches):
        model = shared.value
        known = np.full(1 << BITS, -1, np.int32)
        known[model["index"]] = np.arange(len(model["index"]))
        for batch in batches:
            scores = [np.zeros(0)]
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                lower, starts, ends, first = _tokens(data, offsets)
                row, index = _features(lower, starts, ends, np.repeat(np.arange(hi - lo), np.diff(first)))
                index = known[index]
                held = index >= 0
                seen = np.unique(row[held] * np.int64(1 << BITS) + index[held])  # presence, not number
                total = np.bincount(seen >> BITS, model["weights"][seen & ((1 << BITS) - 1)], hi - lo)
                scores.append(sigmoid(model["slope"] * (total + model["bias"]) + model["offset"]))
            scores = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int")
