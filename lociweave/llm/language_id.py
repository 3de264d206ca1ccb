"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  A trigram's vector binds its
letters' vectors, permuted by their places, by multiplication; a text's vector
bundles (adds) those of its trigrams; a language's prototype bundles its texts.
A document gets the language whose prototype has the largest cosine with it.

Letters are Unicode letters in lower case, anything else is one word gap, so a
single letter already has trigrams.  Null texts and texts without a letter get
`und` and score 0, and so does every text when nothing was learned.  Ties go to
the language that sorts first.  Repeated rows count each time in a prototype.  Texts
of any length are read whole; their trigrams are bundled in blocks, so that memory
follows the text, not its vectors.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chosen, text_slices

DIM = 512
#: documents that are bundled into prototypes, about, at most
TRAIN_ROWS = 20_000
_CACHED_LETTERS = 1 << 16
#: trigrams whose vectors are gathered at once
BLOCK_GRAMS = 8192
_GAP = 0
_state: dict = {}


def _letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or the gap."""
    if "letters" not in _state:
        table = np.zeros(0x110000, np.uint32)
        for k in range(0x110000):
            if (c := chr(k)).isalpha():
                table[k] = ord(low) if len(low := c.lower()) == 1 else k
        _state["letters"] = table
    return _state["letters"]


def letter_vector(letter: int) -> np.ndarray:
    return np.random.default_rng((20_011, letter)).integers(0, 2, DIM).astype(np.int8) * np.int8(2) - np.int8(1)


def gram_vector(code: int) -> np.ndarray:
    """Bound vector of a trigram: the first letter's is permuted twice, the second's once."""
    a, b, c = (letter_vector((code >> shift) & 0x1FFFFF) for shift in (42, 21, 0))
    return np.roll(a, 2) * np.roll(b, 1) * c


def _gram_vectors(codes: np.ndarray) -> np.ndarray:
    """gram_vector of each code; the letters' vectors are remembered with their permutations."""
    letters = np.stack([(codes >> np.uint64(shift)) & np.uint64(0x1FFFFF) for shift in (42, 21, 0)]).astype(np.int64)
    if "places" not in _state or _state["known"] > _CACHED_LETTERS:
        _state.update(places=np.full(0x110000, -1, np.int32), known=0, vectors=np.zeros((3, 1024, DIM), np.int8))
    places = _state["places"]
    for letter in np.unique(letters[places[letters] < 0]).tolist():
        k = _state["known"]
        if k == _state["vectors"].shape[1]:
            _state["vectors"] = np.concatenate((_state["vectors"], np.zeros_like(_state["vectors"])), axis=1)
        places[letter], own = k, letter_vector(letter)
        for turn in range(3):
            _state["vectors"][turn, k] = np.roll(own, turn)
        _state["known"] += 1
    vectors = _state["vectors"]
    out = vectors[2, places[letters[0]]]
    out *= vectors[1, places[letters[1]]]
    out *= vectors[0, places[letters[2]]]
    return out


def text_vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bundled vectors of consecutive texts; zero where there is no letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = heads[offsets]
    letters = _letters()[points]
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for k in range(len(offsets) - 1):
        own = letters[bounds[k] : bounds[k + 1]]
        own = own[(own != _GAP) | np.concatenate(([False], own[:-1] != _GAP))].astype(np.uint64)
        if not own.any():
            continue
        own = np.concatenate(([np.uint64(_GAP)], own, np.zeros(1 + (own[-1] != _GAP), np.uint64)))[: len(own) + 1 + int(own[-1] != _GAP)]
        codes, counts = np.unique(own[:-2] << np.uint64(42) | own[1:-1] << np.uint64(21) | own[2:], return_counts=True)
        for at in range(0, len(codes), BLOCK_GRAMS):
            part = codes[at : at + BLOCK_GRAMS]
            if size + len(part) > BLOCK_GRAMS:
                _bundle(out, waiting)
                waiting, size = [], 0
            waiting.append((k, part, counts[at : at + BLOCK_GRAMS]))
            size += len(part)
    _bundle(out, waiting)
    return out


def _bundle(out: np.ndarray, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """Adds to rows of out the vectors of their trigrams, given as (row, distinct codes, counts)."""
    if not parts:
        return
    codes, back = np.unique(np.concatenate([c for _, c, _ in parts]), return_inverse=True)
    vectors, at = _gram_vectors(codes).astype(np.float32), 0
    for k, own, counts in parts:
        out[k] += counts.astype(np.float32) @ vectors[back[at : at + len(own)]]
        at += len(own)


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """Prototypes by language from (doc_id, text, lang); about train_rows documents chosen by a hash of doc_id."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    n = docs.select("lang").count()
    # rows without doc_id are told apart by their text
    sample = docs.where(chosen(train_rows / n, 1, "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))) if n > train_rows else docs

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                vectors = text_vectors(data, offsets).astype(np.float64)
                for lang in set(langs[lo:hi]):
                    sums[lang] = sums.get(lang, np.zeros(DIM)) + vectors[langs[lo:hi] == lang].sum(axis=0)
        yield pa.RecordBatch.from_pylist([{"lang": k, "vector": v.tolist()} for k, v in sums.items()], pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.float64()))]))

    parts = sample.mapInArrow(bundle, "lang string, vector array<double>")
    # Spark adds up the partitions' bundles; one row of DIM numbers for each language reaches the driver
    added = parts.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    rows = added.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v")).collect()
    if n and not rows:
        raise RuntimeError(f"no document was sampled from {n}")
    return {r["lang"]: np.array([x["x"] for x in r["v"]]) for r in rows}


def language_id(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """One row per document: doc_id, lang_pred and score, the cosine cut to 0..1."""
    names = sorted(k for k, v in prototypes.items() if np.linalg.norm(v) > 0)
    matrix = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names], axis=1).astype(np.float32) if names else np.zeros((DIM, 0), np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(batches):
        names, matrix = shared.value
        for batch in batches:
            langs, scores = [], []
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                vectors = text_vectors(data, offsets)
                norms = np.linalg.norm(vectors, axis=1)
                empty = norms == 0
                if not names or empty.all():
                    langs += ["und"] * (hi - lo)
                    scores += [0.0] * (hi - lo)
                    continue
                cosines = (vectors @ matrix) / np.where(empty, 1, norms)[:, None]
                best = cosines.argmax(axis=1)
                langs += ["und" if e else names[b] for e, b in zip(empty, best, strict=True)]
                scores += np.where(empty, 0, np.clip(cosines[np.arange(hi - lo), best], 0, 1)).astype(float).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")
