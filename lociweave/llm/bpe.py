"""BPE encoding and decoding; long unsplit text by tree concatenation.

Both supported vocabularies never merge across certain white space, so a text falls
into chunks there, and each distinct chunk is encoded once (see `tokens`).  A chunk of
more than LEAF_CHARS bytes, text without such white space, is cut into equal leaves,
which become rows of their own and are encoded in parallel.  Neighbours are then
joined as a tree, all joins of a level in parallel: a window around each join is
encoded anew and grows until it holds, on either side, a token that the half has in
the same place with the same id; left of the first and right of the second the halves'
tokens are right, between them the window's are.  Byte-pair encoding depends on
neighbouring tokens only, so such an agreement fixes everything beyond it; a
window that has grown over both halves is the exact encoding itself.

Agreements count only GUARD characters away from the window's ends, where an
added token, a contraction or a composed character could look different.

Null text counts as empty: no ids, empty decoded text.  A very long text is one row of
the result, so one task holds its ids; its leaves and joins are spread.  Rows without
doc_id and repeated rows are encoded like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import checkpointed, text_slices
from .tokens import codec, vocabulary

LEAF_CHARS = 1 << 15
WINDOW_CHARS = 128
GUARD = 24
#: parts that a task joins, as a tree of their own
FAN = 4

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, starts, ends (in characters)


def encode_span(tokenizer, text: str, shift: int = 0) -> Tokens:
    found = tokenizer.encode(text, add_special_tokens=False)
    places = np.array(found.offsets, np.int64).reshape(-1, 2) + shift
    return np.array(found.ids, np.int64), places[:, 0], places[:, 1]


def _agreements(one: Tokens, two: Tokens, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, in both, of equal tokens within lo..hi that share no character with a neighbour."""

    def clear(tokens: Tokens) -> np.ndarray:
        ids, starts, ends = tokens
        before = np.concatenate(([True], ends[:-1] <= starts[1:])) if len(ids) else np.zeros(0, bool)
        after = np.concatenate((starts[1:] >= ends[:-1], [True])) if len(ids) else np.zeros(0, bool)
        return np.flatnonzero(before & after & (starts >= lo) & (ends <= hi) & (starts < ends))

    a, b = clear(one), clear(two)
    key = lambda tokens, at: list(zip(tokens[1][at].tolist(), tokens[2][at].tolist(), tokens[0][at].tolist(), strict=True))
    places = {k: i for i, k in zip(b.tolist(), key(two, b), strict=True)}
    both = [(i, places[k]) for i, k in zip(a.tolist(), key(one, a), strict=True) if k in places]
    return np.array([i for i, _ in both], np.int64), np.array([j for _, j in both], np.int64)


def join_tokens(tokenizer, text: str, begin: int, middle: int, end: int, left: Tokens, right: Tokens, window: int = WINDOW_CHARS) -> Tokens:
    """Exact tokens of text[begin:end] from those of text[begin:middle] and text[middle:end]."""
    while True:
        lo, hi = max(begin, middle - window), min(end, middle + window)
        seen = encode_span(tokenizer, text[lo:hi], lo)
        l_from = l_at = None
        if lo == begin:
            l_from, l_at = 0, 0
        elif len((found := _agreements(left, seen, lo + GUARD, middle - GUARD))[0]):
            l_from, l_at = found[0][0], found[1][0]
        r_from = r_at = None
        if hi == end:
            r_from, r_at = len(right[0]), len(seen[0])
        elif len((found := _agreements(right, seen, middle + GUARD, hi - GUARD))[0]):
            r_from, r_at = found[0][-1], found[1][-1]
        if l_from is not None and r_from is not None and l_at <= r_at:
            return tuple(np.concatenate((x[:l_from], s[l_at:r_at], y[r_from:])) for x, s, y in zip(left, seen, right, strict=True))
        window *= 2


def join_leaves(tokenizer, text: str, cuts: list[int], leaves: list[Tokens]) -> Tokens:
    """Tokens of the text from those of text[cuts[k]:cuts[k+1]], joined pairwise as a tree."""
    parts = [(cuts[k], cuts[k + 1], t) for k, t in enumerate(leaves)]
    while len(parts) > 1:
        joined = [(a[0], b[1], join_tokens(tokenizer, text, a[0], a[1], b[1], a[2], b[2])) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    return parts[0][2]


def cut_points(text: str, leaf_chars: int = LEAF_CHARS) -> list[int]:
    return [*range(0, max(1, len(text)), leaf_chars), len(text)]


def tree_encode(tokenizer, text: str, leaf_chars: int = LEAF_CHARS) -> np.ndarray:
    """The whole of it in one process, for a single text."""
    cuts = cut_points(text, leaf_chars)
    return join_leaves(tokenizer, text, cuts, [encode_span(tokenizer, text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)])[0]


def _packed(tokens: Tokens) -> dict:
    ids, starts, ends = tokens
    return {"ids": ids.astype("<i4").tobytes(), "places": np.stack((starts, ends)).astype("<u4").tobytes()}


_PART = "row long, doc_id long, segment int, part int, text string, ids binary, places binary"
_PART_SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("segment", pa.int32()), ("part", pa.int32()), ("text", pa.string()), ("ids", pa.binary()), ("places", pa.binary())])


def encode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", cut: str = "words", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row per document: doc_id, ids array<int>, decoded string."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def rows(column, encoder, ids, bounds):
        flat = pa.array(np.ascontiguousarray(ids, np.int32))
        listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
        decoded = _decoded(encoder, ids, bounds)
        return pa.RecordBatch.from_arrays([column.cast(pa.int64()), listed, pa.array(decoded, pa.string())], schema=out)

    def unsplit(encoder, text: bytes) -> bool:
        """Whether the text has a chunk for the tree."""
        return len(text) > leaf_chars and any(len(c) > leaf_chars for block in encoder.blocks(text) for c in encoder.cut(block))

    def by_chunks(batches):
        encoder = codec(content.value, cut)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column("text")):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(hi - lo)]
                plain = [k for k, t in enumerate(texts) if not unsplit(encoder, t)]
                if plain:
                    ids = batch.column("doc_id").slice(lo, hi - lo)
                    ids = ids if len(plain) == hi - lo else ids.take(pa.array(plain))
                    yield rows(ids, encoder, *encoder.encode([texts[k] for k in plain]))

    def segments(batches):
        """Leaves of the long chunks, and the ids of what stands between these."""
        encoder = codec(content.value, cut)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                if not unsplit(encoder, text.encode()):
                    continue
                found, waiting = [], []

                def settle(found=found, waiting=waiting):
                    if waiting:
                        ids, _ = encoder.encode_chunks(waiting)
                        found.append([{"part": 0, "ids": ids.astype("<i4").tobytes()}])
                        waiting.clear()

                for chunk in encoder.cut(text.encode()):
                    if len(chunk) <= leaf_chars:
                        waiting.append(chunk)
                        continue
                    settle()
                    chunk = chunk.decode()
                    cuts = cut_points(chunk, leaf_chars)
                    found.append([{"part": k, "text": chunk[a:b]} for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
                settle()
                yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "segment": n} | part for n, parts in enumerate(found) for part in parts], _PART_SCHEMA)

    def leaves(batches):
        encoder = codec(content.value, cut)
        for batch in batches:
            done = [r | _packed(encode_span(encoder.tokenizer, r["text"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(done, _PART_SCHEMA)

    def joined(table: pa.Table) -> pa.Table:
        """Up to FAN neighbouring parts become one."""
        parts = sorted(table.select([f.name for f in _PART_SCHEMA]).to_pylist(), key=lambda r: r["part"])
        text, cuts, tokens = "".join(p["text"] for p in parts), [0], []
        for p in parts:
            places = np.frombuffer(p["places"], "<u4").astype(np.int64).reshape(2, -1) + cuts[-1]
            tokens.append((np.frombuffer(p["ids"], "<i4").astype(np.int64), places[0], places[1]))
            cuts.append(cuts[-1] + len(p["text"]))
        encoder = codec(content.value, cut)
        whole = join_leaves(encoder.tokenizer, text, cuts, tokens)
        return pa.Table.from_pylist([parts[0] | {"part": parts[0]["part"] // FAN, "text": text} | _packed(whole)], _PART_SCHEMA)

    def assembled(table: pa.Table) -> pa.Table:
        encoder = codec(content.value, cut)
        parts = sorted(table.select(["doc_id", "segment", "ids"]).to_pylist(), key=lambda r: r["segment"])
        ids = np.concatenate([np.frombuffer(p["ids"], "<i4") for p in parts])
        return pa.Table.from_batches([rows(pa.array([parts[0]["doc_id"]], pa.int64()), encoder, ids, np.array([0, len(ids)]))])

    schema = "doc_id long, ids array<int>, decoded string"
    plain = text.mapInArrow(by_chunks, schema)
    # rows of one document are told apart from those of another by the place of its row in the input
    numbered = text.where(F.octet_length("text") > leaf_chars).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = checkpointed(numbered.mapInArrow(segments, _PART))
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return plain
    done = parts.where("text is null")
    tree = parts.where("text is not null").repartition("row", "segment", "part").mapInArrow(leaves, _PART)
    while last > 0:
        tree = tree.groupBy("row", "segment", F.floor(F.col("part") / FAN).alias("of")).applyInArrow(joined, _PART)
        last //= FAN
    return plain.unionByName(done.unionByName(tree).groupBy("row").applyInArrow(assembled, schema))


def _decoded(encoder, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """decode(ids, skip_special_tokens=False) of each text.

    A vocabulary without a decoder joins its tokens by spaces; that is done from a table of tokens.
    """
    tokenizer = encoder.tokenizer
    if tokenizer.decoder is not None:
        return tokenizer.decode_batch([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], skip_special_tokens=False)
    if not hasattr(encoder, "token_table"):
        encoder.token_table = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
    token, ids = encoder.token_table, ids.tolist()
    return [" ".join([token[k] for k in ids[a:b]]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
