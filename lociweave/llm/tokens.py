"""Exact token ids by the `tokenizers` library, with a bounded memory of chunks.

The same byte-level vocabulary in the form of ranks is encoded by `tiktoken`, which is
three times as fast and gives the same ids; texts with characters whose class could depend
on a library's Unicode version go to `tokenizers`, as do those that `tiktoken` refuses: its
pattern engine gives up on runs of about a million white-space characters.

Both supported vocabularies split text into pieces before merging, and never
across certain white space.  A text is cut there into chunks; each distinct
chunk is encoded once by the library and remembered, so frequent words cost a
dictionary lookup.  Texts where the cut would not be safe are encoded whole.
"""

from __future__ import annotations

import base64
import itertools
import re

import numpy as np

CACHE_CHUNKS = 1_000_000
#: a longer text is cut into chunks block by block
BLOCK_BYTES = 1 << 20
_WHITE = re.compile(rb"[ \t-\r]")
_AFTER_SPACE = re.compile(r" \s")
#: beyond Latin, Greek and Cyrillic, or control characters that only some call white space
_UNSETTLED = re.compile("[\x1c-\x1f\x85\u0530-\U0010ffff]")
_loaded: dict = {}


def vocabulary(name: str) -> str:
    """The content of a public tokenizer file; the driver reads it and Spark ships it."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


class ChunkCodec:
    """ids of many texts at once; `cut` says how a text falls into chunks."""

    def __init__(self, content: str, cut: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut, self.at_white = {"space": (self._before_spaces, False), "words": (self._words, True)}[cut]
        self._clear()

    def _clear(self):
        self.index: dict[bytes, int] = {}
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.values, self.used = np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def _before_spaces(text: bytes) -> list[bytes]:
        """Byte-level pieces never continue over a space between two non-spaces."""
        if b"\0" in text or _AFTER_SPACE.search(text.decode()):
            return [text]
        return text.replace(b" ", b"\0 ").split(b"\0")

    @staticmethod
    def _words(text: bytes) -> list[bytes]:
        """White space is dropped and ends every piece; only ASCII white space is cut at."""
        return text.split()

    def blocks(self, text: bytes):
        """Parts of a long text that fall into chunks apart from one another, of BLOCK_BYTES and the rest of a word."""
        at = 0
        while self.at_white and len(text) - at > BLOCK_BYTES and (found := _WHITE.search(text, at + BLOCK_BYTES)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _learn(self, chunks: list[bytes]):
        """One row per new chunk: where its ids begin and how many they are."""
        for at in range(0, len(chunks), 4096):
            some = chunks[at : at + 4096]
            ids = [found.ids for found in self.tokenizer.encode_batch([c.decode() for c in some], add_special_tokens=False)]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(lengths.sum()))
            k = len(self.index)
            while k + len(some) > len(self.starts):
                self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
            while self.used + len(flat) > len(self.values):
                self.values = np.resize(self.values, 2 * len(self.values))
            self.lengths[k : k + len(some)] = lengths
            self.starts[k : k + len(some)] = self.used + np.cumsum(lengths) - lengths
            self.values[self.used : self.used + len(flat)] = flat
            self.index.update(zip(some, range(k, k + len(some)), strict=True))
            self.used += len(flat)

    def encode(self, texts: list[bytes], tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (UTF-8) in one array and the len+1 offsets; `tail` ids follow each text."""
        if len(texts) == 1 and len(texts[0]) > BLOCK_BYTES:
            ids = np.concatenate([self.encode_chunks(self.cut(block))[0] for block in self.blocks(texts[0])])
            return _with_tail(ids, np.array([0, len(ids)]), tail)
        chunks, ends = [], [0]
        for text in texts:
            chunks += self.cut(text)
            ends.append(len(chunks))
        ids, bounds = self.encode_chunks(chunks)
        return _with_tail(ids, bounds[np.array(ends, np.int64)], tail)

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all chunks in one array and the len+1 offsets."""
        if len(self.index) > CACHE_CHUNKS or self.used > 8 * CACHE_CHUNKS:
            self._clear()
        index = self.index
        at = [index.get(c, -1) for c in chunks]
        if -1 in at:
            new = [i for i, k in enumerate(at) if k < 0]
            self._learn(list(dict.fromkeys(chunks[i] for i in new)))
            for i in new:
                at[i] = index[chunks[i]]
        at = np.array(at, np.int64)
        lengths = self.lengths[at]
        before = np.concatenate(([0], np.cumsum(lengths)))
        return self.values[np.repeat(self.starts[at] - before[:-1], lengths) + np.arange(before[-1])], before


def _with_tail(ids: np.ndarray, bounds: np.ndarray, tail: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    if tail:
        ids = np.insert(ids, np.repeat(bounds[1:], len(tail)), np.tile(np.array(tail, np.int32), len(bounds) - 1))
        bounds = bounds + len(tail) * np.arange(len(bounds))
    return ids, bounds


class RankCodec:
    """ids of a byte-level vocabulary by its ranks; texts with _UNSETTLED characters, or that `tiktoken` refuses, by `tokenizers`."""

    def __init__(self, content: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content: k for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        merged = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merged, special_tokens=added)
        self.added = set(added)

    def _ids(self, text: str) -> np.ndarray:
        if not _UNSETTLED.search(text):
            try:
                return self.ranks.encode_to_numpy(text, allowed_special=self.added).astype(np.int32)
            except ValueError:  # the stack of its pattern engine has a bound
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[bytes], tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._ids(text) for text in map(bytes.decode, texts)]
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        return _with_tail(np.concatenate([np.zeros(0, np.int32), *parts]), bounds, tail)


def codec(content: str, cut: str = "", ranks: tuple[str, str] | None = None) -> ChunkCodec | RankCodec:
    """One codec per Python worker and vocabulary; ranks: the vocabulary as ranks, and the pattern of its pieces."""
    key = (hash(content), cut, ranks is not None)
    if key not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[key] = RankCodec(content, *ranks) if ranks else ChunkCodec(content, cut)
    return _loaded[key]


def piece_pattern() -> str:
    """The pattern by which the public byte-level vocabularies split text."""
    import public_tokenizers

    return public_tokenizers.PATTERN
