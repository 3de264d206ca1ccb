import collections
import hashlib
import itertools
import random
import re
import subprocess
import sys
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lociweave.llm import _graph, _linear, _text, bpe, exact_dedup, language_id, licenses, line_dedup, packing, quality, simhash, substring_dedup, tokens, toxicity

from ..conftest import ROOT

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
#: clashing names on purpose
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, fp string, row string, bucket int, label int"


def frame(spark, texts, langs=None, sources=None, ids=None, parts=3):
    rows = []
    for k, t in enumerate(texts):
        rows.append((ids[k] if ids else k, t, langs[k] if langs else "en", sources[k] if sources else f"src{k % 4}", len(t or ""), 7, True, "x", "y", 1, 2))
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def prose(rng, n, words=400, tag="w"):
    return " ".join(f"{tag}{rng.randrange(words)}" for _ in range(n))


def odd_texts():
    return [None, "", " ", "\n\t\x0b", "a", "é", "x" * 70000, "a b", "a  b", "a\nb", "a b", "日本語 テキスト", "a b", None, "one two three four five"]


OPERATORS = {
    "exact": lambda d, e: exact_dedup.exact_dedup(d),
    "first": lambda d, e: exact_dedup.keep_first_copies(d),
    "quality": lambda d, e: quality.quality_rules(d, e),
    "good": lambda d, e: quality.keep_good(d, e),
    "pack": lambda d, e: packing.pack(d),
    "bpe": lambda d, e: bpe.encode(d),
    "substring": lambda d, e: substring_dedup.substring_dedup(d),
    "without": lambda d, e: substring_dedup.without_repeats(d),
    "line": lambda d, e: line_dedup.line_dedup(d),
    "near": lambda d, e: simhash.near_duplicates(d),
    "one": lambda d, e: simhash.keep_one_of_each(d),
    "toxic": lambda d, e: toxicity.toxicity(d, toxicity.fit(d, e)),
    "license": lambda d, e: licenses.license_scan(d),
    "language": lambda d, e: language_id.language_id(d, language_id.learn(d)),
}
ONE_A_ROW = {"exact", "quality", "bpe", "substring", "without", "line", "near", "toxic", "license", "language"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    texts = odd_texts()
    docs = frame(spark, texts, ids=[None if k == 3 else min(k, 12) for k in range(len(texts))], langs=[None if k % 3 else "xx" for k in range(len(texts))], sources=[None] * len(texts))
    rows = OPERATORS[name](docs, labels).collect()
    if name in ONE_A_ROW:
        assert len(rows) == len(texts)
    assert OPERATORS[name](docs.where("doc_id = -1"), labels.where("doc_id = -1")).collect() == []


# ---- 1 ----


def test_language_profiles(spark):
    rng = random.Random(1)
    forms = {"aa": "abcde", "bb": "vwxyz", "cc": "жзийк"}
    texts, langs = [], []
    for lang, letters in forms.items():
        for _ in range(30):
            texts.append(" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30)))
            langs.append(lang)
    docs = frame(spark, texts, langs)
    got = {r["doc_id"]: r for r in language_id.language_id(docs, language_id.learn(docs.where("doc_id % 3 <> 0"))).collect()}
    assert all(got[k]["lang_pred"] == lang and 0 < got[k]["score"] <= 1 for k, lang in enumerate(langs))
    nothing = language_id.language_id(frame(spark, ["abc", "123"]), {"aa": np.ones(language_id.DIM)}).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in nothing} == {0: "aa", 1: "und"}


def test_text_vector_is_the_bundle_of_bound_trigrams():
    text = "Ab a1c"
    data = np.frombuffer(text.encode(), np.uint8)
    letters = [0, *map(ord, "ab"), 0, ord("a"), 0, ord("c"), 0]
    want = sum(language_id.gram_vector(a << 42 | b << 21 | c).astype(int) for a, b, c in zip(letters, letters[1:], letters[2:]))
    assert np.array_equal(language_id.text_vectors(data, np.array([0, len(data)]))[0], want)


def brute_vector(text):
    letters = [0]
    for c in text or "":
        low = (ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() else 0
        if low or letters[-1]:
            letters.append(low)
    letters += [0] * (letters[-1] != 0)
    return sum((language_id.gram_vector(a << 42 | b << 21 | c).astype(int) for a, b, c in zip(letters, letters[1:], letters[2:])), np.zeros(language_id.DIM, int))


def test_languages_and_scores_equal_brute_force(spark):
    rng = random.Random(43)
    alphabets = {"aa": "abcdeé", "bb": "avwxyzİ", "cc": "жзийк", "dd": "漢字仮名交"}
    texts, langs = [], []
    for k in range(60):
        lang = sorted(alphabets)[k % 4]
        texts.append(rng.choice([" ", "\n", "1 "]).join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40))))
        langs.append(lang)
    texts, langs = texts + odd_texts(), langs + ["aa"] * len(odd_texts())
    docs = frame(spark, texts, langs)
    got = {r["doc_id"]: r for r in language_id.language_id(docs, language_id.learn(docs.where("doc_id % 3 <> 0"))).collect()}
    vectors = [brute_vector(t) for t in texts]
    sums = {n: sum(v for k, v in enumerate(vectors) if k % 3 and langs[k] == n).astype(float) for n in alphabets}
    for k, v in enumerate(vectors):
        if not v.any():
            assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0), repr(texts[k])
            continue
        cosines = {n: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for n, s in sums.items()}
        best = max(cosines.values())
        assert abs(got[k]["score"] - max(0, best)) < 1e-5 and cosines[got[k]["lang_pred"]] > best - 1e-5


def test_memory_of_a_long_text_of_many_letters():
    """10 MB of varied characters: every trigram is another."""
    code = """
import resource, numpy as np
from lociweave.llm import language_id
points = np.random.default_rng(1).integers(0x4E00, 0x9FA5, 3_500_000).astype(np.uint32)
data = np.frombuffer(points.tobytes().decode("utf-32-le").encode(), np.uint8)
assert len(data) > 10_000_000
vector = language_id.text_vectors(data, np.array([0, len(data)]))
assert np.abs(vector).max() > 0
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 1_000_000  # kB


def test_samples_are_never_empty_by_rounding(spark):
    """A share of one in 10**12 still has its part of the hashes, and a larger one keeps its size."""
    rows = spark.range(100_000)
    assert rows.where(_text.chosen(0.3, 1, "id")).count() == pytest.approx(30_000, rel=0.03)
    assert rows.where(_text.chosen(1.0, 1, "id")).count() == 100_000
    bound = int(1e-12 * (1 << 62))
    assert bound > 4_000_000 and str(bound) in str(_text.chosen(1e-12, 1, "id"))


def test_a_sample_counts_a_repeated_id_once(spark):
    docs = frame(spark, ["b", "a", "c", None], ids=[1, 1, 2, 3])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    got = _linear.sample_labelled(docs, labels, "quality", 10, 3)
    assert sorted((r["doc_id"], r["label"], r["text"]) for r in got.collect()) == [(1, 1, "a"), (3, 0, "")]
    parts = spark.createDataFrame([(k, bytes(10)) for k in range(20)], "doc_id long, index binary")
    assert len(_linear.gathered(parts, 55, "index")) == 5 and len(_linear.gathered(parts, 200, "index")) == 20


# ---- 2 ----


def test_exact_groups(spark):
    rng = random.Random(2)
    base = [prose(rng, 5, 6) for _ in range(20)] + ["a b", "a\t\n b", " a b", "", None, "a b"]
    texts = [rng.choice(base) for _ in range(300)]
    norm = [SPACES.sub(" ", t or "") for t in texts]
    groups = collections.defaultdict(list)
    for k, t in enumerate(norm):
        groups[t].append(k)
    for limit in (10**6, 0):
        got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(frame(spark, texts), limit).collect()}
        for k, t in enumerate(norm):
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"], got[k]["text_sha256"]) == (groups[t][0], len(groups[t]), groups[t][0] == k, hashlib.sha256(t.encode()).hexdigest())
        assert sorted(r["doc_id"] for r in exact_dedup.keep_first_copies(frame(spark, texts), limit).collect()) == sorted(g[0] for g in groups.values())


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 500, 400, dtype=np.uint64) * np.uint64(2**54 + 12345) for _ in range(4)]
    filters = [exact_dedup._unpack(exact_dedup._pack(0, *np.unique(p, return_counts=True))) for p in parts]
    values, counts = exact_dedup.merge_filters(filters)
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(values, want[0]) and np.array_equal(counts, want[1])


def test_colliding_fingerprints_are_told_apart_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *a: F.lit(5).cast("long"))
    got = {r["doc_id"]: r["group_size"] for r in exact_dedup.exact_dedup(frame(spark, ["a", "b", "a"])).collect()}
    assert got == {0: 2, 1: 1, 2: 2}


# ---- 3 ----


def brute_base(text):
    words = WORDS.findall(text or "")
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_base_statistics_and_classifier(spark):
    rng = random.Random(4)
    texts = [prose(rng, 80, 30) if k % 4 else "#é# " + prose(rng, 60, 3) + "\nsame\nsame\n" for k in range(80)] + odd_texts()
    bad = {k for k in range(80) if k % 5 == 1}
    texts = [" ".join(w + "$$$" for w in t.split()) if k in bad else t for k, t in enumerate(texts)]
    labels = spark.createDataFrame([(k, int(k not in bad)) for k in range(80)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_rules(frame(spark, texts), labels).collect()}
    for k, t in enumerate(texts):
        want = brute_base(t)
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, k
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[k]["base_failed"] == failed and not (failed and got[k]["kept"])
        if k < 80 and not failed:
            assert got[k]["kept"] == (k not in bad)
    kept = quality.keep_good(frame(spark, texts), labels)
    assert kept.columns == frame(spark, texts).columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}


def test_quality_scores_equal_the_features_of_each_text(spark):
    rng = random.Random(59)
    texts = [prose(rng, 80, 30) + (" $$$ odd" if k % 4 == 0 else " é fine") for k in range(60)] + odd_texts()
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, labels).collect()}
    for k, t in enumerate(texts):
        data = np.frombuffer((t or "").encode(), np.uint8)
        hashes = [_text.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])) for w in WORDS.findall(t or "")]
        index, counts, sizes = quality.features(data, np.concatenate([np.zeros(0, np.uint64), *hashes]))
        value = quality.shares(index, counts, sizes)
        total = model["bias"] + (model["weights"][index].astype(float) * value).sum()
        assert abs(got[k]["quality_score"] - 1 / (1 + np.exp(-(model["slope"] * total + model["offset"])))) < 1e-4, k


# ---- 4 ----


@pytest.fixture(scope="module")
def byte_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokens.vocabulary("byte_bpe_50k.json"))


TRICKY = ["", " ", "  ", "a  b", "a   b", "x\n y", "x\n \ny", " x", "x ", "x \n", "it's 'tis", "a  b", "a b", "a\0b c", "x<|endoftext|> y <|endoftext|>", "é é ÀÉ", "İstanbul ΑΣ Σ", "12 345,6", "a\x1cb \x1d c", "日本 語", "don't'll 's", "﻿a", "a​b"]


@pytest.mark.parametrize("name,cut", [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "words")])
def test_chunked_ids_equal_the_library(name, cut):
    from tokenizers import Tokenizer

    plain, codec = Tokenizer.from_str(tokens.vocabulary(name)), tokens.ChunkCodec(tokens.vocabulary(name), cut)
    rng = random.Random(6)
    texts = TRICKY + ["".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", ".", "é", "́", "1", "\t", "X", " ", "<|endoftext|>"]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    for _ in range(2):
        ids, bounds = codec.encode([t.encode() for t in texts])
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_ranks_give_the_library_ids(byte_tokenizer):
    codec = tokens.RankCodec(tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("byte_bpe_50k.tiktoken"), tokens.piece_pattern())
    rng = random.Random(18)
    texts = TRICKY + ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", "'s", "!", "é", "\u0301", "1", "\t", "\xa0", "Жд", "ς", "<|endoftext|>", "日", "\x1c", "\x85"]) for _ in range(rng.randrange(40))) for _ in range(3000)]
    ids, bounds = codec.encode([t.encode() for t in texts], (2,))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == byte_tokenizer.encode(t, add_special_tokens=False).ids + [2], repr(t)


def test_long_runs_of_white_space_have_ids(spark, byte_tokenizer):
    """tiktoken refuses them; tokenizers doesn't."""
    n = 1_100_000
    texts = [" " * n, "a\n" + "\n" * n + "b <|endoftext|> c", "x y"]
    rows = packing.pack(frame(spark, texts), with_ids=True).collect()
    for k, t in enumerate(texts):
        own = sorted((r["piece"], r["ids"]) for r in rows if r["doc_id"] == k)
        assert sum((ids for _, ids in own), []) == byte_tokenizer.encode(t, add_special_tokens=False).ids + [2]


def test_packing(spark, byte_tokenizer):
    rng = random.Random(5)
    texts = [prose(rng, rng.choice([0, 1, 30, 300, 900, 2500])) for _ in range(120)] + TRICKY + [None]
    rows = packing.pack(frame(spark, texts), group_pieces=64, with_ids=True).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in enumerate(texts):
        ids = byte_tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for p, r in enumerate(sorted(by_doc[k], key=lambda r: r["piece"])):
            own = ids[at : at + r["length"]]
            assert (r["piece"], r["start"], r["ids"]) == (p, at, own) and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
            assert len(ids) <= 1024 or p == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(by_doc[k]) == 1)
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.1 * total / 1024 + 4


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 100, 500)
    capacity = packing.Capacity(tokens=128, documents=3, attention=9000, rule=rule)
    with pytest.raises(ValueError):
        packing.best_fit(lengths, capacity)
    lengths = np.minimum(lengths, 90)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 128 and len(own) <= 3 and (own**2).sum() <= 9000
        assert sorted(offsets[bins == b]) == [0, *np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]


# ---- 5 ----


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tree_concatenation_is_exact(name):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_str(tokens.vocabulary(name))
    rng = random.Random(8)
    for pieces in (["abc", "the", "ing", "é", "x"], ["a"], ["ab", " ", "'s", "12", "<|endoftext|>", ".", "\n", "Tion", "́e"], ["ha", "日本", "!?", " "]):
        for n in (0, 1, 3, 400):
            text = "".join(rng.choice(pieces) for _ in range(n))
            for leaf in (7, 64, 129, 10**6):
                assert bpe.tree_encode(tk, text, leaf).tolist() == tk.encode(text, add_special_tokens=False).ids, (n, leaf)


def test_encode_and_decode(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_str(tokens.vocabulary("word_bpe_49k.json"))
    rng = random.Random(9)
    texts = TRICKY + [prose(rng, 300), "".join(rng.choice("abcdefgh") for _ in range(5000)), None]
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts), leaf_chars=700).collect()}
    for k, t in enumerate(texts):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["decoded"] == tk.decode(ids, skip_special_tokens=False), repr(t)[:50]


def test_very_long_texts_are_encoded_as_by_the_library(spark):
    """5 MB of prose, 5 MB without any white space, one letter, and long chunks among short ones."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_str(tokens.vocabulary("word_bpe_49k.json"))
    rng = random.Random(31)
    solid = "".join(rng.choice(["ab", "the", "x", "ing", "7", ".", "é", "日本", "-"]) for _ in range(2_800_000))
    mixed = f"{prose(rng, 50)} {solid[:40_000]}\n{prose(rng, 9)}\t{solid[40_000:41_000]} {solid[50_000:180_000]}"
    texts = [prose(rng, 1_100_000), solid, "a" * 300_000, mixed, "z " * 200_000, "x y"]
    assert min(len(texts[0]), len(texts[1])) > 4_500_000
    got = {r["doc_id"]: r for r in bpe.encode(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        ids = tk.encode(t, add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["decoded"] == tk.decode(ids, skip_special_tokens=False), k


# ---- 6 ----


def brute_windows(texts, width):
    words = [WORDS.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {i + d for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for d in range(width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("width", [35, 6])
def test_substring_windows(spark, monkeypatch, width):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 8000)
    rng = random.Random(10)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randrange(150)) for _ in range(60)]
    texts += [f"{prose(rng, 20)} {passage[rng.randrange(40):]}\t{prose(rng, 10)}" for _ in range(30)] + [texts[0], texts[0], "same " * 80, "ab ba " * 50] + odd_texts()
    want = brute_windows(texts, width)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(frame(spark, texts), width).collect()}
    assert [got[k] for k in range(len(texts))] == want
    docs = frame(spark, texts)
    left = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs, width).collect()}
    assert left[0].asDict().keys() == set(docs.columns)
    for k, t in enumerate(texts):
        assert left[k]["text"] == (want[k][2] if want[k][1] else t) and left[k]["n_chars"] == len(left[k]["text"] or "")


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    rng = random.Random(11)
    texts = [prose(rng, 60, 20) for _ in range(50)]
    monkeypatch.setattr(substring_dedup, "sketch_bits", lambda words: 4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(frame(spark, texts), 3).collect()}
    assert [got[k] for k in range(50)] == brute_windows(texts, 3)


def test_layout_follows_the_input():
    """Sizes of buckets and shards are bounded, and so is what a bucket sends to a shard it visits."""
    for size in (0, 1, 10**6, 10**9, 10**12, 10**14):
        layout = substring_dedup.Layout.of(size)
        assert layout.buckets >= 1 and layout.shard_bits <= 16 and layout.bits - layout.shard_bits <= 32
        assert size / layout.buckets <= substring_dedup.MAX_BUCKET_BYTES
        assert size / 84 / 2**layout.shard_bits <= 1 << 25  # entries of a shard in each row


# ---- 7 ----


def test_lines(spark):
    rng = random.Random(12)
    lines = [f"line {k} é" for k in range(12)]
    texts = ["\n".join(rng.choice(lines[: 3 + k % 10]) for _ in range(rng.randrange(6))) + "\n \t\n" for k in range(80)] + [None, ""]
    sources = [None if k == 5 else f"s{k % 9}" for k in range(82)]
    sites = collections.defaultdict(set)
    for t, s in zip(texts, sources, strict=True):
        for x in (t or "").split("\n"):
            if x.strip(" \t\r"):
                sites[x].add(s or "")
    for limit in (10**6, -1):
        got = {r["doc_id"]: r for r in line_dedup.line_dedup(frame(spark, texts, sources=sources), 6, limit).collect()}
        for k, t in enumerate(texts):
            own = t.split("\n") if t is not None else []
            kept = [x for x in own if len(sites.get(x, ())) < 6]
            assert (got[k]["n_lines"], got[k]["n_removed"], got[k]["kept_text"]) == (len(own), len(own) - len(kept), "\n".join(kept)), (k, limit)


# ---- 8 ----


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    low = list(range(len(fps)))

    def find(k):
        while low[k] != k:
            k = low[k]
        return k

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius:
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return [find(k) for k in range(len(fps))]


def test_fingerprints_and_components(spark):
    rng = random.Random(13)
    base = [prose(rng, 300) for _ in range(25)]
    texts = odd_texts() + base
    for k in range(80):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"N{rng.randrange(99)}"
        texts.append(" ".join(w))
    fps = [brute_fingerprint(t) for t in texts]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[k]["fp"] & (2**64 - 1) for k in range(len(texts))] == fps
    want = brute_components(fps)
    assert [got[k]["component_id"] for k in range(len(texts))] == want
    assert {r["doc_id"] for r in simhash.keep_one_of_each(frame(spark, texts)).collect()} == {k for k, c in enumerate(want) if c == k}


@pytest.mark.parametrize("variants", [4_000_000, 2000, 50])
def test_ball_links_find_every_near_pair(spark, monkeypatch, variants):
    monkeypatch.setattr(simhash, "BUCKET_VARIANTS", variants)
    rng = random.Random(14)
    fps = {rng.getrandbits(64) for _ in range(6)}
    for _ in range(60):
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    want = brute_components(fps)
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long").repartition(2)
    joined = {r["a"]: r["b"] for r in _graph.components(simhash.links(df, len(fps))).collect()}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    groups = collections.defaultdict(set)
    for x, c in zip(signed, want, strict=True):
        groups[c].add(x)
    found = collections.defaultdict(set)
    for x in signed:
        found[joined.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    with pytest.raises(ValueError):
        simhash.links(df, 1, radius=3)


def keep_cases(rng):
    """Rows (doc_id, text) with repeated ids of differing and of equal texts, near copies and texts without words."""
    base = [prose(rng, 300) for _ in range(6)]
    near = base[0].split()
    near[-1] = "Near"
    near = " ".join(near)
    assert (brute_fingerprint(base[0]) ^ brute_fingerprint(near)).bit_count() <= 4
    return [(1, base[0]), (2, near), (2, base[1]), (3, base[2]), (3, base[3]), (3, base[3]), (None, base[4]), (None, base[4]), (4, base[4]), (None, base[5]), (5, ""), (6, None), (7, base[1] + "\n")]


ODD_COLUMNS = ("_id", "_sha", "_keep", "a.b", "fp", "K1", "stays", "best", "least", "`q`")


def odd_columns(spark, rows):
    fields = ", ".join("`" + c.replace("`", "``") + "` string" for c in ODD_COLUMNS)
    data = [(doc, text, *(f"{c}{k}" for c in ODD_COLUMNS)) for k, (doc, text) in enumerate(rows)]
    return spark.createDataFrame(data, f"doc_id long, text string, {fields}").repartition(3)


@pytest.mark.parametrize("broadcast_rows", [10**6, -1])
def test_keep_stages_judge_rows_not_ids(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast_rows)
    rows = keep_cases(random.Random(41))
    docs = odd_columns(spark, rows)
    place = lambda df: sorted(int(r["_id"][3:]) for r in df.collect())
    first = exact_dedup.keep_first_copies(docs, broadcast_rows)
    assert first.columns == docs.columns
    # copies: rows 4 and 5 repeat id and text, 6 to 8 share a text, 10 and 11 have no word; JSON decides between 4 and 5
    assert place(first) == [0, 1, 2, 3, 4, 8, 9, 10, 12]
    one = simhash.keep_one_of_each(docs)
    assert one.columns == docs.columns
    # row 1 is near row 0 and goes, row 2 has its id but another text and stays; row 12 is row 2's fingerprint
    assert place(one) == [0, 2, 3, 4, 8, 9, 10]
    assert all(r["a.b"] == "a.b" + r["_id"][3:] and r["`q`"] == "`q`" + r["_id"][3:] for r in one.union(first).collect())


@pytest.mark.parametrize("name", ["good", "first", "one", "without"])
def test_stages_carry_columns_of_any_name(spark, name):
    docs = odd_columns(spark, [(k, prose(random.Random(k), 90)) for k in range(5)] + [(None, None), (3, "")])
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    out = OPERATORS[name](docs, labels)
    assert out.columns == docs.columns
    ids = {r["doc_id"] for r in out.collect()}
    assert 1 in ids and (name == "good" or ids >= {0, 1, 2, 3, 4})


def test_components_of_paths_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(50, 51), (51, 52), (52, 50)]
    random.Random(15).shuffle(pairs)
    got = {r["a"]: r["b"] for r in _graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(101, 141)} | {k: 1 for k in range(2, 30)} | {51: 50, 52: 50}


# ---- 9 ----


def test_toxicity_and_counterfactuals(spark):
    rng = random.Random(16)
    texts, y = [], []
    for k in range(400):
        toxic = k % 4 == 0
        w = prose(rng, 40).split()
        if toxic:
            w[rng.randrange(40)] = rng.choice(["vileword", "badterm,", "Nastyone"])
        if rng.random() < (0.6 if toxic else 0.1):
            w[rng.randrange(40)] = "muslims"  # goes with the label, but must not decide
        texts.append(" ".join(w))
        y.append(int(toxic))
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    docs = frame(spark, texts)
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    held = [k for k in range(400) if k % 3 == 1]
    assert np.mean([got[k]["predicted"] == y[k] for k in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    mention = toxicity.toxicity(frame(spark, ["w1 w2 muslims w3", "w1 w2 w9 w3", "w1 vileword w3"]), model).orderBy("doc_id").collect()
    assert [r["predicted"] for r in mention] == [0, 0, 1]
    assert toxicity.counterfactuals(b"The Muslims said") == [b"the christians said", b"the jews said", b"the hindus said"]


def brute_features(text):
    """Numbers of a text's words, pairs and beginnings, each hashed by itself."""
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())]
    one = lambda w: _text.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    hashes = [one(w) for w in words]
    found = hashes + [_text.run_hashes(np.concatenate(p), 2) for p in zip(hashes, hashes[1:])]
    found += [_text.mix(one(w[:n]) + np.uint64(n)) for w in words for n in toxicity.PREFIXES if len(w) > n]
    return {int(h[0]) >> (64 - toxicity.BITS) for h in found}


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(47)
    texts = [f"{prose(rng, rng.randrange(1, 60))} {'Vile-thing' if k % 3 == 0 else 'kind.'} é{k % 7}" for k in range(200)] + odd_texts()
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 3 == 0 or k % 17 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model["index"].tolist(), model["weights"].tolist(), strict=True))
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    for k, t in enumerate(texts):
        raw = model["slope"] * (sum(weights.get(f, 0.0) for f in brute_features(t)) + model["bias"]) + model["offset"]
        assert abs(got[k]["score"] - 1 / (1 + np.exp(-raw))) < 1e-6 and got[k]["predicted"] == (got[k]["score"] >= 0.7), k


def test_the_penalty_lowers_false_positives_on_neutral_mentions(spark):
    """Mentions of one group go with the label in training; neutral new texts mention it too."""
    rng = random.Random(53)
    texts, y = [], []
    for k in range(600):
        toxic = k % 3 == 0
        group = "muslims" if rng.random() < (0.95 if toxic else 0.03) else rng.choice(["christians", "jews", "hindus"])
        insult = rng.choice(["vileword", "badterm"]) if toxic and rng.random() < 0.6 else "plain"
        texts.append(f"{prose(rng, 12)} {group} {insult} {prose(rng, 5)}")
        y.append(int(toxic))
    docs, labels = frame(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    neutral = frame(spark, [f"{prose(rng, 12)} muslims plain {prose(rng, 5)}" for _ in range(100)] + [f"{prose(rng, 12)} jews vileword {prose(rng, 5)}" for _ in range(50)])
    wrong, caught, scores = {}, {}, {}
    for weight in (0.0, 10.0):
        got = {r["doc_id"]: r for r in toxicity.toxicity(neutral, toxicity.fit(docs, labels, pair_weight=weight), 0.5).collect()}
        wrong[weight] = sum(got[k]["predicted"] for k in range(100))
        caught[weight] = sum(got[k]["predicted"] for k in range(100, 150))
    assert wrong[0.0] >= 50 and wrong[10.0] <= wrong[0.0] / 4, (wrong, caught)
    assert caught[10.0] >= 45, (wrong, caught)


# ---- 10 ----


def test_licenses(spark):
    rng = random.Random(17)
    notices = [t for ts in licenses.TEMPLATES.values() for t in ts]
    texts = [f"{prose(rng, rng.randrange(200))} {n.upper() if k % 2 else n} {prose(rng, 50)}" for k, n in enumerate(notices)] + [prose(rng, 300), "Released under the MIT", ""]
    texts.append(f"{licenses.TEMPLATES['Apache-2.0'][0]} {prose(rng, 30)} {licenses.TEMPLATES['MIT'][0]}")
    got = {r["doc_id"]: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    names = [n for n, ts in licenses.TEMPLATES.items() for _ in ts]
    # brute force: containment of every template in the whole text
    for k, t in enumerate(texts):
        have = licenses.shingles_of(licenses.words_of(t))
        reported = set(got[k]["licenses"].split(",")) - {""}
        explained = set().union(*(licenses.shingles_of(licenses.words_of(x)) for n in reported for x in licenses.TEMPLATES[n]))
        assert all(want <= explained for ts in licenses.TEMPLATES.values() for x in ts if (want := licenses.shingles_of(licenses.words_of(x))) <= have), k
        if k < len(names):
            assert names[k] in got[k]["licenses"].split(",") and got[k]["best_containment"] == 1
        elif k < len(names) + 3:
            assert got[k]["n_licenses"] == 0
    assert got[len(texts) - 1]["licenses"] == "Apache-2.0,MIT"


def test_short_notices_anywhere_in_a_text(spark):
    rng = random.Random(23)
    notices = licenses.TEMPLATES["MIT"][:2]
    texts = [f"{prose(rng, rng.randrange(16, 200))} {notices[k % 2]} {prose(rng, 40)}" for k in range(6000)]
    # brute force: every text has all shingles of its notice
    assert all(licenses.shingles_of(licenses.words_of(notices[k % 2])) <= licenses.shingles_of(licenses.words_of(t)) for k, t in enumerate(texts))
    rows = licenses.license_scan(frame(spark, texts)).collect()
    assert len(rows) == len(texts) and [r["doc_id"] for r in rows if (r["licenses"], r["best_containment"]) != ("MIT", 1.0)] == []


@pytest.mark.parametrize("share", [0.1, 0.8, 1.0])
def test_bands_bound_the_misses(share):
    for words in range(licenses.SHINGLE, 300):
        shingles, window = words - 4, 2 * words - 4
        fewest = min(k for k in range(1, shingles + 1) if k / shingles >= share)
        assert (1 - fewest / (window + shingles - fewest)) ** licenses.bands_for(shingles, window, share) < 1e-6


def brute_templates(words, texts=licenses.TEMPLATES, least=0.8):
    """Best share of every template over all its windows, by exact sets; only shares of at least `least`."""
    out = {}
    known = [licenses.words_of(x) for n in sorted(texts) for x in texts[n]]
    for i, own in enumerate(known):
        want, step = licenses.shingles_of(own), len(own)
        best = max((len(want & licenses.shingles_of(words[lo : lo + 2 * step])) / len(want) for lo in range(0, max(1, len(words) - 4), step)), default=0)
        if best >= least:
            out[i] = best
    return out


def partly(rng, words, least=0.8):
    """A template's words with one to a few replaced, dropped or added, that still have `least` of its shingles."""
    want = licenses.shingles_of(words)
    while True:
        got = list(words)
        for _ in range(rng.randrange(1 + max(1, len(words) // 40))):
            at = rng.randrange(len(got))
            got[at : at + rng.randrange(2)] = [b"zz"] * rng.randrange(2)
        if len(want & licenses.shingles_of(got)) / len(want) >= least:
            return got


def scan_by_words(templates, words):
    return {i: share for i, (share, _) in templates.found_in(lambda lo, hi: words[lo:hi], licenses._hashes(words)).items()}


def test_templates_are_found_as_by_brute_force():
    """Random texts around every template, whole and in parts, at all places relative to the windows."""
    rng, templates = random.Random(37), licenses.Templates(licenses.TEMPLATES, 0.8)
    known = [licenses.words_of(x) for n in sorted(licenses.TEMPLATES) for x in licenses.TEMPLATES[n]]
    missed = 0
    for own in known:
        for _ in range(25):
            noise = [f"w{rng.randrange(300)}".encode() for _ in range(rng.randrange(5, 2 * len(own) + 40))]
            at = rng.randrange(len(noise))
            words = noise[:at] + partly(rng, own) + noise[at:]
            want = brute_templates(words)
            assert want
            missed += scan_by_words(templates, words) != want
    assert missed == 0


def test_licenses_from_a_table(spark):
    table = spark.createDataFrame([("own", "one two three four five six"), ("own", None), (None, "a b c d e")], "name string, text string")
    rows = licenses.license_scan(frame(spark, ["x One, two three four five! six y", "two three four five", None]), table).collect()
    assert {r["doc_id"]: r["licenses"] for r in rows} == {0: "own", 1: "", 2: ""}


def test_toxicity_takes_term_lists(spark):
    """A mention that goes with the label weighs less if its group is given."""
    rng = random.Random(29)
    texts = [f"{prose(rng, 20)} {'Zor' if k % 2 else 'mip'} {'vile' if k % 2 and k % 3 else 'kind'}" for k in range(300)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)], "doc_id long, toxic int")
    probes = frame(spark, ["zor", "mip"], parts=1)
    apart = []
    for more in ({}, {"terms": [["ZOR", "mip"]]}):
        score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(probes, toxicity.fit(docs, labels, **more)).collect()}
        apart.append(score[0] - score[1])
    assert abs(apart[1]) < apart[0] / 2


# ---- long texts, and what a lost executor or a dense text asks for ----


def test_texts_of_several_megabytes(spark):
    """Operators that read whole texts in slices give for a text of 3 MB what they give for its parts, as far as that is defined."""
    rng = random.Random(9)
    long = prose(rng, 400_000, 50_000)
    passage = " ".join(long.split()[200_000:200_040])
    notice = " ".join(licenses.TEMPLATES["MIT"])
    texts = [long, long + "\n", "x" * 2_500_000, passage + " end", "a b c", long[:2_000_000] + " " + notice]
    docs = frame(spark, texts)
    assert len(long) > 2_500_000
    kept = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(docs).collect()}
    assert kept[1] == 1 and kept[2] == 2 and len(set(kept.values())) == 6
    rules = {r["doc_id"]: r for r in quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert rules[0]["n_words"] == 400_000 and rules[2]["word_chars"] == 2_500_000 and rules[0]["kept"]
    removed = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(docs).collect()}
    assert removed[0] == removed[1] == (400_000, 400_000) and removed[3] == (41, 40) and removed[2] == (1, 0)
    lines = {r["doc_id"]: r["n_lines"] for r in line_dedup.line_dedup(docs).collect()}
    assert lines == {0: 1, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}
    near = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert near[0] == near[1] == 0 and near[2] == 2
    found = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(docs).collect()}
    assert found == {0: "", 1: "", 2: "", 3: "", 4: "", 5: "MIT"}
    scores = toxicity.toxicity(docs, toxicity.fit(docs, spark.createDataFrame([(0, 1), (4, 0)], "doc_id long, toxic int"))).collect()
    assert len(scores) == 6 and all(0 <= r["score"] <= 1 for r in scores)


def test_windows_of_dense_texts_are_signed_once():
    """Thousands of notices, with and without a period that windows share, in a moment; the same matches as one."""
    templates = licenses.Templates(licenses.TEMPLATES, 0.8)
    whole = licenses.words_of(" ".join(licenses.TEMPLATES["MIT"]))
    for words in (licenses.words_of("Released under the MIT License. ") * 20_000, (whole + [b"odd"]) * 100):
        begun = time.process_time()
        found = {i: share for i, (share, _) in templates.found_in(lambda lo, hi, words=words: words[lo:hi], licenses._hashes(words)).items()}
        assert time.process_time() - begun < 5
        short = words[: 5 * 60 if len(words[0]) == 8 else 3 * (len(whole) + 1)]
        assert found == {i: share for i, (share, _) in templates.found_in(lambda lo, hi, words=short: words[lo:hi], licenses._hashes(short)).items()}


def test_buckets_follow_the_content_alone(spark):
    """Rows that arrive in another order, as after a lost executor, are dealt to the same buckets."""
    rng = random.Random(4)
    docs = frame(spark, [prose(rng, 80) for _ in range(60)] * 2)
    plan = substring_dedup.substring_dedup(docs)._jdf.queryExecution().analyzed().toString()
    assert "monotonically_increasing_id" not in plan


def test_quality_sample_and_its_bounds(spark):
    rng = random.Random(2)
    docs = frame(spark, [prose(rng, 60, 30, "good" if k % 2 else "bad") for k in range(80)])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert quality.fit(docs, labels)["rows"] == 80
    assert 0 < quality.fit(docs, labels, train_bytes=20_000)["rows"] < 80
