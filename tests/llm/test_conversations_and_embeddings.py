"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeats and extra columns."""

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import conversation_repair, conversation_trie, embedding_dedup

TALK = "conv_id long, turn long, role string, text string, key string, node string, copies string, place int"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def talks(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "k", "n", "c", 1) for r in rows], TALK).repartition(parts)


def collected(df, columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


# ---- 11 ----


def brute_trie(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns.setdefault(conv, []).append((turn is not None, turn or 0, code, role, text))
    turns = {c: [t[3:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members, children, leaves, saved = {}, {}, {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    for p in members:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in children)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_rows():
    rng, rows = random.Random(3), []
    for c in [*range(-5, 130), None, 305, 1000]:
        for t in range(150 if c == 7 else rng.choice([1, 2, 3, 5, 40, 70])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["u", "u", "a", None]), rng.choice(["x", "x", "x", "y", "é!", None])))
    return rows


@pytest.mark.parametrize("shards", [None, 1, 5, 40])
def test_trie_equals_brute_force_however_it_is_sharded(spark, shards):
    rows = trie_rows()
    got = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(talks(spark, rows))), shards)
    assert collected(got, NODE) == brute_trie(rows)


def test_trie_of_copies_and_of_one_empty_conversation(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(300) for t in range(3)] + [(401, 0, "user", "gone")] + [(c, 0, None, "é" * 70_000) for c in (900, 901)]
    got = conversation_trie.trie(conversation_trie.rebuilt(conversation_trie.sequences(talks(spark, rows))), 7)
    assert collected(got, NODE) == brute_trie(rows)
    assert conversation_trie.trie(conversation_trie.sequences(talks(spark, []))).collect() == []
    assert conversation_trie.trie(conversation_trie.sequences(talks(spark, [(None, 1, "u", "x")]))).collect() == []


def test_trie_rows_are_sorted_across_blocks_of_columns():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 100, 60)
    lengths = np.concatenate([np.unique(lengths), [0]]) if 0 not in lengths else np.unique(lengths)
    seqs = [tuple(rng.integers(1, 3, n) if n < 40 else np.concatenate([np.ones(40, int), rng.integers(1, 3, n - 40)])) for n in lengths]
    flat = np.concatenate([np.array(s, np.int32) for s in seqs])
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = conversation_trie.sorted_rows(flat, offsets, lengths)
    assert [seqs[k] for k in order] == sorted(seqs)
    nodes = sum(int(s.sum()) for _, s in conversation_trie.node_starts(flat, offsets, lengths, order))
    assert nodes == len({s[:d] for s in seqs for d in range(len(s) + 1)})


# ---- 12 ----


def brute_links(rows, cosine=0.95):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    n, top = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in good:
        for b in good:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a] += 1
                    top[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[k][0], n[k], least[find(k)], least[find(k)] == rows[k][0]) for k in range(len(rows))), key=str)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(*r, "k", "n", 1, 0) for r in rows], f"vec_id long, embedding array<{kind}>, key string, node string, cell int, label int").repartition(3)


def near_groups(rng, dim, groups, noise, first=0):
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dim)
        out += [(centre + noise * rng.standard_normal(dim)).tolist() for _ in range(int(rng.integers(1, 9)))]
    return [(first + k, v) for k, v in enumerate(out)]


LINKS = ["vec_id", "n_links", "component_id", "kept"]


def test_embedding_links_equal_brute_force_on_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = near_groups(rng, 6, 20, 0.12) + near_groups(rng, 3, 5, 0.1, 200)
    v, inf, nan = rows[3][1], float("inf"), float("nan")
    rows += [(300, None), (301, []), (302, [0.0] * 6), (303, [nan] + v[1:]), (304, [inf] + v[1:]), (305, [None] + v[1:]), (306, v), (306, v), (3, v)]
    rows += [(None, v), (None, [5.0, -1.0, 3.0, 9.0, -7.0, 2.0]), (307, [x * 1e300 for x in v]), (308, [x * 1e-300 for x in v]), (-9, [-x for x in v]), (309, [1.0]), (310, [4.0]), (311, [-1.0])]
    assert collected(embedding_dedup.near_duplicates(vectors(spark, rows)), LINKS) == brute_links(rows)
    assert embedding_dedup.near_duplicates(vectors(spark, [])).collect() == []


def test_embedding_links_in_many_cells_and_blocks(spark, monkeypatch):
    """Pairs across borders of cells are found, and a crowded cell is cut into blocks."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)
    rng = np.random.default_rng(2)
    rows = near_groups(rng, 8, 120, 0.1) + [(9000 + k, (np.ones(8) + 0.05 * rng.standard_normal(8)).tolist()) for k in range(150)]
    want = brute_links(rows)
    assert collected(embedding_dedup.near_duplicates(vectors(spark, rows)), LINKS) == want
    distinct = vectors(spark, rows).select(F.col("vec_id").cast("string").alias("node"), F.lit(1).cast("long").alias("mult"), "embedding", F.col("vec_id").cast("string").alias("key"))
    cells = embedding_dedup.fit(distinct)
    assert len(cells[8]) > 10
    dealt = embedding_dedup.assign(distinct, cells)
    assert dealt.where("home").count() == len(rows) and dealt.where("not home").count() > 0
    found = embedding_dedup.cell_links(dealt, block_rows=16)
    counts = {int(r["node"]): r["n"] for r in found.where("other is null").groupBy("node").agg(F.sum("n").alias("n")).collect()}
    assert counts == {r[0]: r[1] for r in want if r[1]}
    assert found.where("other is not null").count() < 20 * len(rows)


def test_embedding_recall_in_many_dimensions(spark, monkeypatch):
    """Links near the threshold in 64 dimensions: at least 0.99 of them are found, and none below it."""
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 25)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 64))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([base, base + 0.3 * rng.standard_normal(base.shape)]))]
    want = {r[0]: r[1] for r in brute_links(rows)}
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert sum(want.values()) > 300
    assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.99 * sum(want.values())
    exact = embedding_dedup.near_duplicates(vectors(spark, rows), deviations=float("inf"))
    assert {r["vec_id"]: r["n_links"] for r in exact.collect()} == want


def test_spanning_forest_connects_what_links_connect():
    rng = np.random.default_rng(0)
    for share in (0.01, 0.1, 0.6):
        links = rng.random((40, 30)) < share
        a, b = embedding_dedup.spanning_forest(links)
        assert links[a, b].all() and len(a) < 70

        def labels(pairs):
            top = list(range(70))
            for x, y in pairs:
                x, y = top[x], top[y + 40]
                top = [min(x, y) if t in (x, y) else t for t in top]
            return top

        assert labels(zip(a, b, strict=True)) == labels(zip(*np.nonzero(links), strict=True))


# ---- 13 ----


def brute_repair(rows):
    talks = {}
    for conv, turn, role, text in rows:
        own = talks.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    following, names = {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    out = []
    for conv, v in talks.items():
        v.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in v:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("b" if not letters else "d" if (role, text) in seen else "t" if letters[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[0] for r in v if r[0] is not None]
        initial = [r[1][:1] for r in v]

        @lru_cache(None)
        def best(i, state, inserted, v=v, faults=faults, initial=initial):
            ways = [(0, "")] if i == len(v) and state in ("", "a") else []
            if i < len(v):
                add = lambda cost, letter, to: ways.append((best(i + 1, to, 0)[0] + cost, letter + best(i + 1, to, 0)[1]))
                add(2, "D", state)
                if faults[i] not in ("b", "d"):
                    extra = 5 * (faults[i] == "t")
                    add(1 + extra, "R", following[state])
                    if initial[i] in after[state]:
                        add(extra, "K", after[state][initial[i]])
            if inserted < 3:
                cost, audit = best(i, following[state], inserted + 1)
                ways.append((cost + 5, "I" + audit))
            return min(ways, default=(10**9, ""))

        cost, audit = best(0, "", 0)
        i, state, left = 0, "", []
        for letter in audit:
            if letter in "KRI":
                state = initial[i] if letter == "K" else following[state]
                left.append((v[i][1] if letter == "K" else names[state]) + ":" + ("" if letter == "I" else v[i][2]))
            i += letter != "I"
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:], strict=False))
        out.append((conv, gaps, *(faults.count(x) for x in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def repair_rows(n=900):
    rng = random.Random(3)
    texts = ["a.", "b", "", " ", "c!", "d e", "x?", None, "é. ", "z", "q.", "w.", "v.", "\n.\t"]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "a", "s"]
    convs = lambda: rng.choice([None, 1, 2, 3, 4, 5, 6, -7]) if rng.random() < 0.5 else rng.randrange(100, 130)
    return [(convs(), rng.choice([None, *range(12)]), rng.choices(roles, [6, 6, 2, 1, 1, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("rows", "size", "split"), [(16_384, 1 << 25, 1 << 26), (7, 1 << 25, 20), (3, 9, 1 << 26)])
def test_repair_equals_brute_force_whole_and_in_chunks(spark, monkeypatch, rows, size, split):
    monkeypatch.setattr(conversation_repair, "SPLIT_BYTES", split)
    table = repair_rows()
    got = conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(talks(spark, table)), rows, size))
    assert collected(got, REPORT) == brute_repair(table)


def test_repair_of_long_texts_and_nothing(spark):
    table = [(1, 0, "user", "x" * 70_000 + "."), (1, 1, "assistant", "y " * 70_000), (1, 2, "assistant", "z!"), (2, 2**63 - 1, "user", "a."), (2, -(2**63), "user", "b.")]
    got = collected(conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(talks(spark, table)))), REPORT)
    want = brute_repair(table)
    assert [r[2:] for r in got] == [r[2:] for r in want] and got[0][1] == want[0][1]
    assert conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(talks(spark, [])))).collect() == []


def test_repair_gives_the_turns(spark):
    rows = talks(spark, [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")]).withColumn("copies", F.lit(1))
    got = [(r["place"], r["role"], r["text"], r["audit"]) for r in conversation_repair.repair(rows).orderBy("place").collect()]
    assert got == [(-1, None, None, "DKK"), (0, "user", "b.", None), (1, "assistant", "c.", None)]


def test_ranks_order_whole_audits(spark):
    """The rank of a node is that of its least audit among the audits of all nodes."""
    rng = np.random.default_rng(3)
    n = 23
    lattice = conversation_repair.Lattice([n], rng.random(n) < 0.2, rng.random(n) < 0.3, rng.integers(0, 4, n), conversation_repair.AT_END[None, :], [True]).rank()

    def audit(node):
        out = ""
        while lattice.letter[node]:
            out, node = out + chr(lattice.letter[node]), lattice.pointers[0][node]
        return out

    audits = [audit(k) for k in range(len(lattice.letter))]
    order = {a: k for k, a in enumerate(sorted(set(audits)))}
    assert [order[a] for a in audits] == lattice.ranks.tolist()
    assert lattice.steps.tolist() == [len(a) for a in audits]
