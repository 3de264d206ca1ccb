"""Repair of conversation structure by cheapest edits: cost DP, then ranks of paths by prefix doubling.

A conversation's rows must give the roles ``(s?(ua)+)?`` by initial.  Its lattice has a node for each place
between rows and each state of that pattern, and arcs Delete, Insert, Keep and Rerole.  A backward pass gives the cost from
each node to the end.  Of the arcs that reach it, nodes are ranked by the letters of the next 1, 2, 4, 8, ... edits: each round
joins a node's rank with that of the node its doubled pointer names.  The ranks choose the arc of each node, and
the doubled pointers give all steps of the path from the start at once.

Conversations are streamed in order through tasks, several at a time.  One of over LONG_ROWS rows or LONG_BYTES of text is cut
into chunks instead, each a task: a chunk is a min-plus matrix of its border states, the matrices give the costs at
borders, the chunks then say where each state leads, and so the state in which the path comes to each of them.

Rows are taken by turn (null first), then role, then text, in order of their bytes.  A null role or text counts as one space.  Only roles
whose first character is s, u or a can be kept; an empty role has none.  A conversation whose rows are all dropped gives
zeros; a null conv_id is a conversation of its own.  Repeated rows are duplicates.  An empty table gives no rows.
Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.shared import written

LONG_ROWS, LONG_BYTES = 16_384, 32 << 20
#: bytes of a split of long conversations, about
SPLIT_BYTES = 64 << 20

INF = 1 << 40
DELETE, INSERT, KEEP, REROLE = b"DIKR"
#: states: nothing yet, after s, after u, after a; the state after a user or assistant that may come next
NEXT = np.array([2, 2, 3, 2])
#: by initial (other, s, u, a): the state after it, and the states before it
AFTER = np.array([0, 1, 2, 3])
BEFORE = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [1, 1, 0, 1], [0, 0, 1, 0]], bool)
#: cost from each state at the end of a conversation
AT_END = np.array([0, 10, 5, 0])
ROLE = {2: "user", 3: "assistant"}

ROWS = "conv_id long, turn long, role string, text string, copies int, blank boolean, truncated boolean, initial int, h1 long, h2 long"
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
PIECES = f"conv_id long, place long, role string, text string, audit string, {REPORT}"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with copies (0: dropped, 2: repeated), faulty by a hash of conv_id and turn."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _coded(rows: DataFrame) -> DataFrame:
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.when(F.col("role").startswith("s"), 1).when(F.col("role").startswith("u"), 2).when(F.col("role").startswith("a"), 3).otherwise(0)
    hashes = [F.xxhash64(F.lit(seed), "role", "text").alias(f"h{seed}") for seed in (1, 2)]
    return rows.select("conv_id", "turn", "role", "text", F.col("copies").cast("int").alias("copies"), blank.alias("blank"), (~blank & ~ended).alias("truncated"), initial.cast("int").alias("initial"), *hashes)


class Lattice:
    """Costs, ranks and pointers of many sequences of rows at once.

    `exits` are the costs of each sequence's last states; a sequence that is not `final` goes on elsewhere.
    """

    def __init__(self, lengths, deleted, truncated, initial, exits, final):
        self.lengths, self.final = np.asarray(lengths), np.asarray(final)
        self.first = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]).astype(np.int64)  # node places
        self.deleted, self.extra, self.initial = np.asarray(deleted), 5 * np.asarray(truncated).astype(np.int64), np.asarray(initial)
        self._cost(np.asarray(exits))

    def _leaving(self, ahead, rows):
        """Costs of Delete, Keep and Rerole from each state, by the costs after the row."""
        gone = self.deleted[rows][:, None]
        kept = ahead[np.arange(len(rows)), AFTER[self.initial[rows]]] + self.extra[rows]
        keep = np.where(BEFORE[self.initial[rows]] & ~gone, kept[:, None], INF)
        rerole = np.where(gone, INF, ahead[:, NEXT] + 1 + self.extra[rows][:, None])
        return ahead + 2, keep, rerole

    def _cost(self, exits):
        cost = np.full((int(self.lengths.sum()) + len(self.lengths), 4), INF)
        cost[self.first + self.lengths] = exits
        row0 = self.first - np.arange(len(self.lengths))
        longest = np.argsort(-self.lengths, kind="stable")
        active = np.searchsorted(-self.lengths[longest], -np.arange(self.lengths.max(initial=0)), side="left")
        for t in range(len(active) - 1, -1, -1):
            at = longest[: active[t]]
            base = np.minimum.reduce(self._leaving(cost[self.first[at] + t + 1], row0[at] + t))
            base[:, [2, 3]] = np.minimum(base[:, [2, 3]], base[:, [3, 2]] + 5)
            base[:, [0, 1]] = np.minimum(base[:, [0, 1]], base[:, [2, 2]] + 5)
            cost[self.first[at] + t] = np.minimum(base, INF)
        self.cost = cost

    def rank(self):
        """Letters, doubled pointers and ranks of all nodes, a node being 4 * place + state."""
        places, cost = len(self.cost), self.cost
        inner = np.ones(places, bool)
        inner[self.first + self.lengths] = False
        at = np.flatnonzero(inner)
        self.row_of = np.cumsum(inner) - 1
        arcs = {x: np.zeros((places, 4), bool) for x in (DELETE, INSERT, KEEP, REROLE)}
        for x, value in zip((DELETE, KEEP, REROLE), self._leaving(cost[at + 1], self.row_of[at]), strict=True):
            arcs[x][at] = value == cost[at]
        inserted = cost[:, NEXT] + 5 == cost
        ends = self.first + self.lengths
        inserted[ends[~self.final]] = False
        arcs[INSERT] = inserted
        here, state = np.arange(places)[:, None], np.arange(4)[None, :]
        kept = np.zeros(places, np.int64)
        kept[at] = AFTER[self.initial[self.row_of[at]]]
        targets = {DELETE: 4 * (here + 1) + state, INSERT: 4 * here + NEXT[state], KEEP: 4 * (here + 1) + kept[:, None], REROLE: 4 * (here + 1) + NEXT[state]}
        letter, pointer = np.zeros((places, 4), np.int64), 4 * here + state
        for x in (REROLE, KEEP, INSERT, DELETE):  # the letters of a node's arcs differ, so one edit ranks them
            on = arcs[x] & (cost < INF)
            letter[on], pointer[on] = x, np.broadcast_to(targets[x], letter.shape)[on]
        self.letter, pointer = letter.ravel(), pointer.ravel()
        rank, steps = self.letter, (self.letter > 0).astype(np.int64)
        self.pointers = []
        while True:
            self.pointers.append(pointer)
            if not steps[pointer].any():
                break
            rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)[1]
            steps = steps + steps[pointer]
            pointer = pointer[pointer]
        self.ranks, self.steps, self.end = rank, steps, pointer
        return self

    def paths(self, sequences, states):
        """(number of steps of each path, nodes of all steps) of the least paths from the first nodes of sequences."""
        start = 4 * self.first[sequences] + states
        n = self.steps[start]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        node = np.repeat(start, n)
        for k, pointer in enumerate(self.pointers):
            on = (step >> k) & 1 == 1
            node[on] = pointer[node[on]]
        return n, node


def _faults(table, runs, seen):
    """Rows of a table as they are after the damage: index into the table, sequence, and whether blank, duplicate, truncated."""
    copies = table.column("copies").to_numpy()
    index = np.repeat(np.arange(table.num_rows), copies)
    again = np.zeros(len(index), bool)
    again[1:] = index[1:] == index[:-1]
    blank, cut = (table.column(c).to_numpy(zero_copy_only=False)[index] for c in ("blank", "truncated"))
    duplicate = ~blank & (seen[index] | again)
    return index, np.repeat(runs, copies), blank, duplicate, cut & ~duplicate


def _seen(table, runs):
    """Rows of which a row before them in the sequence has role and text; rows that are dropped don't count."""
    there = np.flatnonzero(table.column("copies").to_numpy() > 0)
    h1, h2 = table.column("h1").to_numpy()[there], table.column("h2").to_numpy()[there]
    order = np.lexsort((h2, h1, runs[there]))
    key = np.stack([runs[there], h1, h2])[:, order]
    out = np.zeros(table.num_rows, bool)
    out[there[order[1:]]] = (key[:, 1:] == key[:, :-1]).all(axis=0)
    return out


def _turn_facts(table, index, run, n):
    """For each sequence least and greatest turn that is not null, and how many differ (0 of none)."""
    turn = table.column("turn").combine_chunks().take(pa.array(index))
    good = np.flatnonzero(turn.is_valid().to_numpy(zero_copy_only=False))
    t, r = turn.take(pa.array(good)).to_numpy(zero_copy_only=False), run[good]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    low, high, differ = np.zeros(n, np.int64), np.zeros(n, np.int64), np.bincount(r[new], minlength=n)
    head = np.ones(len(t), bool)
    head[1:] = r[1:] != r[:-1]
    tail = np.append(head[1:], True)[: len(t)]
    low[r[head]], high[r[tail]] = t[head], t[tail]
    return low, high, differ


def _gaps(low, high, differ):
    return [min(int(b) - int(a) + 1 - int(k), (1 << 63) - 1) if k else 0 for a, b, k in zip(low, high, differ, strict=True)]


def _illegal(initial, run, n):
    legal = ((initial[:-1] == 1) & (initial[1:] == 2)) | ((initial[:-1] == 2) & (initial[1:] == 3)) | ((initial[:-1] == 3) & (initial[1:] == 2))
    return np.bincount(run[1:][(run[1:] == run[:-1]) & ~legal], minlength=n)


def _turns(table, index, lattice, node):
    """Of path nodes those that leave a turn, with its role and text."""
    letter = lattice.letter[node]
    left = np.flatnonzero(letter != DELETE)
    node, letter = node[left], letter[left]
    place, state = node >> 2, node & 3
    row = np.where(letter == INSERT, -1, index[lattice.row_of[place]] if len(index) else -1)
    own = pa.array(np.where(row >= 0, row, 0), mask=row < 0)
    text = pc.fill_null(table.column("text").combine_chunks().take(own), "")
    names = pa.array([ROLE.get(s) for s in range(4)]).take(pa.array(NEXT[state]))
    role = pc.if_else(pa.array(letter == KEEP), table.column("role").combine_chunks().take(own), names)
    return left, role, text


def _solved(table: pa.Table) -> pa.RecordBatch:
    """Reports and turns of whole conversations, which stand one after another in a table."""
    conv = table.column("conv_id").combine_chunks()
    value, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    runs, n = np.cumsum(new) - 1, int(new.sum())
    index, run, blank, duplicate, truncated = _faults(table, runs, _seen(table, runs))
    initial = table.column("initial").to_numpy()[index]
    lattice = Lattice(np.bincount(run, minlength=n), blank | duplicate, truncated, initial, np.tile(AT_END, (n, 1)), np.ones(n, bool)).rank()
    steps, node = lattice.paths(np.arange(n), 0)
    letters, cuts = lattice.letter[node].astype(np.uint8).tobytes(), np.concatenate([[0], np.cumsum(steps)])
    audit = [letters[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    count = lambda flags: np.bincount(run[flags], minlength=n)
    numbers = [_gaps(*_turn_facts(table, index, run, n)), count(blank), count(duplicate), count(truncated), _illegal(initial, run, n), lattice.cost[lattice.first, 0]]
    left, role, text = _turns(table, index, lattice, node)
    owner = np.repeat(np.arange(n), steps)[left]
    turns = np.bincount(owner, minlength=n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(turns) - turns, turns)
    ids = conv.take(pa.array(np.flatnonzero(new)))
    order = np.lexsort((np.concatenate([np.full(n, -1), place]), np.concatenate([np.arange(n), owner])))
    none = lambda kind: pa.nulls(len(owner), kind)
    columns = [pa.concat_arrays([ids, ids.take(pa.array(owner))]), pa.array(np.concatenate([np.full(n, -1), place])), pa.concat_arrays([pa.nulls(n, pa.string()), role.cast(pa.string())]), pa.concat_arrays([pa.nulls(n, pa.string()), text.cast(pa.string())]), pa.concat_arrays([pa.array(audit, pa.string()), none(pa.string())])]
    columns += [pa.concat_arrays([pa.array(x, pa.int64()), none(pa.int64())]) for x in numbers]
    out = pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in PIECES.split(", ")])
    return out.take(pa.array(order))


def _whole(batches):
    """Tables of whole conversations from a stream in which each is contiguous."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        conv = table.column("conv_id").combine_chunks()
        if conv[0] == conv[-1]:
            held = table
            continue
        value, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero((value != value[-1]) | (null != null[-1]))[-1]) + 1
        yield table.slice(0, last)
        held = table.slice(last)
    if held is not None:
        yield held


def _short(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(lambda batches: (_solved(t) for t in _whole(batches)), PIECES)


def _chunked(rows: DataFrame, long_rows: int, long_bytes: int, splits: int) -> DataFrame:
    """The rows in order, with the split and the chunk that each is in and its place there."""
    ranged = rows.withColumns({"r": F.substring("role", 1, 32), "t": F.substring("text", 1, 32)}).repartitionByRange(splits, "conv_id", "turn", "r", "t").drop("r", "t")

    def cut(batches):
        split, chunk, place, size, before = TaskContext.get().partitionId(), -1, 0, 0, ()
        for batch in batches:
            convs, copies = batch.column("conv_id").to_pylist(), batch.column("copies").to_pylist()
            chunks, places = [], []
            for c, n, b in zip(convs, copies, pc.binary_length(batch.column("text")).to_pylist(), strict=True):
                if before != (c,) or place + n > long_rows or size + b > long_bytes:
                    chunk, place, size, before = chunk + 1, 0, 0, (c,)
                chunks.append(chunk)
                places.append(place)
                place, size = place + max(1, n), size + b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([split] * len(convs), pa.int64()), pa.array(chunks, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "split", "chunk", "at"])

    ordered = ranged.sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(cut, f"{ROWS}, split long, chunk long, at long")


_BY = ["conv_id", "split", "chunk"]
_MATRIX = ", ".join(f"m{k} long" for k in range(16))
_EXITS = ", ".join(f"x{k} long" for k in range(4))


def _of_chunk(table: pa.Table):
    table = table.sort_by("at")
    index, run, *flags = _faults(table, np.zeros(table.num_rows, np.int64), table.column("seen").to_numpy(zero_copy_only=False))
    return table, index, run, flags, table.column("initial").to_numpy()[index]


def _long(rows: DataFrame, long_rows: int, long_bytes: int, splits: int) -> DataFrame:
    """The same pieces for conversations in chunks; a conversation's pieces are sorted in one split."""
    chunked = written(_chunked(rows, long_rows, long_bytes, splits))
    order = F.struct("split", "chunk", "at")
    first = chunked.where("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("h1").alias("a"), F.col("h2").alias("b")).agg(F.min(order).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
    rows = written(chunked.join(first, same, "left").select(*chunked.columns, F.coalesce(order > F.col("first"), F.lit(False)).alias("seen")))

    def key(table):
        return [pa.array([table.column(c)[0].as_py()], pa.int64()) for c in _BY]

    def matrix(table: pa.Table) -> pa.Table:
        t, index, run, (blank, duplicate, truncated), initial = _of_chunk(table)
        exits = np.where(np.eye(4, dtype=bool), 0, INF)
        lattice = Lattice(np.full(4, len(index)), np.tile(blank | duplicate, 4), np.tile(truncated, 4), np.tile(initial, 4), exits, np.zeros(4, bool))
        low, high, differ = (int(x[0]) for x in _turn_facts(t, index, run, 1))
        ends = (int(initial[0]), int(initial[-1])) if len(index) else (-1, -1)
        facts = [low, high, differ, *ends, int(blank.sum()), int(duplicate.sum()), int(truncated.sum()), int(_illegal(initial, run, 1)[0])]
        values = [*lattice.cost[lattice.first].T.ravel().tolist(), *facts]
        return pa.table([*key(table), *[pa.array([x], pa.int64()) for x in values]], [*_BY, *[x.split()[0] for x in f"{_MATRIX}, {_FACTS}".split(", ")]])

    def borders(table: pa.Table) -> pa.Table:
        """Costs after each chunk, and the facts of the conversation; one row a chunk."""
        t = table.sort_by([("split", "ascending"), ("chunk", "ascending")]).to_pydict()
        n, x = len(t["chunk"]), AT_END.copy()
        exits = np.zeros((n, 4), np.int64)
        for k in range(n - 1, -1, -1):
            exits[k] = x
            m = np.array([t[f"m{j}"][k] for j in range(16)]).reshape(4, 4)
            x = np.minimum((m + x[None, :]).min(axis=1), INF)
        illegal, low, high, differ, last, turn = sum(t["illegal"]), [], [], 0, -1, None
        for k in range(n):
            if t["head"][k] >= 0:
                illegal += last >= 0 and (last, t["head"][k]) not in ((1, 2), (2, 3), (3, 2))
                last = t["tail"][k]
            if t["differ"][k]:
                differ += t["differ"][k] - (turn == t["low"][k])
                turn = t["high"][k]
                low.append(t["low"][k])
                high.append(turn)
        facts = [_gaps([low[0]], [high[-1]], [differ])[0] if differ else 0, sum(t["n_blank"]), sum(t["n_duplicate"]), sum(t["n_truncated"]), illegal, int(x[0])]
        columns = [pa.array(t[c], pa.int64()) for c in _BY] + [pa.array(exits[:, s]) for s in range(4)] + [pa.array(np.arange(n) == n - 1)]
        columns += [pa.array([v] * n, pa.int64()) for v in facts]
        return pa.table(columns, [*_BY, "x0", "x1", "x2", "x3", "final", *[f.split()[0] for f in REPORT.replace("blank", "all_blank").replace("truncated", "all_truncated").split(", ")]])

    renamed = REPORT.replace("blank", "all_blank").replace("truncated", "all_truncated")
    costs = written(rows.groupBy(*_BY).applyInArrow(matrix, f"conv_id long, split long, chunk long, {_MATRIX}, {_FACTS}").groupBy("conv_id").applyInArrow(borders, f"conv_id long, split long, chunk long, {_EXITS}, final boolean, {renamed}"))
    exits = costs.select(F.col("conv_id").alias("c"), F.col("split").alias("s"), F.col("chunk").alias("k"), "x0", "x1", "x2", "x3", "final")
    joined = rows.join(exits, _same_chunk()).drop("c", "s", "k")

    def lattice_of(table):
        t, index, run, (blank, duplicate, truncated), initial = _of_chunk(table)
        exits = np.array([[t.column(f"x{s}")[0].as_py() for s in range(4)]])
        return t, index, Lattice([len(index)], blank | duplicate, truncated, initial, exits, np.array([t.column("final")[0].as_py()])).rank()

    def leads(table: pa.Table) -> pa.Table:
        """For each state before a chunk: its audit, the state after it, and how many turns it leaves."""
        _, _, lattice = lattice_of(table)
        out = [[], [], []]
        for state in range(4):
            _, node = lattice.paths(np.array([0]), state)
            letters = lattice.letter[node]
            for o, v in zip(out, (letters.astype(np.uint8).tobytes().decode(), int(lattice.end[state]) & 3, int((letters != DELETE).sum())), strict=True):
                o.append(v)
        return pa.table([*key(table), *[pa.array([v], pa.list_(k)) for v, k in zip(out, (pa.string(), pa.int64(), pa.int64()), strict=True)]], [*_BY, "audits", "leads", "turns"])

    def entries(table: pa.Table) -> pa.Table:
        t = table.sort_by([("split", "ascending"), ("chunk", "ascending")]).to_pydict()
        state, base, states, bases, audit = 0, 0, [], [], []
        for audits, to, turns in zip(t["audits"], t["leads"], t["turns"], strict=True):
            states.append(state)
            bases.append(base)
            audit.append(audits[state])
            state, base = to[state], base + turns[state]
        n = len(states)
        return pa.table([*[pa.array(t[c], pa.int64()) for c in _BY], pa.array(states, pa.int64()), pa.array(bases, pa.int64()), pa.array(["".join(audit)] + [None] * (n - 1), pa.string())], [*_BY, "entry", "base", "audit"])

    led = joined.groupBy(*_BY).applyInArrow(leads, "conv_id long, split long, chunk long, audits array<string>, leads array<long>, turns array<long>")
    entered = written(led.groupBy("conv_id").applyInArrow(entries, "conv_id long, split long, chunk long, entry long, base long, audit string"))
    named = entered.select(F.col("conv_id").alias("c"), F.col("split").alias("s"), F.col("chunk").alias("k"), "entry", "base")
    last = joined.join(named, _same_chunk()).drop("c", "s", "k")

    def turns(table: pa.Table) -> pa.Table:
        t, index, lattice = lattice_of(table)
        _, node = lattice.paths(np.array([0]), table.column("entry")[0].as_py())
        _, role, text = _turns(t, index, lattice, node)
        n, base = len(role), table.column("base")[0].as_py()
        return pa.table([key(table)[0].take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(n) + base), role.cast(pa.string()), text.cast(pa.string())], ["conv_id", "place", "role", "text"])

    none = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in REPORT.split(", ")]
    pieces = last.groupBy(*_BY).applyInArrow(turns, "conv_id long, place long, role string, text string").select("*", F.lit(None).cast("string").alias("audit"), *none)
    whole = costs.where("final").alias("o").join(entered.where("audit is not null").alias("e"), F.col("o.conv_id").eqNullSafe(F.col("e.conv_id")))
    null = F.lit(None).cast("string")
    reports = whole.select("o.conv_id", F.lit(-1).cast("long").alias("place"), null.alias("role"), null.alias("text"), "e.audit", "gaps", F.col("all_blank").alias("blank"), "duplicate", F.col("all_truncated").alias("truncated"), "illegal", "cost")
    return reports.union(pieces).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _same_chunk():
    return F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("split") == F.col("s")) & (F.col("chunk") == F.col("k"))


_FACTS = "low long, high long, differ long, head long, tail long, n_blank long, n_duplicate long, n_truncated long, illegal long"


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES) -> DataFrame:
    """Of every conversation a row with place -1, its audit and figures, and a row for each turn that the cheapest edits leave.

    `rows` has conv_id, turn, role, text and copies.  The rows of a conversation stand one after another, in order.
    """
    rows = _coded(rows)
    sizes = rows.groupBy("conv_id").agg(F.sum(F.greatest("copies", F.lit(1))).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = written(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)))
    found = long.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    if not found["n"]:
        return _short(rows)
    long = long.select(F.col("conv_id").alias("c"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    splits = 1 + (found["bytes"] or 0) // SPLIT_BYTES
    return _short(rows.join(long, same, "left_anti")).union(_long(rows.join(long, same, "left_semi"), long_rows, long_bytes, splits))


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation from the rows of `repair`, with the hash of its turns as ``role:text`` lines; texts are streamed."""
    names = [x.split()[0] for x in REPORT.split(", ")]

    def stream(batches):
        held, sha, first = None, None, True

        def give(rows):
            columns = [pa.array([r[k] for r in rows], pa.string() if k in (1, len(names) + 2) else pa.int64()) for k in range(len(names) + 3)]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "audit", *names, "repaired_sha256"])

        for batch in batches:
            done = []
            place, roles, texts = (batch.column(c) for c in ("place", "role", "text"))
            for k, p in enumerate(place.to_pylist()):
                if p < 0:
                    if held is not None:
                        done.append([*held, sha.hexdigest()])
                    held, sha, first = [batch.column(c)[k].as_py() for c in ("conv_id", "audit", *names)], hashlib.sha256(), True
                else:
                    sha.update(f"{'' if first else chr(10)}{roles[k].as_py()}:".encode())
                    sha.update(texts[k].as_buffer())
                    first = False
            yield give(done)
        if held is not None:
            yield give([[*held, sha.hexdigest()]])

    return pieces.mapInArrow(stream, f"conv_id long, audit string, {REPORT}, repaired_sha256 string")
