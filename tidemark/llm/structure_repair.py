"""Conversation structure repair by a bidirectional tight-arc DAG.

A node of the DAG is a number of rows that are done and a state: what the repaired conversation says last (nothing, the
system, a user, an assistant). Arcs are edits: Delete, Insert, Keep, Rerole. Forward and backward minimum costs tell
which arcs are tight, that is on a cheapest path. From the start a set of nodes, all that are reached by the letters so
far, takes the least letter that any tight arc out of it has, until the end is reached.

A conversation may hold a third of all rows, so costs are made by blocks of rows, which are dealt out evenly:

1. Equal rows become one row with its number of copies. Rows are dealt by ranges of (conversation, turn, role, text),
   so that a long conversation takes several tasks, and cut into blocks of at most `BLOCK` rows or `BYTES` of text.
2. A block's costs from every state before it to every state behind it are 16 numbers: the product (minimum, plus) of its
   rows' arcs. Products of a conversation's blocks give forward costs before each block and backward costs behind it.
3. With these two, each block marks its tight arcs and walks from each state that a cheapest path may enter it in.
4. The blocks of a conversation are streamed in order: each goes on in the state in which the last ended. Here the
   repaired text is hashed; that a hash takes its text in order is what the result asks for, and nothing is gathered but
   the audit letters.

Every state has one successor under a letter, so the set of nodes never holds more than one and a block's walk depends
on its entry state alone.

Defined cases: null roles and texts are one space, so rows without text are blank; rows with equal turns (null turns
come first) are ordered by role and text; rows with a null conv_id are one conversation; repeated rows are duplicates; a
conversation whose rows are all dropped, and an empty table, give zeros and no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, runs, small_batches, splits_of, stored

#: Rows and bytes of text of a block; one row may be longer.
BLOCK, BYTES = 4096, 1 << 16
#: Characters of a text by which rows with equal turns and roles are dealt to tasks.
PREFIX = 100
# The costs of edits, and of keeping a truncated row besides.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Initials by number, the state that a kept row of an initial leads to from each state that allows it, and the state that an inserted or reroled row leads to.
INITIALS = "sua?"
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
SAID = (USER, USER, ASSISTANT, USER)
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: A row's code is its initial, plus FORCED if it must be deleted, plus CUT if it is truncated.
FORCED, CUT = 4, 8
NEVER = np.int64(1) << 40
#: What the end costs from each state: users need an answer, a system needs both.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n (copies) of the rows of turns after the damage that their ids ask for."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(given("text"), "[.!?]", "")).otherwise(given("text"))
    return turns.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(given("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("n"))


def sorted_rows(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, n) in order, equal ones as one, with `later`: the same was said at an earlier turn."""
    parts = splits_of(rows)
    same = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n")))
    same = same.withColumn("h", F.sha2("text", 256)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    first = same.groupBy("conv_id", "role", "h").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").select(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("h").alias("what"), "first")
    joined = same.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("h") == F.col("what")), "left")
    told = joined.select("conv_id", "turn", "role", "text", "n", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))
    dealt = told.repartitionByRange(parts, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", F.left("text", F.lit(PREFIX)))
    return dealt.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


def arcs() -> np.ndarray:
    """For each code the costs from every state before a row to every state after it, inserts before the row among them."""
    out = np.full((16, 4, 4), NEVER)
    for code in range(16):
        for s in range(4):
            out[code, s, s] = DELETE
            if not code & FORCED:
                cut = TRUNCATED if code & CUT else 0
                out[code, s, SAID[s]] = min(out[code, s, SAID[s]], REROLE + cut)
                for before, after in KEPT[code & 3].items():
                    if before == s:
                        out[code, s, after] = min(out[code, s, after], cut)
    insert = np.full((4, 4), NEVER)
    for s in range(4):
        insert[s, s] = 0
        insert[s, SAID[s]] = min(insert[s, SAID[s]], INSERT)
    insert = product(np.stack([insert, insert]))
    return np.stack([product(np.stack([insert, x])) for x in out])


def product(matrices: np.ndarray) -> np.ndarray:
    """The product, by minimum and plus, of n matrices in order."""
    while len(matrices) > 1:
        even = len(matrices) // 2 * 2
        paired = (matrices[0:even:2, :, :, None] + matrices[1:even:2, None, :, :]).min(2)
        matrices = np.minimum(np.concatenate([paired, matrices[even:]]), NEVER)
    return matrices[0]


ARCS = arcs()


def steps(state: int, code: int) -> list[tuple[str, int, int, int]]:
    """The arcs out of a state before a row: letter, cost, rows done, next state."""
    out = [("D", DELETE, 1, state), ("I", INSERT, 0, SAID[state])]
    if not code & FORCED:
        cut = TRUNCATED if code & CUT else 0
        out += [("K", cut, 1, KEPT[code & 3][state])] if state in KEPT[code & 3] else []
        out.append(("R", REROLE + cut, 1, SAID[state]))
    return out


STEPS = [[steps(s, code) for s in range(4)] for code in range(16)]


def inserted(cost: list[int], backward: bool) -> list[int]:
    """Least costs once inserts are allowed: up to a state, or backward from it."""
    for _ in range(2):
        for s in range(4):
            a, b = (s, SAID[s]) if backward else (SAID[s], s)
            cost[a] = min(cost[a], cost[b] + INSERT)
    return cost


def walks(codes: bytes, before: list[int], behind: list[int], total: int) -> list[tuple[int, str, int]]:
    """For each state in which a cheapest path may enter a block: that state, the letters through the block, the last state.

    before and behind are the least costs from the start to the block's states, and from those behind it to the end."""
    n = len(codes)
    back = [list(behind)] * (n + 1)
    for k in range(n - 1, -1, -1):
        back[k] = inserted([min(c + back[k + 1][to] for _, c, done, to in STEPS[codes[k]][s] if done) for s in range(4)], True)
    ahead = [inserted(list(before), False)]
    for k in range(n):
        new = [int(NEVER)] * 4
        for s in range(4):
            for _, c, done, to in STEPS[codes[k]][s]:
                if done:
                    new[to] = min(new[to], ahead[k][s] + c)
        ahead.append(inserted(new, False) if k < n - 1 else new)
    found = []
    for entry in range(4):
        if before[entry] + back[0][entry] != total:
            continue
        frontier, letters = {(0, entry)}, []
        while not all(k == n for k, _ in frontier):
            tight = [(letter, (k + done, to)) for k, s in frontier if k < n for letter, c, done, to in STEPS[codes[k]][s] if ahead[k][s] + c + back[k + done][to] == total]
            least = min(letter for letter, _ in tight)
            letters.append(least)
            frontier = {node for letter, node in tight if letter == least}
        found.append((entry, "".join(letters), min(frontier)[1]))
    return found


BLOCKS = "part int, seq int, codes binary, blank long, duplicate long, truncated long, illegal long, turns long, low {turn}, high {turn}, roles array<string>, texts array<string>, copies array<long>"


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of a conversation: its codes and faults, and its roles, texts and numbers of copies."""
    kinds = {k: rows.schema[k].dataType.simpleString() for k in ("conv_id", "turn")}
    schema = f"conv_id {kinds['conv_id']}, " + BLOCKS.format(turn=kinds["turn"])

    def block(table: pa.Table, part: int, seq: int) -> dict:
        out = {"conv_id": table["conv_id"][0].as_py(), "part": part, "seq": seq, "blank": 0, "duplicate": 0, "truncated": 0}
        codes = bytearray()
        roles, copies = table["role"].to_pylist(), table["n"].to_pylist()
        for role, text, n, later in zip(roles, table["text"].cast(pa.large_binary()).to_pylist(), copies, table["later"].to_pylist()):
            initial = INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3
            said = text.rstrip(SPACE)
            cut = bool(said) and said[-1:] not in (b".", b"!", b"?")
            if not said:
                out["blank"] += n
                codes += bytes([initial | FORCED]) * n
            else:
                out["duplicate"] += n - 1 + later
                out["truncated"] += cut and not later
                codes += bytes([initial | (FORCED if later else CUT * cut)]) + bytes([initial | FORCED]) * (n - 1)
        plain = [c & 3 for c in codes]
        out["illegal"] = sum(pair not in LEGAL for pair in zip(plain, plain[1:]))
        turns = [t for t in table["turn"].to_pylist() if t is not None]
        return out | {"codes": bytes(codes), "turns": len(set(turns)), "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "roles": roles, "texts": table["text"].to_pylist(), "copies": copies}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, seq, held, made = None, 0, [], []

        def pieces() -> Iterator[pa.Table]:
            for b in batches:
                size = np.array([len(t) for t in b.column(3).cast(pa.large_binary()).to_pylist()], np.int64)
                weight = np.maximum(size / BYTES, b.column(4).to_numpy() / BLOCK)
                at = 0
                while at < b.num_rows:  # as many rows as fill a block, at least one
                    upto = at + max(1, int(np.searchsorted(np.cumsum(weight[at : at + BLOCK]), 1.0, "right")))
                    yield from runs(iter([b.slice(at, upto - at)]), "conv_id")
                    at = upto

        arrow = _arrow(schema)
        for table in pieces():
            own = [table["conv_id"][0].as_py()]
            seq = seq + 1 if conv == own else 0
            conv = own
            made.append(block(table, part, seq))
            held.append(table.nbytes)
            if sum(held) > 16 * BYTES or len(held) > 1000:
                yield pa.RecordBatch.from_pylist(made, arrow)
                held, made = [], []
        if made:
            yield pa.RecordBatch.from_pylist(made, arrow)

    return small_batches(rows).select("conv_id", "turn", "role", "text", "n", "later").mapInArrow(cut, schema)


def _arrow(schema: str) -> pa.Schema:
    """The Arrow schema of a plain Spark schema string."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "smallint": pa.int16(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([pa.field(name, kinds[kind]) for name, kind in (x.split(" ") for x in schema.split(", "))])


def costs(cut: DataFrame) -> DataFrame:
    """conv_id, part, seq, codes, before, behind and total of every block: least costs up to it and from behind it."""
    conv = cut.schema["conv_id"].dataType.simpleString()
    names = f"conv_id {conv}, part int, seq int, codes binary, matrix array<long>"
    out = f"conv_id {conv}, part int, seq int, before array<long>, behind array<long>, total long"

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [product(ARCS[np.frombuffer(c, np.uint8)]).ravel().tolist() for c in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.int64()))], [*b.schema.names, "matrix"])

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "conv_id"):
            every = np.array(table["matrix"].to_pylist(), np.int64).reshape(-1, 4, 4)
            before, behind = [np.array([0, NEVER, NEVER, NEVER])], [END]
            for m in every[:-1]:
                before.append(np.minimum((before[-1][:, None] + m).min(0), NEVER))
            for m in every[:0:-1]:
                behind.append((m + behind[-1]).min(1))
            total = int((every[0] + behind[-1]).min(1)[START])
            lists = lambda x: pa.array([v.tolist() for v in x], pa.list_(pa.int64()))
            one = table.select(["conv_id", "part", "seq"]).combine_chunks()
            columns = [*(c.combine_chunks() for c in one.columns), lists(before), lists(behind[::-1]), pa.array([total] * len(every), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "seq", "before", "behind", "total"])

    made = cut.select("conv_id", "part", "seq", "codes").mapInArrow(matrices, names).drop("codes")
    return small_batches(made).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(chained, out)


def walked(cut: DataFrame) -> DataFrame:
    """conv_id, part, seq, total, entries, letters and exits of every block: the walks through it."""
    conv = cut.schema["conv_id"].dataType.simpleString()
    known = costs(cut).toDF("of", "in_part", "in_seq", "before", "behind", "total")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")) & (F.col("seq") == F.col("in_seq"))
    joined = cut.select("conv_id", "part", "seq", "codes").join(known, same).select("conv_id", "part", "seq", "total", "codes", "before", "behind")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [walks(c, x, y, t) for t, c, x, y in zip(*(b.column(k).to_pylist() for k in range(3, 7)))]
            columns = [pa.array([[w[k] for w in x] for x in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *columns], ["conv_id", "part", "seq", "total", "entries", "letters", "exits"])

    return joined.mapInArrow(walk, f"conv_id {conv}, part int, seq int, total long, entries array<int>, letters array<string>, exits array<int>")


class _Told:
    """What is known of a conversation, as its blocks go by."""

    def __init__(self):
        self.counts, self.state, self.initial, self.turns, self.low, self.high = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0), START, None, 0, None, None
        self.cost, self.audit, self.hash, self.lines = 0, [], sha256(), 0

    def say(self, role: bytes, text: bytes) -> None:
        self.hash.update(b"\n" * (self.lines > 0) + role + b":" + text)
        self.lines += 1

    def block(self, row: dict, walk: dict) -> None:
        for k in self.counts:
            self.counts[k] += row[k]
        codes = row["codes"]
        self.counts["illegal"] += self.initial is not None and (self.initial, codes[0] & 3) not in LEGAL
        self.initial = codes[-1] & 3
        self.turns += row["turns"] - (self.high is not None and self.high == row["low"])
        self.low = row["low"] if self.low is None else self.low
        self.high = self.high if row["high"] is None else row["high"]
        at = walk["entries"].index(self.state)
        self.cost = walk["total"]
        self.audit.append(walk["letters"][at])
        rows = (pair for role, text, n in zip(row["roles"], row["texts"], row["copies"]) for pair in [(role, text)] * n)
        for letter in walk["letters"][at]:
            if letter == "I":
                self.insert()
                continue
            role, text = next(rows)
            if letter == "K":
                self.say(role.encode(), text.encode())
                self.state = KEPT[INITIALS.find(role[0])][self.state]
            elif letter == "R":
                self.state = SAID[self.state]
                self.say(ROLES[self.state], text.encode())

    def insert(self) -> None:
        self.state = SAID[self.state]
        self.say(ROLES[self.state], b"")

    def row(self, conv) -> dict:
        while END[self.state]:
            self.audit.append("I")
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"conv_id": conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the rows of turns (conv_id, turn, role, text, n)."""
    cut = stored(blocks(sorted_rows(turns)))
    conv = cut.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    rows = cut.withColumn("kind", F.lit(1)).unionByName(walked(cut).withColumn("kind", F.lit(0)), allowMissingColumns=True)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(schema)
        conv, now, walk, done = None, None, None, []
        for row in (r for b in batches for k in range(0, b.num_rows, 50) for r in b.slice(k, 50).to_pylist()):
            if now is None or row["conv_id"] != conv:
                if now is not None:
                    done.append(now.row(conv))
                conv, now = row["conv_id"], _Told()
            if row["kind"] == 0:
                walk = row
            else:
                now.block(row, walk)
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if now is not None:
            done.append(now.row(conv))
        yield pa.RecordBatch.from_pylist(done, arrow)

    return small_batches(rows).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind").mapInArrow(told, schema)


def structure_repair(turns: DataFrame) -> DataFrame:
    """The figures of every conversation of turns (conv_id, turn, role, text), after damage and repair."""
    found = repaired(damaged(turns)).withColumnRenamed("conv_id", "of")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
