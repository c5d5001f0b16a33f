"""Conversation repair by rank-convergence parallel Viterbi.

The rows of a conversation, in order of turn (no turn first, then role and text), become a
sequence of roles ``(s?(ua)+)?`` by the cheapest edits: Keep 0, Rerole to user or assistant 1,
Delete 2, Insert an empty user or assistant row 5, and 5 for a truncated row that is not deleted.
Blank and duplicate rows must go. Of the cheapest edit strings the one least in ASCII is taken.

Rows are sorted by range, so a conversation of any length is spread over as many partitions as
it fills, and its share of a partition is a chunk. The recurrence runs backward: a vector holds,
for each state of the grammar (start, after s, after u, after a), the least cost to the end. A
chunk that touches an edge of its partition does not know the vector behind it and starts from
speculative ones, one per state, which run in step until they differ by constants only; from
then on one stands for all. That gives a chunk's effect on any vector as a small matrix, and the
true vectors at all edges follow from the matrices: two a partition, so what the driver stitches
is bounded by the number of partitions. A fix-up pass traces each such chunk from its true
vector, from every state it may be entered in; stitching the states forward tells the right one.
Tracing takes, place by place, the least edit initial among those that keep the backward cost;
every initial leads to one state, so this is the ASCII-least string. What lies inside a
partition is traced at once. Vectors matter up to a constant, and there are few: the steps of
the recurrence and of the trace are remembered, so a row costs a look-up.

Copies of a row (same turn, role and text) are counted before rows move; earlier copies under
another turn are found by an aggregation, whose result Spark joins, so no conversation is
collected anywhere. The repaired text of a chunk is streamed in pieces, and the digest of a
conversation over several partitions is taken from its sorted pieces, row by row.

Defined results: a null conv_id is one conversation; null roles and texts are one space, as are
nulls in the text that the damage is drawn from; rows without turn come first and count in no
gap; an empty role has no initial and is neither s, u nor a; a conversation without rows has
zeros, an empty audit and the digest of nothing; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.session import cut_lineage

# States of the grammar: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

# A row's code: its initial (s, u, a, any other), 4 if truncated; 8 if it must go.
INITIALS = "sua"
MUST_GO = 8

#: Where a kept row of an initial leads from a state.
KEEPS = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
#: Where the next user or assistant row leads, and which it is.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}

Vector = tuple[int, ...]


def closed(vector: Vector) -> Vector:
    """Least costs where rows may be inserted first."""
    costs = list(vector)
    for _ in costs:
        for state, (after, _) in NEXT.items():
            costs[state] = min(costs[state], INSERT + costs[after])
    return tuple(costs)


def plain(vector: Vector) -> tuple[Vector, int]:
    """The vector with 0 as its least cost, and what was taken off."""
    least = min(vector)
    return tuple(min(c - least, NEVER) for c in vector), least


#: Costs behind the last row.
END = closed((0, NEVER, NEVER, 0))
UNITS = [tuple(0 if s == t else NEVER for t in range(4)) for s in range(4)]


def _ways(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state: initial, cost, state behind it; in the order of the initials."""
    yield "D", DELETE, state
    if code < MUST_GO:
        more = TRUNCATED if code & 4 else 0
        if (kept := KEEPS.get((state, code & 3))) is not None:
            yield "K", more, kept
        yield "R", REROLE + more, NEXT[state][0]


class Steps:
    """The recurrence with memory; vectors come and go with 0 as their least cost."""

    def __init__(self):
        self.backward: dict[tuple[Vector, int], tuple[Vector, int]] = {}
        self.traced: dict[tuple[Vector, int, int], tuple[str, int, int]] = {}

    def back(self, behind: Vector, code: int) -> tuple[Vector, int]:
        """The vector before a row, and the constant that went into it."""
        key = behind, code
        if key not in self.backward:
            costs = tuple(min(c + behind[t] for _, c, t in _ways(code, s)) for s in range(4))
            self.backward[key] = plain(closed(costs))
        return self.backward[key]

    def edits(self, behind: Vector, code: int, state: int) -> tuple[str, int, int]:
        """Initials up to and with a row's own edit, their cost, and the state behind the row."""
        key = behind, code, state
        if key not in self.traced:
            before, least = self.back(behind, code)
            done, cost, at = "", 0, state
            while True:
                left = before[at] + least
                ways = [*_ways(code, at)]
                ways.insert(1, ("I", INSERT, NEXT[at][0]))  # D, I, K, R: ascending
                for letter, price, to in ways:
                    rest = before[to] + least if letter == "I" else behind[to]
                    if price + rest == left:
                        break
                done, cost, at = done + letter, cost + price, to
                if letter != "I":
                    break
            self.traced[key] = done, cost, at
        return self.traced[key]

    def last(self, state: int) -> tuple[str, int]:
        """Inserts behind the last row, and their cost."""
        done, cost = "", 0
        while state not in (START, ASSISTANT):
            done, cost, state = done + "I", cost + INSERT, NEXT[state][0]
        return done, cost

    def run(self, codes: bytes, behind: Vector) -> tuple[list[Vector], Vector, int]:
        """The vector behind every row, the one before the first, and the constant between."""
        vectors, constant = [behind] * len(codes), 0
        for i in range(len(codes) - 1, -1, -1):
            vectors[i] = behind
            behind, more = self.back(behind, codes[i])
            constant += more
        return vectors, behind, constant

    def matrix(self, codes: bytes) -> list[Vector]:
        """What comes of a speculative vector per state; one run once they agree but for constants."""
        now, constants = list(UNITS), [0] * 4
        for i in range(len(codes) - 1, -1, -1):
            if now[0] == now[1] == now[2] == now[3]:
                _, first, more = self.run(codes[: i + 1], now[0])
                now, constants = [first] * 4, [c + more for c in constants]
                break
            for s in range(4):
                now[s], more = self.back(now[s], codes[i])
                constants[s] += more
        return [tuple(min(c + k, NEVER) for c in v) for v, k in zip(now, constants)]


def through(matrix: list[Vector], behind: Vector) -> Vector:
    """The vector before a chunk, from the one behind it."""
    return plain(tuple(min(behind[s] + matrix[s][t] for s in range(4)) for t in range(4)))[0]


# -- Rows ------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after the seeded damage; 0 copies of a dropped row."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")],
        (F.crc32(name) % 20).alias("fault"),
    )
    fault = F.col("fault")
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        F.when(fault != 0, F.col("turn")).alias("turn"),
        F.when(fault == 0, "").when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 0, "").otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows with ``copies``, in order, with ``again``: a row of an earlier turn has the same text."""
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    both = F.concat(F.lpad(F.octet_length("role").cast("string"), 10, "0"), "role", "text")
    same = same.select("*", order.alias("order"), F.unhex(F.sha2(both, 256)).alias("digest"))
    seen = same.filter(F.col("copies") > 0).groupBy(F.col("conv_id").alias("conv"), F.col("digest").alias("known"))
    seen = seen.agg(F.min("order").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    match = F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("known"))
    again = F.coalesce(F.col("first") < F.col("order"), F.lit(False))
    rows = same.join(seen, match, "left").select("conv_id", "turn", "role", "text", "copies", again.alias("again"))
    # Rows alike in the keys stay together, so a few first characters of a long text will do.
    head = F.substring("text", 1, 64)
    rows = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", head)
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


BLANKS = " \t\n\v\f\r"


class Chunk:
    """A conversation's rows in one partition: codes for the recurrence, counts, texts."""

    def __init__(self, conv):
        self.conv = conv
        self.codes = bytearray()
        self.copies: list[int] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn, role: str, text: str, copies: int, again: bool) -> None:
        if not copies:
            return
        ended = text.rstrip(BLANKS)
        initial = role[:1]
        code = INITIALS.find(initial) & 3 if initial else 3
        if not ended:
            self.blank += copies
            code |= MUST_GO
        else:
            self.duplicate += copies - (not again)
            if again:
                code |= MUST_GO
            elif ended[-1] not in ".!?":
                self.truncated += 1
                code |= 4
        if self.first is None:
            self.first = initial
        else:
            self.illegal += (self.last + initial) not in ("su", "ua", "au")
        self.illegal += copies - 1  # no initial may follow itself
        self.last = initial
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        self.codes.append(code)
        self.copies.append(copies)
        self.roles.append(role)
        self.texts.append(text)

    def traced(self, steps: Steps, behind: Vector, state: int, ends: bool) -> tuple[str, int, Iterator[str]]:
        """Audit, cost and repaired rows of this chunk, from the state it is entered in."""
        vectors, _, _ = steps.run(bytes(self.codes), behind)
        audit, cost, kept = [], 0, []
        for i, (code, copies) in enumerate(zip(self.codes, self.copies)):
            at = state
            done, price, state = steps.edits(vectors[i], code, state)
            # What is left of the copies must go, and goes first where that is no later.
            audit.append(done + "D" * (copies - 1))
            cost += price + DELETE * (copies - 1)
            for letter in done:
                if letter == "K":
                    kept.append(f"{self.roles[i]}:{self.texts[i]}")
                elif letter in "RI":
                    at, name = NEXT[at]
                    kept.append(f"{name}:{self.texts[i] if letter == 'R' else ''}")
        if ends:
            at = state
            done, price = steps.last(state)
            audit.append(done)
            cost += price
            for _ in done:
                at, name = NEXT[at]
                kept.append(f"{name}:")
        return "".join(audit), cost, kept

    def leaves(self, steps: Steps, behind: Vector) -> list[int]:
        """The state behind the last row for each state before the first."""
        vectors, _, _ = steps.run(bytes(self.codes), behind)
        return [_walk(steps, vectors, self.codes, s) for s in range(4)]


def _walk(steps: Steps, vectors: list[Vector], codes: bytes, state: int) -> int:
    for vector, code in zip(vectors, codes):
        state = steps.edits(vector, code, state)[2]
    return state


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    chunk, begun = None, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again")]
        for conv, *row in zip(*columns):
            if not begun or conv != chunk.conv:
                if begun:
                    yield chunk
                chunk, begun = Chunk(conv), True
            chunk.add(*row)
    if begun:
        yield chunk


def _with_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, bool, bool]]:
    """Chunks, and whether each is the first or the last of its partition."""
    held, first = None, True
    for chunk in _chunks(batches):
        if held is not None:
            yield held, first, False
            first = False
        held = chunk
    if held is not None:
        yield held, first, True


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


# -- The three passes -----------------------------------------------------------


def _edges(rows: DataFrame, kind: str) -> DataFrame:
    """``part, side, conv_id, codes, matrix`` of the chunks at the edges of partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, steps = _partition(), Steps()
        for chunk, first, last in _with_edges(batches):
            if first or last:
                codes = bytes(chunk.codes)
                flat = [c for v in steps.matrix(codes) for c in v]
                yield pa.RecordBatch.from_pylist(
                    [{"part": part, "side": int(last), "conv_id": chunk.conv, "codes": codes, "matrix": flat}],
                    schema=schema,
                )

    fields = [("part", pa.int64()), ("side", pa.int64()), ("conv_id", _arrow(kind))]
    schema = pa.schema([*fields, ("codes", pa.binary()), ("matrix", pa.list_(pa.int64()))])
    return rows.mapInArrow(run, f"part long, side long, conv_id {kind}, codes binary, matrix array<long>")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _leaving(edges: DataFrame, behind: dict[tuple[int, int], Vector]) -> DataFrame:
    """The fix-up pass: ``part, side, leaves`` of every edge chunk under its true vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                chunk = Chunk(None)
                chunk.codes = row["codes"]
                out.append(chunk.leaves(steps, behind[row["part"], row["side"]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("side"), pa.array(out, pa.list_(pa.int64()))],
                ["part", "side", "leaves"],
            )

    return edges.select("part", "side", "codes").mapInArrow(run, "part long, side long, leaves array<long>")


def _stitched(rows: list, same) -> dict[tuple[int, int], tuple[Vector, bool, bool]]:
    """True vectors behind the edge chunks (in order), and whether a conversation begins or ends there."""
    behind, found = END, {}
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        ends = i + 1 == len(rows) or not same(row, rows[i + 1])
        begins = i == 0 or not same(rows[i - 1], row)
        if ends:
            behind = plain(END)[0]
        found[row.part, row.side] = behind, begins, ends
        matrix = [tuple(row.matrix[4 * s : 4 * s + 4]) for s in range(4)]
        behind = through(matrix, behind)
    return found


COUNTS = ("blank", "duplicate", "truncated", "illegal")
#: Repaired text of an edge chunk travels in pieces of about this many bytes.
PIECE = 1 << 20


def _results(rows: DataFrame, kind: str, known: dict) -> DataFrame:
    """One row per conversation inside a partition; pieces of those that reach an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, steps, out = _partition(), Steps(), []
        whole = plain(END)[0], True, True, START
        for chunk, first, last in _with_edges(batches):
            behind, begins, ends, state = known[part, int(last)] if first or last else whole
            audit, cost, kept = chunk.traced(steps, behind, state, ends)
            row = {"conv_id": chunk.conv, "cost": cost, "turns": chunk.turns, "low": chunk.low, "high": chunk.high}
            row |= {c: getattr(chunk, c) for c in COUNTS} | {"first": chunk.first, "last": chunk.last, "audit": audit}
            if begins and ends:
                text = "\n".join(kept).encode()
                out.append(row | {"digest": hashlib.sha256(text).hexdigest(), "part": None, "piece": None, "kept": None})
            else:
                zero = dict.fromkeys(row, None) | {"conv_id": chunk.conv}
                for number, text in enumerate(_cut(kept)):
                    row = row if not number else zero
                    out.append(row | {"digest": None, "part": part, "piece": number, "kept": text})
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    longs = ("cost", "turns", "low", "high", *COUNTS)
    fields = [("conv_id", _arrow(kind)), *[(c, pa.int64()) for c in longs]]
    fields += [(c, pa.string()) for c in ("first", "last", "audit", "digest")]
    fields += [("part", pa.int64()), ("piece", pa.int64()), ("kept", pa.list_(pa.string()))]
    schema = pa.schema(fields)
    spark_schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in longs)
    spark_schema += ", first string, last string, audit string, digest string, part long, piece long, kept array<string>"
    return rows.mapInArrow(run, spark_schema)


def _cut(kept: list[str]) -> Iterator[list[str]]:
    piece, size = [], 0
    for text in kept:
        piece.append(text)
        size += len(text)
        if size >= PIECE:
            yield piece
            piece, size = [], 0
    yield piece


OUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(pieces: DataFrame, kind: str) -> DataFrame:
    """Conversations over several partitions, put together from their sorted pieces one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        yield state.batch(conv, schema)
                    state, conv = _Sum(), row["conv_id"]
                state.add(row)
        if state is not None:
            yield state.batch(conv, schema)

    longs = ["gaps", *COUNTS, "cost"]
    schema = pa.schema(
        [("conv_id", _arrow(kind)), *[(c, pa.int64()) for c in longs], ("audit", pa.string()), ("repaired_sha256", pa.string())]
    )
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return pieces.mapInArrow(run, f"conv_id {kind}, {OUT}")


class _Sum:
    """Counts, audit and digest over the pieces of one conversation."""

    def __init__(self):
        self.counts = dict.fromkeys((*COUNTS, "cost"), 0)
        self.audit, self.sha, self.begun = [], hashlib.sha256(), False
        self.turns, self.low, self.high, self.last = 0, None, None, None

    def add(self, row: dict) -> None:
        if row["cost"] is not None:  # the first piece of a chunk
            for c in self.counts:
                self.counts[c] += row[c]
            if row["first"] is not None:
                if self.last is not None:
                    self.counts["illegal"] += (self.last + row["first"]) not in ("su", "ua", "au")
                self.last = row["last"]
            if row["low"] is not None:
                self.turns += row["turns"] - (row["low"] == self.high)
                self.low = row["low"] if self.low is None else self.low
                self.high = row["high"]
            self.audit.append(row["audit"])
        for text in row["kept"]:
            self.sha.update((b"\n" if self.begun else b"") + text.encode())
            self.begun = True

    def batch(self, conv, schema: pa.Schema) -> pa.RecordBatch:
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        row = {"conv_id": conv, "gaps": gaps, **self.counts, "audit": "".join(self.audit)}
        return pa.RecordBatch.from_pylist([row | {"repaired_sha256": self.sha.hexdigest()}], schema=schema)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (``conv_id, turn, role, text, copies``).

    ``gaps``, counts of faults, ``cost`` and ``audit`` of the cheapest edits, and the digest of
    the repaired ``role:text`` lines.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    ordered = cut_lineage(sorted_rows(rows))
    edges = cut_lineage(_edges(ordered, kind))
    slim = edges.select("part", "side", "conv_id", "matrix").orderBy("part", "side").collect()
    found = _stitched(slim, lambda a, b: a.conv_id == b.conv_id)
    leaves = _leaving(edges, {k: v[0] for k, v in found.items()}).collect()
    leaves = {(r.part, r.side): r.leaves for r in leaves}
    known, state = {}, START
    for row in slim:
        behind, begins, ends = found[row.part, row.side]
        state = START if begins else state
        known[row.part, row.side] = behind, begins, ends, state
        state = leaves[row.part, row.side][state]
    results = cut_lineage(_results(ordered, kind, known))
    gaps = F.when(F.col("low").isNotNull(), F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(0)
    inside = results.filter(F.col("part").isNull()).select(
        "conv_id", gaps.cast("long").alias("gaps"), *COUNTS, "cost", "audit", F.col("digest").alias("repaired_sha256")
    )
    return inside.unionByName(_joined(results.filter(F.col("part").isNotNull()), kind))


def op12_viterbi_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation of the table, damaged by its rows' digests and repaired."""
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
