"""Repair of the turn structure of conversations by cheapest edits.

The initials of a conversation's roles have to read ``(s?(ua)+)?``. Every message
is kept (0), given another role (2) or deleted (3, the only edit of blank and
duplicate ones), and empty messages can be inserted (2); a truncated message that
isn't deleted costs 1 more. Of the cheapest edits those are taken whose
initials (D, I, K, R) in order are least in ASCII.

Square-root checkpoints. The rest of a conversation is summed up by the least cost from
each of the four states of the pattern, a vector that is computed backward. A
table of all vectors would let one walk forward along tight edits; here only the vectors at
every square-root-th row are stored, and the walk recomputes one block of
them at a time. In the walk the least tight edit is right: an edit and the state
before it give the state after it, and no cheapest edits are the beginning of others.

Scale. Messages are dealt by conversation and stream through a task in order;
texts are shuffled once. A task holds one block of one conversation. Of one of over BLOCK
messages the vectors at the ends of blocks of about the square root of its length
come from a pass before, which composes each block to a min-plus matrix, and
precede its messages in the stream; so memory stays at a square root there, too.
The digest of a conversation's repaired text is sequential by nature, so one
conversation is one stream, however long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from math import isqrt
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import cut, pieces, utf8

#: Messages of a conversation that a task holds without a pass before.
BLOCK = 4096
SPACES = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States: nothing yet, after a system, a user, an assistant message. What a message of each initial leads to, and what an inserted or rerolled one does.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = {"su", "ua", "au"}
#: Costs from each state at the end: a pair or its half has to be inserted, or nothing.
END = (0, 4, 2, 0)
FAR = 1 << 60

Vector = tuple[int, int, int, int]


def _moves(code: tuple[str, int], q: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of one message from state ``q``, in ASCII order, insertion apart."""
    initial, fault = code
    out = [("D", 3, q)]
    if fault in (NONE, TRUNCATED):
        more = int(fault == TRUNCATED)
        if q in KEEPS.get(initial, ()):
            out.append(("K", more, KEEPS[initial][q]))
        out.append(("R", 2 + more, MADE[q]))
    return out


@cache
def _relative(after: Vector, code: tuple[str, int]) -> tuple[Vector, int]:
    """``back`` for a vector whose least entry is 0: the vector less its least entry, and that entry."""
    v = [min(cost + after[p] for _, cost, p in _moves(code, q)) for q in range(4)]
    v[USER], v[ASSISTANT] = min(v[USER], 2 + v[ASSISTANT]), min(v[ASSISTANT], 2 + v[USER])
    v[START], v[SYSTEM] = min(v[START], 2 + v[USER]), min(v[SYSTEM], 2 + v[USER])
    least = min(v)
    return _less(v, least), least


def back(after: Vector, code: tuple[str, int]) -> Vector:
    """Least costs from each state before a message, given those after it."""
    least = min(after)
    v, more = _relative(_less(after, least), code)
    return _less(v, -least - more)


def _less(v: Iterable[int], least: int) -> Vector:
    """The costs less ``least``; what can't be reached stays FAR."""
    return tuple(FAR if x >= FAR // 2 else x - least for x in v)


@cache
def _tight(after: Vector, code: tuple[str, int], q: int) -> tuple[str, int]:
    """The least tight edits of one message from state ``q``, insertions before it included, and the state after it."""
    v, more = _relative(after, code)
    edits = ""
    while True:
        left = v[q] + more
        found = {e: p for e, cost, p in _moves(code, q) if cost + after[p] == left}
        if "D" in found:
            return edits + "D", q
        if left == 2 + v[MADE[q]] + more:
            edits, q = edits + "I", MADE[q]
            continue
        edit = min(found)
        return edits + edit, found[edit]


def last_edits(q: int) -> str:
    """Insertions behind the last message."""
    return "I" * (END[q] // 2)


def walk(codes: list[tuple[str, int]], end: Vector, q: int) -> Iterator[tuple[str, int]]:
    """(edits, state after them) of every message of a block from state ``q``,
    ``end`` being the vector behind it. Vectors are stored at every k-th message and
    recomputed between, k being the square root of their number."""
    n = len(codes)
    k, stored, v = isqrt(n) + 1, {}, end
    for i in reversed(range(n)):
        if i == n - 1 or (i + 1) % k == 0:
            stored[i // k] = v
        v = back(v, codes[i])
    for part in range(0, n, k):
        v = stored[part // k]
        vectors = [v] + [v := back(v, c) for c in reversed(codes[part + 1 : part + k])]
        for c, v in zip(codes[part : part + k], reversed(vectors)):
            edits, q = _tight(_less(v, min(v)), c, q)
            yield edits, q


def cost(codes: list[tuple[str, int]]) -> int:
    """The least cost of a conversation's edits."""
    v = END
    for c in reversed(codes):
        v = back(v, c)
    return v[START]


def damage(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with faults by the CRC-32 of
    ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its
    ``.!?``, 3 repeats it, 4 makes it the user's. A null counts as one space; other columns go."""
    key = F.concat(_plain("conv_id"), F.lit(":"), _plain("turn"))
    fate = F.crc32(key.cast("binary")) % 20
    rows = messages.select("conv_id", "turn", _plain("role").alias("role"), _plain("text").alias("text"), fate.alias("__gm_fate")).where("__gm_fate <> 0")
    text = F.when(F.col("__gm_fate") == 1, "").when(F.col("__gm_fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__gm_fate") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("__gm_fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__gm_copy")).drop("__gm_copy")


def _plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _stream(messages: DataFrame) -> DataFrame:
    """conv, turn, role, text, fault and a place among equal messages, dealt by conversation."""
    rows = messages.select(F.col("conv_id").alias("conv"), "turn", _plain("role").alias("role"), _plain("text").alias("text")).repartition("conv")
    same = Window.partitionBy("conv", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    numbered = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("again", F.row_number().over(same)).drop("digest")
    bare = F.rtrim("text", F.lit(SPACES))
    fault = F.when(bare == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    return numbered.withColumn("fault", fault.cast("byte"))


def _sorted(rows: DataFrame) -> DataFrame:
    """In order of conversations and turns; ties by role, text and place among equals. What precedes a conversation's messages has a header."""
    return rows.sortWithinPartitions("conv", F.col("header").isNull(), F.col("turn").asc_nulls_first(), "role", "text", "again")


def _initial(role: bytes) -> str:
    return role.decode("utf-8", "replace")[:1]


def _matrix(codes: list[tuple[str, int]]) -> list[Vector]:
    """The block as a min-plus matrix: row q holds the costs from each state to q behind it."""
    out = []
    for q in range(4):
        v: Vector = tuple(0 if p == q else FAR for p in range(4))
        for c in reversed(codes):
            v = back(v, c)
        out.append(v)
    return out


def _block_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, header) of every conversation in (conv, size, role, fault): block size
    and the vectors at the ends of its blocks as one run of longs."""

    def done() -> pa.RecordBatch:
        matrices.append(_matrix(codes))
        v, ends = END, [END]
        for m in reversed(matrices[1:]):
            v = tuple(min(m[q][p] + v[q] for q in range(4)) for p in range(4))
            ends.append(v)
        header = np.array([size, *(x for v in reversed(ends) for x in v)], "<i8").tobytes()
        return pa.RecordBatch.from_arrays([now, pa.array([header], pa.binary())], names=["conv", "header"])

    now, matrices, codes, size = None, [], [], 0
    for b in pieces(batches):
        convs = b.column(0).to_pylist()
        for k, (conv, n, role, fault) in enumerate(zip(convs, b.column(1).to_pylist(), utf8(b.column(2)), b.column(3).to_pylist())):
            if now is None or conv != was:
                if now is not None:
                    yield done()
                now, was, matrices, codes, size = b.column(0).slice(k, 1), conv, [], [], n
            if len(codes) == size:
                matrices.append(_matrix(codes))
                codes = []
            codes.append((_initial(role), fault))
    if now is not None:
        yield done()


class _Conversation:
    """One conversation as it streams through a task: its counts, and the block that isn't walked yet."""

    def __init__(self, conv: Any, place: pa.Array) -> None:
        self.conv, self.place, self.size, self.ends = conv, place, None, [END]
        self.rows: list[tuple[bytes, bytes]] = []
        self.codes: list[tuple[str, int]] = []
        self.state, self.block, self.at = START, 0, 0
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.first, self.last, self.turns = None, None, 0
        self.audit: list[str] = []
        self.sha, self.lines, self.cost = hashlib.sha256(), 0, 0

    def begin(self, header: bytes) -> None:
        numbers = np.frombuffer(header, "<i8").tolist()
        self.size, self.ends = numbers[0], [tuple(numbers[k : k + 4]) for k in range(1, len(numbers), 4)]

    def add(self, turn: int | None, role: bytes, text: bytes, fault: int) -> list[tuple]:
        made = self.flush(self.ends[self.block]) if self.size and len(self.rows) == self.size else []
        initial = _initial(role)
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        self.rows.append((role, text))
        self.codes.append((initial, fault))
        return made

    def flush(self, end: Vector) -> list[tuple]:
        """The edits of the block: (place, edit, role, text), deleted messages without a role."""
        made = []
        for (role, text), (_, fault), (edits, state) in zip(self.rows, self.codes, walk(self.codes, end, self.state)):
            for e in edits:
                if e == "I":
                    self.state = MADE[self.state]
                    made.append(self._line(e, ROLES[self.state], b"", 2))
                elif e == "D":
                    made.append(self._line(e, None, text, 3))
                else:
                    made.append(self._line(e, role if e == "K" else ROLES[state], text, (2 if e == "R" else 0) + (fault == TRUNCATED)))
            self.state = state
        self.rows, self.codes, self.block = [], [], self.block + 1
        return made

    def finish(self) -> list[tuple]:
        made = self.flush(END)
        for e in last_edits(self.state):
            self.state = MADE[self.state]
            made.append(self._line(e, ROLES[self.state], b"", 2))
        return made

    def _line(self, edit: str, role: bytes | None, text: bytes, cost: int) -> tuple:
        self.audit.append(edit)
        self.cost += cost
        if role is not None:
            self.sha.update((b"\n" if self.lines else b"") + role + b":" + text)
            self.lines += 1
        self.at += 1
        return self.at - 1, edit, role, text

    def summary(self) -> list:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return [gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()]


def _walked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Conversation, list[tuple], bool]]:
    """Every conversation with the edits of a block, and whether it ends there."""
    now = None
    for b in pieces(batches):
        columns = (b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), utf8(b.column(3)), utf8(b.column(4)), b.column(5).to_pylist())
        for k, (conv, header, turn, role, text, fault) in enumerate(zip(*columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    yield now, now.finish(), True
                now = _Conversation(conv, b.column(0).slice(k, 1))
            if header is not None:
                now.begin(header)
            elif made := now.add(turn, role, text, fault):
                yield now, made, False
    if now is not None:
        yield now, now.finish(), True


def _ready(messages: DataFrame, block: int) -> DataFrame:
    """Sorted messages; those of a conversation of over ``block`` messages follow their vectors."""
    counted = messages.groupBy(F.col("conv_id").alias("conv")).count().where(F.col("count") > block)
    size = F.greatest(F.lit(block), F.ceil(F.sqrt("count"))).cast("long")
    long = cut(counted.select("conv", size.alias("size")))
    rows = _stream(messages).withColumn("header", F.lit(None).cast("binary"))
    if not long.isEmpty():
        few = messages.join(long.withColumnRenamed("conv", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "turn", "role", "text")
        kind = messages.schema["conv_id"].dataType.simpleString()
        sized = _stream(few).withColumn("header", F.lit(None).cast("binary")).join(long.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv")))
        sized = _sorted(sized.repartition("conv"))
        heads = cut(sized.select("conv", "size", "role", "fault").mapInArrow(_block_ends, f"conv {kind}, header binary"))
        rows = rows.unionByName(heads, allowMissingColumns=True).repartition("conv")
    return _sorted(rows).select("conv", "header", "turn", "role", "text", "fault")


def audit(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per ``conv_id`` of ``messages`` (conv_id, turn, role, text):
    ``gaps`` in the turns; messages whose first fault is ``blank``,
    ``duplicate`` (role and text seen earlier) or ``truncated``; ``illegal``
    neighbours; the ``cost`` of the cheapest edits, their initials as ``audit``, and
    the SHA-256 of the repaired ``role:text`` lines.

    Rows are taken by turn, nulls first, ties by role and text; a null role or
    text counts as one space. Rows without a ``conv_id`` are one conversation.
    Repeated rows are duplicates. Texts of any length; an empty table gives an
    empty one; other columns are ignored."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = messages.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, rows = [], []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.concat_arrays(places), *(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", *counts, "audit", "repaired_sha256"])

        for conversation, _, last in _walked(batches):
            if last:
                places.append(conversation.place)
                rows.append(conversation.summary())
                if len(rows) == 1024:
                    yield out()
                    places, rows = [], []
        if rows:
            yield out()

    return _ready(messages, block).mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, audit string, repaired_sha256 string")


def repair(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every edit as a row: ``conv_id``, its ``place`` in order, ``edit`` (D, I,
    K or R), and the ``role`` and ``text`` of the message that it leaves; a deleted
    one has no role and its old text. Odd rows as for ``audit``."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "edit", "role", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conversation, made, _ in _walked(batches):
            if made:
                place, edit, role, text = zip(*made)
                conv = pa.concat_arrays([conversation.place] * len(made))
                texts = [pa.array(x, pa.binary()).cast(pa.string()) for x in (role, text)]
                yield pa.RecordBatch.from_arrays([conv, pa.array(place, pa.int64()), pa.array(edit), *texts], names=names)

    return _ready(messages, block).mapInArrow(run, f"conv_id {kind}, place bigint, edit string, role string, text string")
