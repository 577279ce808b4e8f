"""Conversation structure repair: the cheapest edits that make a conversation's roles (s?(ua)+)?, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of rows read and the role before (none, system, user, assistant). Edges are edits: Keep costs 0, Rerole to
the role that is due 2, Delete 3 (a must for blank and duplicate rows), Insert of the role that is due 2; a truncated row that stays adds 1. A forward and a
reverse heap meet; both go on until no path as cheap is left, so that every node of every cheapest path is settled by one of them. Of the crossings between
the two, all of equal cost, the path with the least audit (the edits' initials) is taken: as the initials tell the path and no cheapest audit begins another
one, it is found letter by letter among the edges that lie on cheapest paths.

Conversations stream through tasks in order of their turns, once for the audit and once for the repaired text, so texts are never gathered; a row
leaves two bytes and the digest of its role and text. Lattices of more than SEGMENT rows are cut into segments, whose cheapest paths between all roles are put together.

Defined cases: a null role or text is one space; a null conv_id is a conversation, a null turn comes first; rows of one turn are ordered by role and text; a
role counts by its initial; repeated rows are duplicates; texts are read whole, however long; a conversation without rows (all dropped) has zeros and an
empty audit; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize

SEGMENT = 1000
ENDS, BLANKS = ".!?", " \t\n\v\f\r"
#: States: nothing yet, after system, user, assistant. The state that an inserted or reroled row leads to, and its role.
NONE, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_BEFORE = tuple(tuple(s for s in range(4) if DUE[s] == t) for t in range(4))
#: States from which a row whose initial has a code (0: none of s, u, a) may be kept.
_KEPT_FROM = ((), (NONE,), (NONE, SYSTEM, ASSISTANT), (USER,))
#: A row: the code of its initial, whether it must go, whether it is truncated.
MUST_GO, TRUNCATED = 4, 8


def _next(rows: bytes, node: int) -> Iterator[tuple[str, int, int]]:
    """Edits at a node, least initial first, with cost and next node. A node is 4 * rows read + state."""
    i, state = node >> 2, node & 3
    row = rows[i] if i < len(rows) else None
    if row is not None:
        yield "D", 3, node + 4
    yield "I", 2, (i << 2) + DUE[state]
    if row is not None and not row & MUST_GO:
        stays = row >> 3
        if state in _KEPT_FROM[row & 3]:
            yield "K", stays, (i + 1 << 2) + (row & 3)
        yield "R", 2 + stays, (i + 1 << 2) + DUE[state]


def _previous(rows: bytes, node: int) -> Iterator[tuple[int, int]]:
    """Cost and node of the edits that lead to a node."""
    i, state = node >> 2, node & 3
    for s in _BEFORE[state]:
        yield 2, (i << 2) + s
    if i:
        row = rows[i - 1]
        yield 3, node - 4
        if not row & MUST_GO:
            stays = row >> 3
            if row & 3 == state:
                for s in _KEPT_FROM[state]:
                    yield stays, (i - 1 << 2) + s
            for s in _BEFORE[state]:
                yield 2 + stays, (i - 1 << 2) + s


def cheapest(rows: bytes, start: int = NONE, ends: tuple[int, ...] = (NONE, ASSISTANT)) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits of rows that lead from the state start to one of ends; None if there are none."""
    n = len(rows) << 2
    far = {start: 0}, {n + e: 0 for e in ends}
    heaps = [(0, start)], [(0, n + e) for e in ends]
    settled: tuple[set[int], set[int]] = set(), set()
    least = min((0 for node in far[0] if node in far[1]), default=math.inf)
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= least:
        side = int(heaps[1][0][0] < heaps[0][0][0])
        cost, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        own, other = far[side], far[1 - side]
        for c, to in (_previous(rows, node) if side else ((c, to) for _, c, to in _next(rows, node))):
            if cost + c < own.get(to, math.inf):
                own[to] = cost + c
                heapq.heappush(heaps[side], (cost + c, to))
                least = min(least, cost + c + other.get(to, math.inf))
    if least == math.inf:
        return None
    (ahead, back), (done, done_back) = far, settled
    crosses = lambda node, c: node in done_back and c + back[node] == least
    last = {n + e for e in ends}
    # Forward nodes on cheapest paths: the end, those with an edge across, and those before them.
    todo = [v for v in done if crosses(v, ahead[v]) or (v in last and ahead[v] == least) or any(crosses(to, ahead[v] + c) for _, c, to in _next(rows, v))]
    on_path = set(todo)
    while todo:
        v = todo.pop()
        for c, u in _previous(rows, v):
            if u in done and u not in on_path and ahead[u] + c == ahead[v]:
                on_path.add(u)
                todo.append(u)
    node, cost, audit = start, 0, []
    while not (cost == least and node in last):
        edit, c, to = next((e, c, to) for e, c, to in _next(rows, node) if crosses(to, cost + c) or (to in on_path and ahead[to] == cost + c))
        node, cost = to, cost + c
        audit.append(edit)
    return int(least), "".join(audit)


class Lattice:
    """A conversation's rows as they come: whole segments are put together at once, as the cheapest way to each state."""

    def __init__(self, segment: int = SEGMENT) -> None:
        self.segment, self.rows = segment, bytearray()
        self.ways: dict[int, tuple[int, list[str]]] = {NONE: (0, [])}

    def add(self, row: int) -> None:
        if len(self.rows) == self.segment:
            rows, ways = bytes(self.rows), self.ways
            self.ways = {s: way for s in range(4) if (way := _join(ways, rows, (s,)))}
            self.rows = bytearray()
        self.rows.append(row)

    def best(self) -> tuple[int, str]:
        cost, parts = _join(self.ways, bytes(self.rows), (NONE, ASSISTANT))
        return cost, "".join(parts)


def _join(ways: dict[int, tuple[int, list[str]]], rows: bytes, ends: tuple[int, ...]) -> tuple[int, list[str]] | None:
    found = [(cost + more[0], [*parts, more[1]]) for s, (cost, parts) in ways.items() if (more := cheapest(rows, s, ends))]
    low = min((cost for cost, _ in found), default=None)
    equal = [way for way in found if way[0] == low]
    return equal[0] if len(equal) == 1 else min(equal, key=lambda way: "".join(way[1]), default=None)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by the CRC-32 of `conv_id:turn`; dropped rows stay with gone set."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), twice.alias("copy")).drop("copy")


def _streamed(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def audits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text, gone): its faults, and the cost and audit of its repair."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close() -> tuple:
            cost, audit = state["lattice"].best()
            gaps = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
            return state["conv_id"], gaps, *state["faults"], state["illegal"], cost, audit

        for batch in batches:
            out = []
            for row in (r for k in range(0, len(batch), 500) for r in batch.slice(k, 500).to_pylist()):
                if state is None or state["conv_id"] != row["conv_id"]:
                    if state is not None:
                        out.append(close())
                    state = {"conv_id": row["conv_id"], "lattice": Lattice(segment), "faults": [0, 0, 0], "illegal": 0, "seen": set(), "initial": None, "turns": 0, "first": None, "last": None}
                if row["gone"]:
                    continue
                if row["turn"] is not None and (not state["turns"] or row["turn"] != state["last"]):
                    state["first"] = row["turn"] if not state["turns"] else state["first"]
                    state["last"], state["turns"] = row["turn"], state["turns"] + 1
                role, text = row["role"], row["text"].rstrip(BLANKS)
                told = hashlib.blake2b(f"{len(role)}:{role}{row['text']}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                fault = 0 if not text else 1 if told in state["seen"] else 2 if text[-1] not in ENDS else None
                state["seen"].add(told)
                if fault is not None:
                    state["faults"][fault] += 1
                if state["initial"] is not None and state["initial"] + role[:1] not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["initial"] = role[:1]
                state["lattice"].add(max(" sua".find(role[:1]), 0) | (MUST_GO if fault in (0, 1) else TRUNCATED if fault == 2 else 0))
            if out:
                yield _batch(out, names, kinds)
        if state is not None:
            yield _batch([close()], names, kinds)

    conv = rows.schema["conv_id"].dataType.simpleString()
    kinds = [pa.int64()] * 7 + [pa.string()] if conv == "bigint" else None
    return _streamed(rows.select("conv_id", "turn", "role", "text", "gone"), "turn", "role", "text").mapInArrow(run, f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType] | None) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds or [None] + [pa.int64()] * 6 + [pa.string()], strict=True)], names=names)


def repaired(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the repaired conversations in order (place). rows as for audits(), told its result."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, conv_id, place, role, text in _replayed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(conv_id, batch.schema.field("conv_id").type), pa.array(place, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "role", "text"])

    return _with_audits(rows, told).mapInArrow(run, f"conv_id {conv}, place long, role string, text string")


def digests(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the SHA-256 of each repaired conversation's `role:text`, joined by newlines, hashed as it streams."""
    conv = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = (), None, None
        for batch, conv_ids, places, roles, texts in _replayed(batches, starts=True):
            kind, out = batch.schema.field("conv_id").type, []
            for conv_id, place, role, text in zip(conv_ids, places, roles, texts, strict=True):
                if place < 0:
                    if now:
                        out.append((now[0], digest.hexdigest()))
                    now, digest = (conv_id,), hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out], pa.string())], ["conv_id", "repaired_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return _with_audits(rows, told).mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def _with_audits(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order."""
    heads = told.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    every = heads.unionByName(rows.where("not gone").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit")))
    return _streamed(every.withColumn("is_row", F.col("audit").isNull()), "is_row", "turn", "role", "text")


def _replayed(batches: Iterator[pa.RecordBatch], starts: bool = False) -> Iterator[tuple[pa.RecordBatch, list, list, list, list]]:
    """Lists of conv_id, place, role and text of the repaired rows, batch by batch; with starts set, a row of place -1 begins each conversation."""
    audit, at, state, place = "", 0, NONE, 0
    for batch in batches:
        out: tuple[list, list, list, list] = [], [], [], []

        def put(*row: object, out: tuple[list, list, list, list] = out) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def inserts(conv_id: object) -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = DUE[state]
                put(conv_id, place, ROLES[state], "")
                at, place = at + 1, place + 1

        for row in (r for k in range(0, len(batch), 500) for r in batch.slice(k, 500).to_pylist()):
            conv_id = row["conv_id"]
            if row["audit"] is not None:
                audit, at, state, place = row["audit"], 0, NONE, 0
                if starts:
                    put(conv_id, -1, None, None)
                inserts(conv_id)
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                state = " sua".index(row["role"][0])
                put(conv_id, place, row["role"], row["text"])
            elif edit == "R":
                state = DUE[state]
                put(conv_id, place, ROLES[state], row["text"])
            place += edit != "D"
            inserts(conv_id)
        yield batch, *out


def repair(rows: DataFrame) -> DataFrame:
    """audits() of rows with the digest of the repaired conversation. rows (conv_id, turn, role, text, gone) is read twice and is written first."""
    rows = materialize(rows, "repair-rows")
    told = materialize(audits(rows), "repair-audits")
    hashed = digests(rows, told)
    return told.join(hashed.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
