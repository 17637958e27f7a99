"""Repair of the structure of conversations: the cheapest edits that make their roles follow a grammar.

A conversation's rows and the grammar's states span a lattice: node (i, state) is reached when i rows are dealt with. Its
edges are the edits, and it is never built: Dijkstra's algorithm makes a node's edges when it is popped. The priority is
(cost, edits so far as a string); of two ways to a node with equal costs neither string leads the other, so what is
appended keeps their order, and the first accepting end node that is popped has the least cost and, of those, the least
string.

Rows are dealt out by ranges of (conversation, turn), so a conversation of any length is spread over tasks. One that lies
within a range and has up to `ROWS` rows is solved there. Any other is cut into segments; each is solved from every state
to every state, a task joins a conversation's segments by their best ways, and the edits go back to the segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm.common import shared_dir, split_join, written

#: Costs of an edit, and of keeping a row that is cut off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows, and characters, of a segment.
ROWS, CHARACTERS = 1024, 4_000_000
#: Grammar (s?(ua)+)?: state and initial of a role to the next state. 0: nothing yet, 1: after s, 2: after u, 3: after a.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING, STATES = (0, 3), range(4)
LEGAL = {"su", "ua", "au"}
WHITE, STOPS = " \t\n\x0b\x0c\r", ".!?"
ROLE_OF = {"u": "user", "a": "assistant"}


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged copies of rows, by crc32 of `conv_id:turn` modulo 20: 0 goes, 1 loses its text, 2 its `.!?`, 3 is there twice,
    4 gets the role user. Nulls count as one blank, but in conv_id and turn, which stay as they are."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def ways(rows: list[tuple[str, bool, bool]], start: int, accepting: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """Least (cost, edits) over rows of (initial, has to go, is cut off), from a state to all states; to one of the
    accepting states alone if they are given, which ends at the first of them."""
    heap, done, found, n = [(0, "", 0, start)], set(), {}, len(rows)
    while heap:
        cost, edits, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if accepting is None:
                found[state] = cost, edits
                if len(found) == len(STATES):
                    return found
            elif state in accepting:
                return {state: (cost, edits)}
        turned = [t for role in ROLE_OF if (t := STEP.get((state, role))) is not None]
        for t in turned:
            if (i, t) not in done:
                heappush(heap, (cost + INSERT, edits + "I", i, t))
        if i < n:
            initial, must_go, cut_off = rows[i]
            heappush(heap, (cost + DELETE, edits + "D", i + 1, state))
            if not must_go:
                extra = TRUNCATED if cut_off else 0
                kept = STEP.get((state, initial))
                if kept is not None:
                    heappush(heap, (cost + extra, edits + "K", i + 1, kept))
                for t in turned:
                    heappush(heap, (cost + extra + REROLE, edits + "R", i + 1, t))
    return found


def joined(left: dict, right: dict) -> dict:
    """Ways through two segments, by (from, to), from the ways through each."""
    out: dict = {}
    for (a, m), (cost, edits) in left.items():
        for (n, z), (more, rest) in right.items():
            if m == n:
                way = cost + more, edits + rest
                if (a, z) not in out or way < out[a, z]:
                    out[a, z] = way
    return out


def through(segments: list[dict]) -> dict:
    """Ways through segments in order; pairwise, so that long strings are copied a logarithmic number of times."""
    while len(segments) > 1:
        segments = [joined(*segments[k : k + 2]) if k + 1 < len(segments) else segments[k] for k in range(0, len(segments), 2)]
    return segments[0]


def state_after(elements: int, with_system: bool) -> int:
    """The grammar's state after so many roles; the first of an odd total is the system's."""
    if elements <= 1:
        return elements if with_system else 2 * elements
    return 2 + (elements + with_system + 1) % 2


def edited(roles: list[str], texts: list[str], edits: str, elements: int, with_system: bool) -> tuple[list[str], list[str]]:
    """Roles and texts after edits, where so many roles are there before."""
    out_roles, out_texts, i = [], [], 0
    for e in edits:
        role = ROLE_OF["a" if state_after(elements, with_system) == 2 else "u"]
        if e == "I":
            out_roles.append(role)
            out_texts.append("")
        elif e != "D":
            out_roles.append(roles[i] if e == "K" else role)
            out_texts.append(texts[i])
        i += e != "I"
        elements += e != "D"
    return out_roles, out_texts


@dataclass
class Segment:
    """Rows of a conversation, and what is counted of them."""

    rows: list = field(default_factory=list)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    turns: set = field(default_factory=set)
    counts: dict = field(default_factory=lambda: {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0})
    first_turn: int | None = None
    last_turn: int | None = None
    characters: int = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool) -> None:
        stripped = text.rstrip(WHITE)
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if stripped[-1:] not in STOPS else None
        if fault:
            self.counts[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        if not self.rows:
            self.first_turn = turn
        self.last_turn = turn
        if turn is not None:
            self.turns.add(turn)
        self.rows.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        self.roles.append(role)
        self.texts.append(text)
        self.characters += len(text)


_SEGMENT = pa.schema(
    [("key", pa.string()), ("pos", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "low", "high", "turns", "first_turn", "last_turn", "cost")]
    + [("head", pa.string()), ("tail", pa.string()), ("audit", pa.string()), ("ends", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
_SEGMENT_DDL = (
    "key string, pos long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, first_turn long, last_turn long, cost long, "
    "head string, tail string, audit string, ends array<int>, costs array<long>, audits array<string>, roles array<string>, texts array<string>"
)


def _told(key: str, pos: int, s: Segment, whole: bool) -> dict:
    row = {"key": key, "pos": pos, "whole": whole, "n": len(s.rows), **s.counts, "low": min(s.turns, default=None), "high": max(s.turns, default=None), "turns": len(s.turns)}
    row |= {"first_turn": s.first_turn, "last_turn": s.last_turn, "head": s.roles[0][:1], "tail": s.roles[-1][:1]}
    if whole:
        ((cost, edits),) = ways(s.rows, 0, ACCEPTING).values()
        roles, texts = edited(s.roles, s.texts, edits, 0, (len(edits) - edits.count("D")) % 2 == 1)
        return row | {"cost": cost, "audit": edits, "ends": None, "costs": None, "audits": None, "roles": roles, "texts": texts}
    found = {(a, z): way for a in STATES for z, way in ways(s.rows, a).items()}
    row |= {"cost": None, "audit": None, "ends": [4 * a + z for a, z in found], "costs": [w[0] for w in found.values()], "audits": [w[1] for w in found.values()]}
    return row | {"roles": s.roles, "texts": s.texts}


def _segments(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Rows in order to segments. The first and the last conversation of a range may go on in another one."""
    pos = TaskContext.get().partitionId() << 32
    out: list[dict] = []
    size = 0
    key = previous = None
    own: list[Segment] = []
    first = True

    def told(last: bool) -> None:
        nonlocal pos, size
        for s in own:
            out.append(_told(key, pos, s, len(own) == 1 and not first and not last))
            pos, size = pos + 1, size + s.characters + 100

    def flushed() -> pa.RecordBatch:
        nonlocal size
        batch = pa.RecordBatch.from_pylist(out, schema=_SEGMENT)
        out.clear()
        size = 0
        return batch

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            columns = [c.to_pylist() for c in batch.slice(start, 256).columns]
            for k, turn, role, text, digest, blank, later in zip(*columns, strict=True):
                if k != key:
                    if own:
                        told(False)
                        first = False
                        if size > CHARACTERS or len(out) > 2000:
                            yield flushed()
                    key, previous, own = k, None, []
                if not own or len(own[-1].rows) >= most or own[-1].characters >= CHARACTERS:
                    own.append(Segment())
                    if len(own) > 1:  # a long conversation: what is complete goes on
                        s = own.pop(0)
                        out.append(_told(key, pos, s, False))
                        pos += 1
                        yield flushed()
                        first = True
                own[-1].add(turn, role, text, blank, later or previous == (turn, digest))
                previous = turn, digest
    if own:
        told(True)
    if out:
        yield flushed()


_COMPOSED = pa.schema(
    [("key", pa.string()), ("pos", pa.int64()), ("elements", pa.int64()), ("with_system", pa.bool_()), ("edits", pa.string())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "gaps", "cost")]
    + [("audit", pa.string())]
)
_COMPOSED_DDL = "key string, pos long, elements long, with_system boolean, edits string, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, audit string"


def _composed(table: pa.Table) -> pa.Table:
    """All segments of a conversation: each one's edits, and the whole's counts in the row of the last one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
    ways_of = [{divmod(e, 4): (c, a) for e, c, a in zip(r["ends"], r["costs"], r["audits"], strict=True)} for r in rows]
    whole = through(ways_of)
    cost, audit = min(whole[0, z] for z in ACCEPTING if (0, z) in whole)
    with_system = (len(audit) - audit.count("D")) % 2 == 1
    out, at, elements = [], 0, 0
    none = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "gaps", "cost", "audit"))
    for r in rows:
        start, left = at, r["n"]
        while left:
            left -= audit[at] != "I"
            at += 1
        if r is rows[-1]:
            at = len(audit)
        edits = audit[start:at]
        out.append({"key": r["key"], "pos": r["pos"], "elements": elements, "with_system": with_system, "edits": edits} | none)
        elements += len(edits) - edits.count("D")
    pairs = list(zip(rows, rows[1:], strict=False))
    counts = {c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated", "illegal")}
    counts["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in pairs)
    distinct = sum(r["turns"] for r in rows) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
    low, high = [r["low"] for r in rows if r["low"] is not None], [r["high"] for r in rows if r["high"] is not None]
    out[-1] |= counts | {"gaps": max(high) - min(low) + 1 - distinct if low else 0, "cost": cost, "audit": audit}
    return pa.Table.from_pylist(out, schema=_COMPOSED)


_MESSAGES = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("whole", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_MESSAGES_DDL = "key string, pos long, whole boolean, roles array<string>, texts array<string>"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            (r,) = batch.slice(k, 1).to_pylist()
            roles, texts = edited(r["roles"], r["texts"], r["edits"], r["elements"], r["with_system"])
            yield pa.RecordBatch.from_pylist([{"key": r["key"], "pos": r["pos"], "whole": False, "roles": roles, "texts": texts}], schema=_MESSAGES)


@dataclass
class Repaired:
    """conversations: key, the counts of faults, gaps, cost and audit, a row each. messages: key, pos, whole, roles, texts:
    repaired rows in the order of pos, in one row where `whole`."""

    conversations: DataFrame
    messages: DataFrame


def key_of(conversation: Column) -> Column:
    """A text that tells conversations apart, a null one too."""
    return F.coalesce(F.concat(F.lit("#"), conversation.cast("string")), F.lit(""))


def repair(spark: SparkSession, rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", most: int = ROWS) -> Repaired:
    """Repairs all conversations that have rows; a segment has up to `most` of them. Their order is by turn, nulls first, of ties by role and a digest of role
    and text. Null roles and texts count as one blank, rows of a null conversation are one conversation; repeated rows are
    duplicates; an empty table gives none. Other columns, whatever their names, are not read.

    A row's first fault counts: blank; duplicate (its role and text came earlier in the conversation); truncated (its last
    character that isn't white space is none of `.!?`).
    """
    scratch = shared_dir(spark)
    blank_of = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    own = rows.select(key_of(rows[conversation]).alias("key"), rows[turn].cast("long").alias("turn"), blank_of(role).alias("role"), blank_of(text).alias("text"))
    own = own.withColumn("digest", F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)), 1, 16))
    own = own.withColumn("blank", ~F.col("text").rlike(f"[^{WHITE}]"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    repeated = own.where("not blank").groupBy("key", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    own = split_join(spark, own, repeated, ["key", "digest"], "left")
    later = F.coalesce(F.when(F.col("first.some"), F.col("turn") > F.col("first.turn")).otherwise(F.col("turn").isNotNull() & F.col("first").isNotNull()), F.lit(False))
    own = written(spark, own.select("key", "turn", "role", "text", "digest", "blank", later.alias("later")), f"{scratch}/rows")
    order = ["key", "turn", "role", "digest"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = own.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(partial(_segments, most=most), _SEGMENT_DDL)
    segments = written(spark, segments, f"{scratch}/segments")
    parts = segments.where("not whole")
    composed = parts.drop("roles", "texts", "cost", "audit").groupBy("key").applyInArrow(_composed, _COMPOSED_DDL)
    composed = written(spark, composed, f"{scratch}/composed")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    whole = segments.where("whole")
    found = whole.select("key", gaps, *counts, "cost", "audit").unionByName(composed.where("cost is not null").select("key", "gaps", *counts, "cost", "audit"))
    mended = parts.select("key", "pos", "roles", "texts").join(composed.select("key", "pos", "elements", "with_system", "edits"), ["key", "pos"]).mapInArrow(_apply, _MESSAGES_DDL)
    return Repaired(found, whole.select("key", "pos", "whole", "roles", "texts").unionAll(mended))


def digests(messages: DataFrame) -> DataFrame:
    """key, digest: SHA-256 of each conversation's `role:text` lines. It has to read them in order; a conversation in several
    rows streams through one task, a row at a time."""
    line = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    schema = pa.schema([("key", pa.string()), ("digest", pa.string())])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, empty = None, None, True
        for batch in batches:
            for k in range(batch.num_rows):
                own, lines = batch.column("key")[k].as_py(), batch.column("lines")[k].as_py()
                if own != key:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([{"key": key, "digest": state.hexdigest()}], schema=schema)
                    key, state, empty = own, hashlib.sha256(), True
                if lines:
                    state.update((lines if empty else "\n" + lines).encode())
                    empty = False
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "digest": state.hexdigest()}], schema=schema)

    short = messages.where("whole").select("key", F.sha2(line, 256).alias("digest"))
    long = messages.where("not whole").select("key", "pos", line.alias("lines")).repartition("key").sortWithinPartitions("key", "pos")
    return short.unionAll(long.mapInArrow(streamed, "key string, digest string"))
