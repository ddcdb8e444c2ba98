"""Repair of conversations: the cheapest edits that make the roles alternate, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is a number of rows taken and the state that the repaired roles are in: nothing yet, after the system turn,
after a user turn, after an assistant turn. The edits are Keep, Rerole (to user or assistant), Delete and Insert (an empty user or assistant turn);
from each state at most one edit of a kind is legal, so an audit string tells one path. A repaired conversation is empty, or an optional system turn
followed by pairs of a user and an assistant turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import spread_lookup, stage

#: Blanks that a text is judged without (fixed).
BLANK = " \t\n\x0b\x0c\r"
#: Costs of the edits; of every row that is left cut off (fixed).
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
#: Rows of a conversation that one search takes; longer ones are searched in segments.
SEGMENT = 4096

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an initial, and the state after the one turn of user and assistant that is legal.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
#: Kinds of rows: to be deleted, or an initial and whether the text is cut off. The last stands behind all rows.
KINDS = [None, *((x, cut) for x in ("s", "u", "a", "") for cut in (False, True)), "end"]
DROP, END = 0, len(KINDS) - 1


def _edges(kind, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows taken, state, cost) of the edits at a row of this kind, in the order of their letters."""
    out = [] if kind == "end" else [("D", 1, state, DELETE)]
    out.append(("I", 0, TURN[state], INSERT))
    if kind not in (None, "end"):
        initial, cut = kind
        left = CUT_OFF if cut else 0
        if state in AFTER.get(initial, {}):
            out.append(("K", 1, AFTER[initial][state], left))
        out.append(("R", 1, TURN[state], REROLE + left))
    return out


FORWARD = [[[(taken * 4 + to - state, cost, letter) for letter, taken, to, cost in _edges(k, state)] for state in range(4)] for k in KINDS]
#: (step back, cost) to a state from the states before it: within a row (insertions), and over a row of each kind.
INSERTED = [[(state - to, INSERT) for state in range(4) if TURN[state] == to] for to in range(4)]
TAKEN = [[[(state - 4 - to, cost) for state in range(4) for _, taken, t, cost in _edges(k, state) if taken and t == to] for to in range(4)] for k in KINDS]


def search(kinds: bytes, source: int = START, targets: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Cost and audit of the cheapest path over rows of ``kinds`` from a state to one of the ``targets``, of equally cheap ones the ASCII-least; None
    without a path.

    Both heaps run until their tops add up to more than the best crossing, so every node of every cheapest path is settled from one
    side. The audit is then read off from the start, by the least letter that stays on such a path."""
    n = len(kinds)
    row = kinds + bytes([END])
    far = 1 << 60
    there, back = [far] * (4 * n + 4), [far] * (4 * n + 4)
    done, met = bytearray(4 * n + 4), bytearray(4 * n + 4)
    width = 4 * n + 4
    there[source] = 0
    ahead, behind, settled = [source], [], []
    for t in targets:
        back[4 * n + t] = 0
        heappush(behind, 4 * n + t)
    best = min((0 for t in targets if not n and t == source), default=far)
    while ahead and behind:
        if ahead[0] // width + behind[0] // width > best:
            break
        if ahead[0] // width <= behind[0] // width:
            cost, v = divmod(heappop(ahead), width)
            if done[v]:
                continue
            done[v] = 1
            settled.append(v)
            for step, c, _ in FORWARD[row[v >> 2]][v & 3]:
                w, c = v + step, cost + c
                if c < there[w]:
                    there[w] = c
                    heappush(ahead, c * width + w)
                if c + back[w] < best:
                    best = c + back[w]
        else:
            cost, v = divmod(heappop(behind), width)
            if met[v]:
                continue
            met[v] = 1
            i, state = v >> 2, v & 3
            for step, c in INSERTED[state] + (TAKEN[kinds[i - 1]][state] if i else []):
                w, c = v + step, cost + c
                if c < back[w]:
                    back[w] = c
                    heappush(behind, c * width + w)
                if c + there[w] < best:
                    best = c + there[w]
    if best >= far:
        return None
    goal = {4 * n + t for t in targets}
    on: set[int] = set()
    for v in sorted(settled, key=lambda v: (v >> 2, there[v]), reverse=True):
        cost = there[v]
        if v in goal and cost == best:
            on.add(v)
            continue
        for step, c, _ in FORWARD[row[v >> 2]][v & 3]:
            w = v + step
            if (w in on and there[w] == cost + c) or (met[w] and cost + c + back[w] == best):
                on.add(v)
                break
    v, cost, audit = source, 0, []
    while not (v in goal and cost == best):
        for step, c, letter in FORWARD[row[v >> 2]][v & 3]:
            w = v + step
            if (w in on and there[w] == cost + c) or (met[w] and cost + c + back[w] == best):
                audit.append(letter)
                v, cost = w, cost + c
                break
        else:
            raise AssertionError("a cheapest path breaks off")
    return best, "".join(audit)


@lru_cache(1 << 16)
def _short(kinds: bytes) -> tuple[int, str]:
    return search(kinds)


def cheapest(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation; short patterns come again and are remembered."""
    return _short(kinds) if len(kinds) <= 24 else search(kinds)


class Replay:
    """Puts an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, TURN[self.state]
            yield ROLE[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """The repaired turns up to and with this row."""
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = AFTER[role[0]][self.state]
            yield role, text
        elif letter == "R":
            self.state = TURN[self.state]
            yield ROLE[self.state], text

    def rest(self) -> Iterator[tuple[str, str]]:
        """The turns behind the last row."""
        yield from self._inserted()


class Digest:
    """SHA-256 of repaired turns as ``role:text``, joined by line feeds."""

    def __init__(self) -> None:
        self.hash, self.started = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.hash.update(f"{chr(10) * self.started}{role}:{text}".encode())
            self.started = True


def kind_of(role: str, drop: bool, cut: bool) -> int:
    return DROP if drop else KINDS.index((role[:1] if role[:1] in ("s", "u", "a") else "", cut))


_KIND = {(x, cut): KINDS.index((x if x in ("s", "u", "a") else "", cut)) for x in ("s", "u", "a", "") for cut in (False, True)}


class Facts:
    """Counts over rows in order: faults, illegal neighbours and the turns seen. ``join`` adds those of the rows that follow."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.turns = 0
        self.first = self.last = ""
        self.first_turn = self.last_turn = None

    def add(self, role: str, turn: int | None, fault: str | None) -> None:
        one = Facts()
        one.rows, one.first, one.last = 1, role[:1], role[:1]
        one.turns, one.first_turn, one.last_turn = int(turn is not None), turn, turn
        if fault:
            setattr(one, fault, 1)
        self.join(one)

    def join(self, other: Facts) -> None:
        if self.rows and other.rows:
            self.illegal += self.last + other.first not in ("su", "ua", "au")
        self.turns += other.turns - (other.turns > 0 and self.last_turn == other.first_turn)
        if self.first_turn is None:
            self.first_turn = other.first_turn
        if other.last_turn is not None:
            self.last_turn = other.last_turn
        if other.rows:
            self.first, self.last = self.first if self.rows else other.first, other.last
        for c in ("blank", "duplicate", "truncated", "illegal", "rows"):
            setattr(self, c, getattr(self, c) + getattr(other, c))

    def gaps(self) -> int:
        """Turn numbers missing between the least and the greatest, as 64-bit numbers."""
        found = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (found + (1 << 63)) % (1 << 64) - (1 << 63)

    def values(self) -> tuple[int, ...]:
        return self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damaged rows, by crc32 of ``conv:turn`` modulo 20: 0 marks the row as ``gone``, 1 empties the text, 2 takes its ``.!?`` out, 3 repeats the row, 4
    makes it a user's. Nulls are one space each, in the key as in role and text; conv and turn themselves stay null."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    body = F.when(case <= 1, "").when(case == 2, F.translate(blank(text), ".!?", "")).otherwise(blank(text))
    made = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.when(case == 4, "user").otherwise(blank(role)).alias("role"), body.alias("text"), (case == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(case == 3, 2).otherwise(1))).alias("copy"))
    return made.select(F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), F.col("text").alias(text), "gone")


def _flags(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank; whether its last character that is none is not ``.!?``."""
    kept = F.rtrim(text, F.lit(BLANK))
    return kept == "", ~F.substring(kept, -1, 1).isin(".", "!", "?")


ORDER = ["conv", "turn", "role", "text"]


def _rows(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"))
    empty, cut = _flags(F.col("text"))
    return out.select("*", empty.alias("empty"), cut.alias("cut"))


def _report(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = [*zip(*rows)]
    types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _short_ones(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations of at most ``SEGMENT`` rows, each in one task."""

    def one(conv, held: list[tuple]) -> tuple:
        facts, seen, kinds = Facts(), set(), bytearray()
        for turn, role, text, empty, cut in held:
            twice = (role, text) in seen
            seen.add((role, text))
            facts.add(role, turn, "blank" if empty else "duplicate" if twice else "truncated" if cut else None)
            initial = role[:1]
            kinds.append(DROP if empty or twice else _KIND[initial if initial in ("s", "u", "a") else "", cut])
        cost, audit = cheapest(bytes(kinds))
        replay, digest = Replay(audit), Digest()
        for _, role, text, _, _ in held:
            digest.add(replay.row(role, text))
        digest.add(replay.rest())
        return conv, *facts.values(), cost, audit, digest.hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out, type_ = None, None, [], None
        for batch in batches:
            type_ = batch.column("conv").type
            for conv, gone, *row in zip(*(batch.column(c).to_pylist() for c in ("conv", "gone", "turn", "role", "text", "empty", "cut"))):
                if held is None or conv != current:
                    if held is not None:
                        out.append(one(current, held))
                    current, held = conv, []
                if not gone:
                    held.append(tuple(row))
            if len(out) > 4096:
                yield _report(out, type_)
                out = []
        if held is not None:
            out.append(one(current, held))
        if out:
            yield _report(out, type_)

    ordered = rows.repartition("conv").sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(run, f"conv {kind}, {REPORT}")


_SEGMENT_COLUMNS = "part int, seq long, costs array<long>, audits array<string>, facts array<long>, edges array<string>, ends array<long>"


def _segments(rows: DataFrame, kind: str, limit: int) -> DataFrame:
    """Range-partitioned rows cut into segments of at most ``limit`` rows, each with the cheapest way from every state to every other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def closed(conv, type_, kinds: bytearray, facts: Facts) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            found = [search(bytes(kinds), s, (t,)) for s in range(4) for t in range(4)]
            cells = [[x[0] if x else None for x in found], [x[1] if x else None for x in found]]
            counts = [facts.blank, facts.duplicate, facts.truncated, facts.illegal, facts.rows, facts.turns]
            values = [(conv, type_), (part, pa.int32()), (seq, pa.int64()), (cells[0], pa.list_(pa.int64())), (cells[1], pa.list_(pa.string())), (counts, pa.list_(pa.int64())), ([facts.first, facts.last], pa.list_(pa.string())), ([facts.first_turn, facts.last_turn], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], names=["conv", "part", "seq", "costs", "audits", "facts", "edges", "ends"])

        current, kinds, facts, type_ = None, bytearray(), Facts(), None
        for batch in batches:
            type_ = batch.column("conv").type
            for conv, turn, role, empty, cut, n, fresh in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "empty", "cut", "n", "fresh"))):
                if kinds and conv != current:
                    yield closed(current, type_, kinds, facts)
                    kinds, facts = bytearray(), Facts()
                current = conv
                for copy in range(n):
                    twice = copy > 0 or not fresh
                    facts.add(role, turn, "blank" if empty else "duplicate" if twice else "truncated" if cut else None)
                    kinds.append(kind_of(role, empty or twice, cut))
                    if len(kinds) == limit:
                        yield closed(current, type_, kinds, facts)
                        kinds, facts = bytearray(), Facts()
        if kinds:
            yield closed(current, type_, kinds, facts)

    return rows.mapInArrow(run, f"conv {kind}, {_SEGMENT_COLUMNS}")


def _composed(segments: DataFrame, kind: str) -> DataFrame:
    """(conv, figures of the report but its digest): segments in a row, as the least of (cost, audit) over the states between them. No cheapest
    audit between two states begins another one (more insertions cost more), so least parts make the least whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ways, facts, type_ = None, None, None, None

        def closed() -> pa.RecordBatch:
            cost, audit = min(ways[t] for t in ENDS if t in ways)
            return _report([(current, *facts.values(), cost, audit, None)], type_)

        for batch in batches:
            type_ = batch.column("conv").type
            for s in batch.to_pylist():
                if ways is None or s["conv"] != current:
                    if ways is not None:
                        yield closed()
                    current, ways, facts = s["conv"], {START: (0, "")}, Facts()
                new: dict[int, tuple[int, str]] = {}
                for a, (cost, audit) in ways.items():
                    for b in range(4):
                        if s["costs"][4 * a + b] is not None:
                            way = (cost + s["costs"][4 * a + b], audit + s["audits"][4 * a + b])
                            new[b] = min(new.get(b, way), way)
                ways = new
                here = Facts()
                here.blank, here.duplicate, here.truncated, here.illegal, here.rows, here.turns = s["facts"]
                (here.first, here.last), (here.first_turn, here.last_turn) = s["edges"], s["ends"]
                facts.join(here)
        if ways is not None:
            yield closed()

    ordered = segments.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return ordered.mapInArrow(run, f"conv {kind}, {REPORT}")


def _replayed(rows: DataFrame, audits: DataFrame, schema: str, emit) -> DataFrame:
    """Rows (conv, turn, role, text, n) streamed past their conversation's audit; ``emit(conv, audit)`` makes an object that takes the repaired
    turns and yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, sink = None, None
        for batch in batches:
            for conv, audit, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "n"))):
                if audit is not None:
                    if replay is not None:
                        sink.add(replay.rest())
                        yield sink.close()
                    replay, sink = Replay(audit), emit(conv, batch.column("conv").type)
                else:
                    for _ in range(n):
                        sink.add(replay.row(role, text))
                    if sink.full():
                        yield sink.part()
        if replay is not None:
            sink.add(replay.rest())
            yield sink.close()

    head = audits.select("conv", F.lit(0).alias("body"), "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    both = head.unionByName(rows.select("conv", F.lit(1).alias("body"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "n"))
    return both.repartition("conv").sortWithinPartitions("conv", "body", *ORDER[1:]).mapInArrow(run, schema)


class _DigestSink(Digest):
    def __init__(self, conv, type_):
        super().__init__()
        self.conv, self.type_ = conv, type_

    def full(self) -> bool:
        return False

    def close(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([self.conv], self.type_), pa.array([self.hash.hexdigest()])], names=["conv", "digest"])


class _TurnSink:
    def __init__(self, conv, type_):
        self.conv, self.type_, self.turns, self.place = conv, type_, [], 0

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        self.turns.extend(turns)

    def full(self) -> bool:
        return len(self.turns) >= 1024

    def part(self) -> pa.RecordBatch:
        n, self.turns, turns = len(self.turns), [], self.turns
        self.place += n
        columns = [pa.array([self.conv] * n, self.type_), pa.array(range(self.place - n, self.place), pa.int64()), *(pa.array([t[i] for t in turns], pa.string()) for i in (0, 1))]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "place", "role", "text"])

    close = part


def _long_ones(rows: DataFrame, kind: str, limit: int) -> DataFrame:
    """Conversations of any length: no task holds more than a segment's rows (but for the audits, which are results)."""
    spark = rows.sparkSession
    here = rows.where("not gone").groupBy("conv", "turn", "role", "text", "empty", "cut").agg(F.count(F.lit(1)).alias("n"))
    here = stage(here.withColumn("same", F.sha2(F.to_json(F.struct("conv", "role", F.sha2("text", 256).alias("t"))), 256)), "turns")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = stage(here.groupBy("same").agg(F.min(at).alias("first")), "firsts")
    told = spread_lookup(here, firsts, ["same"]).withColumn("fresh", at.eqNullSafe(F.col("first"))).drop("same", "first")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = told.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    report = stage(_composed(stage(_segments(ordered, kind, limit), "segments"), kind), "repairs")
    digests = _replayed(here.select("conv", "turn", "role", "text", "n"), report.select("conv", "audit"), f"conv {kind}, digest string", _DigestSink)
    empty = rows.select("conv").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    named = empty.join(report.drop("repaired_sha256").withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c")
    named = named.join(digests.withColumnRenamed("conv", "_c"), F.col("conv").eqNullSafe(F.col("_c")), "left").drop("_c")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return named.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.lit(nothing)).alias("repaired_sha256"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per conversation: gaps (turn numbers missing between the least and the greatest), blank, duplicate and truncated rows
    (each row's first fault), illegal (neighbours whose initials are not su, ua or au), cost and audit of the cheapest repair and the SHA-256 of the
    repaired ``role:text`` lines.

    Rows are taken by turn (nulls first), rows of one turn by role and text. Null roles and texts are one space. An empty role, or one of another
    initial than s, u or a, is never kept as it is. Rows marked by the column ``gone`` only name their conversation; one without other rows
    has zeros, an empty audit and the digest of nothing. A null conv is one conversation. Texts may be of any length. Other columns are
    ignored. An empty table gives an empty table. Gaps wrap as 64-bit numbers.

    Conversations of more than ``segment`` rows are counted first. Their rows are range-partitioned, each segment is searched from every state to every
    other, and the segments are put together; only their digest (SHA-256 runs from the first byte to the last) streams a conversation through
    one task, in memory that does not depend on its length."""
    kind = rows.schema[conv].dataType.simpleString()
    ready = _rows(rows, conv, turn, role, text, gone)
    long_ones = stage(ready.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment).select(F.col("conv").alias("_c")), "long")
    same = F.col("conv").eqNullSafe(F.col("_c"))
    out = _short_ones(ready.join(long_ones, same, "left_anti"), kind)
    if not long_ones.isEmpty():
        out = out.unionByName(_long_ones(ready.join(long_ones, same, "left_semi"), kind, segment))
    return out.withColumnRenamed("conv", conv)


def repaired(rows: DataFrame, report: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """The repaired turns (conv, place, role, text) of the same ``rows`` by the audits of their ``report``."""
    kind = rows.schema[conv].dataType.simpleString()
    ready = _rows(rows, conv, turn, role, text, gone).where("not gone").withColumn("n", F.lit(1).cast("long"))
    audits = report.select(F.col(conv).alias("conv"), "audit")
    out = _replayed(ready, audits, f"conv {kind}, place long, role string, text string", _TurnSink)
    return out.select(F.col("conv").alias(conv), "place", F.col("role").alias(role), F.col("text").alias(text))
