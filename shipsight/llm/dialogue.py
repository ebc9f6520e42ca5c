"""Repair of conversation structure: the cheapest edits that give `(s?(ua)+)?`, found by divide and conquer in linear space.

Four states say what a repaired conversation holds so far: nothing, a system turn, and last a user's or an assistant's turn.
Forward costs from the start and backward costs from the end meet mid-conversation; the best state there splits the rows in
two halves that are solved alike, so nothing but two vectors and the answer is ever held. Of equally cheap crossings the one
with the least audit on its left is taken. For that, forward vectors carry the rank of each state's least audit among the
four: edits to different states differ before either ends, so ranks decide every later comparison.

Long conversations are cut into segments. A segment's table of costs and ranks from state to state takes part in the same
meeting as a single row does, so that first the states between segments are found, and then each segment is solved by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shipsight.functions.settle import settle

#: States, and the state after an inserted or reroled turn.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits, by initial; a truncated turn that stays costs one more.
COST = {"K": 0, "R": 2, "I": 2, "D": 3}
#: The inserts that end a conversation from each state.
TAIL = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FREE, LATE, GONE = 0, 1, 2  # of a turn: may stay, may stay at a cost, has to go
INITIALS = "sua"
#: A state that is dearer than another by more can't be on a cheapest way: two inserts and a deletion make up for any state.
SLACK = 8
#: White space, and what ends a sentence.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"

Table = tuple  # [from][to] -> (cost, key) or None
Vector = tuple  # costs and ranks by state; a cost of None is out of reach


def edits(code: int) -> Table:
    """The cheapest inserts and edit that take each state to each other one over a turn of this code, ties ASCII-least."""
    initial, fault = code % 4, code // 4
    best: list[list] = [[None] * 4 for _ in STATES]

    def offer(start: int, end: int, said: str) -> None:
        cost = sum(map(COST.__getitem__, said)) + (fault == LATE and said[-1] != "D")
        if best[start][end] is None or (cost, said) < best[start][end]:
            best[start][end] = (cost, said)

    for start in STATES:
        at, said = start, ""
        for _ in range(3):
            offer(start, at, said + "D")
            if fault != GONE:
                offer(start, NEXT[at], said + "R")
                if initial == 0 and at == NOTHING:
                    offer(start, SYSTEM, said + "K")
                if initial in (1, 2) and NEXT[at] == (USER, ASSISTANT)[initial - 1]:
                    offer(start, NEXT[at], said + "K")
            at, said = NEXT[at], said + "I"
    return tuple(map(tuple, best))


EDITS = [edits(code) for code in range(12)]


def ahead(vector: Vector, table: Table) -> tuple[Vector, int]:
    """The forward vector after one more item, its costs relative to the least, and that least."""
    costs, ranks = vector
    found = {}
    for end in STATES:
        ways = [(costs[s] + table[s][end][0], ranks[s], table[s][end][1]) for s in STATES if costs[s] is not None and table[s][end]]
        if ways:
            found[end] = min(ways)
    least = min(w[0] for w in found.values())
    found = {end: w for end, w in found.items() if w[0] <= least + SLACK}
    order = {way: i for i, way in enumerate(sorted({w[1:] for w in found.values()}))}
    return (tuple(found[t][0] - least if t in found else None for t in STATES), tuple(order[found[t][1:]] if t in found else 0 for t in STATES)), least


def behind(costs: tuple, table: Table) -> tuple:
    """Costs to the end from before an item, given those from after it; relative to the least."""
    found = []
    for start in STATES:
        ways = [costs[t] + table[start][t][0] for t in STATES if costs[t] is not None and table[start][t]]
        found.append(min(ways) if ways else None)
    least = min(c for c in found if c is not None)
    return tuple(None if c is None else c - least for c in found)


#: Steps taken before: costs within SLACK are few, so there are few of them.
AHEAD: dict[tuple, tuple[Vector, int]] = {}
BEHIND: dict[tuple, tuple] = {}


def ahead_of_turn(vector: Vector, code: int) -> tuple[Vector, int]:
    known = AHEAD.get((vector, code))
    if known is None:
        known = AHEAD[vector, code] = ahead(vector, EDITS[code])
    return known


def behind_turn(costs: tuple, code: int) -> tuple:
    known = BEHIND.get((costs, code))
    if known is None:
        known = behind(costs, EDITS[code])
        if len(BEHIND) < 1 << 16:
            BEHIND[costs, code] = known
    return known


def only(state: int) -> tuple:
    return tuple(0 if s == state else None for s in STATES)


def crossing(vector: Vector, costs: tuple) -> int:
    """The state through which the cheapest way goes, ties by the least audit before it."""
    return min((f + b, rank, s) for s, (f, rank, b) in enumerate(zip(*vector, costs)) if f is not None and b is not None)[2]


def forward(items, start: int, step: Callable) -> Vector:
    vector = only(start), (0,) * 4
    for item in items:
        vector, _ = step(vector, item)
    return vector


def meet(items, start: int, end: int, step: Callable, back: Callable, out: list[tuple[int, int]]) -> None:
    """Add the states before and after each item on the cheapest way from start to end."""
    if len(items) < 2:
        out += [(start, end)] * len(items)
        return
    half = len(items) // 2
    costs = only(end)
    for item in reversed(items[half:]):
        costs = back(costs, item)
    state = crossing(forward(items[:half], start, step), costs)
    meet(items[:half], start, state, step, back, out)
    meet(items[half:], state, end, step, back, out)


def last_state(items, step: Callable) -> int:
    """The state from which the conversation's end is cheapest."""
    return crossing(forward(items, NOTHING, step), tuple(len(TAIL[s]) * COST["I"] for s in STATES))


def summary(codes: bytes) -> list[tuple[tuple, tuple]]:
    """A segment as one item: from each state, costs and ranks to each other; costs are whole here."""
    out = []
    for start in STATES:
        vector, total = (only(start), (0,) * 4), 0
        for code in codes:
            vector, more = ahead_of_turn(vector, code)
            total += more
        out.append((tuple(None if c is None else c + total for c in vector[0]), vector[1]))
    return out


def as_table(flat: list) -> Table:
    """A summary, flattened costs before ranks, as an item."""
    return tuple(tuple(None if flat[4 * s + t] is None else (flat[4 * s + t], flat[16 + 4 * s + t]) for t in STATES) for s in STATES)


def solve(codes: bytes, counts: list[int], start: int, end: int) -> tuple[list[str], int]:
    """The edits of each turn (with those of its further copies) on the cheapest way, and their cost."""
    ways: list[tuple[int, int]] = []
    meet(codes, start, end, ahead_of_turn, behind_turn, ways)
    said, cost = [], 0
    for code, n, (a, b) in zip(codes, counts, ways):
        more, word = EDITS[code][a][b]
        said.append(word + "D" * (n - 1))
        cost += more + COST["D"] * (n - 1)
    return said, cost


def judged(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows without their texts: equal ones counted once with their number, and the faults of each."""
    last = F.substring(F.rtrim(F.col(text), F.lit(SPACES)), -1, 1)  # the last visible character
    slim = rows.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), digest(text).alias("digest"),
        (last == "").alias("blank"), (~last.isin(*ENDS)).alias("late"),
    )
    turns = slim.groupBy("conv_id", "turn", "role", "digest", "blank", "late").agg(F.count("*").alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    seen = turns.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("earliest"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    fault = F.when(F.col("blank") | (place > F.col("earliest")), GONE).when(F.col("late"), LATE).otherwise(FREE)
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), 3).otherwise(initial)
    return turns.join(seen, same).select("conv_id", "turn", "role", "digest", "n", "blank", (fault * 4 + initial).cast("int").alias("code"), initial.cast("int").alias("initial"))


def beside(rows: DataFrame, columns: list[str], more: str) -> StructType:
    """The schema of some columns of `rows` and further ones."""
    return StructType([*[rows.schema[c] for c in columns], *StructType.fromDDL(more).fields])


def digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def segmented(turns: DataFrame, segment_rows: int) -> DataFrame:
    """Turns in order as one row per segment: a conversation's rows within one range, in pieces of bounded length."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]
    kept = "array<struct<turn:bigint,role:string,digest:binary>>"
    schema = beside(turns, ["conv_id"], f"task int, segment long, codes binary, counts array<bigint>, turns {kept}, table array<bigint>, " + ", ".join(f"{c} long" for c in FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, done, held = TaskContext.get().partitionId(), 0, [], []
        into = None

        def close() -> None:
            nonlocal held, made
            if held:
                done.append(one_segment(held, task, made))
                held, made = [], made + 1

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), into)], schema=into)

        for batch in batches:
            into = into or pa.schema([batch.schema.field("conv_id"), *arrow_fields()])
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "n", "blank", "code", "initial"))):
                if held and (held[-1][0] != row[0] or len(held) >= segment_rows):
                    close()
                held.append(row)
            if len(done) > 1000:
                yield batch_of()
                done = []
        close()
        if done:
            yield batch_of()

    return turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


#: Numbers of a segment: faults by kind, unfit neighbours, initials at both ends, and its turn numbers.
FACTS = ("blank", "duplicate", "truncated", "illegal", "initial_first", "initial_last", "turn_first", "turn_last", "turn_count")


def arrow_fields() -> list[pa.Field]:
    kept = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]))
    kinds = {"task": pa.int32(), "segment": pa.int64(), "codes": pa.binary(), "counts": pa.list_(pa.int64()), "turns": kept, "table": pa.list_(pa.int64())}
    return [pa.field(name, kind) for name, kind in (kinds | dict.fromkeys(FACTS, pa.int64())).items()]


def fits(a: int, b: int) -> bool:
    """Whether turns with these initials may be neighbours."""
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def one_segment(rows: list[tuple], task: int, number: int) -> tuple:
    codes = bytes(r[6] for r in rows)
    counts = [r[4] for r in rows]
    flat = summary(codes)
    blank = sum(r[4] for r in rows if r[5])
    duplicate = sum(r[4] if r[6] // 4 == GONE else r[4] - 1 for r in rows if not r[5])
    truncated = sum(r[6] // 4 == LATE for r in rows)
    illegal = sum(counts) - len(rows) + sum(not fits(a[7], b[7]) for a, b in zip(rows, rows[1:]))
    numbers = [r[1] for r in rows if r[1] is not None] or [None]
    different = 0 if numbers[0] is None else 1 + sum(a != b for a, b in zip(numbers, numbers[1:]))
    table = [c for costs, _ in flat for c in costs] + [r for _, ranks in flat for r in ranks]
    turns = [{"turn": r[1], "role": r[2], "digest": r[3]} for r in rows]
    return rows[0][0], task, number, codes, counts, turns, table, blank, duplicate, truncated, illegal, rows[0][7], rows[-1][7], numbers[0], numbers[-1], different


def joined(segments: DataFrame) -> DataFrame:
    """The states before and after each segment, and what only neighbouring segments together tell."""
    columns = ["task", "segment", "table", "initial_first", "initial_last", "turn_first", "turn_last", "turn_count"]
    schema = "task int, segment long, start int, stop int, last boolean, border long, gaps long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> list[tuple]:
            if not held:
                return []
            items = [as_table(r[3]) for r in held]
            ways: list[tuple[int, int]] = []
            meet(items, NOTHING, last_state(items, ahead), ahead, behind, ways)
            turns = [r for r in held if r[6] is not None]
            known = sum(r[8] for r in turns) - sum(a[7] == b[6] for a, b in zip(turns, turns[1:]))
            gaps = turns[-1][7] - turns[0][6] + 1 - known if turns else 0
            border = [0] + [int(not fits(a[5], b[4])) for a, b in zip(held, held[1:])]
            return [(r[1], r[2], a, b, i == len(held) - 1, x, 0 if i else gaps) for i, (r, (a, b), x) in enumerate(zip(held, ways, border))]

        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()]
        for batch in batches:
            done = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *columns))):
                if held and held[-1][0] != row[0]:
                    done += close()
                    held = []
                held.append(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*close()), types)], names=names)

    return segments.select("conv_id", *columns).repartition("conv_id").sortWithinPartitions("conv_id", "task", "segment").mapInArrow(run, schema)


def solved(segments: DataFrame, states: DataFrame) -> DataFrame:
    """Each segment with its audit, its cost, and the turns of the repaired conversation."""
    line = "array<struct<role:string,turn:bigint,old:string,digest:binary>>"
    schema = beside(segments, ["conv_id", "task", "segment"], f"audit string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long, lines {line}")
    kind = pa.list_(pa.struct([("role", pa.string()), ("turn", pa.int64()), ("old", pa.string()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for codes, counts, turns, start, stop, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "counts", "turns", "start", "stop", "last"))):
                said, cost = solve(codes, counts, start, stop)
                lines, state = [], start
                for word, turn in zip(said, turns):
                    for edit in word:
                        if edit == "K":
                            state = (SYSTEM, USER, ASSISTANT)[INITIALS.index(turn["role"][0])]
                            lines.append({"role": turn["role"], "turn": turn["turn"], "old": turn["role"], "digest": turn["digest"]})
                        elif edit != "D":
                            state = NEXT[state]
                            lines.append({"role": ROLE[state]} | ({"turn": turn["turn"], "old": turn["role"], "digest": turn["digest"]} if edit == "R" else {}))
                if last:
                    for _ in TAIL[state]:
                        said.append("I")
                        cost, state = cost + COST["I"], NEXT[state]
                        lines.append({"role": ROLE[state]})
                found.append(("".join(said), cost, lines))
            audits, costs, lines = zip(*found) if found else ((), (), ())
            illegal = [a + b for a, b in zip(batch.column("illegal").to_pylist(), batch.column("border").to_pylist())]
            columns = {"audit": pa.array(audits, pa.string()), "cost": pa.array(costs, pa.int64()), "illegal": pa.array(illegal, pa.int64()), "lines": pa.array(lines, kind)}
            yield pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else batch.column(f.name) for f in schema], names=schema.names)

    return segments.join(states, ["task", "segment"]).mapInArrow(run, schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_rows: int = 16384) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation: a report (one row each) and the repaired turns.

    Turns are taken by number, nulls first, then by role and by digest of the text. A turn is blank without a visible
    character, else a duplicate where role and text were seen earlier in its conversation, else truncated where its last
    visible character is none of `.!?`. Keeping a turn costs 0, another role (user or assistant) 2, deleting 3 (required for
    blank turns and duplicates), inserting an empty user's or assistant's turn anywhere 2; a truncated turn that stays adds 1.
    The initials of the repaired roles match `(s?(ua)+)?`; of equally cheap audits the ASCII-least is taken.

    Report: conv_id, gaps (missing numbers between the first and the last turn, nulls aside), blank, duplicate, truncated,
    illegal (neighbours whose initials are not su, ua or au), cost (long), audit (initials of the edits in order). Repaired
    turns: conv_id, task, segment, line (which sort them), role, text.

    Null roles and texts count as one space, a null conv_id as a conversation of its own; repeated rows are duplicates; an empty
    table has no conversations; other columns are not read. Rows are ordered by ranges and cut into segments of at most
    `segment_rows`, so a conversation of any length is spread over tasks; only four-state tables of its segments, and in the
    report its audit, meet in one. Equal rows are counted before the shuffle, and texts wait outside until lines are known.
    """
    named = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    segments = settle(segmented(judged(named, "conv_id", "turn", "role", "text"), segment_rows))
    done = settle(solved(segments, joined(segments)))
    parts = F.array_sort(F.collect_list(F.struct("task", "segment", "audit")))
    sums = [F.sum(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    report = done.groupBy("conv_id").agg(*sums, F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    lines = done.select("conv_id", "task", "segment", F.posexplode("lines").alias("line", "l")).select("conv_id", "task", "segment", "line", "l.*")
    texts = named.select("conv_id", "turn", F.col("role").alias("old"), digest("text").alias("digest"), "text").groupBy("conv_id", "turn", "old", "digest").agg(F.first("text").alias("text"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.turn").eqNullSafe(F.col("b.turn")) & (F.col("a.old") == F.col("b.old")) & (F.col("a.digest") == F.col("b.digest"))
    repaired = lines.alias("a").join(texts.alias("b"), same, "left")
    return report, repaired.select("a.conv_id", "task", "segment", "line", "role", F.coalesce("text", F.lit("")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the turns as `role:text`, joined by line ends; texts stream past, none is held."""
    schema = beside(repaired, ["conv_id"], "repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, into = None, None, None
        for batch in batches:
            into = into or pa.schema([batch.schema.field("conv_id"), pa.field("repaired_sha256", pa.string())])
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if sha is None or conv != at:
                    if sha is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), into)], schema=into)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((at, sha.hexdigest()), into)], schema=into)

    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "task", "segment", "line").mapInArrow(run, schema)
