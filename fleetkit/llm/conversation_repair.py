"""Conversation structure repair: the cheapest edits that make a conversation alternate.

Rows are range-partitioned and sorted by conversation and turn, so a task walks
over whole conversations and keeps one at a time.  Each row becomes one sign (its
role's initial, capital if truncated, ``d`` if it must go), and the signs are
searched by iterative-deepening A*: depth first, edits in ASCII order, under a
cost bound that rises to the least cost not yet refuted.  Failed (row, state)
pairs keep the cost that was refuted for them, across all bounds.

A conversation of more than ``WHOLE`` rows is searched in pieces of ``PIECE``
rows: the search gives the least cost of each piece from each state to each
state, the sums of these from the end give the cost still to come at each
border, and the pieces' own edits follow from the start.  Strings of two
different paths of a piece always differ before either ends, so the ASCII-least
choice per piece is the ASCII-least whole.

A conversation that may continue in the next task (the first and last of each
task), or that is too long to be kept, leaves the walk row by row.  Its repeated
rows are found by an aggregate, its signs are gathered per task (``segments``),
and segments are put together by conversation.  Only its hash, which is one
sequence over all its texts by definition, reads the texts in one task, in
order and a batch at a time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm.common import keep, prepare, table, with_row_key

COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED = 5
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPT = (START, ASSISTANT)
#: What a rerole or an insert adds in each state (initial, next state).
WANTED = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 40
#: Rows of a conversation that are searched as one, and rows of a piece beyond that.
WHOLE, PIECE = 128, 8
#: A conversation beyond these is not kept by the walk.
KEEP_ROWS, KEEP_CHARS = 1024, 16_000_000
# Fixed value: the contract's white space.
BLANKS = "".join(map(chr, (0x20, *range(0x09, 0x0E))))


# ---------------------------------------------------------------- search
def after(state: int, initial: str) -> int | None:
    """State behind a kept row, None if the pattern forbids it."""
    if initial == "s":
        return SYSTEM if state == START else None
    return WANTED[state][1] if initial == WANTED[state][0] else None


def bounds(signs: str) -> list[int]:
    """Least cost of the rows from each one on: rows that must go, truncated rows (gone or
    dearer), foreign roles, and half of the neighbouring clean rows that have one initial
    (an edit of cost 1 mends two such pairs at best)."""
    forced, pairs, last, out = 0, 0, "", [0]
    for sign in reversed(signs):
        if sign == "d" or sign.isupper():
            forced += 2
        elif sign in "ua":
            pairs += sign == last
            last = sign
        else:
            forced += sign == "x"
            last = ""
        out.append(forced + (pairs + 1) // 2)
    return out[::-1]


@lru_cache(100_000)
def search(signs: str, start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """Cheapest edits of ``signs`` from state ``start``, ties ASCII-least: (cost, audit).

    With ``goal`` the path ends in that state right behind the last row; without,
    it ends in an accepting state and may insert at the end.  None: no path."""
    least, proven, path, n = bounds(signs), {}, [], len(signs)

    def moves(i, state):
        initial, behind = WANTED[state]
        if i < n:
            yield "D", COSTS["D"], i + 1, state
        if i < n or goal is None:
            yield "I", COSTS["I"], i, behind
        if i < n and signs[i] != "d":
            extra = TRUNCATED if signs[i].isupper() else 0
            kept = after(state, signs[i].lower())
            if kept is not None:
                yield "K", COSTS["K"] + extra, i + 1, kept
            yield "R", COSTS["R"] + extra, i + 1, behind

    def descend(i, state, left) -> bool:
        if i == n and (state in ACCEPT if goal is None else state == goal):
            return True
        refuted = NEVER
        for letter, cost, j, behind in moves(i, state):
            if cost + proven.get((j, behind), least[j]) <= left and descend(j, behind, left - cost):
                path.append(letter)
                return True
            refuted = min(refuted, cost + proven.get((j, behind), least[j]))
        proven[i, state] = refuted
        return False

    bound = least[0]
    while bound < NEVER:
        if descend(0, start, bound):
            return bound, "".join(reversed(path))
        bound = proven[0, start]
    return None


def pieces(signs: str) -> list[str]:
    return [signs[i:i + PIECE] for i in range(0, len(signs), PIECE)]


def crossing(piece: str, start: int, goal: int) -> tuple[int, str] | None:
    """``search`` between two states; paths that the pattern rules out are not tried."""
    if goal < start and (goal, start) != (USER, ASSISTANT):
        return None                                      # nothing leads back to the beginning
    if (start, goal) == (START, SYSTEM) and not set("sS") & set(piece):
        return None
    if not piece:
        return (0, "") if start == goal else None
    return search(piece, start, goal)


def to_come(signs: str, end: list[int]) -> list[list[int]]:
    """Least cost still to come at each piece's border, by state, if ``end`` is that behind the last."""
    out = [end]
    for piece in reversed(pieces(signs)):
        row = []
        for start in range(4):
            ways = [(crossing(piece, start, goal), out[-1][goal]) for goal in range(4)]
            row.append(min((way[0] + rest for way, rest in ways if way), default=NEVER))
        out.append(row)
    return out[::-1]


def crossed(signs: str) -> list[list[int]]:
    """Least cost of ``signs`` from each state to each state."""
    columns = [to_come(signs, [0 if s == goal else NEVER for s in range(4)])[0] for goal in range(4)]
    return [[columns[goal][start] for goal in range(4)] for start in range(4)]


def followed(signs: str, start: int, end: list[int]) -> tuple[int, str]:
    """The cheapest, ASCII-least edits from ``start`` if ``end`` is the cost to come behind: (state, audit)."""
    rest, state, audit = to_come(signs, end), start, []
    for k, piece in enumerate(pieces(signs)):
        best = None
        for goal in range(4):
            way = crossing(piece, state, goal)
            if way and way[0] + rest[k + 1][goal] == rest[k][state] and (best is None or way[1] < best[1]):
                best = goal, way[1]
        state = best[0]
        audit.append(best[1])
    return state, "".join(audit)


#: Cost to come behind the last row: what must be inserted to reach an accepting state.
END = [0, 2 * COSTS["I"], COSTS["I"], 0]
CLOSING = ["", "II", "I", ""]


def repair(signs: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if len(signs) <= WHOLE:
        return search(signs)
    state, audit = followed(signs, START, END)
    return to_come(signs, END)[0][START], audit + CLOSING[state]


class Writer:
    """Hash of the repaired rows, fed row by row."""

    def __init__(self):
        self.sha, self.state, self.empty = hashlib.sha256(), START, True
        self.audit, self.at = "", 0

    def _write(self, row: str) -> None:
        self.sha.update((row if self.empty else "\n" + row).encode())
        self.empty = False

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            initial, self.state = WANTED[self.state]
            self._write(ROLE[initial] + ":")
            self.at += 1

    def edits(self, audit: str) -> None:
        """The edits of the rows that follow; what is left of the ones before is inserted."""
        self._inserts()
        self.audit, self.at = audit, 0

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = after(self.state, role[:1])
            self._write(f"{role}:{text}")
        elif letter == "R":
            initial, self.state = WANTED[self.state]
            self._write(f"{ROLE[initial]}:{text}")

    def digest(self) -> str:
        self._inserts()
        return self.sha.hexdigest()


# ---------------------------------------------------------------- rows
def damaged(rows: DataFrame, name: str = "repair-rows") -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the contract's damage.

    Returns rid, copy (1 for the repeated row), conv_id, turn, role, text, gone
    (a dropped row: it only says that its conversation occurs)."""
    nothing = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(nothing("conv_id"), F.lit(":"), nothing("turn"))) % 20
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (with_row_key(rows, ["conv_id", "turn", "role", "text"], name)
            .select("rid", "conv_id", "turn", kind.alias("kind"), nothing("role").alias("role"), nothing("text").alias("text"))
            .select("rid", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
                    "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    text.alias("text"), (F.col("kind") == 0).alias("gone")))


def sign(role: str, text: str, repeated: bool) -> tuple[str, int]:
    """A row's sign and its fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    end = text.rstrip(BLANKS)[-1:]
    if not end:
        return "d", 1
    if repeated:
        return "d", 2
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return (letter, 0) if end in ".!?" else (letter.upper(), 3)


class Tally:
    """Counts of a conversation's rows, in order."""

    def __init__(self):
        self.faults, self.illegal, self.initials = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, fault: int, initial: str, turn: int | None) -> None:
        self.faults[fault] += 1
        if self.initials is None:
            self.initials = [initial, initial]
        else:
            self.illegal += self.initials[1] + initial not in LEGAL
            self.initials[1] = initial
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def join(self, other: "Tally") -> None:
        """Adds the counts of the rows that follow."""
        if other.initials is None:
            return
        self.faults = [x + y for x, y in zip(self.faults, other.faults)]
        self.illegal += other.illegal
        if self.initials is None:
            self.initials = list(other.initials)
        else:
            self.illegal += self.initials[1] + other.initials[0] not in LEGAL
            self.initials[1] = other.initials[1]
        if other.low is not None:
            self.turns += other.turns - (other.low == self.high)
            self.low = other.low if self.low is None else self.low
            self.high = other.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


RESULT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")
RESULT_NAMES = [x.split()[0] for x in RESULT.split(", ")]
ROW = "pid int, at long, turn long, role string, text string, gone boolean"
WALKED = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in RESULT_NAMES[1:7]], ("audit", pa.string()),
                    ("repaired_sha256", pa.string()), ("pid", pa.int32()), ("at", pa.int64()), ("turn", pa.int64()),
                    ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_())])


def _solved(conv, rows) -> dict:
    """The result of a whole conversation: rows of (turn, role, text, gone)."""
    tally, signs, seen = Tally(), [], set()
    rows = [r for r in rows if not r[3]]
    for turn, role, text, _ in rows:
        letter, fault = sign(role, text, (role, text) in seen)
        seen.add((role, text))
        signs.append(letter)
        tally.add(fault, role[:1], turn)
    cost, audit = repair("".join(signs))
    out = Writer()
    out.edits(audit)
    for _, role, text, _ in rows:
        out.row(role, text)
    return _result(conv, tally, cost, audit, out.digest())


def _result(conv, tally: Tally, cost: int, audit: str, digest: str | None) -> dict:
    return dict(zip(RESULT_NAMES, (conv, tally.gaps(), *tally.faults[1:], tally.illegal, cost, audit, digest)))


def _walk(batches, keep_rows: int, keep_chars: int):
    """Sorted rows -> one result row per conversation that lies in this task for sure; the rows of all others."""
    buffer: list[dict] = []
    state = {"conv": None, "first": True, "long": False, "chars": 0, "at": 0, "any": False}
    out: list[dict] = []

    def rows_out():
        out.extend(buffer)
        buffer.clear()

    def end(last: bool):
        if not state["any"]:
            return
        if state["first"] or last or state["long"]:
            rows_out()
        else:
            out.append(_solved(state["conv"], [(r["turn"], r["role"], r["text"], r["gone"]) for r in buffer]))
            buffer.clear()

    def batch():
        table_ = pa.RecordBatch.from_pylist(out, WALKED)
        out.clear()
        return table_

    for b in batches:
        for r in b.to_pylist():
            if not state["any"] or r["conv_id"] != state["conv"]:
                end(False)
                state |= {"first": not state["any"], "conv": r["conv_id"], "long": False, "chars": 0, "any": True}
            state["chars"] += len(r["text"])
            buffer.append(r | {"at": state["at"]})
            state["at"] += 1
            if len(buffer) > keep_rows or state["chars"] > keep_chars:
                state |= {"long": True, "chars": 0}
                rows_out()
            if len(out) >= 2000:
                yield batch()
        if out:
            yield batch()
    end(True)
    if out:
        yield batch()


# ---------------------------------------------------------------- conversations over several tasks
TALLY = "faults array<long>, illegal long, initials array<string>, low long, high long, turns long"
TALLY_FIELDS = [x.split()[0] for x in TALLY.split(", ")]


def _tally_row(t: Tally) -> dict:
    return {c: getattr(t, c) for c in TALLY_FIELDS}


def _tally_of(row: dict) -> Tally:
    t = Tally()
    for c in TALLY_FIELDS:
        setattr(t, c, row[c])
    return t


def _arrow(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
             "array<string>": pa.list_(pa.string())}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]))


SEGMENT = f"conv_id long, pid int, signs string, costs array<long>, {TALLY}"


def _segments(batches):
    """Rows without texts, sorted by conversation and task, -> one row per segment: its signs, costs and counts."""
    now, signs, tally = None, [], Tally()

    def segment():
        text = "".join(signs)
        return _arrow([{"conv_id": now[0], "pid": now[1], "signs": text, "costs": sum(crossed(text), [])} | _tally_row(tally)],
                      SEGMENT).to_batches()

    for b in batches:
        for r in b.to_pylist():
            if (r["conv_id"], r["pid"]) != now:
                if now is not None:
                    yield from segment()
                now, signs, tally = (r["conv_id"], r["pid"]), [], Tally()
            if not r["gone"]:
                letter = r["sign"]
                fault = 2 if r["repeated"] and r["fault"] != 1 else r["fault"]
                signs.append("d" if fault == 2 else letter)
                tally.add(fault, r["initial"], r["turn"])
    if now is not None:
        yield from segment()


def _remaining(key, t):
    """Segments of a conversation -> the cost to come behind each."""
    rows, rest, out = t.sort_by("pid").to_pylist(), END, []
    for r in reversed(rows):
        out.append({"conv_id": r["conv_id"], "pid": r["pid"], "rest": rest})
        rest = [min(r["costs"][4 * s + g] + rest[g] for g in range(4)) for s in range(4)]
    return _arrow(out, "conv_id long, pid int, rest array<long>")


PATHS = f"conv_id long, pid int, ends array<long>, audits array<string>, cost long, {TALLY}"


def _paths(batches):
    """Segments with the cost to come -> the end state and the edits from each state."""
    for b in batches:
        for r in b.to_pylist():
            start_cost = to_come(r["signs"], r["rest"])[0]
            ways = [followed(r["signs"], s, r["rest"]) if start_cost[s] < NEVER else (s, "") for s in range(4)]
            yield from _arrow([{"conv_id": r["conv_id"], "pid": r["pid"], "ends": [w[0] for w in ways],
                                "audits": [w[1] for w in ways], "cost": start_cost[START]}
                               | {c: r[c] for c in TALLY_FIELDS}], PATHS).to_batches()


def _chained(key, t):
    """Segments of a conversation -> its result without the hash (pid null), and each segment's edits."""
    state, tally, out, parts, rows = START, Tally(), [], [], t.sort_by("pid").to_pylist()
    for k, r in enumerate(rows):
        audit, state = r["audits"][state], r["ends"][state]
        audit += CLOSING[state] if k == len(rows) - 1 else ""
        parts.append(audit)
        out.append({"conv_id": r["conv_id"], "pid": r["pid"], "audit": audit})
        tally.join(_tally_of(r))
    out.append(_result(rows[0]["conv_id"], tally, rows[0]["cost"], "".join(parts), None))
    return _arrow(out, RESULT + ", pid int")


def _hashed(batches):
    """Sorted edits and rows of conversations -> (conv_id, repaired_sha256)."""
    now, out = None, None
    done = lambda: _arrow([{"conv_id": now[0], "repaired_sha256": out.digest()}],
                          "conv_id long, repaired_sha256 string").to_batches()
    for b in batches:
        for r in b.to_pylist():
            if (r["conv_id"],) != now:
                if now is not None:
                    yield from done()
                now, out = (r["conv_id"],), Writer()
            if r["at"] < 0:
                out.edits(r["text"])
            else:
                out.row(r["role"], r["text"])
    if now is not None:
        yield from done()


def _across(parts: DataFrame) -> DataFrame:
    """Results of the conversations whose rows the walk passed on."""
    row = parts.select("conv_id", "pid", "at", "turn", "role", "gone", F.md5("text").alias("digest"),
                       F.rtrim("text", F.lit(BLANKS)).alias("trimmed"))
    initial = F.left("role", F.lit(1))
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    last = F.right("trimmed", F.lit(1))
    fault = F.when(F.col("trimmed") == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    row = row.select(
        "conv_id", "pid", "at", "turn", "role", "digest", "gone", initial.alias("initial"), fault.cast("long").alias("fault"),
        F.when(F.col("trimmed") == "", "d").when(fault == 3, F.upper(letter)).otherwise(letter).alias("sign"))
    # repeated rows: only texts that occur more than once are joined back
    repeats = (row.where("not gone and fault <> 1").groupBy("conv_id", "role", "digest")
               .agg(F.min(F.struct("pid", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").alias("f"))
    marked = row.alias("r").join(repeats, F.expr(
        "r.conv_id <=> f.conv_id AND r.role = f.role AND r.digest = f.digest AND NOT r.gone"), "left").select(
        "r.conv_id", "r.pid", "r.at", "r.turn", "r.gone", "r.initial", "r.fault", "r.sign",
        F.coalesce(F.expr("struct(r.pid, r.at) > f.first"), F.lit(False)).alias("repeated"))
    segments = keep(marked.repartition("conv_id", "pid").sortWithinPartitions("conv_id", "pid", "at")
                    .mapInArrow(_segments, SEGMENT), "repair-segments")
    rest = segments.select("conv_id", "pid", "costs").groupBy("conv_id").applyInArrow(
        _remaining, "conv_id long, pid int, rest array<long>")
    paths = (segments.alias("s").join(rest.alias("t"), F.expr("s.conv_id <=> t.conv_id AND s.pid = t.pid"))
             .select("s.*", "t.rest").mapInArrow(_paths, PATHS))
    chained = keep(paths.groupBy("conv_id").applyInArrow(_chained, RESULT + ", pid int"), "repair-paths")
    edits = chained.where("pid is not null").select(
        "conv_id", "pid", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    hashed = (edits.union(parts.where("not gone").select("conv_id", "pid", "at", "role", "text"))
              .repartition("conv_id").sortWithinPartitions("conv_id", "pid", "at")
              .mapInArrow(_hashed, "conv_id long, repaired_sha256 string"))
    return (chained.where("pid is null").drop("repaired_sha256", "pid").alias("c")
            .join(hashed.alias("h"), F.expr("c.conv_id <=> h.conv_id"))
            .select("c.*", "h.repaired_sha256").select(RESULT_NAMES))


def repaired(rows: DataFrame, keep_rows: int = KEEP_ROWS, keep_chars: int = KEEP_CHARS) -> DataFrame:
    """Cheapest repair of every conversation among ``rows`` (rid, copy, conv_id, turn, role, text, gone; no nulls in
    role and text), as ``damaged`` returns them.

    Order: turn (nulls first), then role, digest of the text and row key, so rows of one turn
    have a defined order.  A null conv_id is a conversation like any other.  A role that does not
    begin with s, u or a (an empty one too) must be reroled or deleted.  Conversations without any row
    left give zeros, an empty audit and the hash of nothing.  No rows: no results.  A conversation beyond
    ``keep_rows`` rows or ``keep_chars`` characters is not held in memory (same results)."""
    prepare(rows.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(),
             F.col("digest").asc(), F.col("rid").asc(), F.col("copy").asc()]
    ordered = (rows.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
               .withColumn("digest", F.md5("text")).repartitionByRange(*order).sortWithinPartitions(*order)
               .select("conv_id", F.spark_partition_id().alias("pid"), "turn", "role", "text", "gone"))
    walked = keep(ordered.mapInArrow(partial(_walk, keep_rows=keep_rows, keep_chars=keep_chars), f"{RESULT}, {ROW}"), "repair-walk")
    return (walked.where("pid is null").select(RESULT_NAMES)
            .unionByName(_across(walked.where("pid is not null").select("conv_id", *[x.split()[0] for x in ROW.split(", ")]))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of all damaged ``conversations``."""
    return repaired(damaged(table(spark, sf_dir, "conversations")))
