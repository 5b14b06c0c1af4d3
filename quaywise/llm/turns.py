"""Conversation structure repair: a dynamic program over edits with square-root checkpoints.

Edits turn the rows of a conversation, in order of turn, into one whose role initials read
``(s?(ua)+)?``. A state says what was emitted last (nothing, system, user, assistant); the
vector of a row holds, for each state, the least cost from there to the end. Vectors are
computed backwards and stored at checkpoints only, one in about the square root of the
rows; walking forward, each block's vectors are computed again from the checkpoint behind
it, and the least letter among the cheapest edits is taken. A letter leads to one state
only, so this gives the ASCII-least of all cheapest edit strings.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation with very
many rows spreads over tasks. A task finishes the conversations that lie whole between its
first and last one; of the others it leaves slices of bounded size. A slice is a min-plus
matrix from the vector behind it to the one before it. Folding the matrices of a
conversation gives the vectors at the slices' borders, which are checkpoints too; each
slice is then walked from all four states, and folding their ends gives the state in which
each slice is entered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, partitions, read_table

#: Rows and characters of a slice, about.
SLICE_ROWS, SLICE_CHARS = 4096, 4 << 20

KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
_BLANKS = " \t\n\x0b\x0c\r"
_NEVER = 1 << 40
# states: nothing yet, after system, after user, after assistant
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_NAMES = {_USER: "user", _ASSISTANT: "assistant"}
#: Least cost from each state when no row is left.
END = (0, 2 * INSERT, INSERT, 0)
# a row's code: role initial (s, u, a, other), truncated, must be deleted
_TRUNCATED, _MUST = 4, 8


def _target(code: int, state: int) -> int:
    """The state after keeping a row, -1 where it can't be kept."""
    initial = code & 3
    if initial == 0:
        return _SYSTEM if state == _START else -1
    if initial == 1:
        return -1 if state == _USER else _USER
    return _ASSISTANT if initial == 2 and state == _USER else -1


# keeping a row by code and state, as a table
_KEPT = [[-1 if code & _MUST else _target(code, state) for state in range(4)] for code in range(16)]


def back(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before a row from the one behind it."""
    own = [x + DELETE for x in after]
    if not code & _MUST:
        late = 1 if code & _TRUNCATED else 0
        kept = _KEPT[code]
        for q in range(4):
            own[q] = min(own[q], after[_NEXT[q]] + REROLE + late)
            if kept[q] >= 0:
                own[q] = min(own[q], after[kept[q]] + KEEP + late)
    u, a = min(own[2], own[3] + INSERT), min(own[3], own[2] + INSERT)
    return min(own[0], u + INSERT), min(own[1], u + INSERT), u, a


def matrix(codes: bytes) -> list[int]:
    """Cost of going through the rows from each state to each state, row by row."""
    columns = []
    for r in range(4):
        v = tuple(0 if q == r else _NEVER for q in range(4))
        for code in reversed(codes):
            v = back(code, v)
        columns.append(v)
    return [min(columns[r][q], _NEVER) for q in range(4) for r in range(4)]


def walk(codes: bytes, after: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
    """The edits of the rows and the state behind them; with ``last`` also the inserts at the end."""
    n = len(codes)
    block = isqrt(n) + 1
    marks = {}
    v = after
    for i in range(n, 0, -1):
        if i % block == 0 or i == n:
            marks[i] = v
        v = back(codes[i - 1], v)
    out = []
    for lo in range(0, n, block):
        hi = min(lo + block, n)
        vectors = [marks[hi]]
        for i in range(hi, lo, -1):
            vectors.append(back(codes[i - 1], vectors[-1]))
        vectors.reverse()
        for i in range(lo, hi):
            here, there, code = vectors[i - lo], vectors[i - lo + 1], codes[i]
            late = 1 if code & _TRUNCATED else 0
            while True:
                if here[state] == there[state] + DELETE:
                    out.append("D")
                elif here[state] == here[_NEXT[state]] + INSERT:
                    out.append("I")
                    state = _NEXT[state]
                    continue
                elif _KEPT[code][state] >= 0 and here[state] == there[_KEPT[code][state]] + KEEP + late:
                    out.append("K")
                    state = _KEPT[code][state]
                else:
                    out.append("R")
                    state = _NEXT[state]
                break
    while last and after[state]:
        out.append("I")
        state = _NEXT[state]
    return "".join(out), state


def edited(rows: list[tuple[str, str, int]], codes: bytes, audit: str, state: int) -> list[tuple[str, str]]:
    """(role, text) after the edits; rows are (role, text, times)."""
    each = ((role, text) for role, text, times in rows for _ in repeat(None, times))
    out, k = [], 0
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            out.append((_NAMES[state], ""))
            continue
        role, text = next(each)
        if letter == "K":
            state = _KEPT[codes[k]][state]
            out.append((role, text))
        elif letter == "R":
            state = _NEXT[state]
            out.append((_NAMES[state], text))
        k += 1
    return out


class _Slice:
    """Rows of one conversation that stand together, and what is counted of them."""

    def __init__(self):
        self.rows: list[tuple[str, str, int]] = []
        self.codes = bytearray()
        self.chars = 0
        self.faults = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.first = self.initial = None
        self.turns = [None, None, 0]  # first, last, distinct

    def add(self, turn: int | None, role: str, text: str, times: int, later: bool) -> None:
        body = text.strip(_BLANKS)
        initial = role[:1]
        kind = "sua".find(initial) if initial else 3
        kind = 3 if kind < 0 else kind
        if not body or later:
            self.faults[0 if not body else 1] += times
            self.codes += bytes([kind | _MUST]) * times
        else:
            late = body[-1] not in ".!?"
            self.faults[2] += late
            self.faults[1] += times - 1
            self.codes.append(kind | (_TRUNCATED if late else 0))
            self.codes += bytes([kind | _MUST]) * (times - 1)
        if self.initial is None:
            self.first = initial
        else:
            self.faults[3] += self.initial + initial not in ("su", "ua", "au")
        self.faults[3] += times - 1
        self.initial = initial
        if turn is not None:
            if self.turns[0] is None:
                self.turns[0] = turn
            self.turns[2] += turn != self.turns[1]
            self.turns[1] = turn
        self.rows.append((role, text, times))
        self.chars += len(role) + len(text)

    @property
    def full(self) -> bool:
        return len(self.rows) >= SLICE_ROWS or self.chars >= SLICE_CHARS


def _gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def _lines(pieces: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in pieces)


def repair_turns(turns: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired rows) of rows (conv_id, turn, role, text).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. repaired rows: conv_id, slice, place, role, text; they go by (slice, place).

    Rows go by turn, those without a turn first, equal turns by role and text; equal rows stand
    together, and all but the first are duplicates. Null roles and texts count as one space,
    bytes that aren't UTF-8 as U+FFFD; rows without conv_id are one conversation. Texts are read whole. Conversations without rows don't
    occur; an empty table gives empty results. Further columns are ignored, whatever their names.
    The SHA-256 of a conversation can only be computed in order, so one task streams the slices
    of a long one, holding none.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    given = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.make_valid_utf8(F.coalesce("role", F.lit(" "))).alias("role"), F.make_valid_utf8(F.coalesce("text", F.lit(" "))).alias("text"))
    rows = given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    # keys that come at several turns, with the first of them (null goes first)
    several = rows.groupBy("conv_id", "role", "text").agg(F.when(F.count("turn") == F.count(F.lit(1)), F.min("turn")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = several.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), "first", F.lit(True).alias("again"))
    met = rows.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    later = (F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))).alias("later")
    marked = work.table(met.select("conv_id", "turn", "role", "text", "times", later), "marked")
    order = ["conv_id", "turn", "role", "text"]
    dealt = marked.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)

    fields = f"conv_id {kind}, slice long, gaps long, faults array<long>, cost long, audit string, sha string, matrix array<long>, codes binary, ends array<string>, turns array<long>, roles array<string>, texts array<string>, times array<long>"
    names = [f.split()[0] for f in fields.split(", ")]
    shape = pa.schema([(n, t) for n, t in zip(names[1:], [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64())])])

    def finished(number: int, s: _Slice) -> dict:
        codes = bytes(s.codes)
        cost = END
        for code in reversed(codes):
            cost = back(code, cost)
        audit, _ = walk(codes, END, _START, True)
        pieces = edited(s.rows, codes, audit, _START)
        sha = hashlib.sha256(_lines(pieces).encode()).hexdigest()
        return {"slice": number, "gaps": _gaps(*s.turns), "faults": s.faults, "cost": cost[_START], "audit": audit, "sha": sha, "roles": [r for r, _ in pieces], "texts": [t for _, t in pieces]}

    def left_open(number: int, s: _Slice) -> dict:
        codes = bytes(s.codes)
        roles, texts, times = zip(*s.rows)
        return {"slice": number, "faults": s.faults, "matrix": matrix(codes), "codes": codes, "ends": [s.first, s.initial], "turns": s.turns, "roles": roles, "texts": texts, "times": times}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, found, weight = [], [], 0
        now, held, begun, open_ = None, _Slice(), False, True  # the first conversation may have begun before

        def put(row: dict) -> None:
            nonlocal number, weight
            ids.append(now)
            found.append(row)
            number += 1
            weight += sum(map(len, row["texts"])) + 200

        def taken() -> pa.RecordBatch:
            nonlocal weight
            rest = pa.RecordBatch.from_pylist(found, schema=shape)
            out = pa.RecordBatch.from_arrays([pa.array(ids, type_of_id), *rest.columns], names)
            ids.clear()
            found.clear()
            weight = 0
            return out

        type_of_id = None
        for batch in batches:
            type_of_id = batch.schema.field(0).type
            for conv, turn, role, text, times, again in zip(*(c.to_pylist() for c in batch.columns)):
                if begun and conv != now:
                    put((left_open if open_ else finished)(number, held))
                    held, open_ = _Slice(), False
                elif held.full:
                    put(left_open(number, held))
                    held, open_ = _Slice(), True
                now, begun = conv, True
                held.add(turn, role, text, times, again)
                if weight > SLICE_CHARS:
                    yield taken()
        if begun:
            put(left_open(number, held))  # may go on in the next task
            yield taken()

    parts = work.table(dealt.mapInArrow(run, fields), "parts")
    done, slices = parts.filter("audit is not null"), parts.filter("audit is null")

    def fold_back(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["slice", "matrix"]).to_pylist(), key=lambda r: r["slice"])
        v, behind = END, []
        for r in reversed(rows):
            behind.append(list(v))
            v = tuple(min(r["matrix"][4 * q + t] + v[t] for t in range(4)) for q in range(4))
            # inserts before the slice's first row are in its matrix
        n = len(rows)
        return pa.table({"slice": [r["slice"] for r in rows], "behind": behind[::-1], "last": [k == n - 1 for k in range(n)], "cost": [v[_START]] * n})

    borders = slices.select("conv_id", "slice", "matrix").groupBy("conv_id").applyInArrow(fold_back, "slice long, behind array<long>, last boolean, cost long")
    borders = work.table(borders, "borders")

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                ways = [walk(row["codes"], tuple(row["behind"]), q, row["last"]) for q in range(4)]
                out.append({"slice": row["slice"], "audits": [w[0] for w in ways], "exits": [w[1] for w in ways]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("slice", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))]))

    walked = slices.select("slice", "codes").join(borders, "slice").select("slice", "codes", "behind", "last").mapInArrow(walk_all, "slice long, audits array<string>, exits array<long>")
    walked = work.table(walked, "walked")

    def fold_forth(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["slice", "exits"]).to_pylist(), key=lambda r: r["slice"])
        q, entry = _START, []
        for r in rows:
            entry.append(q)
            q = r["exits"][q]
        return pa.table({"slice": [r["slice"] for r in rows], "entry": pa.array(entry, pa.int64())})

    entries = slices.select("conv_id", "slice").join(walked.select("slice", "exits"), "slice").groupBy("conv_id").applyInArrow(fold_forth, "slice long, entry long")
    entries = work.table(entries, "entries")
    chosen = entries.join(walked, "slice").select("slice", "entry", F.col("audits")[F.col("entry").cast("int")].alias("piece")).join(borders.select("slice", F.col("cost").alias("total")), "slice")
    long_ = slices.drop("audit", "cost", "matrix", "sha", "gaps").join(chosen, "slice")
    mended = work.table(_edited_slices(long_, kind), "mended")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((batch.schema.field(0).type, row) for batch in batches for row in batch.to_pylist())
        now, out = None, None
        for kind_, row in rows:
            if out is None or row["conv_id"] != now:
                if out is not None:
                    yield ended(now, kind_, out)
                now = row["conv_id"]
                out = {"sha": hashlib.sha256(), "lines": 0, "audit": [], "faults": [0] * 4, "initial": None, "turns": [None, None, 0], "cost": row["total"]}
            for role, text in zip(row["roles"], row["texts"]):
                out["sha"].update((f"\n{role}:{text}" if out["lines"] else f"{role}:{text}").encode())
                out["lines"] += 1
            out["audit"].append(row["piece"])
            out["faults"] = [x + y for x, y in zip(out["faults"], row["faults"])]
            if out["initial"] is not None:
                out["faults"][3] += out["initial"] + row["ends"][0] not in ("su", "ua", "au")
            out["initial"] = row["ends"][1]
            first, last, distinct = row["turns"]
            if first is not None:
                own = out["turns"]
                out["turns"] = [first if own[0] is None else own[0], last, own[2] + distinct - (own[1] == first)]
        if out is not None:
            yield ended(now, kind_, out)

    def ended(conv, kind_: pa.DataType, out: dict) -> pa.RecordBatch:  # noqa: ANN001
        columns = [[conv], [_gaps(*out["turns"])], *([x] for x in out["faults"]), [out["cost"]], ["".join(out["audit"])], [out["sha"].hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind_, *[pa.int64()] * 6, pa.string(), pa.string()])], wanted)

    wanted = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    in_order = mended.repartition("conv_id").sortWithinPartitions("conv_id", "slice")
    long_results = in_order.mapInArrow(stream, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    short_results = done.select("conv_id", "gaps", *[F.col("faults")[k].alias(n) for k, n in enumerate(wanted[2:6])], "cost", "audit", F.col("sha").alias("repaired_sha256"))
    repaired = done.select("conv_id", "slice", "roles", "texts").unionByName(mended.select("conv_id", "slice", "roles", "texts"))
    each = repaired.select("conv_id", "slice", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row")).select("conv_id", "slice", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))
    return short_results.unionByName(long_results), each


def _edited_slices(slices: DataFrame, kind: str) -> DataFrame:
    """Slices with the edits applied: roles and texts are those of the repaired rows."""
    columns = {"slice": "long", "faults": "array<long>", "ends": "array<string>", "turns": "array<long>", "piece": "string", "total": "long", "roles": "array<string>", "texts": "array<string>"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = [], []
            for row in batch.select(["roles", "texts", "times", "codes", "piece", "entry"]).to_pylist():
                pieces = edited(list(zip(row["roles"], row["texts"], row["times"])), row["codes"], row["piece"], row["entry"])
                roles.append([r for r, _ in pieces])
                texts.append([t for _, t in pieces])
            same = [batch.column(c) for c in ["conv_id", *list(columns)[:-2]]]
            yield pa.RecordBatch.from_arrays([*same, pa.array(roles, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string()))], ["conv_id", *columns])

    return slices.mapInArrow(run, ", ".join([f"conv_id {kind}", *(f"{c} {t}" for c, t in columns.items())]))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn``, a null being a space: mod 20, 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("what")
    is_ = lambda k: F.col("what") == k
    role: Column = F.when(is_(4), F.lit("user")).otherwise(F.coalesce("role", F.lit(" ")))
    body = F.coalesce("text", F.lit(" "))
    text = F.when(is_(1), F.lit("")).when(is_(2), F.regexp_replace(body, "[.!?]", "")).otherwise(body)
    left = turns.select("conv_id", "turn", "role", "text", what).filter("what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(is_(3), 2).otherwise(1).alias("times"))
    return left.select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged ``conversations`` and their repair, one row for each original conv_id: see damaged and repair_turns, also for the odd cases.

    A conversation with no row left has zeros, an empty audit and the digest of nothing.
    """
    turns = read_table(spark, sf_dir, "conversations")
    found, _ = repair_turns(damaged(turns), Workspace(spark, "turns"))
    all_ = turns.select(F.col("conv_id").alias("id")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = all_.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
