"""Faults of conversations and their cheapest repair, by divide and conquer.

A repaired conversation is an optional system turn followed by pairs of a user and an assistant turn. What has been read
so far is one of four states (nothing, system, user, assistant), so a stretch of turns is a 4 x 4 table of costs from
state to state, and stretches join like matrices. The edits are found as Hirschberg finds an alignment: forward costs of
the first half and backward costs of the second meet in the middle, the crossing of least cost (of those, the one whose
edits so far come first in ASCII) is fixed, and both halves are solved alike; only four numbers are held at a time. A
conversation longer than a block is cut into blocks, whose tables are joined by a tree, and the crossings between blocks
are fixed from the top of the tree down, so that no task holds a long conversation's turns.

Beside each cost stands the rank of its edits among those of the other states. The edits up to a crossing end with one
that uses up a turn (insertions belong to what follows), hence none is the beginning of another, and ranks alone tell
which of two longer sequences comes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..plans.frames import cut_lineage, need

BLOCK = 4096               # turns of a block
FAN = 256                  # nodes under a node of the tree
#: Costs of edits, white space, ends of sentences.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60              # cost of what cannot be reached
INITIALS = "sua"           # then any other
LEGAL = {"su", "ua", "au"}

Table = tuple[tuple[tuple[int, int], ...], ...]     # [from][to]: cost and rank


def _next(state: int) -> int:
    """The state after a further user or assistant turn, whichever may stand there."""
    return ASSISTANT if state == USER else USER


def _turn_edits(code: int) -> list[list[tuple[int, str]]]:
    """Cheapest edits of one turn, first in ASCII, from each state to each state; code = 3 * initial + fault."""
    initial, fault = divmod(code, 3)            # fault: 0 none, 1 has to go, 2 truncated
    best = [[(FAR, "")] * 4 for _ in range(4)]
    for q in range(4):
        at, before, spent = q, "", 0
        for _ in range(3):                      # no, one or two insertions; more only come round again
            options = [("D", at, DELETE)]
            if fault != 1:
                extra = TRUNCATED if fault == 2 else 0
                options.append(("R", _next(at), REROLE + extra))
                to = {0: SYSTEM if at == START else None, 1: USER if at != USER else None, 2: ASSISTANT if at == USER else None}.get(initial)
                if to is not None:
                    options.append(("K", to, extra))
            for letter, to, cost in options:
                best[q][to] = min(best[q][to], (spent + cost, before + letter))
            at, before, spent = _next(at), before + "I", spent + INSERT
    return best


EDITS = [_turn_edits(code) for code in range(12)]
#: What may follow the last turn: cost and edits by state.
TAIL = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


def _ranked(costs: Sequence[int], keys: Sequence) -> tuple[tuple[int, int], ...]:
    order = sorted((k, i) for i, (c, k) in enumerate(zip(costs, keys)) if c < FAR)
    rank = {i: r for r, (_, i) in enumerate(order)}
    return tuple((c, rank.get(i, 9)) for i, c in enumerate(costs))


TURNS: list[Table] = [tuple(_ranked([c for c, _ in row], [e for _, e in row]) for row in e) for e in EDITS]


def _forward(vec: Sequence[tuple[int, int]], table: Table) -> tuple[tuple[int, int], ...]:
    """Costs and ranks by state behind a stretch, from those in front of it."""
    costs, keys = [], []
    for to in range(4):
        cost, rank, mid = min((vec[m][0] + table[m][to][0], vec[m][1], m) for m in range(4))
        costs.append(min(cost, FAR))
        keys.append((rank, table[mid][to][1]))
    return _ranked(costs, keys)


def _backward(vec: Sequence[int], table: Table) -> tuple[int, ...]:
    """Costs by state in front of a stretch, from those behind it."""
    return tuple(min(FAR, min(table[q][m][0] + vec[m] for m in range(4))) for q in range(4))


def _less(vec, low: int):
    return tuple((c - low if c < FAR else FAR, r) for c, r in vec)


_STEPS: dict = {}          # few differences of costs occur, so steps over single turns are looked up


def _forward_turn(vec, code: int):
    got = _STEPS.get((vec, code))
    if got is None:
        out = _forward(vec, TURNS[code])
        low = min(c for c, _ in out)
        got = _STEPS[vec, code] = (_less(out, low), low)
    return got


def _backward_turn(vec, code: int):
    got = _STEPS.get((code, vec))
    if got is None:
        out = _backward(vec, TURNS[code])
        low = min(out)
        got = _STEPS[code, vec] = tuple(c - low if c < FAR else FAR for c in out)
    return got


def _at(state: int) -> tuple[tuple[int, int], ...]:
    return tuple((0, 0) if q == state else (FAR, 9) for q in range(4))


def block_table(codes: Sequence[int]) -> Table:
    """The table of a stretch of turns: one forward pass from each state."""
    rows = []
    for q in range(4):
        vec, total = _at(q), 0
        for c in codes:
            vec, low = _forward_turn(vec, c)
            total += low
        rows.append(tuple((c + total if c < FAR else FAR, r) for c, r in vec))
    return tuple(rows)


def joined_table(tables: Sequence[Table]) -> Table:
    rows = []
    for q in range(4):
        vec = _at(q)
        for t in tables:
            vec = _forward(vec, t)
        rows.append(vec)
    return tuple(rows)


def crossings(n: int, start: int, end: int, forward: Callable, backward: Callable) -> list[int]:
    """States between n stretches (n + 1 of them with both ends) of the audit-least cheapest way from start to end.

    `forward(vec, i)` and `backward(vec, i)` carry a vector over stretch i.
    """
    out = [start] * (n + 1)
    out[n] = end
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        ahead = _at(out[lo])
        for i in range(lo, mid):
            ahead = forward(ahead, i)
        behind = tuple(0 if q == out[hi] else FAR for q in range(4))
        for i in range(hi - 1, mid - 1, -1):
            behind = backward(behind, i)
        out[mid] = min((ahead[q][0] + behind[q], ahead[q][1], q) for q in range(4))[2]
        todo += [(lo, mid), (mid, hi)]
    return out


def block_edits(codes: Sequence[int], start: int, end: int) -> str:
    """The edits of a stretch of turns, one letter each."""
    states = crossings(len(codes), start, end, lambda v, i: _forward_turn(v, codes[i])[0], lambda v, i: _backward_turn(v, codes[i]))
    return "".join(EDITS[c][a][b][1] for c, a, b in zip(codes, states, states[1:]))


def ending(row: Sequence[tuple[int, int]]) -> tuple[int, int]:
    """Least cost of a conversation and the state behind its last turn, from the first row of its table."""
    cost, _, state = min((row[q][0] + TAIL[q][0], row[q][1], q) for q in range(4))
    return cost, state


# The same on tables of turns.

_NODE = "conv {kind}, id bigint, up bigint, cost array<bigint>, rank array<bigint>, first string, last string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, codes binary"


def _tagged(most: int) -> Callable:
    """Numbers the rows of a sorted task and cuts each conversation's run of them into parts of at most `most` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        now, n, part = object(), 0, at
        for b in batches:
            ids, parts = [], []
            for c in b.column(0).to_pylist():
                if c != now or n == most:
                    now, n, part = c, 0, at
                ids.append(at)
                parts.append(part)
                at, n = at + 1, n + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64()), pa.array(parts, pa.int64())], names=[*b.schema.names, "id", "up"])
    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of consecutive batches by runs of `key`."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][key] != r[key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _flat(t: Table) -> tuple[list[int], list[int]]:
    return [c for row in t for c, _ in row], [r for row in t for _, r in row]


def _table(r: dict) -> Table:
    pairs = list(zip(r["cost"], r["rank"]))
    return tuple(tuple(pairs[4 * q:4 * q + 4]) for q in range(4))


def _emit(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _batched(made: Iterator[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for r in made:
        rows.append(r)
        if len(rows) == most:
            yield _emit(rows, schema)
            rows = []
    if rows:
        yield _emit(rows, schema)


def _arrow(df_schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(df_schema))


def _blocks(flagged: DataFrame, kind: str) -> DataFrame:
    """One row for each block of turns: its table, its counts and a code for each turn."""
    fields = _NODE.format(kind=kind)
    schema = _arrow(fields)

    def one(rows: list[dict]) -> dict:
        codes, pairs = [], 0
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for i, r in enumerate(rows):
            fault = "blank" if r["blank"] else "duplicate" if r["again"] else "truncated" if r["truncated"] else None
            if fault:
                counts[fault] += 1
            at = INITIALS.find(r["initial"]) if r["initial"] else -1
            codes.append(3 * (at if at >= 0 else 3) + {None: 0, "truncated": 2}.get(fault, 1))
            pairs += i > 0 and rows[i - 1]["initial"] + r["initial"] not in LEGAL
        cost, rank = _flat(block_table(codes))
        return {"conv": rows[0]["conv"], "id": rows[0]["up"], "up": None, "cost": cost, "rank": rank, "first": rows[0]["initial"], "last": rows[-1]["initial"], **counts, "illegal": pairs, "codes": bytes(codes)}

    def run(batches):
        return _batched((one(g) for g in _groups(batches, "up")), schema)

    return flagged.repartition("up").sortWithinPartitions("up", "id").mapInArrow(run, fields)


def _parents(children: DataFrame, kind: str) -> DataFrame:
    fields = _NODE.format(kind=kind)
    schema = _arrow(fields)

    def one(rows: list[dict]) -> dict:
        cost, rank = _flat(joined_table([_table(r) for r in rows]))
        seams = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(rows, rows[1:]))
        return {"conv": rows[0]["conv"], "id": rows[0]["up"], "up": None, "cost": cost, "rank": rank, "first": rows[0]["first"], "last": rows[-1]["last"],
                **{k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}, "illegal": seams + sum(r["illegal"] for r in rows), "codes": None}

    def run(batches):
        return _batched((one(g) for g in _groups(batches, "up")), schema)

    return children.repartition("up").sortWithinPartitions("up", "id").mapInArrow(run, fields)


def _fixed(children: DataFrame, parents: DataFrame, kind: str) -> DataFrame:
    """Children with the states in front of and behind them, from those of their parents (id, enter, leave)."""
    fields = _NODE.format(kind=kind) + ", enter int, leave int"
    schema = _arrow(fields)
    p = parents.select(F.col("id").alias("up"), F.col("enter").alias("e"), F.col("leave").alias("l"))

    def one(rows: list[dict]) -> Iterator[dict]:
        tables = [_table(r) for r in rows]
        states = crossings(len(rows), rows[0]["e"], rows[0]["l"], lambda v, i: _forward(v, tables[i]), lambda v, i: _backward(v, tables[i]))
        for r, a, b in zip(rows, states, states[1:]):
            yield {**{k: v for k, v in r.items() if k not in ("e", "l")}, "enter": a, "leave": b}

    def run(batches):
        return _batched((r for g in _groups(batches, "up") for r in one(g)), schema)

    return children.join(p, "up").select("conv", "id", "up", *[c for c in children.columns if c not in ("conv", "id", "up")], "e", "l").repartition("up").sortWithinPartitions("up", "id").mapInArrow(run, fields)


def turns_of(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, text and h, the digest that orders turns beside their role; a null role or text is one space."""
    need(df, conv_col, turn_col, role_col, text_col)
    d = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    return d.withColumn("h", F.sha2("text", 256))


ORDER = ("turn", "role", "h")


def _plans(turns: DataFrame, block: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """For each conversation its counts, cost and closing edits, and for each block its edits: (conv, id, audit)."""
    kind = turns.schema["conv"].dataType.simpleString()
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    thin = turns.select("conv", *ORDER, F.substring("role", 1, 1).alias("initial"), (rest == "").alias("blank"), (~F.right(rest, F.lit(1)).isin(*ENDS)).alias("truncated"))
    thin = cut_lineage(thin)                                     # texts are read once
    ordered = thin.repartitionByRange("conv", *ORDER).sortWithinPartitions("conv", *ORDER)
    rows = cut_lineage(ordered.mapInArrow(_tagged(block), f"conv {kind}, turn bigint, role string, h string, initial string, blank boolean, truncated boolean, id bigint, up bigint"))
    first = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("h").alias("g")).agg(F.min("id").alias("first"))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("g"))
    flagged = rows.join(first, same).select("conv", "id", "up", "initial", "blank", "truncated", (F.col("id") > F.col("first")).alias("again"))
    level = cut_lineage(_blocks(flagged, kind))

    levels = []
    while True:
        size = level.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).collect()[0]
        if (size[0] or 0) <= 1:
            break
        cut = level.drop("up").select("conv", *[c for c in level.columns if c not in ("conv", "id", "up")], F.col("id").alias("at"))
        # Few nodes to a conversation meet in one task; more are cut by ranges first.
        cut = cut.repartition("conv") if size[0] <= fan else cut.repartitionByRange(max(1, size[1] // (2 * fan)), "conv", "at")
        cut = cut.sortWithinPartitions("conv", "at")
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
        tagged = cut_lineage(cut.mapInArrow(_tagged(fan), fields + ", id bigint, up bigint"))
        order = tagged.select("conv", "id", "up", *[c for c in level.columns if c not in ("conv", "id", "up")], "at")
        levels.append(cut_lineage(order))
        level = cut_lineage(_parents(order.drop("at"), kind))

    ends = _closed(level, kind)
    fixed = ends.select("conv", "id", F.lit(START).alias("enter"), "leave")
    for nodes in reversed(levels):
        got = cut_lineage(_fixed(nodes.drop("at"), fixed, kind))
        back = nodes.select(F.col("id").alias("i"), "at")
        fixed = got.join(back, F.col("i") == F.col("id")).select("conv", F.col("at").alias("id"), "enter", "leave")
    blocks = level if not levels else levels[0].drop("id").withColumnRenamed("at", "id")
    audits = _audits(blocks.select("id", "codes").join(fixed, "id"), kind)
    return ends, audits


def _closed(roots: DataFrame, kind: str) -> DataFrame:
    fields = f"conv {kind}, id bigint, leave int, total bigint, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    schema = _arrow(fields)

    def one(r: dict) -> dict:
        total, leave = ending(_table(r)[START])
        return {**{f: r.get(f) for f in schema.names}, "leave": leave, "total": total, "tail": TAIL[leave][1]}

    return cut_lineage(roots.mapInArrow(lambda bs: _batched((one(r) for b in bs for r in b.to_pylist()), schema), fields))


def _audits(blocks: DataFrame, kind: str) -> DataFrame:
    fields = f"conv {kind}, id bigint, audit string"
    schema = _arrow(fields)

    def one(r: dict) -> dict:
        return {"conv": r["conv"], "id": r["id"], "audit": block_edits(r["codes"], r["enter"], r["leave"])}

    return blocks.mapInArrow(lambda bs: _batched((one(r) for b in bs for r in b.to_pylist()), schema), fields)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, edit, role, text) for every edit of every conversation, and (conv, None, audit, None) behind each.

    A conversation's audits come first, its turns after them, both in order.
    """
    now, audit, parts, at, last = object(), "", [], 0, ""

    def take(turn=None):
        """Insertions up to the next edit of a turn, and that edit if a turn is given."""
        nonlocal at, last
        while at < len(audit):
            e = audit[at]
            if e != "I" and turn is None:
                return
            at += 1
            if e == "D":
                yield (now, e, turn["role"], turn["text"])
                return
            role = turn["role"] if e == "K" else "assistant" if last == "u" else "user"
            last = role[:1]
            yield (now, e, role, "" if e == "I" else turn["text"])
            if e != "I":
                return

    for b in batches:
        for r in b.to_pylist():
            if r["conv"] != now:
                if parts:
                    audit = audit or "".join(parts)
                    yield from take()
                    yield (now, None, audit, None)
                now, audit, parts, at, last = r["conv"], "", [], 0, ""
            if r["audit"] is not None:
                parts.append(r["audit"])
            else:
                audit = audit or "".join(parts)
                yield from take(r)
    if parts:
        audit = audit or "".join(parts)
        yield from take()
        yield (now, None, audit, None)


def _streams(turns: DataFrame, ends: DataFrame, audits: DataFrame) -> DataFrame:
    """Audits (blocks in order, then the closing edits) and turns of each conversation, dealt by conversation and in order.

    A repaired text is one digest and its audit one cell, so a conversation's turns pass through one task, batch by batch.
    """
    none = {"turn": "bigint", "role": "string", "h": "string", "text": "string"}
    empty = [F.lit(None).cast(t).alias(c) for c, t in none.items()]
    a = audits.select("conv", F.lit(0).alias("what"), "id", "audit", *empty)
    t = ends.select("conv", F.lit(1).alias("what"), F.lit(0).cast("bigint").alias("id"), F.col("tail").alias("audit"), *empty)
    r = turns.select("conv", F.lit(2).alias("what"), F.lit(0).cast("bigint").alias("id"), F.lit(None).cast("string").alias("audit"), *none)
    return a.union(t).union(r).repartition("conv").sortWithinPartitions("conv", "what", "id", *ORDER)


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """The repaired turns themselves: conv, seq (from 1), role, text and edit (K kept, R given another role, I inserted).

    Rows, nulls and ties as in `repair`.
    """
    turns = turns_of(df, conv_col, turn_col, role_col, text_col)
    kind = turns.schema["conv"].dataType.simpleString()
    fields = f"conv {kind}, seq bigint, role string, text string, edit string"
    schema = _arrow(fields)

    def made(batches):
        seq = 0
        for conv, edit, role, text in _edited(batches):
            if edit is None:
                seq = 0
            elif edit != "D":
                seq += 1
                yield {"conv": conv, "seq": seq, "role": role, "text": text, "edit": edit}

    return _streams(turns, *_plans(turns, block, fan)).mapInArrow(lambda bs: _batched(made(bs), schema), fields).withColumnRenamed("conv", conv_col)


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Faults of every conversation and its cheapest repair, one row per conversation.

    Turns are taken by `turn` (nulls first), ties by role, then by the text's digest; equal rows stand side by side.
    Returns conv, gaps (turn numbers left out between the least and the greatest, nulls aside), blank, duplicate (role
    and text seen earlier in the conversation), truncated (does not end with . ! or ?) by each turn's first fault,
    illegal (neighbouring roles whose initials are not su, ua or au), cost, audit (one letter for each edit: Keep 0,
    Rerole to user or assistant 1, Delete 2, Insert an empty turn 5; blank and duplicate turns must be deleted, keeping
    a truncated one costs 5 more; the cheapest edits after which the roles' initials are s?(ua)+ or nothing, ties by
    ASCII) and repaired_sha256 (of `role:text`, joined by line feeds).

    A null role or text is one space, so a null text is blank; a null conversation id is a conversation of its own. An
    empty role has no initial and cannot be kept. Texts and conversations may be of any length. Other columns are
    ignored, so their names cannot clash. An empty table gives no rows. `block` and `fan` change no result.
    """
    turns = turns_of(df, conv_col, turn_col, role_col, text_col)
    kind = turns.schema["conv"].dataType.simpleString()
    ends, audits = _plans(turns, block, fan)
    fields = f"conv {kind}, audit string, repaired_sha256 string"
    schema = _arrow(fields)

    def made(batches):
        digest, some = sha256(), False
        for conv, edit, role, text in _edited(batches):
            if edit is None:
                yield {"conv": conv, "audit": role, "repaired_sha256": digest.hexdigest()}
                digest, some = sha256(), False
            elif edit != "D":
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

    done = cut_lineage(_streams(turns, ends, audits).mapInArrow(lambda bs: _batched(made(bs), schema, 100), fields))
    spans = turns.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    e = ends.select(F.col("conv").alias("c"), "blank", "duplicate", "truncated", "illegal", F.col("total").alias("cost"))
    s = spans.select(F.col("conv").alias("d"), "gaps")
    out = done.join(e, F.col("conv").eqNullSafe(F.col("c"))).join(s, F.col("conv").eqNullSafe(F.col("d")))
    return out.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
