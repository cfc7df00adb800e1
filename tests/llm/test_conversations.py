"""Conversation repair against all edit sequences by dynamic programming on whole strings."""

import hashlib
import random
import re

import pytest

from statloom.llm.conversations import block_edits, block_table, ending, joined_table, repair, repaired

KIND = "conv_id long, turn long, role string, text string"


def moves(q, row):
    """(cost, edits, state, lines) of what may become of a turn, after any insertions in front of it."""
    role, text, must, cut = row
    at, before, spent, lines = q, "", 0, []
    for _ in range(3):
        yield spent + 2, before + "D", at, lines
        if not must:
            role_at = "assistant" if at == 2 else "user"
            yield spent + 1 + 5 * cut, before + "R", 3 if at == 2 else 2, [*lines, f"{role_at}:{text}"]
            i = role[:1]
            if (i == "s" and at == 0) or (i == "u" and at != 2) or (i == "a" and at == 2):
                yield spent + 5 * cut, before + "K", {"s": 1, "u": 2, "a": 3}[i], [*lines, f"{role}:{text}"]
        at, before, spent, lines = (3 if at == 2 else 2), before + "I", spent + 5, [*lines, ("assistant:" if at == 2 else "user:")]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(t, role if role is not None else " ", text if text is not None else " ") for c, t, role, text in rows if c == conv]
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marked, n = set(), [], [0, 0, 0]
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                n[kind] += 1
            marked.append((role, text, kind in (0, 1), kind == 2))
        best = {0: (0, "", [])}
        for row in marked:
            after = {}
            for q, (c, e, t) in best.items():
                for c2, e2, q2, t2 in moves(q, row):
                    new = (c + c2, e + e2, t + t2)
                    if q2 not in after or new[:2] < after[q2][:2]:
                        after[q2] = new
            best = after
        tail = {0: (0, "", []), 1: (10, "II", ["user:", "assistant:"]), 2: (5, "I", ["assistant:"]), 3: (0, "", [])}
        cost, audit, lines = min((c + tail[q][0], e + tail[q][1], t + tail[q][2]) for q, (c, e, t) in best.items())
        ini = [r[0][:1] for r in marked]
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(ini, ini[1:]))
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


def sample(rng, convs, most):
    texts = ["", " \t", "Yes.", "No!", "Why? ", "cut off", "and", "Ünï\n", "…?", "a.b"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    rows = []
    for c in convs:
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice([*texts, f"word {rng.random()}.", None])))
    return rows


@pytest.mark.parametrize("block,fan", [(4096, 256), (2, 2), (5, 3)])
def test_against_all_edits(spark, block, fan):
    rng = random.Random(block)
    rows = sample(rng, [None, *range(40)], 9) + sample(rng, [100], 300)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], KIND + ", cost int, audit string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair(df, block=block, fan=fan).collect()}
    want = brute(rows)
    assert got == {c: w[:-1] for c, w in want.items()}
    lines = {}
    for r in sorted(repaired(df, block=block, fan=fan).collect(), key=lambda r: (str(r.conv_id), r.seq)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}


def test_empty_repeated_and_long(spark):
    none = spark.createDataFrame([], KIND)
    assert repair(none).collect() == [] and repaired(none).collect() == []
    rows = [(1, 1, "user", "x" * 3_000_000 + "."), (1, 1, "user", "x" * 3_000_000 + "."), (1, 2, "assistant", "ok."), (2, None, None, None)]
    (a, b) = sorted(repair(spark.createDataFrame(rows, KIND)).collect())
    assert tuple(a)[1:8] == (0, 0, 1, 0, 1, 2, "KDK") and tuple(b)[1:8] == (0, 1, 0, 0, 0, 2, "D")
    assert b.repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_tables_join_like_stretches():
    rng = random.Random(3)
    for _ in range(200):
        codes = [rng.randrange(12) for _ in range(rng.randint(2, 30))]
        cut = rng.randint(1, len(codes) - 1)
        whole = block_table(codes)
        assert joined_table([block_table(codes[:cut]), block_table(codes[cut:])]) == whole
        cost, leave = ending(whole[0])
        letters = block_edits(codes, 0, leave).replace("I", "")
        assert len(letters) == len(codes)
