"""Conversation repair against all edit sequences of small dialogues."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from asofspark.llm import repair

LEGAL = re.compile("(s?(ua)+)?")


def faults(rows):
    """rows: (turn, role, text) in order."""
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, messages) of least (cost, audit) among all edit sequences, by plain search."""
    marks = faults(rows)
    best = [(3 * len(rows), "D" * len(rows), ())]

    def walk(i, cost, audit, roles, out):
        if cost > best[0][0]:
            return
        if i == len(rows) and LEGAL.fullmatch(roles) and (cost, audit) < best[0][:2]:
            best[0] = (cost, audit, tuple(out))
        for role in ("user", "assistant"):  # an insert
            if cost + 2 <= best[0][0] and audit[-4:] != "IIII":
                walk(i, cost + 2, audit + "I", roles + role[0], [*out, f"{role}:"])
        if i < len(rows):
            _, role, text = rows[i]
            walk(i + 1, cost + 3, audit + "D", roles, out)
            if marks[i] not in ("blank", "duplicate"):
                more = marks[i] == "truncated"
                walk(i + 1, cost + more, audit + "K", roles + (role[:1] or "-"), [*out, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    walk(i + 1, cost + 2 + more, audit + "R", roles + other[0], [*out, f"{other}:{text}"])

    walk(0, 0, "", "", [])
    return best[0]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def expected(rows):
    rows = order(rows)
    turns = [t for t, _, _ in rows if t is not None]
    marks = faults(rows)
    cost, audit, said = brute(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (len(rows), gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def dialogues(n):
    r = random.Random(13)
    texts = ["Yes.", "No", "  ", "", "Why?", "one two", "Done!  ", "x" * 5_000]
    for k in range(n):
        rows = [(r.choice([None, *range(7)]) if k % 3 == 0 else t, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "stranger"]), r.choice(texts) if r.random() < 0.5 else f"text {t}.") for t in range(r.randint(1, 5))]
        if k % 2:  # nearly legal
            rows = [(t, ["user", "assistant"][(t or 0) % 2] if r.random() < 0.8 else role, text) for t, role, text in rows]
        yield (None if k == 0 else k), rows


def test_least_cost_and_audit_of_all_edit_sequences(spark):
    made = dict(dialogues(160))
    made[999] = [(0, "user", "a."), (0, "user", "a."), (0, "user", "a."), (1, "user", "a.")]  # copies
    data = [(c, t, role, text, "x", 1) for c, rows in made.items() for t, role, text in rows]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, audit string, `key` int").repartition(6)
    repaired = repair.repair(turns)
    got = {x.conv_id: tuple(x)[1:] for x in repaired.collect()}
    assert got == {c: expected(rows) for c, rows in made.items()}
    said = {}
    for x in sorted(repair.messages(turns, repaired).collect(), key=lambda x: x.place):
        said.setdefault(x.conv_id, []).append(f"{x.role}:{x.text}")
    assert all(hashlib.sha256("\n".join(said.get(c, [])).encode()).hexdigest() == v[-1] for c, v in got.items())


def test_long_dialogue_whose_parses_never_meet(spark):
    n = 20_000
    rows = [(7, t, "x", f"{t}.") for t in range(n + 1)]
    x = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()[0]
    assert (x.cost, x.audit) == (3 + 2 * n, "D" + "R" * n)
    want = "\n".join(f"{('assistant', 'user')[t % 2]}:{t}." for t in range(1, n + 1))
    assert x.repaired_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_nulls_damage_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, None if (c, t) == (3, 1) else "user", None if t == 2 else f"Text {t}! yes.") for c in (None, 1, 2, 3, 4, 5) for t in (None, *range(30))]
    want = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    damaged = repair.damage(spark.createDataFrame(rows, schema))
    assert sorted(map(str, map(tuple, damaged.collect()))) == sorted(map(str, want))
    nulls = repair.repair(spark.createDataFrame([(1, 0, None, None), (1, None, None, "A")], schema)).collect()[0]
    assert tuple(nulls)[1:9] == (2, 0, 1, 0, 1, 1, 6, "DD")
    assert repair.repair(spark.createDataFrame([], schema)).collect() == []


def test_query_returns_every_conversation(spark, tmp_path):
    gone = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    spark.createDataFrame([(gone[0], gone[1], "user", "a."), (None, None, None, None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    from asofspark.llm.queries import op13_structure_repair

    got = {x.conv_id: tuple(x)[1:] for x in op13_structure_repair(spark, str(tmp_path)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[gone[0]] == (0, 0, 0, 0, 0, 0, "", empty) and set(got) == {gone[0], None}
