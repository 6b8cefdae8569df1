"""Conversation structure repair: generalised LR parsing of damaged dialogues with weighted edits.

``TABLE`` is the LR automaton of the role grammar: an optional system turn and then pairs of user and assistant, or
nothing. A dialogue's rows are read in order by turn. Every open parse is a stack of automaton states; stacks share what
lies under their tops, and of stacks with equal tops only the one of least (cost, audit) lives on, as what may follow is
the same for all. Keep and Rerole shift a row's role, Insert shifts a role without a row, Delete passes a row.

Spark finds rows said before (groups that occur once never come back to their rows), brings each dialogue in order to
one task and streams it there: a task holds the few open parses, never a dialogue. An open parse keeps its audit as a chain
of pieces and the running hash of its repaired text, since both are one value of the whole dialogue. Audits are compared
by rank among the open parses, so that a row costs the same however long the dialogue is.

Defined results: null roles and texts are one space; a null conv_id is a dialogue; rows of equal turn go by role and text,
null turns come first; rows equal in all are copies, of which the first counts; an empty table gives no rows; other columns
don't travel, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

#: The grammar over role initials (D a dialogue, P its pairs), the roles that edits give, and the edits' costs.
GRAMMAR = (("D", ""), ("D", "P"), ("D", "sP"), ("P", "Pua"), ("P", "ua"))
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANKS, END = " \t\n\x0b\x0c\r", "$"
#: Characters of an audit's piece.
PIECE = 1024
RESULT = "conv_id long, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def lr_table(grammar: tuple[tuple[str, str], ...]) -> tuple[dict, dict]:
    """(actions, gotos) of a grammar whose capital letters are nonterminals and whose first left side is the start:
    actions[state, terminal] lists ("shift", state), ("reduce", rule) and ("accept",)."""
    heads = {h for h, _ in grammar}
    empty = {h for h, body in grammar if not body}
    first = {h: set() for h in heads}
    follow = {h: set() for h in heads} | {grammar[0][0]: {END}}
    before = None
    while before != (before := str((sorted((k, sorted(v)) for k, v in first.items()), sorted((k, sorted(v)) for k, v in follow.items()), sorted(empty)))):
        for head, body in grammar:
            for x in body:
                first[head] |= first[x] if x in heads else {x}
                if x not in empty:
                    break
            else:
                empty.add(head)
            behind = set(follow[head])
            for x in reversed(body):
                if x in heads:
                    follow[x] |= behind
                    behind = first[x] | (behind if x in empty else set())
                else:
                    behind = {x}

    def closed(items: set) -> frozenset:
        items, work = set(items), list(items)
        while work:
            rule, dot = work.pop()
            body = grammar[rule][1] if rule >= 0 else grammar[0][0]
            for r, (head, _) in enumerate(grammar):
                if dot < len(body) and body[dot] == head and (r, 0) not in items:
                    items.add((r, 0))
                    work.append((r, 0))
        return frozenset(items)

    states, actions, gotos = [closed({(-1, 0)})], {}, {}
    for n, items in enumerate(states):  # grows on the way
        moves: dict[str, set] = {}
        for rule, dot in sorted(items):
            body = grammar[rule][1] if rule >= 0 else grammar[0][0]
            if dot < len(body):
                moves.setdefault(body[dot], set()).add((rule, dot + 1))
            elif rule < 0:
                actions.setdefault((n, END), []).append(("accept",))
            else:
                for t in sorted(follow[grammar[rule][0]]):
                    actions.setdefault((n, t), []).append(("reduce", rule))
        for x, kernel in sorted(moves.items()):
            to = closed(kernel)
            if to not in states:
                states.append(to)
            if x in heads:
                gotos[n, x] = states.index(to)
            else:
                actions.setdefault((n, x), []).append(("shift", states.index(to)))
    return actions, gotos


class Stacks:
    """What a stack becomes by a symbol. A stack is (top state, stack below); the stacks under live tops are few, so that
    each move is worked out once."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.grammar, (self.actions, self.gotos) = grammar, lr_table(grammar)
        self.moves: dict = {}

    def after(self, stack: tuple, symbol: str) -> list[tuple]:
        """All stacks after the reductions that ``symbol`` allows and its shift; for END the accepted ones."""
        if (stack, symbol) not in self.moves:
            out = self.moves[stack, symbol] = []
            for action, *to in self.actions.get((stack[0], symbol), ()):
                if action == "accept":
                    out.append(stack)
                elif action == "shift":
                    out.append((to[0], stack))
                else:
                    head, body = self.grammar[to[0]]
                    below = stack
                    for _ in body:
                        below = below[1]
                    out += self.after((self.gotos[below[0], head], below), symbol)
        return self.moves[stack, symbol]


class Parse:
    """An open parse. (rank, tail) orders its audit among those of the other open ones."""

    __slots__ = ("stack", "cost", "rank", "tail", "trail", "said", "some")

    def __init__(self, stack, cost=0, rank=0, tail="", trail=(None, ""), said=None, some=False):
        self.stack, self.cost, self.rank, self.tail, self.trail, self.some = stack, cost, rank, tail, trail, some
        self.said = said or hashlib.sha256()

    def then(self, stack: tuple, cost: int, edit: str, message: bytes | None) -> Parse:
        trail = (self.trail[0], self.trail[1] + edit) if len(self.trail[1]) < PIECE else (self.trail, edit)
        said = self.said
        if message is not None:
            said = said.copy()
            said.update(b"\n" + message if self.some else message)
        return Parse(stack, self.cost + cost, self.rank, self.tail + edit, trail, said, self.some or message is not None)

    def audit(self) -> str:
        pieces, trail = [], self.trail
        while trail is not None:
            pieces.append(trail[1])
            trail = trail[0]
        return "".join(reversed(pieces))


class Repair:
    """The cheapest repair of one dialogue, whose rows come one by one."""

    def __init__(self, stacks: Stacks):
        self.stacks = stacks
        self.open = self._inserted({0: Parse((0, None))})

    def _offer(self, best: dict, parse: Parse, symbol: str, cost: int, edit: str, message: bytes) -> list[int]:
        """Tops at which this move is the new least."""
        better = []
        for stack in self.stacks.after(parse.stack, symbol):
            old = best.get(stack[0])
            if old is None or (parse.cost + cost, parse.rank, parse.tail + edit) < (old.cost, old.rank, old.tail):
                best[stack[0]] = parse.then(stack, cost, edit, message)
                better.append(stack[0])
        return better

    def _inserted(self, tops: dict) -> dict:
        work = list(tops)
        while work:
            parse = tops[work.pop()]
            for symbol, role in ROLES.items():
                work += self._offer(tops, parse, symbol, INSERT, "I", f"{role}:".encode())
        return tops

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        best: dict[int, Parse] = {}
        for state, parse in self.open.items():
            key = (parse.cost + DELETE, parse.rank, parse.tail + "D")
            if state not in best or key < (best[state].cost, best[state].rank, best[state].tail):
                best[state] = parse.then(parse.stack, DELETE, "D", None)
            if not must_go:
                self._offer(best, parse, role[:1], KEEP + TRUNCATED * truncated, "K", f"{role}:{text}".encode())
                for symbol, other in ROLES.items():
                    self._offer(best, parse, symbol, REROLE + TRUNCATED * truncated, "R", f"{other}:{text}".encode())
        self.open = self._inserted(best)
        self._rank()

    def _rank(self) -> None:
        """Ranks afresh: audits of which none begins with another get ranks of their own, the rest keep what they differ in."""
        rank, base = -1, None
        for p in sorted(self.open.values(), key=lambda p: (p.rank, p.tail)):
            if base is None or p.rank != base[0] or not p.tail.startswith(base[1]):
                rank, base = rank + 1, (p.rank, p.tail)
            p.rank, p.tail = rank, p.tail[len(base[1]) :]

    def end(self) -> Parse:
        done = [p for p in self.open.values() if self.stacks.after(p.stack, END)]
        return min(done, key=lambda p: (p.cost, p.rank, p.tail))


def _rows(turns: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text): without nulls but for turn and conv_id; the key tells a null conv_id apart."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))


def said_before(rows: DataFrame) -> DataFrame:
    """``rows`` and ``again``: the same role and text stand at an earlier turn of the dialogue. Groups are counted before the
    shuffle, and only those of several rows are joined."""
    at = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    known = rows.withColumn("digest", F.sha2("text", 256))
    group = ["key", "role", "digest"]
    repeated = known.groupBy(*group).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(repeated, group, "left").select(*rows.columns, F.coalesce(at > F.col("first"), F.lit(False)).alias("again"))


def repair(turns: DataFrame) -> DataFrame:
    """One row per conv_id: n_rows, gaps among turn numbers, rows by first fault, illegal neighbours, and the least cost, its
    audit (D delete, I insert, K keep, R rerole) and the hash of the repaired dialogue's ``role:text`` lines."""
    marked = said_before(_rows(turns)).repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks, key, done = Stacks(), None, []

        def close() -> tuple:
            best = repairing.end()
            return own, n, high - low + 1 - turns_seen if turns_seen else 0, blank, duplicate, truncated, illegal, best.cost, best.audit(), best.said.hexdigest()

        for b in batches:
            for k, conv_id, turn, role, text, again in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "again")), strict=True):
                if k != key:
                    if key is not None:
                        done.append(close())
                    key, own, repairing, last = k, conv_id, Repair(stacks), None
                    n = low = high = turns_seen = blank = duplicate = truncated = illegal = 0
                n += 1
                if turn is not None and (not turns_seen or turn != high):
                    low, high, turns_seen = (low if turns_seen else turn), turn, turns_seen + 1
                kept = text.rstrip(BLANKS)
                fault = "blank" if not kept else "duplicate" if again or last == (turn, role, text) else "truncated" if kept[-1] not in ".!?" else ""
                blank, duplicate, truncated = blank + (fault == "blank"), duplicate + (fault == "duplicate"), truncated + (fault == "truncated")
                illegal += last is not None and last[1][:1] + role[:1] not in ("su", "ua", "au")
                last = (turn, role, text)
                repairing.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

            yield record(done)
            done = []
        if key is not None:
            yield record([close()])

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.string()] * 2
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    return map_batches(marked, run, RESULT)


def messages(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repaired dialogues as rows (conv_id, place, edit, role, text), from the audits of ``repairs``."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = _rows(turns).withColumn("n", F.row_number().over(order)).select("key", "n", "role", "text")
    edits = repairs.where("audit <> ''").select(key, "conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edits = edits.withColumns({"n": F.count_if(F.col("edit") != "I").over(upto), "place": F.count_if(F.col("edit") != "D").over(upto)})
    edits = edits.withColumn("n", F.when(F.col("edit") != "I", F.col("n"))).where("edit <> 'D'")
    met = edits.join(rows, ["key", "n"], "left")
    system = F.max(F.when(F.col("place") == 1, ((F.col("edit") == "K") & F.col("role").startswith("s")).cast("int"))).over(Window.partitionBy("key"))
    given = F.when((F.col("place") - system) % 2 == 1, ROLES["u"]).otherwise(ROLES["a"])
    return met.select("conv_id", "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ends of
    sentences, 3 repeats it, 4 makes its role user. Nulls of role and text, and in the checked string, are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))), F.lit(20))
    rows = turns.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
