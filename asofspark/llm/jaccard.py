"""N-gram Jaccard join by prefix trees: documents whose sets of word n-grams are alike, and their components.

1. Every document becomes the set of its hashed word n-grams (64 bits); equal sets (by 128 bits) are one class from here on.
2. A pair of at least ``percent`` Jaccard shares, in any global order of n-grams, some of the first ones. A class with
   fewer shared ones among its first than any partner would demand has no partner and is left out. Both sides of
   this test are aggregated counts, with hot n-grams combined before they are shuffled.
3. The n-grams of the classes left are counted. The global order is by that count (its power of two, the frequent first),
   then by hash; what no other class has is left out. The rarest n-grams of a class, as many as a partner can't lack
   altogether, are its keys: partners share a key, and are of one size class or of neighbouring ones.
4. The classes of a key, at most ``block`` of them in a task, form a compressed trie in the global order. Each set walks the
   trie, sharing the overlap of common beginnings, and leaves a subtree when the remaining lengths can't reach the demanded
   overlap any more, or when the subtree is all in the set's own component already. Keys with the same classes are one.
5. Tries come in rounds, as most classes of a key are alike or else few: first each class goes with its rarest keys; then,
   under keys whose classes are of several components, one class of each component; keys whose classes all met, or are of
   one component, are done. Under the keys left every class meets every other of another component: a key of many classes
   is split by the next n-gram of the global order, which partners share as well, and what is still large is dealt in
   pairs of blocks, with each other and with the key's largest component, whose own pairs need no look any more.
6. The links found, a spanning forest of each task, are joined to components.

Defined results: null text and text without words have an empty set and are linked with nothing, also not with each
other; texts shorter than an n-gram are one n-gram; rows that share a doc_id are documents of their own; null doc_id
comes last, a component of such rows alone has null component_id; repeated rows fall into one class; a very long text is
one row in one task; an empty table gives no rows. Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, LAST_ID, beside, binaries, component_labels, discard, kept_columns, keyed, keyed_columns, map_batches, stash

BLOCK = 200
#: Rarest keys of a class in the first round, rounds with one class of a component after it, and classes under a key from
#: which on it is split by a second n-gram.
RAREST, ROUNDS, SPLIT = 2, 2, 4 * BLOCK
SHINGLES = "_id long, _h long, doc_id long, n long, digest binary, first array<long>"


def shingles(raw: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a UTF-8 text, A-Z lower-cased, split at ASCII white space."""
    w = raw.lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    out = h[: max(1, len(h) - words + 1)].copy()
    for j in range(1, min(words, len(h))):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(min(len(h), words))
    return np.unique(out ^ (out >> np.uint64(32)))


def least_overlap(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def shared_firsts(n: int) -> int:
    """How many of their first n-grams partners of n n-grams must share; firsts are counted to allow for it."""
    return max(1, n // 10)


def first_count(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + shared_firsts(n)


def links(rows: list[tuple[int, int, np.ndarray]], percent: int, component: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """rows: (key, size, n-grams in their global order, as ascending numbers). A spanning forest of the pairs that reach
    ``percent`` Jaccard, on top of the components already known (by key)."""
    rows = list({k: (k, n, s) for k, n, s in rows}.values())
    while len(rows) > 1:  # n-grams that no other row has match nothing; rows with too many of them have no partner
        every = np.concatenate([s for _, _, s in rows])
        values, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        least = min(n for _, n, _ in rows)
        held, at, matched = [], 0, []
        for r in rows:
            ids = inverse[at : at + len(r[2])]
            at += len(r[2])
            ids = ids[count[ids] > 1]
            if (100 + percent) * len(ids) >= percent * (r[1] + max(least, least_overlap(r[1], percent))):
                held.append(r)
                matched.append(ids)
        if len(held) == len(rows):
            break
        rows = held
    if len(rows) < 2:
        return []
    order = sorted(range(len(rows)), key=lambda i: matched[i].astype(">u4").tobytes())
    keys, size, sets = [rows[i][0] for i in order], [rows[i][1] for i in order], [matched[i] for i in order]
    known = [(component or {}).get(k, k) for k in keys]
    first = {c: i for i, c in reversed(list(enumerate(known)))}
    return _walk(keys, np.array(size), sets, len(values), percent, np.array([first[c] for c in known]))


def _node(sets: list[np.ndarray], size: np.ndarray, lo: int, hi: int, depth: int) -> tuple:
    """(lo, hi, depth after the edge, edge, least size, greatest rest, rows that end here, children)."""
    a, b = sets[lo][depth:], sets[hi - 1][depth:]
    k = min(len(a), len(b))
    apart = np.flatnonzero(a[:k] != b[:k])
    k = int(apart[0]) if len(apart) else k
    end, children, i = depth + k, [], lo
    while i < hi and len(sets[i]) == end:
        i += 1
    stop = i
    while i < hi:
        j, token = i + 1, sets[i][end]
        while j < hi and sets[j][end] == token:
            j += 1
        children.append((i, j))
        i = j
    rest = max(len(s) for s in sets[lo:hi]) - end
    return (lo, hi, end, a[:k], int(size[lo:hi].min()), rest, stop, children)


def _walk(keys: list[int], size: np.ndarray, sets: list[np.ndarray], vocabulary: int, percent: int, root: np.ndarray) -> list[tuple[int, int]]:
    made: dict[tuple[int, int, int], tuple] = {}
    found, own = [], np.zeros(vocabulary + 1, bool)
    for x, mine in enumerate(sets):
        own[mine] = True
        stack = [(0, len(sets), 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            if (root[lo:hi] == root[x]).all():
                continue
            node = made.get((lo, hi, depth)) or made.setdefault((lo, hi, depth), _node(sets, size, lo, hi, depth))
            _, _, end, edge, least, rest, stop, children = node
            overlap += int(own[edge].sum())
            left = len(mine) - int(np.searchsorted(mine, edge[-1], "right")) if len(edge) else len(mine) if not end else len(mine) - int(np.searchsorted(mine, sets[lo][end - 1], "right"))
            if (100 + percent) * (overlap + min(rest, left)) < percent * (int(size[x]) + least):
                continue
            for y in range(lo, stop):
                if root[y] != root[x] and (100 + percent) * overlap >= percent * (int(size[x]) + int(size[y])):
                    found.append((keys[x], keys[y]))
                    root[root == root[y]] = root[x]
            stack += [(i, j, end, overlap) for i, j in children]
        own[mine] = False
    return found


def short_ways(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same components by links of each node to the least one, so that few rounds join them further."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(find(x), x) for x in root if find(x) != x]


def arrays(column: pa.Array) -> list[np.ndarray]:
    """The rows of a column of long arrays."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], solve: Callable[[list[tuple]], list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Pairs from each group of rows (k, n, tokens, c) that come in the order of ``keys``."""
    now, held = None, []
    for b in batches:
        out = []
        for *g, k, n, c, tokens in zip(*(b.column(x).to_pylist() for x in (*keys, "k", "n", "c")), arrays(b.column("tokens")), strict=True):
            if g != now:
                out += solve(held)
                now, held = g, []
            held.append((k, n, tokens.copy(), c))
        yield _pairs(out)
    yield _pairs(solve(held))


def components(docs: DataFrame, words: int = 3, percent: int = 90, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, _h, doc_id, n_shingles, class_key (null: empty set), component (its own key, null:
    empty set) and component_id (its least doc_id, which components may share)."""
    docs = keyed(docs, id_col, text_col)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, key, first = [], [], []
            for t in binaries(b.column("text")):
                s = shingles(t, words) if t.strip(b" \t\n\r\x0b\x0c") else None
                n.append(0 if s is None else len(s))
                key.append(None if s is None else hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                first.append(s[: first_count(len(s), percent)].view(np.int64) if s is not None and len(s) * (100 - percent) >= percent else [])
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_h"), b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["_id", "_h", "doc_id", "n", "digest", "first"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, words).view(np.int64) for t in binaries(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n"), pa.array(sets, pa.list_(pa.int64()))], ["k", "n", "grams"])

    each = stash(map_batches(docs.select("_id", "_h", "doc_id", "text"), summarise, SHINGLES), "shingles")
    classes = each.where("digest is not null").groupBy("digest").agg(F.min(F.struct("_id", "_h")).alias("rep"), F.first("n").alias("n"), F.first("first").alias("first"))
    classes = stash(classes.select(F.monotonically_increasing_id().alias("k"), "digest", "rep", "n", "first"), "classes")

    # partners share at least ``need`` of their first n-grams
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / F.lit(100)) / 10))
    tokens = classes.where(F.size("first") > 0).select("k", "n", F.explode("first").alias("t"))
    for turn in ("once", "twice"):  # the second time among those that the first left
        shared = stash(tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t"), "shared-ngrams")  # at rest, so that the join can be split where an n-gram is hot
        rich = stash(tokens.join(shared, "t").groupBy("k", "n").agg(F.collect_list("t").alias("ts")).where(F.size("ts") >= need), f"shared-{turn}")
        tokens = rich.select("k", "n", F.explode("ts").alias("t"))
        discard(shared)

    chosen = rich.select("k", "n").join(classes.select("k", "rep._id", "rep._h"), "k")
    whole = docs.select("_id", "_h", "text").join(chosen, ["_id", "_h"]).select("k", "n", "text").dropDuplicates(["k"])
    whole = stash(map_batches(whole, sets_of, "k long, n long, grams array<long>"), "whole-sets")
    discard(rich)
    sets = _ordered(whole, percent)
    found = _links(sets, percent, block)
    discard(sets)
    labelled = classes.select("k", "digest", F.col("rep._id").alias("least")).join(found.withColumnRenamed("node", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = labelled.groupBy("component").agg(F.min("least").alias("smallest"))
    return each.select("_id", "_h", "doc_id", "n", "digest").join(labelled.select("k", "digest", "component").join(least, "component"), "digest", "left").select("_id", "_h", "doc_id", F.col("n").alias("n_shingles"), F.col("k").alias("class_key"), "component", _known(F.coalesce("smallest", "_id")).alias("component_id"))


def _ordered(whole: DataFrame, percent: int) -> DataFrame:
    """whole: (k, n, grams). At rest: (k, n, size, keys, more, tokens) of the classes that may have a partner: ``tokens``,
    their shared n-grams as numbers that ascend in the global order, ``keys``, the rarest of them, and ``more``, one more."""
    grams = whole.select("k", "n", F.explode("grams").alias("t"))
    counts = stash(grams.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "ngram-counts")
    shared = grams.join(counts, "t").groupBy("k", "n").agg(F.collect_list(F.struct("t", "c")).alias("ts")).where(F.size("ts") >= F.ceil(F.col("n") * percent / F.lit(100)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, more, numbers = [], [], []
            for n, t, c in zip(b.column("n").to_pylist(), arrays(b.column("t")), arrays(b.column("c")), strict=True):
                rare, many = np.lexsort((t, c)), len(t) - least_overlap(n, percent) + 1
                keys.append(t[rare[:many]])
                more.append(t[rare[: many + 1]])  # of these partners share two
                # five bits for the power of two, the frequent first, and 58 of the hash
                power = np.minimum(np.log2(c.astype(np.float64)).astype(np.int64), 31)
                numbers.append(np.sort(((31 - power) << 58) | (t & ((1 << 58) - 1))))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (keys, more, numbers)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("n"), b.column("size"), *lists], ["k", "n", "size", "keys", "more", "tokens"])

    # partners' sizes differ by less than one step, so they are of one size class or of neighbouring ones
    size = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent))).cast("int")
    out = map_batches(shared.select("k", "n", size.alias("size"), F.col("ts.t").alias("t"), F.col("ts.c").alias("c")), run, "k long, n long, size int, keys array<long>, more array<long>, tokens array<long>")
    out = stash(out, "ordered-sets")
    discard(counts, whole)
    return out


def _links(sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Components (node, component) of the classes that have links, all found by tries."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.select("k", "n", "tokens")

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(held: list[tuple]) -> list[tuple[int, int]]:
            return short_ways(links([x[:3] for x in held], percent, {x[0]: x[3] for x in held}))

        return _grouped(batches, ("t", "s", "i", "j"), solve)

    def met(cells: DataFrame) -> DataFrame:
        """cells: (t, s, i, j, k, c). The links of each cell's trie."""
        dealt = cells.join(rows, "k").repartition(parts, "t", "s", "i", "j").sortWithinPartitions("t", "s", "i", "j")
        return stash(map_batches(dealt, tries, "a long, b long"), "links")

    def once(groups: DataFrame) -> DataFrame:
        """groups: (t, s, k, c), those of several classes with ``members``. Of keys with the same classes one is left."""
        told = groups.groupBy("t", "s").agg(F.count("*").alias("members"), F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("k", F.lit(1)).cast("decimal(38,0)")).alias("y")).where("members > 1")
        one = stash(told.groupBy("members", "x", "y").agg(F.min(F.struct("t", "s")).alias("g")).select("g.t", "g.s", "members"), "keys-once")
        return groups.join(one, ["t", "s"])

    def dealt(groups: DataFrame) -> DataFrame:
        """Cells of at most about ``block`` classes, by hash."""
        share = F.pmod(F.xxhash64("k"), F.ceil(F.col("members") / block)).cast("int")
        return groups.select("t", "s", share.alias("i"), F.lit(0).alias("j"), "k", "c")

    def mixed(groups: DataFrame, labels: DataFrame) -> DataFrame:
        """(t, s, k, c) under the keys whose classes are of several components."""
        state = groups.join(labels.withColumnRenamed("node", "k"), "k", "left").select("t", "s", "k", F.coalesce("component", "k").alias("c"))
        several = stash(state.groupBy("t", "s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t", "s"), "mixed")  # at rest, so that the join can be split at a hot key
        out = stash(state.join(several, ["t", "s"]), "unsettled")
        discard(several)
        return out

    def joined(labels: DataFrame | None, fresh: DataFrame) -> DataFrame:
        """labels (node, component), joined further by fresh links (a, b): only the components themselves are nodes of the
        graph that is solved, so that late rounds are short."""
        if labels is None:
            return component_labels(fresh, "components")
        of = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        ends = fresh.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
        ends = stash(ends.where("x <> y"), "fresh-links")
        if ends.isEmpty():
            return labels
        top = component_labels(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "components")
        nodes = labels.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")), F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("e")).select("e.*")).distinct()
        up = top.select(F.col("node").alias("component"), F.col("component").alias("up"))
        out = stash(nodes.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        discard(ends)
        return out

    # (t, s): classes with key t of size class s or the next one
    each = sets.select("k", "size", F.posexplode("keys").alias("rank", "t")).select("k", "t", "rank", F.explode(F.array(F.col("size") - 1, F.col("size"))).alias("s"))
    each = stash(each, "keys")
    several = stash(each.groupBy("t", "s").agg(F.count("*").alias("m")).where("m > 1").select("t", "s"), "keys-of-several")
    groups = stash(each.join(several, ["t", "s"]), "groups")
    discard(each, several)
    rarest = groups.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "t", "s"))), 1, 2 * RAREST).alias("g")).select("k", F.col("k").alias("c"), F.explode("g").alias("g")).select("g.t", "g.s", "k", "c")
    labels = joined(None, met(dealt(once(rarest))))
    state = mixed(groups.select("t", "s", "k"), labels)
    discard(groups)
    for _ in range(ROUNDS):
        if state.isEmpty():
            break
        some = stash(state.groupBy("t", "s", "c").agg(F.min("k").alias("k"), F.count("*").alias("n")), "one-of-each")
        labels = joined(labels, met(dealt(once(some.select("t", "s", "k", "c")))))
        # all classes of a key have met where each was its component's only one, and one cell held them
        open_ = some.groupBy("t", "s").agg(F.count("*").alias("m"), F.max("n").alias("most")).where((F.col("most") > 1) | (F.col("m") > block)).select("t", "s")
        before, state = state, mixed(state.select("t", "s", "k").join(stash(open_, "open"), ["t", "s"]), labels)
        discard(some, before)
    if not state.isEmpty():
        labels = joined(labels, met(_cells(_split(state, sets, percent), once, block)))
    return labels


def _split(state: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """state: (t, s, k, c). Keys of more than SPLIT classes give way to pairs of n-grams: partners share a second one among
    their keys and the next n-gram after them (at 50 percent or less that may be lacking, and keys stay whole)."""
    if percent <= 50:
        return state
    large = state.groupBy("t", "s").agg(F.count("*").alias("m")).where(F.col("m") > SPLIT).select("t", "s")
    large = stash(large, "large-keys")
    if large.isEmpty():
        return state
    pairs = state.join(large, ["t", "s"]).join(sets.select("k", F.explode("more").alias("u")), "k").where("u <> t")
    pairs = stash(pairs.select(F.xxhash64(F.least("t", "u"), F.greatest("t", "u")).alias("t"), "s", "k", "c").distinct(), "pairs-of-ngrams")
    apart = pairs.groupBy("t", "s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t", "s")
    return stash(state.join(large, ["t", "s"], "left_anti").select("t", "s", "k", "c").unionByName(pairs.join(apart, ["t", "s"]).select("t", "s", "k", "c")), "split")


def _cells(state: DataFrame, once: Callable[[DataFrame], DataFrame], block: int) -> DataFrame:
    """state: (t, s, k, c). Cells in which any two classes of a key meet unless both are of its largest component."""
    state = once(state)
    by_component = state.groupBy("t", "s", "c").agg(F.count("*").alias("n"))
    of_key = by_component.groupBy("t", "s").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("most"))
    u, m = F.col("n") - F.col("most.n"), F.col("most.n")
    plan = stash(of_key.select("t", "s", F.col("most.c").alias("bulk"), (F.col("n") > block).alias("large"), F.greatest(F.lit(1), F.ceil(u / block)).cast("int").alias("apart"), F.ceil(m / block).cast("int").alias("together")), "deal")
    inside = F.col("c") == F.col("bulk")
    own = F.pmod(F.xxhash64("k"), F.when(inside, F.col("together")).otherwise(F.col("apart"))).cast("int")
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    among = F.transform(F.sequence(F.lit(0), F.col("apart") - 1), lambda x: cell(F.least(F.col("own"), x), F.greatest(F.col("own"), x)))
    across = F.transform(F.sequence(F.lit(0), F.col("together") - 1), lambda x: cell(F.col("own"), F.col("apart") + x))
    back = F.transform(F.sequence(F.lit(0), F.col("apart") - 1), lambda x: cell(x, F.col("apart") + F.col("own")))
    cells = F.when(~F.col("large"), F.array(cell(F.lit(0), F.lit(0)))).when(inside, back).otherwise(F.concat(among, across))
    return state.join(plan, ["t", "s"]).withColumn("own", own).select("t", "s", "k", "c", F.explode(cells).alias("x")).select("t", "s", "x.i", "x.j", "k", "c")


def _known(column: Column) -> Column:
    return F.when(column < LAST_ID, column)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """The documents (all columns) without near copies: of each component the row of least (doc_id, text hash)
    stays; rows without words all stay; rows that repeat id and text of a kept one go."""
    found = components(docs.select("doc_id", "text"), words, percent, block)
    group = F.when(F.col("component").isNull(), F.struct(F.lit(1).alias("x"), F.col("_id").alias("a"), F.col("_h").alias("b"))).otherwise(F.struct(F.lit(0).alias("x"), F.col("component").alias("a"), F.lit(0).cast("long").alias("b")))
    first = found.groupBy(group.alias("g")).agg(F.min(F.struct("_id", "_h")).alias("r")).select(F.col("r._id").alias(KEY[0]), F.col("r._h").alias(KEY[1]))
    rows = keyed_columns(beside(docs, docs.columns, doc_id=F.col("doc_id"), text=F.col("text")))
    return rows.join(first, list(KEY)).dropDuplicates(list(KEY)).select(*kept_columns(docs.columns))
