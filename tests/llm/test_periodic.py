"""Periodic runs against plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np

from asofspark.llm import periodic


def brute(words):
    """(start, end, period) of every run, period by period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        equal = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            if not equal[i]:
                i += 1
                continue
            j = i
            while equal[j]:
                j += 1
            x = words[i : j + q]
            if len(x) >= max(12, 2 * q) and not any(x[d:] == x[:-d] for d in range(1, q)):
                out.append((i, j + q, q))
            i = j
    return sorted(out)


def made(trials, seed):
    r = random.Random(seed)
    for _ in range(trials):
        n, letters = r.choice([3, 12, 40, 90, 160]), r.choice([1, 2, 3, 6, 50])
        w = [r.randrange(letters) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 2))
            for i in range(a + p, min(n, a + r.randint(p, 6 * p + 12))):
                w[i] = w[i - p]
        yield w


def test_all_runs_of_random_and_of_repetitive_words():
    f, g = [0], [0, 1]
    while len(g) < 300:
        f, g = g, g + f
    for w in [*made(250, 12), [], [0], [0] * 200, ([0] * 20 + [1]) * 9, ([0] * 5 + [1] * 7) * 12, g[:300]]:
        got = np.stack(periodic.find_runs(np.array(w, np.int64), len(w)), axis=1).tolist()
        assert sorted(map(tuple, got)) == brute(w), w


def test_transform_is_exact_and_a_zero_sum_alone_is_no_occurrence():
    a = np.random.default_rng(1).integers(0, periodic.PRIME, (3, 64))
    assert (periodic.transform(periodic.transform(a), inverse=True) == a).all()
    # two squared differences whose sum is the prime: 2013265921 = x*x + y*y
    x = next(x for x in range(1, 44_870) if int((periodic.PRIME - x * x) ** 0.5 + 0.5) ** 2 == periodic.PRIME - x * x)
    y = int((periodic.PRIME - x * x) ** 0.5 + 0.5)
    words = np.array([100_000, 100_000, 100_000 + x, 100_000 + y, 5, 6, 7, 8], np.int64)
    assert [v.tolist() for v in periodic.occurrences(words, np.array([0]), 2, 1, 4)] == [[], []]


def planted(doc_id, text):
    """The contract's words of a document."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]


def test_query_over_documents(spark, tmp_path):
    texts = [" ".join(f"w{x}" for x in w) for w in made(150, 7)]
    texts += [None, "", " \n\t ", "a " * 30, "ä\xa0b\x0bc " * 8, "tail of one", "say it again " * 4_000 + "and stop"]
    rows = [(k * 7 - 20, t) for k, t in enumerate(texts)] + [(None, "x y " * 9), (5, "same"), (5, "same")]
    spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, runs int, collapsed string, `a.b` int").write.parquet(f"{tmp_path}/documents.parquet")
    from asofspark.llm.queries import op12_periodic_runs

    want = []
    for doc_id, text in rows:
        words = planted(doc_id, text)
        runs = brute(words) if len(words) < 1_000 else [(0, 12_000, 3)]
        gone = {i for s, e, q in runs for i in range(s + q, e)}
        best = min(((s - e, s, q) for s, e, q in runs), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(runs), *top, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and w[1] for (i, _), w in zip(rows, want, strict=True))
    assert sorted(map(str, map(tuple, op12_periodic_runs(spark, str(tmp_path)).collect()))) == sorted(map(str, want))


def test_other_columns_stay_and_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "b a " * 6, 3, 4)], "doc_id long, text string, runs int, `a.b` int")
    x = periodic.search(docs).collect()[0]
    assert x.asDict(True) == {"doc_id": 1, "a.b": 4, "n_words": 12, "runs": [{"start": 0, "length": 12, "period": 2}], "collapsed": "b a"}
    assert periodic.search(docs.where("doc_id > 1")).collect() == []
