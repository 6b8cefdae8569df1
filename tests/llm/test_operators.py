"""The training-data operators against brute force, exact round trips and defined edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofspark.llm import chat, jaccard, language, leaks, licences, lines, ogg, packing, textnet, toxicity, windows
from asofspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h string, score string, n_lines string"


def frame(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, rows = text(70), []
    for k in range(60):
        t = text(r.randint(0, 160))
        if k % 4 == 1:
            t += " " + passage + "\n" + text(r.randint(0, 20))
        if k % 5 == 2 and rows:  # near copies of an earlier text, chained
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        rows.append((100 - k if k % 2 else k, t))
    base = text(150).split(" ")
    for k in range(200, 240):
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(150)] = r.choice(vocabulary)
        rows.append((k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "One"), (305, "two words"), (None, rows[1][1]), (None, rows[2][1]), rows[3], rows[3], (7, "other text of a known id " + passage), (400, passage + " " + text(5000))]
    return rows


def brute_windows(rows, n=50):
    words = [(t or "").encode().split() for _, t in rows]
    ids = [(1 << 63) - 1 if i is None else i for i, _ in rows]
    first = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            first[key] = min(first.get(key, i), i)
    out = []
    for (doc_id, _), i, w in zip(rows, ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [256, 3])
def test_windows_match_brute_force(spark, corpus, bucket_rows):
    got = windows.remove_repeats(frame(spark, corpus), bucket_rows=bucket_rows).collect()
    want = brute_windows(corpus)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert sum(x[2] > 0 for x in want) > 10


def test_windows_of_near_copies_and_periodic_texts(spark):
    r = random.Random(21)
    base, rows = [f"b{r.randrange(90)}" for _ in range(160)], []
    for k in range(60):  # near copies, so that minimisers stay hot for several levels
        w = list(base)
        for _ in range(k % 4):
            w[r.randrange(160)] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(["same"] * (500 + k % 7))) for k in range(20)] + [(200 + k, " ".join(["to", "and", "fro"] * (60 + k))) for k in range(5)]
    for bucket_rows in (2, 20):
        got = windows.remove_repeats(frame(spark, rows), bucket_rows=bucket_rows).collect()
        assert sorted([tuple(x) for x in got], key=str) == brute_windows(rows)


def test_windows_of_300_texts_of_one_word_stay_small():
    import tracemalloc

    words = [b"same"] * 20_000
    first, n, m = windows.super_kmers(words)
    assert n.max() == windows.MOST_WINDOWS and n.sum() == len(words) - 49 and len(set(m)) == 1 and (first[1:] == first[:-1] + n[:-1]).all()
    bucket = [(b"%d" % k, b" ".join([b"same"] * 113), k, k) for k in range(windows.BUCKET_ROWS)]  # as full as a bucket can be
    tracemalloc.start()
    assert len(list(windows.first_in_bucket(bucket, 50))) == 255
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_minimiser_is_that_of_the_window():
    words = [b"%d" % (k * k % 17) for k in range(300)]
    m = windows.minimisers(words)
    assert len(m) == 251
    assert all(m[k] == windows.minimisers(words[k : k + 50])[0] for k in range(0, 251, 7))


def brute_jaccard(rows, words, percent):
    sets = []
    for _, t in rows:
        w = [bytes(x) for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted([(i, len(s), least.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))], key=str)


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 400), (3, 90, 4), (5, 80, 400), (2, 70, 5)])
def test_jaccard_components_match_brute_force(spark, corpus, words, percent, block):
    got = jaccard.components(frame(spark, corpus), words, percent, block).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_jaccard(corpus, words, percent)


def test_jaccard_chain_is_one_component_of_linear_rows(spark):
    words = [f"c{k}" for k in range(5100)]
    rows = [(k, " ".join(words[k : k + 100])) for k in range(5000)]  # each is linked with its neighbours only
    rows += [(9000 + k, " ".join(words[40 * k : 40 * k + 50] + [f"z{k}x{j}" for j in range(60)])) for k in range(50)]
    got = {x["doc_id"]: x["component_id"] for x in jaccard.components(frame(spark, rows)).select("doc_id", "component_id").collect()}
    assert {got[k] for k in range(5000)} == {0} and all(got[9000 + k] == 9000 + k for k in range(50))


def test_jaccard_of_a_group_larger_than_a_block(spark):
    r = random.Random(31)
    base, rows = [f"g{r.randrange(60)}" for _ in range(130)], []
    for k in range(150):  # more or less like one text, so that some are linked with few others and some with none
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(130)] = f"y{r.randrange(12)}"
        rows.append((k, " ".join(w)))
    got = jaccard.components(frame(spark, rows), 3, 90, 10).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_jaccard(rows, 3, 90)
    assert sorted([tuple(x) for x in got], key=str) == want and 5 < len({x[2] for x in want}) < 150


def test_jaccard_of_large_keys_split_by_a_second_ngram(spark, monkeypatch):
    r = random.Random(37)
    base = [f"g{k}" for k in range(130)]
    rows = []
    for k in range(160):  # all share the rare n-grams of one passage, few are linked
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(40, 130)] = f"y{r.randrange(9)}"
        rows.append((k, " ".join(w)))
    monkeypatch.setattr(jaccard, "SPLIT", 15)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    got = jaccard.components(frame(spark, rows), 3, 90, 6).select("doc_id", "n_shingles", "component_id").collect()
    want = brute_jaccard(rows, 3, 90)
    assert sorted([tuple(x) for x in got], key=str) == want and 5 < len({x[2] for x in want}) < 150


def test_keep_one_keeps_all_columns_and_one_of_a_group(spark, corpus):
    docs = frame(spark, corpus)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(ids) == len(set(ids))
    rows = list(dict.fromkeys(corpus))
    groups = {x[2] for x in brute_jaccard(rows, 5, 80)}
    empty = {(i, t) for i, t in rows if not (t or "").split()}
    assert {i for i, _ in ids} == groups
    assert empty <= set(ids)


def test_keep_one_tells_components_of_one_id_apart(spark):
    r = random.Random(17)
    text = lambda: [f"k{r.randrange(5000)}" for _ in range(120)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (None, " ".join(c)), (None, near(c)), (None, " ".join(d))]
    kept = [(x["doc_id"], x["text"]) for x in jaccard.keep_one(frame(spark, rows)).collect()]
    assert {t for i, t in kept if i is not None} == {rows[0][1], rows[1][1]}
    alone = [t for i, t in kept if i is None]
    assert len(kept) == 4 and rows[6][1] in alone and len({rows[4][1], rows[5][1]} & set(alone)) == 1


def expected_lines(texts, min_words=10):
    """texts in order: which lines go."""
    places = [(a, p) for a, t in enumerate(texts) for p in range(len(t))]
    gone = [[False] * len(t) for t in texts]
    for x, (a, p) in enumerate(places):
        best = 0
        for b, q in places[:x]:
            n = 0
            while p + n < len(texts[a]) and q + n < len(texts[b]) and texts[a][p + n] == texts[b][q + n]:
                n += 1
            best = max(best, n)
        if best and sum(len(s.split()) for s in texts[a][p : p + best]) >= min_words:
            gone[a][p : p + best] = [True] * best
    return gone


def test_line_runs_match_brute_force(spark):
    r = random.Random(5)
    pool = [" ".join(f"v{r.randrange(50)}" for _ in range(r.randint(0, 5))) for _ in range(14)] + [f"unique {k} with seven more words in the line" for k in range(40)]
    run = [r.choice(pool) for _ in range(23)]
    texts = [[r.choice(pool) for _ in range(r.randint(1, 9))] for _ in range(30)] + [run, run[3:20], ["x"] + run[5:] + ["y"], run, ["long line of more than ten words that comes again and again"] * 3]
    rows = [(k, "\n".join(t)) for k, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in lines.remove_repeats(frame(spark, rows + [rows[4], (None, None), (99, "")])).select("doc_id", "text", "n_lines", "n_removed", "lang").collect()}
    for k, (t, g) in enumerate(zip(texts, expected_lines(texts), strict=True)):
        if k not in (99,):
            assert got[k]["n_removed"] == sum(g), k
            assert got[k]["text"] == "\n".join(x for x, o in zip(t, g, strict=True) if not o)
    assert got[None]["text"] is None and got[99]["n_lines"] == 1
    assert sum(x["n_removed"] for x in got.values()) > 60


def test_line_dedup_without_repeats(spark):
    got = lines.remove_repeats(frame(spark, [(1, "a\nb"), (2, "c")])).collect()
    assert [x["n_removed"] for x in got] == [0, 0]


def edits(a, b):
    """Least edits of a against any piece of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_brute_force(spark):
    r = random.Random(9)
    syllables = ["ka", "lo", "mi", "tre", "on", "sa", "ve", "dun", "pi", "ral"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(r.randint(4, 18))) for k in range(12)] + [(50, None), (51, ""), (52, "kot"), (None, text(9)), (53, "kalomitreons"), (54, "vedunpiralkalomitres"), (55, "mi vedunp")]
    docs = [(0, None), (1, ""), (None, items[0][1])]
    for k in range(2, 40):
        _, t = items[k % 12]
        c = list(t)
        for _ in range(r.randint(0, 2 + len(c) // 6)):
            p = r.randrange(len(c))
            c[p : p + 1] = r.choice([[], [c[p], "x"], ["q"]])
        docs.append((k, text(r.randint(0, 30)) + " " + "".join(c).upper() + "\n " + text(r.randint(0, 30)) + (" a kot b" if k == 5 else "") + (" kalomXtreons vedunpXralkalXmitres" if k == 7 else "") + (" mi vedunp" if k == 9 else "")))
    got = {(x["doc_id"], x["item_id"]): x["distance"] for x in leaks.find(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_chars=300).collect()}
    want = {}
    for d, t in docs:
        for i, b in items:
            x, y = leaks.normal(b), leaks.normal(t)
            if not x or not y:
                continue
            k = len(x) // 10 if len(x) >= 7 else 0
            e = edits(x, y) if len(x) >= 7 else 0 if f" {x} " in f" {y} " else 1
            if e <= k:
                want[d, i] = e
    assert got == want and len(want) > 12 and {(7, 53), (7, 54), (9, 55)} <= set(want)
    clean = {x["doc_id"] for x in leaks.remove(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_best_fit_and_ids(spark):
    from tokenizers import Tokenizer

    r = random.Random(1)
    words = packing.WordIds(tokenizer_path(), keep_bytes=40_000)
    whole = Tokenizer.from_file(tokenizer_path())
    signs = "abcXYZ'0 9.,\n\t\x85\xa0\x1c\x0b²¼ªß×÷ÀÿµİΣσςй\u0301J\u030c<|endoftext|>_-%'s'T'llé"
    odd = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["<|ENDOFTEXT|> a", "x<|startoftext|>y", "WE'LL 'S'RE''t"]
    assert all(words.encode(x) == np.array(whole.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in odd)
    texts = ["It's NAÏVE <|endoftext|> fin.\tTab\x1cfs", " ".join(f"tok{r.randrange(900)}x" for _ in range(9000)), None, "", "a\n\nb"] + [" ".join(r.choice(["alpha", "beta", "Gamma!", "δ"]) for _ in range(r.randint(1, 700))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(3, "")]
    got = packing.best_fit(packing.stash(packing.token_pieces(frame(spark, rows), tokenizer_path(), window=512), "t"), window=512, group_pieces=60).collect()
    t = Tokenizer.from_file(tokenizer_path())
    for d, text in rows[:-1]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted({(x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got if x["doc_id"] == d})
        at = 0
        for start, length, crc, n in own:
            assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    sequences: dict = {}
    for x in got:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    full = []
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
        full.append(at)
    assert sum(full) / (512 * len(full)) > 0.95


def test_packing_fills_windows_at_production_size(spark):
    r = np.random.default_rng(3)
    lengths = np.minimum(4096, np.exp(r.normal(6, 1.2, 60_000)).astype(int) + 1)
    rows = spark.createDataFrame([(int(k), int(n), "x", 0.5) for k, n in enumerate(lengths)], "`a b` long, length long, offset string, __g double")
    got = packing.best_fit(rows).cache()
    assert got.columns == ["a b", "length", "__g", "sequence_id", "offset"] and got.count() == len(lengths)
    n, total = got.agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert total / (4096 * n) > 0.998
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n <> end or end > 4096").isEmpty()
    assert sorted(map(tuple, packing.best_fit(rows).select("a b", "sequence_id", "offset").collect())) == sorted(map(tuple, got.select("a b", "sequence_id", "offset").collect()))


def test_segment_tree_finds_the_tightest():
    tree, held, r = packing.Capacities(64), [], random.Random(2)
    for k in range(2000):
        if r.random() < 0.5:
            c = r.randint(1, 64)
            tree.add(k, c)
            held.append(c)
        else:
            need = r.randint(1, 64)
            best = min((c for c in held if c >= need), default=None)
            found = tree.take_tightest(need)
            assert (found[1] if found else None) == best
            if found:
                held.remove(best)


def test_ogg_round_trip_and_damage(spark):
    for data in (b"", b"x", bytes(range(256)) * 300, "é".encode() * 64, bytes(4096 * 17), bytes(255 * 255 * 2)):
        media = ogg.encode(data)
        x = ogg.decode(media)
        assert x["payload"][: len(data)] == data and x["n_bytes"] == len(data) and len(x["payload"]) % 64 == 0 and x["payload"]
        assert x["streams"] == 2 and x["ms"] == len(x["payload"]) // 8
        broken = bytearray(media)
        broken[len(media) // 2] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.decode(bytes(broken))
        with pytest.raises(ogg.OggError):
            ogg.decode(media[:-1])
    crc = 0
    for byte in b"OggS test page":  # the bitwise definition
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg.page_checksum(b"OggS test page") == crc
    rows = ogg.read_media(ogg.to_media(frame(spark, [(1, None), (2, ""), (3, "same"), (None, "same")]))).collect()
    assert rows[0]["media_sha256"] == rows[1]["media_sha256"] and rows[2]["feature"] == rows[3]["feature"] and rows[0]["payload_bytes"] == 64
    bad = ogg.read_media(spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")).collect()
    assert bad[0]["valid"] is False and bad[1]["valid"] is None


def test_media_columns_by_hand(spark):
    rows = [(1, "héllo " * 4000), (2, None), (3, "x" * 64), (4, "x" * 65)]
    stored = {x["doc_id"]: bytes(x["media"]) for x in ogg.to_media(frame(spark, rows)).collect()}
    got = {x["doc_id"]: x for x in ogg.read_media(ogg.to_media(frame(spark, rows))).collect()}
    for k, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        x, v = got[k], np.frombuffer(payload, np.uint8).astype(float)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(stored[k]), hashlib.sha256(stored[k]).hexdigest())
        pages, at = [], 0  # the container read anew: serial, granule, lacing values of each page
        while at < len(stored[k]):
            n = stored[k][at + 26]
            lacing = stored[k][at + 27 : at + 27 + n]
            pages.append((int.from_bytes(stored[k][at + 14 : at + 18], "little"), int.from_bytes(stored[k][at + 6 : at + 14], "little", signed=True), lacing))
            at += 27 + n + sum(lacing)
        crossings = sum((a >= 96) != (b >= 96) for a, b in zip(payload, payload[1:]))
        assert x["feature"] == f"streams=2;pages={len(pages)};packets={sum(c < 255 for p in pages for c in p[2])};ms={len(payload) // 8};mean={v.mean():.4f};sd={v.std():.4f};crossings={crossings}"
        ends = {(p["serial"], p["end_ms"]) for p in x["page_times"]}
        assert ends == {(s, g // 8) for s, g, lacing in pages if g >= 0} and x["packet_end_ms"] == [min(i + 4096, len(payload)) // 8 for i in range(0, len(payload), 4096)]
        assert {s["kind"][:4] for s in x["streams"]} == {"PCM8", "NOTE"} and sum(s["pages"] for s in x["streams"]) == len(pages)
    other = b"".join(ogg.stream_pages(77, [(b"\x01vorbis", 0), (b"abc", 960), (b"d" * 70_000, 1920)]))
    x = ogg.read_media(spark.createDataFrame([(1, other)], "doc_id long, media binary")).first()
    assert x["valid"] and x["payload_bytes"] is None and [tuple(s) for s in x["streams"]] == [(77, "\x01vorbis", 3, 3, 1920)]


def test_licences_by_brute_force(spark):
    texts = ["Released under the MIT License.", "released under MIT license", "x\n  This work is licensed under the GNU General Public License, version 2!\nmore", None, "", "license", "Licensed under CC BY-NC 4.0. and much more text follows here that does not belong", "the the the the the"]
    got = {x["doc_id"]: x for x in licences.scan(frame(spark, list(enumerate(texts)))).collect()}
    sets = {k: set(licences.bigrams(v)) for k, v in licences.TEMPLATES.items()}
    for k, t in enumerate(texts):
        want = []
        for n, line in enumerate((t or "").split("\n") if t is not None else []):
            a = set(licences.bigrams(line))
            if a:
                best = max(sorted(sets), key=lambda x: (2 * len(a & sets[x]) / (len(a) + len(sets[x])), [-ord(c) for c in x]))
                score = round(2 * len(a & sets[best]) / (len(a) + len(sets[best])), 6)
                if score >= 0.8:
                    want.append((n, best, score))
        assert [tuple(m) for m in got[k]["licences"]] == want and got[k]["n_matches"] == len(want)
    assert got[2]["licences"][0]["licence"] == "GPL-2.0" and got[3]["n_lines"] == 0


def test_licences_wrapped_over_lines(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction."
    by = "x y z\n\n# This work is licensed under a Creative Commons\n#\n# Attribution 4.0 International License.\nother words"
    texts = [grant, by, by + "\n" + grant, "This work is licensed under a\nRome and\nCarthage", "\n".join(licences.TEMPLATES["GPL-3.0"].split(" ")), "Released under the MIT License.\nReleased under\nthe MIT License."]
    got = {x["doc_id"]: [tuple(m)[:2] for m in x["licences"]] for x in licences.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {0: [(0, "MIT-grant")], 1: [(2, "CC-BY-4.0")], 2: [(2, "CC-BY-4.0"), (6, "MIT-grant")], 3: [], 4: [(0, "GPL-3.0")], 5: [(0, "MIT"), (1, "MIT")]}


def test_whole_licence_texts(spark):
    import textwrap

    wrap = lambda name, width, mark: "\n".join(mark + x for x in textwrap.wrap(" ".join(licences.TEXTS[name].split()), width))
    code = "\n".join(f"def f{k}(a, b):\n    return a + {k} * b" for k in range(40))
    mit, apache, isc = wrap("MIT-text", 72, "# "), wrap("Apache-2.0-notice", 60, " * "), wrap("ISC-text", 200, "")
    half = "\n".join(mit.split("\n")[: len(mit.split("\n")) // 2])
    texts = [f"# Copyright somebody\n#\n{mit}\n\n{code}", f"/*\n{apache}\n */\n{code}\n{mit}", isc, half + "\n" + code, code, "x\nReleased under the MIT License.\n" + isc.replace("AUTHOR", "HOLDER")]
    got = {x["doc_id"]: [(m["line"], m["licence"]) for m in x["licences"]] for x in licences.scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got[0] == [(2, "MIT-text")] and got[1] == [(1, "Apache-2.0-notice"), (1 + apache.count("\n") + 1 + 1 + code.count("\n") + 1, "MIT-text")]
    assert got[2] == [(0, "ISC-text")] and all(k != "MIT-text" for _, k in got[3]) and got[4] == [] and got[5] == [(1, "MIT"), (2, "ISC-text")]


def test_very_long_texts(spark):
    r = random.Random(41)
    long = "\n".join(" ".join(f"q{r.randrange(9000)}" for _ in range(12)) for _ in range(6000))  # some 400,000 characters
    rows = [(1, long), (2, "x\n" + long), (3, "short"), (4, "m" * 300_000)]
    docs = frame(spark, rows)
    assert {x["doc_id"]: x["n_removed"] for x in windows.remove_repeats(docs).collect()} == {1: 0, 2: 72_000, 3: 0, 4: 0}
    assert {x["component_id"] for x in jaccard.components(docs).where("doc_id < 3").collect()} == {1}
    done = {x["doc_id"]: x for x in lines.remove_repeats(docs).collect()}
    assert done[2]["text"] == "x" and done[1]["text"] == long and done[2]["n_removed"] == 6000
    media = {x["doc_id"]: x for x in ogg.read_media(ogg.to_media(docs)).collect()}
    assert all(media[k]["n_bytes"] == len(t) and media[k]["valid"] for k, t in rows)
    pieces = packing.pack(docs, tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == 4 and all(x["n"] == x["m"] for x in pieces)
    assert [x["n_matches"] for x in licences.scan(docs).collect()] == [0] * 4
    model = toxicity.fit(["good", "bad zurk"] * 20, np.array([0, 1] * 20))
    assert all(0 <= x["score"] <= 1 for x in toxicity.score(docs, model).select("score").collect())
    known = language.fit([language.sparse("abc"), language.sparse("xyz")] * 20, ["a", "b"] * 20, epochs=2)
    assert {x["lang_pred"] for x in language.predict(docs, known).select("lang_pred").collect()} <= {"a", "b"}
    assert {(x["doc_id"], x["item_id"]) for x in leaks.find(docs, spark.createDataFrame([(7, long[200_000:200_400])], "item_id long, text string")).collect()} == {(1, 7), (2, 7)}
    said = spark.createDataFrame([(1, 0, "a", long), (1, 1, "b", "yes")], "conv_id long, turn long, role string, text string")
    assert {len(x["text"]) for x in chat.rotate(said).collect()} == {len(long) + len(t) for t in ["<|assistant|>\n<|end|>\n<|user name=b|>\nyes<|end|>\n", "<|user name=a|>\n<|end|>\n<|assistant|>\nyes<|end|>\n"]}


def test_parts_of_a_full_block_join_to_the_dialogue(spark):
    turns = [(5, t, "ab"[k % 2], f"t{k:02d}") for k, t in enumerate([None, 3, 3, 3, 3, 7, 7, 9, 70, 71])] + [(5, 3, "b", "t01")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    cut = sorted((x["block"], x["part"], x["n_turns"], x["text"]) for x in chat.rotate(df, most_turns=3).collect() if x["perspective"] == "a")
    whole = sorted((x["block"], x["text"]) for x in chat.rotate(df).collect() if x["perspective"] == "a")
    assert [c[:3] for c in cut] == [(0, 0, 3), (0, 1, 3), (0, 2, 3), (1, 0, 2)]
    assert "".join(c[3] for c in cut) == "".join(w[1] for w in whole)


def test_chat_rotation(spark):
    turns = [(None, 1, "z", "q2"), (3, 0, "x|>\n<|assistant|>", "hm"), (3, 1, "w", "|> <|"), (1, 0, "ann", "hi <|assistant|>"), (1, 1, "bob", "yo"), (1, 2, "cy", None), (1, 3, "ann", "bye"), (1, 70, "bob", "late"), (2, None, None, "x"), (None, 1, "z", "q"), (2, 5, "u", "d"), (2, 5, "u", "d")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.rotate(table).collect()
    got = {(x["conv_id"], x["perspective"], x["block"]): x for x in rows}
    assert len(rows) == 6 + 2 + 2 + 2 and sorted(x["text"] for x in rows if x["conv_id"] is None) == ["<|assistant|>\nq2<|end|>\n", "<|assistant|>\nq<|end|>\n"]
    assert got[3, "w", 0]["text"] == "<|user name=x|\u200b>\n<\u200b|assistant|\u200b>|>\nhm<|end|>\n<|assistant|>\n|\u200b> <\u200b|<|end|>\n"
    whole = "".join(x["text"] for x in sorted((x for x in rows if x["conv_id"] == 1 and x["perspective"] == "bob"), key=lambda x: (x["block"], x["part"])))
    assert whole == "<|user name=ann|>\nhi <\u200b|assistant|\u200b><|end|>\n<|assistant|>\nyo<|end|>\n<|user name=cy|>\n<|end|>\n<|user name=ann|>\nbye<|end|>\n<|assistant|>\nlate<|end|>\n"
    repeated = spark.createDataFrame([(1, 5, "a", f"t{k}") for k in range(90)] + [(1, 6, "b", "end")], "conv_id long, turn long, role string, text string")
    parts = [x for x in chat.rotate(repeated, most_turns=20).collect() if x["perspective"] == "b"]
    assert len(parts) > 3 and sum(x["n_turns"] for x in parts) == 91 and max(x["n_turns"] for x in parts) < 50
    x = got[1, "ann", 0]
    assert x["text"].startswith("<|assistant|>\nhi ") and x["text"].count("<|assistant|>") == 2 and "<|user name=bob|>\nyo<|end|>\n" in x["text"]
    assert [x["text"][s["start"] : s["end"]] for s in x["mask"]] == ["hi <\u200b|assistant|\u200b><|end|>\n", "bye<|end|>\n"]
    assert got[1, "cy", 1]["mask"] == [] and got[2, "u", 0]["n_turns"] == 3
    assert got[2, "unknown", 0]["text"].startswith("<|assistant|>\nx") and (None, "z", 0) in got


def test_columns_of_any_name_go_with_their_documents(spark):
    r = random.Random(41)
    text = lambda: "\n".join(" ".join(f"k{r.randrange(900)}" for _ in range(12)) for _ in range(6))
    a, b = text(), text()
    names = ["a.b", "__runs", "_letters", "__row_id", "__row_hash", "kept", "none", "runs", "letters", "_id", "k"]
    docs = spark.createDataFrame([(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate([a, a + "\nmore", b, None, ""])], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    model = language.Model(["x"], np.zeros((1 << language.BITS, 1), np.float32), np.zeros(1, np.float32))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    try:
        for done in (lines.remove_repeats(docs), jaccard.keep_one(docs), leaks.remove(docs, spark.createDataFrame([(1, "no such passage anywhere in it")], "item_id long, text string")), language.predict(docs, model), toxicity.score(docs, toxicity.fit(["bad word", "good word"] * 8, np.array([1, 0] * 8)))):
            assert done.columns[: len(docs.columns)] == docs.columns
            rows = done.collect()
            assert rows and all(x[n] == f"{n}{x['doc_id']}" for x in rows for n in names)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_toxicity_learns_and_holds_out(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for k in range(400):
        w = [word() for _ in range(r.randint(3, 60))]
        bad = k % 4 == 0
        if bad:
            w[r.randrange(len(w))] = "zurk" + word()
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(900, None), (901, ""), (None, "zurkaa"), rows[0]]
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int"), learn_from=toxicity.fold("doc_id") != 0)
    got = toxicity.score(docs.select("doc_id", "text"), model).collect()
    truth = dict(labels)
    held = [x for x in got if x["doc_id"] in truth and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(x["score"] >= 0.5) == truth[x["doc_id"]] for x in held]) > 0.9
    assert all(0 <= x["score"] <= 1 for x in got) and len(got) == len(rows)
    assert {c for c in toxicity.reject(toxicity.score(docs.drop("score"), model), model).columns} >= {"rejected", "score"}
    alone = toxicity.fit(["a b", "c"], np.array([0, 0]))
    assert toxicity.scores(alone, ["a", None]).max() < 0.5


def test_scores_match_naive_loops():
    texts = ["good day to you", "bad zurk zürk9 extraordinarily", "", "Zurk", "one, two; three!"]
    model = toxicity.fit(texts * 10, np.array([0, 1, 0, 1, 0] * 10))
    mix = [int(x) for x in textnet._MIX]
    for t in texts:
        words, held = [], bytearray()
        for c in t.lower().encode() + b" ":
            if c >= 128 or chr(c).isalnum():
                held.append(c)
            elif held:
                words.append(bytes(held))
                held = bytearray()
        rows = []
        for w in words:
            head, tail = int.from_bytes(w[:8], "little"), int.from_bytes(w[-8:], "little")
            ids = [((int.from_bytes(w[: min(p, len(w))], "little") + k) * mix[k] % 2**64) >> (64 - toxicity.BITS) for k, p in enumerate(textnet.PREFIXES)]
            ids.append((((head * mix[4]) ^ (tail * mix[5]) ^ (len(w) * mix[0])) % 2**64 * mix[1] % 2**64) >> (64 - toxicity.BITS))
            rows.append(sum(model.table[i] for i in ids))
        rows += [np.zeros(toxicity.DIM, np.float32)] * 2
        z = model.offset
        for f, (width, kernel) in enumerate((w, k) for w, k in zip(toxicity.WIDTHS, model.kernels)):
            for j in range(toxicity.FILTERS):
                top = max((sum(float(rows[i + d] @ kernel[d, :, j]) for d in range(width)) for i in range(len(rows) - width + 1)), default=-np.inf)
                z += max(0.0, top + float(model.bias[f * toxicity.FILTERS + j])) * float(model.dense[f * toxicity.FILTERS + j])
        assert abs(z - toxicity.logits(model, [t])[0]) < 1e-3
        assert abs(1 / (1 + np.exp(-(model.scale * z + model.shift))) - toxicity.scores(model, [t])[0]) < 1e-3


def test_language_probabilities_match_naive_loops():
    r = np.random.default_rng(2)
    model = language.Model(["a", "b", "c"], r.normal(size=(1 << language.BITS, 3)).astype(np.float32), np.array([0.1, 0.0, -0.2], np.float32), 1.5)
    texts = ["Héllo wörld", "", "x", "tab\tand more " * 30]
    got = language.probabilities(model, texts)
    for t, p in zip(texts, got, strict=True):
        raw = b" " + bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in t.lower().encode()) + b"   "
        total, n = np.zeros(3), 0
        for i in range(len(raw) - 3):
            for k in range(1, 5):
                code = int.from_bytes(raw[i : i + k], "little")
                code = ((code * 0x9E3779B1 + 0x7F4A7C15 * k) % 2**32) * 0x85EBCA6B % 2**32 >> (32 - language.BITS)
                total, n = total + model.shares[code], n + 1
        z = (total / n + model.bias) * model.temperature
        assert np.allclose(p, np.exp(z) / np.exp(z).sum(), atol=1e-4)
    assert np.allclose(language.probabilities(model, texts[1:2]), got[1:2])


def test_language_sample_is_bounded(spark):
    rows = [(k % 50, f"text {k} of many", f"l{k % 7}") for k in range(700)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_per_lang=6, sample_rows=35, epochs=1)
    assert model.langs == [f"l{k}" for k in range(7)]


def test_pooling_does_not_cross_texts():
    model = toxicity.fit(["good day", "bad zurk", "fine", "zurk"] * 20, np.array([0, 1, 0, 1] * 20))
    together = toxicity.logits(model, ["zurk", "", "good", "bad zurk day"])
    alone = np.concatenate([toxicity.logits(model, [t]) for t in ["zurk", "", "good", "bad zurk day"]])
    assert np.allclose(together, alone, atol=1e-4)


def test_word_features_follow_the_words():
    ids, n = textnet.word_features(["Hello, hello wörld", "", "hello"], 12)
    assert n.tolist() == [3, 0, 1] and (ids[0] == ids[1]).all() and (ids[0] == ids[3]).all() and (ids[2] != ids[0]).any()


def test_language_learns(spark):
    r = random.Random(6)
    make = {"aa": "abcde", "bb": "vwxyzö"}
    rows = []
    for k in range(200):
        lang = "aa" if k % 3 else "bb"
        rows.append((k, " ".join("".join(r.choice(make[lang]) for _ in range(4)) for _ in range(r.randint(4, 40))), lang))
    rows += [(500, None, "aa"), (501, "123 !!", "bb"), (502, "abc", None), (None, "vwx", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.predict(docs.select("doc_id", "text"), language.train(docs, learn_from=toxicity.fold("doc_id") != 0)).collect()
    held = [(x["lang_pred"], rows[x["doc_id"]][2]) for x in got if x["doc_id"] is not None and x["doc_id"] < 200 and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    by = {x["doc_id"]: x for x in got}
    assert by[500]["lang_pred"] == by[501]["lang_pred"] == "und" and by[500]["score"] == 0 and by[502]["lang_pred"] == "aa"
    empty = language.predict(docs.limit(0), language.train(docs.limit(0)))
    assert empty.count() == 0


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert windows.remove_repeats(docs).count() == jaccard.components(docs).count() == lines.remove_repeats(docs).count() == 0
    assert leaks.find(docs, items).count() == packing.pack(docs, tokenizer_path()).count() == licences.scan(docs).count() == 0
    assert leaks.find(frame(spark, [(1, "text")]), items).count() == 0
    assert ogg.read_media(ogg.to_media(docs)).count() == jaccard.keep_one(docs).count() == 0
    assert toxicity.score(docs.drop("score"), toxicity.train(docs, labels)).count() == 0


def test_components_of_a_long_path(spark):
    from asofspark.llm.common import component_labels

    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1005), (1005, 1003), (7, 7)]
    got = {x["node"]: x["component"] for x in component_labels(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert set(got.values()) == {0, 1000} and got[300] == 0 and got[1003] == 1000


def test_leaks_in_slices_and_groups_of_texts(monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeo") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(r.randint(4, 20))) for k in range(6)]
    texts = []
    for k in range(60):
        c = list(items[k % 6][1])
        for _ in range(r.randint(0, len(c) // 8)):
            p = r.randrange(len(c))
            c[p : p + 1] = r.choice([[], [c[p], "z"], ["y"]])
        texts.append(text(r.randint(0, 150)) + " " + "".join(c) + " " + text(r.randint(0, 150)) if k % 4 else text(r.randint(0, 3)))
    block = leaks.block(items)
    for size in (1_000_000, 400, 120):
        monkeypatch.setattr(leaks, "SLICE_CHARS", size)
        for t, found in zip(texts, leaks.matches(block, texts), strict=True):
            got = {i: d for i, d, _, _ in found}
            want = {i: e for i, b in items if (e := edits(b, t)) <= len(b) // 10}
            assert got == want


def test_leaks_of_one_letter_texts_stay_small():
    import tracemalloc

    index = leaks.block([(1, "a" * 1500), (2, "ab" * 40), (3, "zzzzzzzzzz")])
    tracemalloc.start()
    got = leaks.matches(index, ["a" * 10_000, "ab" * 300 + "q" + "ab" * 300, "b" * 9000, "z" * 9])
    assert [[i for i, *_ in x] for x in got] == [[1], [2], [], [3]]
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()


def test_prefix_trees_match_all_pairs():
    r = random.Random(12)
    for percent in (70, 80, 90):
        base = [sorted(r.sample(range(400), 60)) for _ in range(4)]
        rows = []
        for k in range(90):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 9)):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(400))
            a = np.array(sorted(s), np.uint64)
            rows.append((k, len(a), a))
        root = {k: k for k, _, _ in rows}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i, n, a in rows:
            for j, m, b in rows[:i]:
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (n + m - both):
                    root[find(i)] = find(j)
        want = {frozenset(x for x in root if find(x) == f) for f in {find(x) for x in root}}
        got = {k: k for k in root}
        for i, j in jaccard.links(rows, percent):
            old, new = got[i], got[j]
            got = {k: new if v == old else v for k, v in got.items()}
        assert {frozenset(x for x in got if got[x] == f) for f in set(got.values())} == want
