"""The corpus pipeline, stage by stage, on a small corpus with planted cases."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from asofspark.llm import leaks, toxicity
from asofspark.llm.common import DOCUMENT_COLUMNS
from asofspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(11)
    words = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(900)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    text = lambda: "\n".join(line(r.randint(5, 30)) for _ in range(r.randint(1, 6)))
    items = [(k, line(20)) for k in range(5)]
    docs, labels, kinds = [], [], {}
    for k in range(240):
        t, kind = text(), "clean"
        if k % 6 == 1:
            w = t.split(" ")
            w[r.randrange(len(w))] = "zurkbad"
            t, kind = " ".join(w), "toxic"
        elif k % 12 == 4:
            t, kind = f"{t} {items[k % 5][1].upper()} {line(4)}", "leak"
        docs.append((k, t, "en", f"s{k % 3}", len(t)))
        kinds[k] = kind
        if k % 2:
            labels.append((k, 1, int(kind == "toxic")))
    for k in range(240, 250):  # near copies of one long line
        w = (docs[0][1].replace("\n", " ") + " " + line(80)).split(" ") if k == 240 else list(base)
        if k == 240:
            base = list(w)
        else:
            w[r.randrange(len(w))] = r.choice(words)
        docs.append((k, " ".join(w), "en", "copies", 9))
        kinds[k] = "copy"
    docs += [(250, None, None, None, None), (251, "", "en", "s", 0), (252, docs[2][1], "en", "s", 5), docs[3]]
    kinds |= {250: "empty", 251: "empty", 252: "exact"}
    top = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), docs, kinds, items


def test_stages_one_by_one(spark, folder):
    top, docs, kinds, items = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    now, seen = spark.read.parquet(f"{top}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, top)
        assert out.columns == list(DOCUMENT_COLUMNS)
        rows = out.collect()
        now = spark.createDataFrame(rows, SCHEMA)
        seen[name] = {x["doc_id"]: x for x in rows}
    clean = {k for k, v in kinds.items() if v not in ("toxic",)}
    assert clean <= set(seen["toxicity"]) and not {k for k in seen["toxicity"] if kinds[k] == "toxic"}
    lines = seen["line_dedup"]
    assert set(lines) == set(seen["toxicity"])
    assert lines[252]["text"] == "" or len(lines[252]["text"]) < len(docs[2][1])  # an exact copy loses its long lines
    assert all(x["n_chars"] == len(x["text"]) for x in lines.values() if x["text"] is not None and x["doc_id"] == 252)
    copies = [k for k in seen["ngram_jaccard"] if kinds[k] == "copy"]
    assert copies == [240]
    left = seen["decontamination"]
    assert {k for k in seen["ngram_jaccard"]} - set(left) == {k for k, x in seen["ngram_jaccard"].items() if any(t in leaks.normal(x["text"]) for _, t in items)}
    assert all(kinds[k] == "leak" for k in set(seen["ngram_jaccard"]) - set(left))
    assert {250, 251} <= set(left)


def test_run_packs_what_is_left(spark, folder):
    from tokenizers import Tokenizer

    top, docs, kinds, _ = folder
    rows = corpus_pipeline.run(spark, top).collect()
    t = Tokenizer.from_file(tokenizer_path())
    text = {k: x for k, x, *_ in docs}
    whole = [x for x in rows if kinds[x["doc_id"]] == "clean" and x["doc_tokens"] == x["length"]]
    checked = 0
    for x in whole:
        ids = [*t.encode(text[x["doc_id"]], add_special_tokens=False).ids, 2]
        if len(ids) == x["doc_tokens"]:
            assert x["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            checked += 1
    assert checked > 100 and not {x["doc_id"] for x in rows if kinds[x["doc_id"]] in ("toxic", "leak")}


def test_stages_of_an_empty_corpus(spark, folder):
    top = folder[0]
    none = spark.read.parquet(f"{top}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, top).count() == 0


def test_run_matches_brute_force(spark, folder):
    from test_operators import brute_jaccard, expected_lines
    from tokenizers import Tokenizer

    top, docs, _, items = folder
    table = spark.read.parquet(f"{top}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{top}/labels.parquet"))
    limit = [model.thresholds.get(lang, 0.5) for _, _, lang, _, _ in docs]
    rows = [(i, t) for (i, t, *_), p, most in zip(docs, toxicity.scores(model, [d[1] for d in docs]), limit, strict=True) if p < most]
    texts = sorted({(i, t) for i, t in rows if t is not None})  # positions in order of doc_id; repeated rows count once
    gone = dict(zip(texts, expected_lines([t.split("\n") for _, t in texts]), strict=True))
    cut = {key: "\n".join(x for x, g in zip(key[1].split("\n"), marks, strict=True) if not g) for key, marks in gone.items()}
    rows = list(dict.fromkeys((i, cut.get((i, t), t)) for i, t in rows))
    text_of, kept = dict(rows), {}
    for i, n, c in brute_jaccard(rows, 5, 80):
        if n == 0 or i == c:
            kept[i] = text_of[i]
    clean = {i: t for i, t in kept.items() if not any(leaks.normal(x) in leaks.normal(t) for _, x in items)}
    t, want = Tokenizer.from_file(tokenizer_path()), {}
    for i, text in clean.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want |= {(i, at): zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes()) for at in range(0, len(ids), 4096)}
    got = corpus_pipeline.run(spark, top).collect()
    assert {x["doc_id"] for x in got} == set(clean)
    assert {(x["doc_id"], x["start"]): x["ids_crc32"] for x in got} == want and len(clean) > 100
