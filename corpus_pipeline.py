"""A corpus in five stages: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination and packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of
``documents``; the last returns packed pieces. ``run`` writes each stage's result and reads it for the next.

Documents need the five columns doc_id, text, lang, source and n_chars (a missing one is an error); other columns go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.llm import jaccard, leaks, lines, packing, toxicity
from asofspark.llm.common import DOCUMENT_COLUMNS, discard, stash_only, table
from asofspark.llm.queries import tokenizer_path


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the classifier learns from the labels of all folds."""
    docs = _documents(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _documents(toxicity.reject(toxicity.score(docs, model), model).where("not rejected"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go; every document stays, n_chars follows its text."""
    done = lines.remove_repeats(_documents(docs))
    return _documents(done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component at five words and Jaccard 0.8, the document of least doc_id stays."""
    return _documents(jaccard.keep_one(_documents(docs)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _documents(leaks.remove(_documents(docs), table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of 4096."""
    return packing.pack(_documents(docs), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier, a suffix array and a tokenizer are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. Of each stage only its result stays in the scratch folder, and that until the next one's is there."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash_only(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if name != STAGES[0][0]:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
