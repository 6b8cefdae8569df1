"""The queries of the numbered operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, language, leaks, licences, lines, ogg, packing, periodic, repair, toxicity, windows
from .common import table
from .sql import ORACLE


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.remove_repeats(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_from=toxicity.fold("doc_id") != 0)
    scored = toxicity.score(docs.select("doc_id", "text", F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False)).alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    listed = F.transform("licences", lambda m: F.concat_ws(":", m["line"].cast("string"), m["licence"]))
    return found.select("doc_id", "n_lines", "n_matches", F.array_join(listed, ",").alias("licences"), F.coalesce(F.array_max(F.transform("licences", lambda m: m["dice"])), F.lit(0.0)).alias("best_dice"))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return chat.rotate(table(spark, sf_dir, "conversations")).withColumn("mask", F.array_join(spans, ","))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, learn_from=toxicity.fold("doc_id") != 0)
    told = language.predict(docs.select("doc_id", "text", F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False)).alias("held_out")), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.to_media(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_ms")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    ranks = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    told = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "ids")
    tokens = bpe.token_table(spark, ranks)
    return bpe.decode(told, tokens, tokens.count()).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.search(periodic.plant(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shortness"), r["start"].alias("start"), r["period"].alias("period"))))
    told = found.select("doc_id", "collapsed", "runs", best.alias("best")).withColumns({"start": F.col("best.start"), "length": -F.col("best.shortness"), "period": F.col("best.period")})
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    milli = F.expr("1000 * length div period").alias("exponent_milli")
    return told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired = repair.repair(repair.damage(turns)).withColumnRenamed("conv_id", "_conv_id")
    every = turns.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict:
    return {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_license_scan, op4_chat_rotation, op5_ngram_jaccard, op6_language_id, op7_ogg_media, op8_best_fit_packing, op9_line_dedup, op10_decontamination, op11_byte_bpe, op12_periodic_runs, op13_structure_repair)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
