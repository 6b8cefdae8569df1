"""Chat formatting: one rendering of a dialogue for every participant, with that speaker as the assistant.

Only DataFrame functions run. A dialogue's turns are cut into blocks of ``block_turns`` by turn number, so that a
dialogue of any length spreads over many rows; a block is rendered once for each participant of the whole dialogue.
The speaker's own turns carry the assistant tag and a mask span, the others are named users. The texts of a dialogue's
blocks, joined in order of block and part, are the whole dialogue; mask spans count characters from the start of their
block.

Defined results: null role is the speaker "unknown", null text is empty, a turn without conv_id is a dialogue of its
own; turns of equal number are ordered by role and text; rows with equal conv_id, turn, role and text count once per
row; a null turn comes in block 0 before all others; where turns repeat a number so often that a block has more than
``most_turns``, it is cut in that order into parts (``part``, else 0); a very long text is one row; an empty table gives no
rows. Tags in texts and roles are broken up by a zero-width space, so that neither can
forge one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS, MOST_TURNS = 64, 4096
OPEN, CLOSE = "<|", "|>"


def broken_up(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(OPEN), F.lit("<\u200b|")), F.lit(CLOSE), F.lit("|\u200b>"))


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS, most_turns: int = MOST_TURNS) -> DataFrame:
    """Rows (conv_id, perspective, block, part, n_turns, n_masked_chars, text, mask array<struct<start, end>>)."""
    said = turns.select(
        "conv_id",
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.col("turn").alias("turn"),
        broken_up(F.coalesce("text", F.lit(""))).alias("body"),
        F.floor(F.coalesce(F.col("turn"), F.lit(0)) / block_turns).cast("long").alias("block"),
    )
    own, alone = said.where("conv_id is not null"), said.where("conv_id is null")
    place = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "speaker", "body")) - 1
    parts = own.withColumn("part", F.floor(place / most_turns).cast("long"))
    blocks = parts.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "body"))).alias("turns"))
    people = own.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    one = blocks.join(people, "conv_id").select("conv_id", "block", "part", "turns", "perspective")
    one = one.unionByName(alone.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("part"), F.array(F.struct("turn", "speaker", "body")).alias("turns"), F.col("speaker").alias("perspective")))

    def head(t):
        return F.when(t["speaker"] == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), broken_up(t["speaker"]), F.lit("|>\n")))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["body"], F.lit("<|end|>\n")).alias("body"), (t["speaker"] == F.col("perspective")).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def step(a, p):
        begin = a["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["own"], F.concat(a["mask"], span)).otherwise(a["mask"]).alias("mask"))

    drawn = one.select("conv_id", "perspective", "block", "part", F.size("turns").cast("long").alias("n_turns"), parts.alias("parts"))
    drawn = drawn.select("conv_id", "perspective", "block", "part", "n_turns", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "").alias("text"), F.aggregate("parts", start, step)["mask"].alias("mask"))
    masked = F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return drawn.select("conv_id", "perspective", "block", "part", "n_turns", masked.alias("n_masked_chars"), "text", "mask")
