"""Preference pairs as a shared prompt and two masked completions.

Both conversations of a pair are compared turn by turn. The longest common prefix (same role and text at the same place) is rendered
once as the prompt; what follows is rendered for either side, with the spans of its assistant turns, the only ones to be trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values of the rendering
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"


def rendered(role, text):
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def format_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair of ``turns`` (pair_id, side "chosen" or "rejected", turn, role, text).

    prefix_turns int, prompt string, and for either side its completion string and mask, an array of (start, end) in code points of the
    completion: the text of each assistant turn and the line end that closes it. A side without turns has NULL completion and mask and
    leaves the prompt empty; equal sides share all turns and have empty completions. NULL role or text counts as empty; rows with a
    NULL pair_id, turn or another side are left out. Turns are placed by (turn, role, text): gaps in the numbering do not matter, and
    an exactly repeated row is one turn.
    """
    rows = turns.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected"))
    rows = rows.select("pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    at = Window.partitionBy("pair_id", "side").orderBy("turn", "role", "text")
    placed = rows.withColumn("at", F.row_number().over(at)).withColumn("same", F.xxhash64("role", "text"))
    # the first place where the sides differ: a count and one equality per place, without collecting a conversation
    place = placed.groupBy("pair_id", "at").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("role", "text")).alias("a"), F.max(F.struct("role", "text")).alias("b")
    )
    differ = (F.col("n") < 2) | (F.col("a") != F.col("b"))
    prefix = place.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(differ, F.col("at"))) - 1, F.max("at")).cast("int").alias("prefix_turns")
    )
    told = placed.join(prefix, "pair_id").withColumn("line", rendered(F.col("role"), F.col("text")))
    own = F.col("at") > F.col("prefix_turns")
    after = Window.partitionBy("pair_id", "side").orderBy("at")
    told = told.withColumn("end", F.sum(F.when(own, F.length("line")).otherwise(0)).over(after))
    taught = own & (F.col("role") == "assistant")
    span = F.struct((F.col("end") - F.length("text") - len(CLOSE)).cast("int").alias("start"), F.col("end").cast("int").alias("end"))

    def side(name: str) -> list:
        mine = F.col("side") == name
        ordered = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("at", "line"))))
        text = F.array_join(F.transform(ordered(mine & own), lambda x: x["line"]), "")
        spans = F.array_sort(F.collect_list(F.when(mine & taught, span)))
        there = F.max(mine)
        return [F.when(there, text).alias(f"{name}"), F.when(there, spans).alias(f"{name}_mask")]

    shared = ~own & (F.col("side") == "chosen")
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(shared, F.struct("at", "line")))), lambda x: x["line"]), "")
    return told.groupBy("pair_id").agg(F.max("prefix_turns").alias("prefix_turns"), prompt.alias("prompt"), *side("chosen"), *side("rejected"))
