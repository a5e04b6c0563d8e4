"""Chat formatting of preference pairs, with DataFrame functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the prompt; what is left of
each is its completion, with the spans of characters that a loss may count: what the assistant says, and its end mark.

A conversation's turns are ordered by number, then role and text. Nulls: a null role or text is empty, a null turn
number comes first, a null key belongs to no conversation. Turns that repeat are turns of their own. A key found on one
side only gives no pair. If one conversation begins the other, its completion is empty. Empty tables give an empty
result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def mask(turns: str, trained: str = TRAINED) -> Column:
    """Spans (start, end) of characters of the rendered turns that the loss counts."""
    head, tail = len(OPEN) + len(AFTER_ROLE), len(CLOSE)
    step = (
        f"aggregate({turns}, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)),"
        f" (a, t) -> named_struct('at', a.at + {head + tail} + length(t.role) + length(t.text), 'spans',"
        f" if(t.role = '{trained}', concat(a.spans, array(named_struct('start', a.at + {head} + length(t.role), 'end', a.at + {head + tail} + length(t.role) + length(t.text)))), a.spans)),"
        " a -> a.spans)"
    )
    return F.expr(step)


def turns_of(df: DataFrame, key: str, side: int, turn: str, role: str, text: str) -> DataFrame:
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("pair_id"), F.struct(F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text")).alias("t"), F.lit(side).alias("side"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask): one row for each key on both sides. One shuffle."""
    both = turns_of(chosen, key, 0, turn, role, text).unionByName(turns_of(rejected, key, 1, turn, role, text))
    sides = both.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.when(F.col("side") == 0, F.col("t")))).alias("c"), F.array_sort(F.collect_list(F.when(F.col("side") == 1, F.col("t")))).alias("r"))
    sides = sides.where((F.size("c") > 0) & (F.size("r") > 0)).withColumn("m", F.least(F.size("c"), F.size("r")))
    equal = F.zip_with(F.slice("c", F.lit(1), F.col("m")), F.slice("r", F.lit(1), F.col("m")), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    sides = sides.withColumn("differ", F.array_position(equal, False)).withColumn("prefix_turns", F.when(F.col("differ") == 0, F.col("m").cast("long")).otherwise(F.col("differ") - 1))
    n = F.col("prefix_turns").cast("int")
    sides = sides.withColumn("p", F.slice("c", F.lit(1), n)).withColumn("c", F.slice("c", n + 1, F.size("c"))).withColumn("r", F.slice("r", n + 1, F.size("r")))
    return sides.select("pair_id", "prefix_turns", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"))


def swapped_answers(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: chosen, as they are up to their last answer; rejected, the same with the
    last answer of the neighbouring conversation (ids 2k and 2k + 1 are neighbours; of conversations without an answer, or
    without such a neighbour, there is no pair)."""
    plain = turns.where(F.col(conversation).isNotNull()).select(F.col(conversation).cast("long").alias("pair_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    answers = plain.where(F.col("role") == trained).groupBy("pair_id").agg(F.max(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), "text")).alias("last"))
    other = answers.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("last.text").alias("answer"))
    ends = answers.join(other, "pair_id").select("pair_id", F.col("last.turn").alias("end"), "answer")
    kept = plain.join(ends, "pair_id").where(F.coalesce("turn", F.lit(-(1 << 62))) <= F.col("end"))
    chosen = kept.select("pair_id", "turn", "role", "text")
    at_end = (F.coalesce("turn", F.lit(-(1 << 62))) == F.col("end")) & (F.col("role") == trained)
    return chosen, kept.select("pair_id", "turn", "role", F.when(at_end, F.col("answer")).otherwise(F.col("text")).alias("text"))
