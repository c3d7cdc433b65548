"""Preference formatting of conversation pairs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _opened(role: str) -> Column:
    return F.concat(F.lit("<|"), F.col(role), F.lit("|>\n"))


def _render(turns: Column) -> Column:
    """Turns as '<|role|>\\ntext<|end|>\\n'."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _spans(turns: Column, trained: str) -> Column:
    """Half-open character spans, within the rendered turns, of what the trained role says, its end mark included."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        head = acc["at"] + F.length(t["role"]) + 5
        tail = head + F.length(t["text"]) + 7
        mine = F.array(F.struct(head.alias("start"), tail.alias("end")))
        return F.struct((tail + 1).alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                     text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """Pairs of conversations as (prompt, chosen, rejected) with loss masks.

    ``pair`` names the pair of a conversation, ``chosen`` says which of the two it is. The prompt is the longest common
    prefix of turns (equal role and text), rendered once; each completion is what follows in its own conversation, with
    character spans that carry loss: the turns of the trained role with their end mark. Spans count from the completion's
    start. If one conversation is a prefix of the other, its completion is empty; equal ones have two empty completions.

    Returns pair_id, chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans
    (arrays of struct start, end). Pairs that lack a side are left out, as there's nothing to prefer. Turns are ordered by
    (turn, role, text); repeated rows are repeated turns; null roles count as '' and null texts as ''; rows with a null
    conversation id belong to none. If several conversations claim a side of a pair, the one with the least id is it.
    """
    t = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("__conv"), pair.alias("pair_id"), chosen.alias("__chosen"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    ).filter("pair_id is not null and __chosen is not null")
    # a conversation is one row of the result, so its turns meet in one task; no two pairs do
    talks = t.groupBy("pair_id", "__chosen", "__conv").agg(F.array_sort(F.collect_list("t")).alias("__turns"))
    both = talks.groupBy("pair_id").agg(
        F.min(F.when(F.col("__chosen"), F.struct("__conv", "__turns"))).alias("c"),
        F.min(F.when(~F.col("__chosen"), F.struct("__conv", "__turns"))).alias("r"),
    ).filter("c is not null and r is not null")
    both = both.select("pair_id", F.col("c.__conv").alias("chosen_id"), F.col("r.__conv").alias("rejected_id"), F.col("c.__turns").alias("ct"), F.col("r.__turns").alias("rt"))
    same = F.zip_with("ct", "rt", lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    shared = F.least(F.size("ct"), F.size("rt"))
    parting = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)).cast("int")
    both = both.withColumn("n_prompt_turns", F.when(parting == 0, shared).otherwise(parting - 1))
    rest = lambda x: F.slice(x, F.col("n_prompt_turns") + 1, F.size(x))
    both = both.withColumn("cr", rest("ct")).withColumn("rr", rest("rt")).withColumn("pt", F.slice("ct", 1, F.col("n_prompt_turns")))
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), _render(F.col("pt")).alias("prompt"),
        _render(F.col("cr")).alias("chosen"), _render(F.col("rr")).alias("rejected"), _spans(F.col("cr"), trained).alias("chosen_spans"), _spans(F.col("rr"), trained).alias("rejected_spans"),
    )
