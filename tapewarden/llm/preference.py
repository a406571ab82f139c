"""Preference formatting: one prompt and two masked completions for each pair of conversations.

A conversation's turns are ordered and rendered by a template. The longest common
prefix of turns of the chosen and the rejected conversation is rendered once, as the
prompt; what follows on either side is a completion. A completion's mask lists the
stretches of characters that count for the loss: the words of assistant turns, with
the sign that ends the turn, but not the role marks nor what others say.

All of it is array work inside a row, so pairs need no shuffle beyond the one that
brings the turns of a conversation together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
LEARNED = "assistant"


def conversation_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order, as structs of (role, text).

    Equal rows are one turn. Rows without turn number come first; ties of the number go by role, then
    text. Null roles and texts are empty. Rows without conv_id are left out.
    """
    said = turns.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    return said.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of turns at the beginning that are the same on both sides."""
    shorter = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: x == y)
    first_difference = F.array_position(same, F.lit(False))
    return F.when(first_difference == 0, shorter).otherwise((first_difference - 1).cast("int"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def loss_spans(turns: Column) -> Column:
    """(start, end) in characters of the rendered turns, end exclusive, of what an assistant says with its end sign."""

    def length(t: Column) -> Column:
        return F.char_length(_head(t)) + F.char_length(t["text"]) + len(END)

    # positions are running sums over the few turns of one conversation
    placed = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,start:int,end:int>>").alias("spans")),
        lambda state, t: F.struct(
            (state["at"] + length(t)).alias("at"),
            F.concat(
                state["spans"],
                F.array(
                    F.struct(
                        t["role"].alias("role"),
                        (state["at"] + F.char_length(_head(t))).alias("start"),
                        (state["at"] + length(t) - 1).alias("end"),
                    )
                ),
            ).alias("spans"),
        ),
    )
    learned = F.filter(placed["spans"], lambda s: s["role"] == LEARNED)
    return F.transform(learned, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def format_preferences(pairs: DataFrame) -> DataFrame:
    """``pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask`` from ``pairs(pair_id, chosen, rejected)``.

    ``chosen`` and ``rejected`` are arrays of (role, text). The prompt is the common prefix of turns,
    rendered once, and holds at most all of the shorter side; masks are arrays of (start, end) in the
    completion's characters. A null side counts as one without turns: it has an empty completion and mask.
    Equal sides have everything in the prompt. Repeated rows give repeated pairs; other columns are
    ignored; an empty table gives an empty result.
    """
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select("pair_id", *[F.coalesce(F.col(c).cast("array<struct<role:string,text:string>>"), nothing).alias(c) for c in ("chosen", "rejected")])
    split = sides.withColumn("n_common", common_prefix(F.col("chosen"), F.col("rejected")))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    return split.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        rendered(F.slice("chosen", F.lit(1), F.col("n_common"))).alias("prompt"),
        *[rendered(rest(c)).alias(c) for c in ("chosen", "rejected")],
        *[loss_spans(rest(c)).alias(f"{c}_mask") for c in ("chosen", "rejected")],
    )


def stale_answer_pairs(turns: DataFrame) -> DataFrame:
    """Pairs made from single conversations: ``pair_id, chosen, rejected``, one for each that has an answer.

    Chosen is the conversation up to its last assistant turn. Rejected ends with a stale answer instead,
    the assistant turn before that one, or with an empty answer if there is none.
    """
    told = conversation_turns(turns)
    numbers = F.sequence(F.lit(1), F.size("turns"))
    spots = F.filter(numbers, lambda i: (F.get("turns", i - 1)["role"] == LEARNED))
    told = told.withColumn("spots", F.when(F.size("turns") > 0, spots)).filter(F.size("spots") > 0)
    last = F.element_at("spots", -1)
    before = F.when(F.size("spots") > 1, F.get("turns", F.get("spots", F.size("spots") - 2) - 1)["text"]).otherwise(F.lit(""))
    stale = F.array(F.struct(F.lit(LEARNED).alias("role"), before.alias("text")))
    return told.select(
        F.col("conv_id").alias("pair_id"),
        F.slice("turns", F.lit(1), last).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), last - 1), stale).alias("rejected"),
    )
