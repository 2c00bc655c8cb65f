"""Chat formatting for preference training, with built-in DataFrame functions only.

Of a chosen and a rejected conversation, the longest common prefix of turns (role and text equal)
is rendered once, as the prompt; what follows in each is rendered as its completion.  Only the
texts of assistant turns, with their end marks, carry loss; masks are code-point spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"


def _head(turn):
    return F.concat(F.lit(BEGIN), turn["role"], F.lit(MIDDLE))


def _body(turn):
    return F.concat(turn["text"], F.lit(END))


def _render(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _loss_spans(turns, loss_role: str):
    """Spans (start, end) of the rendered turns that carry loss."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_body(t))
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == loss_role, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_loss, rejected_loss.

    `turns` has pair_id, chosen (boolean), turn, role, text; other columns are ignored.  Turns are
    ordered by turn number, ties by role and text; a null role is 'unknown', a null text empty.
    Turns without a pair or a side are left out.  A pair with one side has an empty prompt and a
    null completion for the other; where one conversation is a prefix of the other, the shorter
    one's completion is empty.  Turns that repeat, wholly or in their number, all count, in that order;
    an empty table gives no rows.  One group is one pair, which becomes one example.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # collect_list leaves out nulls, so each side gets its own turns from one shuffle.
    both = turns.where("pair_id is not null and chosen is not null").groupBy("pair_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("chosen"), turn))).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("chosen"), turn))).alias("r")
    )
    least = F.least(F.size("c"), F.size("r"))
    same = F.transform(F.arrays_zip("c", "r"), lambda z: (z["c"]["role"] == z["r"]["role"]) & (z["c"]["text"] == z["r"]["text"]))
    differ = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    both = both.withColumn("k", F.when(least == 0, 0).when(differ == 0, least).otherwise(differ - 1).cast("int"))
    rest = lambda side: F.slice(side, F.col("k") + 1, F.greatest(F.size(side), F.lit(1)))
    side = lambda name, value: F.when(F.size(name) > 0, value)
    return both.select(
        "pair_id", F.col("k").alias("n_prompt_turns"), _render(F.slice("c", 1, F.col("k"))).alias("prompt"),
        side("c", _render(rest("c"))).alias("chosen"), side("r", _render(rest("r"))).alias("rejected"),
        side("c", _loss_spans(rest("c"), loss_role)).alias("chosen_loss"), side("r", _loss_spans(rest("r"), loss_role)).alias("rejected_loss"),
    )


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected one of pair k."""
    conv = F.col("conv_id").cast("long")
    return conversations.select(F.floor(conv / 2).alias("pair_id"), (F.pmod(conv, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")


def preference_digest(conversations: DataFrame) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    out = preference_pairs(conversation_pairs(conversations))
    return out.withColumns({"chosen_loss": spans("chosen_loss"), "rejected_loss": spans("rejected_loss")})
