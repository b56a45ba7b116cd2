"""Preference formatting: the longest common turn prefix of two conversations rendered once, and masked completions.

Turns are rendered as chat markup. Of a chosen and a rejected conversation, the turns that agree from the first on
(role and text) are the prompt; what follows in each is its completion, with the spans of characters that a loss should
count: the text and end mark of its assistant turns. All of it is DataFrame functions on one row per conversation.

Defined results: rows without a conversation id belong to none and are left out; repeated rows of a conversation count
once; turns are in order of turn (null first), role and text; null roles and texts are empty; conversations that agree
throughout are all prompt with two empty completions; further columns are ignored; no rows give no pairs. Texts are
kept whole: a conversation of any length is one row, as its rendered form is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.shared import KEY

#: Fixed values of the markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<begin:int,end:int>>"


def gather(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns, an array of (role, text), from one row per turn."""
    turn = F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    grouped = rows.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("conv_id")).agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(a: Column, b: Column) -> Column:
    """The number of turns that agree from the first on."""
    shorter = F.least(F.size(a), F.size(b))
    agree = F.zip_with(F.slice(a, 1, shorter), F.slice(b, 1, shorter), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(agree, False)
    return F.when(first == 0, shorter).otherwise(first - 1).cast("int")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column, trained: str = "assistant") -> Column:
    """Where the text and end mark of the trained role's turns stand in the rendered turns, in characters."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["role"]) + len(OPEN) + 1
        end = begin + F.length(turn["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == trained, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda state: state["spans"])


def format_pairs(pairs: DataFrame, trained: str = "assistant") -> DataFrame:
    """``pairs`` has columns chosen and rejected, arrays of (role, text); they become prompt_turns, prompt, chosen,
    rejected (the completions), chosen_spans and rejected_spans. Other columns stay, but for those of these names, which
    are replaced. A null conversation is one without turns; null roles and texts are empty."""
    made = ("prompt_turns", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")
    others = [c for c in pairs.columns if c not in made]
    sides = [F.transform(F.coalesce(side, F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))) for side in ("chosen", "rejected")]
    # One struct of a name of its own, so that no column of the caller can clash with what is made on the way.
    split = pairs.select(*[F.col(f"`{c}`") for c in others], F.struct(*[t.alias(side) for t, side in zip(sides, ("chosen", "rejected"))]).alias(KEY))
    chosen, rejected = F.col(f"{KEY}.chosen"), F.col(f"{KEY}.rejected")
    split = split.withColumn(KEY, F.struct(chosen.alias("chosen"), rejected.alias("rejected"), common_turns(chosen, rejected).alias("n")))
    n = F.col(f"{KEY}.n")
    rest = {side: F.slice(turns, n + 1, F.greatest(F.size(turns) - n, F.lit(0))) for side, turns in (("chosen", chosen), ("rejected", rejected))}
    return split.select(
        *[F.col(f"`{c}`") for c in others],
        n.alias("prompt_turns"),
        render(F.slice(chosen, 1, n)).alias("prompt"),
        *[render(turns).alias(side) for side, turns in rest.items()],
        *[loss_spans(turns, trained).alias(f"{side}_spans") for side, turns in rest.items()],
    )


def mismatched_pairs(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """A pair for every conversation (conv_id, turns): the rejected one has the last reply of conversation conv_id + 1 in
    place of its own last reply, or no last reply where there is no such conversation or it has none."""
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), trained) + 1
    base = conversations.withColumn("_last", F.when(F.array_contains(F.transform("turns", lambda t: t["role"]), trained), last).cast("int"))
    # The key is never null, which the optimiser is told: a filter for that would make this side gather all turns again.
    before = F.coalesce(F.col("conv_id") - 1, F.lit(-1))
    replies = base.where("_last IS NOT NULL").select(before.alias("conv_id"), F.element_at("turns", F.col("_last"))["text"].alias("_reply"))
    swapped = F.transform("turns", lambda t, k: F.when(k + 1 == F.col("_last"), F.when(F.col("_reply").isNotNull(), F.struct(t["role"].alias("role"), F.col("_reply").alias("text")))).otherwise(t))
    rejected = F.when(F.col("_last").isNull(), F.col("turns")).otherwise(F.filter(swapped, lambda t: t.isNotNull()))
    return base.join(replies, "conv_id", "left").select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


def spans_text(spans: Column) -> Column:
    """Spans as text, like ``12-40,60-75``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
