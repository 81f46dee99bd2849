"""Preference formatting (operator 5), in DataFrame operations only.

Input are turns of pairs of conversations, one chosen and one rejected. The longest common prefix of turns, equal in
role and text, is rendered once as the prompt; what follows is rendered for each side, with a mask that lists
where, in code points of the completion, text of the assistant stands, which is what a trainer's loss covers.

Defined results: a null text is rendered as empty and a null role as UNKNOWN; turns are ordered by number, ties by
role and text; repeated rows are repeated turns; a conversation without turns on one side makes no pair; if the
sides are equal both completions are empty, and without a common turn the prompt is; an empty table gives an empty
one; other columns are not read. A pair becomes one row, so its turns, and nothing more, meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSISTANT = "assistant"
UNKNOWN = "unknown"
END = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """array<struct<start, end>>: the assistant's texts with their end marks, in code points of the rendered turns.

    A turn knows where it ends in its conversation, so its place in the completion is a difference.
    """
    own = F.filter(turns, lambda t: t["role"] == ASSISTANT)
    first = F.try_element_at(turns, F.lit(1))
    begin = first["upto"] - F.length(_head(first)) - F.length(first["text"]) - len(END)

    def span(t: Column) -> Column:
        end = (t["upto"] - begin).cast("int")
        return F.struct((end - F.length(t["text"]) - len(END)).alias("start"), end.alias("end"))

    return F.transform(own, span)


def preference_pairs(turns: DataFrame, pair: str, rejected: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """pair, n_prefix, prompt, chosen, rejected, chosen_mask and rejected_mask for each pair with both sides.

    rejected names a boolean column: whether the turn belongs to the rejected conversation. Rows in which it or the
    pair is null belong to no pair.
    """
    known = turns.where(F.col(pair).isNotNull() & F.col(rejected).isNotNull())
    known = known.select(F.col(pair).alias("pair"), F.col(rejected).alias("rejected"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Dealt by pair once: that serves the running lengths of both sides, and the gathering of turns.
    dealt = known.repartition("pair")
    order = Window.partitionBy("pair", "rejected").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.withColumn("upto", F.sum(F.length(_head(F.struct("role"))) + F.length("text") + len(END)).over(order))
    one = F.struct("rejected", "turn", "role", "text", "upto")
    pairs = upto.groupBy("pair").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    sides = pairs.select("pair", F.filter("turns", lambda t: ~t["rejected"]).alias("a"), F.filter("turns", lambda t: t["rejected"]).alias("b"))
    sides = sides.where((F.size("a") > 0) & (F.size("b") > 0))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(F.col("same"), False)
    sides = sides.withColumn("same", same).withColumn("n", F.when(first == 0, F.size("same")).otherwise(first - 1).cast("int"))
    rest = {side: F.slice(side, F.col("n") + 1, F.size(side)) for side in ("a", "b")}
    return sides.select(
        F.col("pair").alias(pair),
        F.col("n").alias("n_prefix"),
        _render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest["a"]).alias("chosen"),
        _render(rest["b"]).alias("rejected"),
        _mask(rest["a"]).alias("chosen_mask"),
        _mask(rest["b"]).alias("rejected_mask"),
    )
