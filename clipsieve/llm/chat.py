"""Preference formatting of chats: shared prompt once, two masked completions (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
#: The role whose turns are trained on.
TRAINED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    before, after = OPEN.split("{}")
    return F.concat(F.lit(before), role, F.lit(after), text, F.lit(CLOSE))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """``pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, usable`` for each pair.

    ``turns``: ``pair_id, side`` (``chosen`` or ``rejected``), ``turn, role,
    text``. Turns are ordered by number, then role and text, so gaps and repeated
    numbers do no harm; null roles are ``unknown``, null texts empty. The prompt
    is the longest common prefix of turns with equal role and text, rendered
    once; if one side is a prefix of the other, its completion is empty, as is
    that of a side which is missing; such rows, and pairs of equal sides, are no
    preference and not ``usable``. A mask is an array of ``begin, end``
    character ranges of the completion to train on: text and end mark of each
    assistant turn. Rows without pair or side are passed over; an empty table
    gives no rows, other columns are not read.

    Sides are compared turn by turn after one shuffle by pair and place; only a
    conversation's own turns are ever gathered.
    """
    known = turns.filter(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = known.withColumn("at", F.row_number().over(W.partitionBy("pair_id", "side").orderBy("turn", "role", "text")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("role", "text")))
    both = placed.groupBy("pair_id", "at").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    differ = F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("at"))).over(W.partitionBy("pair_id"))
    cut = both.withColumn("common", F.coalesce(F.col("at") < differ, F.lit(True)))
    gathered = cut.groupBy("pair_id").agg(
        F.sum(F.col("common").cast("long")).alias("n_common"),
        *(F.array_sort(F.collect_list(F.when(F.col("common") == shared, F.struct("at", F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text"))))).alias(name)
          for name, side, shared in (("p", "c", True), ("c", "c", False), ("r", "r", False))))
    turns_of = lambda name: F.filter(name, lambda t: t["role"].isNotNull())
    text = lambda name: F.array_join(F.transform(turns_of(name), lambda t: rendered(t["role"], t["text"])), "")

    def mask(name: str) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

        def add(state: Column, t: Column) -> Column:
            begin = state["at"] + F.length(rendered(t["role"], F.lit(""))) - len(CLOSE)
            end = state["at"] + F.length(rendered(t["role"], t["text"]))
            span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(t["role"] == TRAINED, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(turns_of(name), start, add, lambda s: s["spans"])

    out = gathered.select("pair_id", "n_common", text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"),
                          mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"))
    return out.withColumn("usable", (F.col("chosen") != "") & (F.col("rejected") != ""))
