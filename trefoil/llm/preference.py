"""Preference formatting: paired conversations as one prompt and two masked completions.

The longest common turn prefix of a pair is found without gathering a conversation: turns meet by (pair, turn) and
the first turn at which the sides differ is a minimum per pair. Turns before it are the prompt, rendered once;
the others are completions of their side, in which only assistant turns are trained on. The result has one row per
rendered turn, so a conversation of any length is never one task's work; ``examples`` puts them together to paired
completions, one row per pair. Built-in functions only.

Defined results: a null role renders as ``unknown``, a null text as nothing; of rows with the same conversation and
turn the smallest (role, text) counts; rows with a null conversation or turn are left out; identical sides are all
prompt; a side without a partner is a completion without prompt, ``paired`` false; only the named columns are
read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The template's marks.
ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"


def _consecutive() -> dict:
    """Pair and side of consecutive ids, in whole numbers: an even id is the chosen side, the odd id after it the rejected side."""
    conv = F.col("conv_id")
    return {"pair_id": F.shiftright(conv.cast("long"), 1), "side": F.when(conv.cast("long").bitwiseAND(F.lit(1)) == 0, "chosen").otherwise("rejected")}


def consecutive_pairs(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pair_id, side)`` of consecutive ids."""
    return conversations.select("conv_id").distinct().where("conv_id is not null").select("conv_id", *[c.alias(name) for name, c in _consecutive().items()])


def turns(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(pair_id, turn, side, role, text)``; without ``pairs`` consecutive ids are paired, and no join is needed."""
    one = conversations.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = one.withColumns(_consecutive()) if pairs is None else one.join(pairs.select("conv_id", "pair_id", "side"), "conv_id")
    return one.select("pair_id", "turn", "side", "role", "text")


def format_pairs(conversations: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(pair_id, segment, turn, role, rendered, train_from, train_to, paired)``: segments are prompt, chosen and rejected; characters from train_from up to train_to are trained on.

    Texts are shuffled once, by (pair, turn): where a pair splits is found from the turns' numbers alone and comes back under that key.
    """
    side = lambda s: F.min(F.when(F.col("side") == s, F.struct("role", "text"))).alias(s)
    aligned = turns(conversations, pairs).groupBy("pair_id", "turn").agg(side("chosen"), side("rejected"))
    same = F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False))
    slim = aligned.select(F.col("pair_id").alias("p"), F.col("turn").alias("t"), same.alias("same"), F.col("chosen").isNotNull().alias("c"), F.col("rejected").isNotNull().alias("r"))
    first = slim.groupBy("p").agg(F.min(F.when(~F.col("same"), F.col("t"))).alias("split"), (F.max("c") & F.max("r")).alias("paired"))
    places = slim.select("p", "t").join(first, "p").withColumnsRenamed({"p": "pair_id", "t": "turn"})
    cut = aligned.join(places, ["pair_id", "turn"])
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    part = lambda name, s: F.struct(F.lit(name).alias("segment"), F.col(s).alias("t"))
    parts = F.when(shared, F.array(part("prompt", "chosen"))).otherwise(F.array(part("chosen", "chosen"), part("rejected", "rejected")))
    rows = cut.select("pair_id", "turn", "paired", F.explode(parts).alias("p")).where("p.t is not null").select("pair_id", "p.segment", "turn", "p.t.role", "p.t.text", "paired")
    head = F.concat(F.lit(ROLE_OPEN), "role", F.lit(ROLE_CLOSE))
    body = F.concat("text", F.lit(TURN_END))
    trained = (F.col("segment") != "prompt") & (F.col("role") == "assistant")
    mark = lambda value: F.when(trained, value).otherwise(F.lit(0)).cast("long")
    return rows.select("pair_id", "segment", "turn", "role", F.concat(head, body).alias("rendered"), mark(F.length(head)).alias("train_from"), mark(F.length(head) + F.length(body)).alias("train_to"), "paired")


def examples(formatted: DataFrame, block: int | None = None) -> DataFrame:
    """``(pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask, paired)``: the paired completions, one row per pair; masks are ``from-to`` spans of characters.

    Where conversations may be too long for a row, ``block`` gives a row for so many turns of a pair, in the order of turns whatever their numbers, and
    tells them apart by ``part``; parts follow one another.
    """
    part = [] if block is None else [F.floor((F.dense_rank().over(Window.partitionBy("pair_id").orderBy("turn")) - 1) / F.lit(block)).cast("long").alias("part")]
    key = ["pair_id", *(["part"] if part else [])]
    before = Window.partitionBy(*key, "segment").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = formatted.select("*", *part).withColumn("at", F.coalesce(F.sum(F.length("rendered")).over(before), F.lit(0)))
    rows = lambda s, value, also=F.lit(True): F.array_sort(F.collect_list(F.when((F.col("segment") == s) & also, F.struct("turn", value.alias("v")))))
    of = lambda s: F.array_join(F.transform(rows(s, F.col("rendered")), lambda x: x.v), "").alias(s)
    span = F.concat_ws("-", F.col("at") + F.col("train_from"), F.col("at") + F.col("train_to"))
    spans = lambda s: F.array_join(F.transform(rows(s, span, F.col("train_to") > 0), lambda x: x.v), ",").alias(f"{s}_mask")
    return placed.groupBy(*key).agg(of("prompt"), of("chosen"), of("rejected"), spans("chosen"), spans("rejected"), F.bool_or("paired").alias("paired"))
