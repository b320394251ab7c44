"""Preference formatting for chat pairs, in DataFrame functions only.

The longest common turn prefix of the chosen and the rejected conversation is rendered once, as the prompt; what
follows it on either side is a completion, with a mask in which only assistant turns are trained on.

A turn renders as "<|role|>\\n" + text + "<|end|>\\n". A mask is a list of runs (characters, whether trained); its
runs add up to the completion's length.

Defined cases: a null role renders as "unknown", a null text as empty; "<|" inside a text is broken up to "< |", so
that no text can close a turn; turns are put in the order of turn, role and text (null first), repeated rows are
turns too; equal conversations are a tie with empty completions; a conversation that is null or without turns has an
empty side; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
ASSISTANT = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id_col and turns, an ordered array of struct(role, text)."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    listed = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |"))


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(END))))


def mask(turns: Column) -> Column:
    """Runs of a completion: each turn's head is not trained on, its text and end are if the assistant speaks."""
    return F.flatten(F.transform(turns, lambda t: F.array(
        F.struct(F.length(_head(t)).alias("chars"), F.lit(False).alias("trained")),
        F.struct((F.length(_body(t)) + len(END)).alias("chars"), (F.coalesce(t["role"], F.lit("")) == ASSISTANT).alias("trained")),
    )))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that a and b share."""
    n = F.least(F.size(a), F.size(b))
    grow = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, i: F.when((k == i - 1) & F.element_at(a, i).eqNullSafe(F.element_at(b, i)), i).otherwise(k))
    return F.when(n > 0, grow).otherwise(0)


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen_col: str = "chosen", rejected_col: str = "rejected") -> DataFrame:
    """Per pair: id, prompt_turns, prompt, chosen and rejected completion with chosen_mask and rejected_mask, tie."""
    nothing = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.select(F.col(id_col), F.coalesce(chosen_col, nothing).alias("_a"), F.coalesce(rejected_col, nothing).alias("_b"))
    rows = rows.withColumn("_n", common_prefix(F.col("_a"), F.col("_b")))
    rest = {c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0))) for c in ("_a", "_b")}
    return rows.select(
        id_col, F.col("_n").alias("prompt_turns"), rendered(F.slice("_a", 1, F.col("_n"))).alias("prompt"),
        rendered(rest["_a"]).alias("chosen"), rendered(rest["_b"]).alias("rejected"),
        mask(rest["_a"]).alias("chosen_mask"), mask(rest["_b"]).alias("rejected_mask"),
        ((F.size("_a") == F.col("_n")) & (F.size("_b") == F.col("_n"))).alias("tie"),
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen, rejected of every conversation: rejected is the conversation with its last assistant text
    taken from its neighbour (2k and 2k + 1 are neighbours). Without one, or without an assistant turn, both are
    equal, which formats as a tie."""
    own = conversations(turns)
    given = turns.where(F.col("role") == ASSISTANT).groupBy(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("_to")).agg(
        F.max(F.struct("turn", "text")).alias("_last"))
    rows = own.join(given, own["conv_id"] == F.col("_to"), "left")
    at = F.aggregate(F.sequence(F.lit(1), F.size("turns")), F.lit(0), lambda k, i: F.when(F.element_at("turns", i)["role"] == ASSISTANT, i).otherwise(k))
    rows = rows.withColumn("_at", at)
    swapped = F.transform("turns", lambda t, i: F.when((i + 1 == F.col("_at")) & F.col("_last").isNotNull(), F.struct(t["role"].alias("role"), F.col("_last.text").alias("text"))).otherwise(t))
    return rows.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))


def mask_text(runs: Column) -> Column:
    """A mask as text: 0x12,1x40,..."""
    return F.concat_ws(",", F.transform(runs, lambda r: F.concat(F.when(r["trained"], F.lit("1x")).otherwise(F.lit("0x")), r["chars"].cast("string"))))
