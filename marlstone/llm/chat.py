"""Chat formatting with prefix-target expansion: every assistant turn becomes an example of its own.

An example's text is all turns up to and including its target; only the target's text is under the loss mask. A turn is
`<|role|>` text `</s>`, and no text or role can hold a mark: & < [ and | are written as entities, which unescape()
takes back. A conversation whose last turn isn't the assistant's gets one more example with no target, so that no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In this order when escaping, and backwards when reading.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    for raw, entity in ENTITIES:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for raw, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return text


def examples(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """From rows (conv_id, turn, role, text): conv_id, example (the target's place, from 1), text, loss_start, loss_chars, is_last.

    loss_start is the code point of text at which the target begins (0-based; null without a target). Turns are ordered by turn (nulls
    first; ties by role and text). A null text or role is empty; a null conv_id is a conversation like others. Repeated rows are turns
    of their own. Extra columns are ignored. An empty table gives no examples.
    """
    safe = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), safe("role").alias("role"), safe("text").alias("text"))
    whole = turns.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    parts = F.transform("t", lambda x: F.concat(F.lit("<|"), escape(x["role"]), F.lit("|>"), escape(x["text"]), F.lit("</s>")))
    n = F.size("t")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("t", i - 1)["role"] == TARGET_ROLE) | (i == n))
    rows = whole.select("conv_id", "t", parts.alias("parts"), F.explode(targets).alias("example"))
    text = F.array_join(F.slice("parts", 1, F.col("example")), "")
    last = F.get("t", F.col("example") - 1)
    rows = rows.select("conv_id", "example", text.alias("text"), F.when(last["role"] == TARGET_ROLE, F.char_length(escape(last["text"]))).alias("loss_chars"), (F.col("example") == F.size("t")).alias("is_last"))
    return rows.select("conv_id", "example", "text", (F.char_length("text") - 4 - F.col("loss_chars")).alias("loss_start"), F.coalesce("loss_chars", F.lit(0)).alias("loss_chars"), "is_last")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    return F.transform(F.filter(F.split(text, "</s>"), lambda p: p != ""), lambda p: F.struct(unescape(F.substring_index(F.substring(p, F.lit(3), F.char_length(p)), "|>", 1)).alias("role"), unescape(F.substring(p, F.locate("|>", p) + 2, F.char_length(p))).alias("text")))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its examples alone."""
    target = F.when(F.col("loss_start").isNotNull(), unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_chars")))).otherwise("")
    turns = F.when(F.col("is_last"), read_turns(F.col("text")))
    digest = F.sha2(F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    each = formatted.select("conv_id", "example", target.alias("target"), F.size(turns).cast("long").alias("n"), digest.alias("sha"), F.char_length("text").cast("long").alias("chars"))
    by = each.groupBy("conv_id").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list(F.struct("example", "target"))).alias("targets"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("targets", lambda x: x["target"]), "")
    return by.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
