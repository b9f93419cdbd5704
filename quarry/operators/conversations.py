"""Conversation transcripts (F1-F4, F6): the chat page's data side.

Turns are ``(conv_id, turn, role, text)``; turn numbers order a
conversation and may have gaps.  No operator here partitions a window by
conversation: a conversation holding a large share of all turns must not
land in one task.  Messages are ranked globally on narrow keys, and the
ranks join the texts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.code import to_markdown
from quarry.functions.text import col_, py_strip
from quarry.operators.ordering import with_global_index

# Fixed values of the chat page.
APOLOGY = "I'm sorry, but I'm unable to assist with that request."
ASSISTANT_NAME = "Philippe"          # default speaker name removed from displayed text
USER_PREFIX = "You:"
DISPLAY_ROLES = ["user", "assistant"]
HISTORY_PAGE = 1000                  # messages per history row (build_history)


def valid_user_turns(turns: DataFrame) -> DataFrame:
    """drop user turns whose input is null or blank (other roles pass)."""
    return turns.where(~((F.col("role") == "user") & _is_blank("text")))


def display_text(text) -> Column:
    """remove the assistant's name prefix and ``You:`` from a message."""
    cleaned = F.replace(col_(text), F.lit(ASSISTANT_NAME + ":"), F.lit(""))
    return F.replace(cleaned, F.lit(USER_PREFIX), F.lit(""))


def display_messages(turns: DataFrame) -> DataFrame:
    """user and assistant messages only, with name prefixes removed."""
    return turns.where(F.col("role").isin(DISPLAY_ROLES)).withColumn("text", display_text("text"))


def _is_blank(text) -> Column:
    return col_(text).isNull() | (F.length(py_strip(text)) == 0)


def history_rows(turns: DataFrame) -> DataFrame:
    """F2 (long form): ``conv_id, position, turn, role, content`` of every stored message.

    The store holds user inputs and assistant replies in turn order.  A
    blank input is not stored, and neither is the reply right after it.
    ``position`` is the 0-based index in the conversation's history; it is
    a global rank minus the conversation's first rank, so a conversation
    of any size is ranked across many tasks.  Only keys and a hash of the
    text are sorted.  A row submitted twice (equal in all columns) counts once.
    """
    msgs = turns.where(F.col("role").isin(DISPLAY_ROLES)) \
        .select("conv_id", "turn", "role", F.col("text").alias("content"), F.xxhash64("text").alias("_h"))
    key = ["conv_id", "turn", "role", "_h"]
    narrow = msgs.select(*key, ((F.col("role") == "user") & _is_blank("content")).alias("_blank")).dropDuplicates(key)
    # of one turn the user's message comes first
    ranked = with_global_index(narrow, [F.col("conv_id"), F.col("turn"), F.col("role").desc(), F.col("_h")], name="_g")
    before = ranked.where("_blank").select((F.col("_g") + 1).alias("_g"), F.col("conv_id").alias("_conv_before"))
    orphan = (F.col("role") == "assistant") & F.col("conv_id").eqNullSafe(F.col("_conv_before")) & F.col("_after_blank")
    stored = ranked.join(before.withColumn("_after_blank", F.lit(True)), "_g", "left") \
        .where(~F.col("_blank") & ~F.coalesce(orphan, F.lit(False))).select("_g", *key)
    placed = with_global_index(stored, [F.col("_g")], name="_p")
    starts = placed.groupBy("conv_id").agg(F.min("_p").alias("_start")).withColumnRenamed("conv_id", "_conv")
    position = placed.join(starts, placed["conv_id"].eqNullSafe(starts["_conv"])) \
        .select(*key, (F.col("_p") - F.col("_start")).alias("position"))
    texts = msgs.dropDuplicates(key)
    same = [texts[c].eqNullSafe(position[c]) for c in key]
    return texts.join(position, same).select(
        texts["conv_id"], "position", texts["turn"], texts["role"], "content")


def build_history(turns: DataFrame, page_size: int = HISTORY_PAGE) -> DataFrame:
    """``conv_id, page, history``: the ordered ``array<struct<role, content>>``
    of each conversation, cut into pages of at most ``page_size`` messages.

    Pages are part of the result's contract, not a cut: a row stays small
    whatever a conversation holds.  Pages are grouped by ``(conv_id, position div page_size)``, so no group
    holds more than ``page_size`` messages however long a conversation is;
    concatenating a conversation's pages in ``page`` order gives its history.
    """
    if page_size < 1:
        raise ValueError("page_size must be positive")
    rows = history_rows(turns).withColumn("page", (F.col("position") / page_size).cast("long"))
    hist = rows.groupBy("conv_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("position", "role", "content"))).alias("_h"))
    return hist.select("conv_id", "page", F.transform("_h", lambda m: F.struct(
        m["role"].alias("role"), m["content"].alias("content"))).alias("history"))


def reply_or_fallback(turns: DataFrame, language: str = "julia") -> DataFrame:
    """each valid user turn with its assistant reply in a code fence, or
    the fixed apology when the next stored message is not a reply.

    Messages are paired by their place in the history, so gaps in the turn
    numbers and messages of other roles do not separate them.
    """
    stored = history_rows(turns)
    users = stored.where(F.col("role") == "user").select("conv_id", "turn", "position", F.col("content").alias("user_text"))
    replies = stored.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_conv"), (F.col("position") - 1).alias("_position"), F.col("content").alias("_reply"))
    paired = users.join(replies, users["conv_id"].eqNullSafe(replies["_conv"]) & (F.col("position") == F.col("_position")), "left")
    reply = F.when(F.col("_reply").isNotNull(), to_markdown("_reply", language)).otherwise(F.lit(APOLOGY))
    return paired.select("conv_id", "turn", "user_text", reply.alias("reply"))


def parse_model_choice(name) -> dict[str, Column]:
    """"135m_signature" -> base "135m", signature true, baseline false."""
    n = col_(name)
    baseline = n.contains("_baseline")
    return {"base": F.lower(F.substring_index(n, "_", 1)),
            "signature": ~baseline & n.contains("_signature"),
            "baseline": baseline}
