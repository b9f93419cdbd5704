"""Chat formatting by event-sourced reconstruction.

A log holds events of messages: ``message`` opens one (turn and role), ``delta`` appends text,
``edit`` replaces the text so far, ``regenerate`` discards it.  Events are folded message by
message, in the order of their sequence numbers; the final messages of a conversation are put in
order and rendered with a template, together with the loss mask.

* The fold groups by (conversation, message), so a conversation with any share of all events is
  dealt over many tasks; only finished messages meet in their conversation's row.
* Places in the output are running sums over the conversation's messages (a window, which spills),
  so rendering and reading back take linear time.

The template: ``<s>`` opens a conversation; a turn is ``<|role|>``, a line feed, the text and
``</s>`` with a line feed.  Control strings all start with ``<`` or ``[``; inside roles and texts
these two characters and the backslash are written as ``\\l``, ``\\b`` and ``\\e``, which no
unescaped text can produce, so escaping is reversible.

Defined results: null text is empty, null role is the empty role; messages come by turn (null
first), then role, then text; rows that repeat are separate messages; a message without a
``message`` event is not rendered; a null conversation id is a conversation of its own; an empty
log gives no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, HEAD_END, END = "<s>", "<|", "|>\n", "</s>\n"
#: The backslash first: what the others insert must not be escaped again.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))
DELTA_CHARS = 400   # code points a streamed delta carries
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def as_events(rows: DataFrame) -> DataFrame:
    """The log that would have produced finished rows (conv_id, turn, role, text): each opens a
    message and streams its text in deltas."""
    # the id only tells messages of one conversation apart; the output does not depend on its value
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message"))
    opened = F.struct(F.lit(0).alias("seq"), F.lit("message").alias("kind"), F.lit("").alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0))
    deltas = F.transform(pieces, lambda p, i: F.struct((i + 1).alias("seq"), F.lit("delta").alias("kind"), p.alias("text")))
    return rows.select("conv_id", "message", "turn", "role", F.explode(F.concat(F.array(opened), deltas)).alias("event")) \
        .select("conv_id", "message", "event.seq", "event.kind", "turn", "role", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, turn, role, text).

    Per message the events are sorted by sequence; the last ``edit`` or ``regenerate`` is where its
    text starts, and the deltas from there on are appended.
    """
    resets = F.col("kind").isin("edit", "regenerate")
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind") == "message", F.struct("seq", "turn", "role"))).alias("opened"),
        F.max(F.when(resets, F.col("seq"))).alias("reset"), F.sort_array(F.collect_list(event)).alias("log"))
    live = F.filter("log", lambda e: (F.col("reset").isNull() | (e["seq"] >= F.col("reset"))) & e["kind"].isin("delta", "edit"))
    return log.filter("opened is not null").select(
        "conv_id", "message", "opened.turn", F.coalesce("opened.role", F.lit("")).alias("role"),
        F.concat_ws("", F.transform(live, lambda e: e["text"])).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted and turns.

    ``turns`` has, in order, each turn's start and end in ``formatted`` and the part under the loss
    mask (loss_start, loss_end; null outside assistant turns), in code points, ends exclusive.
    """
    block = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(HEAD_END), escape(F.col("text")), F.lit(END))
    blocks = messages.withColumn("block", block).withColumn("size", F.length("block").cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text", "message")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + len(OPEN)
    placed = blocks.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    text_end = F.col("end") - len(END)
    loss = F.col("role") == LOSS_ROLE
    turn = F.struct("start", "end", F.when(loss, text_end - F.length(escape(F.col("text")))).alias("loss_start"),
                    F.when(loss, text_end).alias("loss_end"), F.col("block"))
    turns = F.sort_array(F.collect_list(turn))
    return placed.groupBy("conv_id").agg(turns.alias("all")).select(
        "conv_id", F.concat(F.lit(OPEN), F.concat_ws("", F.col("all.block"))).alias("formatted"),
        F.transform("all", lambda t: t.dropFields("block")).alias("turns"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, messages, losses) from ``formatted`` and the mask alone: the messages
    (role, text), and the unescaped texts under the loss mask in order."""
    body = F.substring("formatted", len(OPEN) + 1, 2147483647)
    pieces = F.split(body, F.lit("</s>\n"))  # what follows the last end is empty
    at = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("piece"), F.col("turns").alias("turn"))
    head = lambda p: F.instr(p, F.lit(HEAD_END))
    message = lambda x: F.struct(
        unescape(F.substring(x["piece"], F.lit(len(HEAD) + 1), head(x["piece"]) - len(HEAD) - 1)).alias("role"),
        unescape(F.substring(x["piece"], head(x["piece"]) + len(HEAD_END), F.length(x["piece"]))).alias("text"))
    masked = lambda x: unescape(F.substring(
        x["piece"], (x["turn"]["loss_start"] - x["turn"]["start"] + 1).cast("int"),
        (x["turn"]["loss_end"] - x["turn"]["loss_start"]).cast("int")))
    return rendered.select("conv_id", "formatted", F.transform(at, message).alias("messages"),
                           F.transform(F.filter(at, lambda x: x["turn"]["loss_start"].isNotNull()), masked).alias("losses"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Finished rows (conv_id, turn, role, text) through the log, the fold and the template."""
    return render(fold(as_events(rows)))
