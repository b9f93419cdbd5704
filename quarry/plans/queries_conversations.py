"""Registered queries: conversations (F1-F6), batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import PY_WHITESPACE
from quarry.operators import conversations as cv
from quarry.plans.queries_corpus import VARIANTS
from quarry.plans.registry import load, register, sql_chars, with_ctes
from quarry.session import scratch_path
from quarry.streaming import history as sh

WS = sql_chars(PY_WHITESPACE)


def fx_turns(spark, sf_dir) -> DataFrame:
    """Conversation turns with blank inputs, gaps in the turn numbers and ``You:``/name prefixes mixed in."""
    conv = load(spark, sf_dir, "conversations")
    k = F.col("conv_id") * 7 + F.col("turn")
    text = (F.when(k % 11 == 0, F.lit("  "))
            .when(k % 13 == 0, F.concat(F.lit("You: "), F.col("text")))
            .when(k % 17 == 0, F.concat(F.lit(cv.ASSISTANT_NAME + ": "), F.col("text")))
            .otherwise(F.col("text")))
    return conv.select("conv_id", (F.col("turn") * (1 + F.col("conv_id") % 3)).alias("turn"), "role", text.alias("text"))


FX_TURNS_SQL = f"""fx_turns AS (
  SELECT conv_id, turn * (1 + conv_id % 3) AS turn, role,
    CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN '  '
         WHEN (conv_id * 7 + turn) % 13 = 0 THEN 'You: ' || text
         WHEN (conv_id * 7 + turn) % 17 = 0 THEN '{cv.ASSISTANT_NAME}: ' || text
         ELSE text END AS text
  FROM conversations)"""
VALID_SQL = f"""valid AS (
  SELECT * FROM fx_turns WHERE NOT (role = 'user' AND (text IS NULL OR length(trim(text, {WS})) = 0)))"""
# a blank input stores neither itself nor the reply right after it
STORED_SQL = f"""shown AS (
  SELECT *, role = 'user' AND (text IS NULL OR length(trim(text, {WS})) = 0) AS blank
  FROM fx_turns WHERE role IN ('user', 'assistant')),
followed AS (
  SELECT *, lag(blank) OVER (PARTITION BY conv_id ORDER BY turn) AS after_blank FROM shown),
stored AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position
  FROM followed WHERE NOT blank AND NOT (role = 'assistant' AND coalesce(after_blank, false)))"""
HISTORY_SQL = with_ctes(FX_TURNS_SQL, STORED_SQL) + """
SELECT conv_id, CAST(position AS BIGINT) AS position, turn, role, text AS content FROM stored"""


@register("f1_valid_user_turns", with_ctes(FX_TURNS_SQL, VALID_SQL) + "SELECT conv_id, turn, role, text FROM valid")
def f1_valid_user_turns(spark, sf_dir):
    return cv.valid_user_turns(fx_turns(spark, sf_dir))


@register("f2_build_history", HISTORY_SQL)
def f2_build_history(spark, sf_dir):
    return cv.history_rows(fx_turns(spark, sf_dir))


@register("f2_history_arrays", with_ctes(FX_TURNS_SQL, STORED_SQL) + f"""
SELECT conv_id, CAST(position // {cv.HISTORY_PAGE} AS BIGINT) AS page, CAST(count(*) AS INTEGER) AS messages,
       CAST(to_json(list({{'role': role, 'content': text}} ORDER BY turn)) AS VARCHAR) AS history
FROM stored GROUP BY conv_id, position // {cv.HISTORY_PAGE}""")
def f2_history_arrays(spark, sf_dir):
    h = cv.build_history(fx_turns(spark, sf_dir))
    return h.select("conv_id", "page", F.size("history").alias("messages"),
                    F.to_json("history").alias("history"))


@register("f3_reply_or_fallback", with_ctes(FX_TURNS_SQL, STORED_SQL) + f"""
SELECT conv_id, turn, text AS user_text,
       CASE WHEN next_role = 'assistant' AND next_text IS NOT NULL THEN '```julia' || chr(10) || next_text || chr(10) || '```'
            ELSE '{cv.APOLOGY.replace("'", "''")}' END AS reply
FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM stored
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""")
def f3_reply_or_fallback(spark, sf_dir):
    return cv.reply_or_fallback(fx_turns(spark, sf_dir))


@register("f4_display_messages", with_ctes(FX_TURNS_SQL) + f"""
SELECT conv_id, turn, role, replace(replace(text, '{cv.ASSISTANT_NAME}:', ''), 'You:', '') AS text
FROM fx_turns WHERE role IN ('user', 'assistant')""")
def f4_display_messages(spark, sf_dir):
    return cv.display_messages(fx_turns(spark, sf_dir))


@register("f5_stream_history", HISTORY_SQL)
def f5_stream_history(spark, sf_dir):
    """Turn events arrive in three waves, the latest turns first, so a conversation's
    history is spread over micro-batches and arrives out of order."""
    src, table, ckpt = (scratch_path(spark, n) for n in ("turn-events", "history", "history-ckpt"))
    turns = fx_turns(spark, sf_dir)
    wave = F.least((F.col("turn") / 2).cast("long"), F.lit(2))
    for k in (2, 0, 1):  # written one after another: the file source reads oldest first
        turns.where(wave == k).write.mode("append").parquet(src)
    q = sh.stream_history(spark, src, table, ckpt, files_per_batch=8)
    q.awaitTermination()
    return sh.read_history(spark, table)


@register("f6_parse_model_choice", f"""
SELECT conv_id, turn, model, lower(split_part(model, '_', 1)) AS base,
       NOT contains(model, '_baseline') AND contains(model, '_signature') AS signature,
       contains(model, '_baseline') AS baseline
FROM (SELECT conv_id, turn,
             [{", ".join(f"'{m}'" for m in VARIANTS)}][(conv_id + turn) % {len(VARIANTS)} + 1] AS model
      FROM conversations)""")
def f6_parse_model_choice(spark, sf_dir):
    conv = load(spark, sf_dir, "conversations")
    names = F.array(*[F.lit(m) for m in VARIANTS])
    model = F.element_at(names, ((F.col("conv_id") + F.col("turn")) % len(VARIANTS) + 1).cast("int"))
    rows = conv.select("conv_id", "turn", model.alias("model"))
    return rows.withColumns(cv.parse_model_choice("model"))
