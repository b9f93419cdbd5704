"""Registered queries: training-corpus preparation.

Inputs are the cleaned corpus (C8 over fx_functions); array outputs are
reported as comma-joined strings so both engines compare them exactly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import PY_WHITESPACE
from quarry.operators import completions as comp
from quarry.operators import corpus as cp
from quarry.operators import preprocess as pp
from quarry.plans.fixtures import FX_PROMPTS_SQL, MODELS, fx_functions, fx_prompts
from quarry.plans.queries_clean import cleaned_ctes
from quarry.plans.registry import load, register, sql_chars, with_ctes

WS = sql_chars(PY_WHITESPACE)
VOCAB_SIZE = 4096
SAMPLE, SEED = 250, 7
PATTERN = cp.TOKEN_PATTERN


def cleaned(spark, sf_dir):
    return pp.preprocess(fx_functions(spark, sf_dir), fx_prompts(spark, sf_dir))


def texts(spark, sf_dir, just_signature=False):
    return cp.compose_text(cleaned(spark, sf_dir), just_signature).select("id", "text")


def vocab(spark, sf_dir):
    return cp.build_vocab(texts(spark, sf_dir), VOCAB_SIZE)


def _text_sql(just_signature: bool = False) -> str:
    parts = ([] if just_signature else ["doc_string"]) + ["function_header", "function_body"]
    joined = " || chr(10) || ".join(f"coalesce({c}, '')" for c in parts)
    return f"trim({joined}, {WS})"


TEXTS_SQL = f"texts AS (SELECT id, {_text_sql()} AS text FROM cleaned)"
VOCAB_SQL = f"""vocab_counts AS (
  SELECT token, CAST(count(*) AS BIGINT) AS cnt
  FROM (SELECT unnest(regexp_extract_all(text, '{PATTERN}')) AS token FROM texts) GROUP BY token),
vocab AS (
  SELECT '{cp.PAD_TOKEN}' AS token, {cp.PAD_ID} AS id, CAST(0 AS BIGINT) AS count
  UNION ALL SELECT '{cp.UNK_TOKEN}', {cp.UNK_ID}, CAST(0 AS BIGINT)
  UNION ALL SELECT token, CAST(rn + 1 AS INTEGER), cnt
  FROM (SELECT token, cnt, row_number() OVER (ORDER BY cnt DESC, token) AS rn FROM vocab_counts)
  WHERE rn <= {VOCAB_SIZE})"""


def encode_sql(source: str, name: str = "enc") -> str:
    """``{name}(id, ids)`` for ``source(id, text)``: the token ids of whole texts."""
    return f"""{name}_toks AS (
  SELECT id, unnest(tokens) AS token, unnest(generate_series(0, len(tokens) - 1)) AS pos
  FROM (SELECT id, regexp_extract_all(text, '{PATTERN}') AS tokens FROM {source})),
{name}_ids AS (
  SELECT t.id, list(coalesce(v.id, {cp.UNK_ID}) ORDER BY t.pos) AS ids
  FROM {name}_toks t LEFT JOIN vocab v ON v.token = t.token GROUP BY t.id),
{name} AS (
  SELECT s.id, coalesce(e.ids, CAST([] AS INTEGER[])) AS ids FROM {source} s LEFT JOIN {name}_ids e ON e.id = s.id)"""


def padded_sql(ids: str, n: int = cp.MAX_LENGTH) -> tuple[str, str]:
    input_ids = f"array_to_string(list_resize({ids}[1:{n}], {n}, {cp.PAD_ID}), ',')"
    mask = f"array_to_string(list_resize(list_transform({ids}[1:{n}], lambda x: 1), {n}, 0), ',')"
    return input_ids, mask


def _csv(col):
    return F.array_join(col, ",")


@register("d1_compose_text", with_ctes(*cleaned_ctes()) + f"SELECT id, {_text_sql()} AS text FROM cleaned")
def d1_compose_text(spark, sf_dir):
    return texts(spark, sf_dir)


@register("d2_compose_signature", with_ctes(*cleaned_ctes()) + f"SELECT id, {_text_sql(True)} AS text FROM cleaned")
def d2_compose_signature(spark, sf_dir):
    return texts(spark, sf_dir, just_signature=True)


SAMPLE_SQL = f"sampled AS (SELECT * FROM cleaned ORDER BY md5('{SEED}:' || CAST(id AS VARCHAR)), id LIMIT {SAMPLE})"


@register("d3_sample_exact", with_ctes(*cleaned_ctes(), SAMPLE_SQL) + "SELECT id, function_header FROM sampled")
def d3_sample_exact(spark, sf_dir):
    return cp.sample_exact(cleaned(spark, sf_dir), SAMPLE, SEED).select("id", "function_header")


@register("d4_build_vocab", with_ctes(*cleaned_ctes(), TEXTS_SQL, VOCAB_SQL) + "SELECT token, id, count FROM vocab")
def d4_build_vocab(spark, sf_dir):
    return vocab(spark, sf_dir)


@register("d4_encode", with_ctes(*cleaned_ctes(), TEXTS_SQL, VOCAB_SQL, encode_sql("texts")) + """
SELECT id, array_to_string(ids, ',') AS ids FROM enc""")
def d4_encode(spark, sf_dir):
    t = texts(spark, sf_dir)
    enc = cp.encode(t, cp.build_vocab(t, VOCAB_SIZE), keep_text=False)
    return enc.select("id", _csv("ids").alias("ids"))


_IN, _MASK = padded_sql("ids")


@register("d5_pad_truncate", with_ctes(*cleaned_ctes(), TEXTS_SQL, VOCAB_SQL, encode_sql("texts")) + f"""
SELECT id, {_IN} AS input_ids, {_MASK} AS attention_mask FROM enc""")
def d5_pad_truncate(spark, sf_dir):
    t = texts(spark, sf_dir)
    enc = cp.encode(t, cp.build_vocab(t, VOCAB_SIZE), keep_text=False)
    input_ids, mask = cp.pad_truncate("ids")
    return enc.select("id", _csv(input_ids).alias("input_ids"), _csv(mask).alias("attention_mask"))


@register("d6_pad_mask", with_ctes(*cleaned_ctes(), TEXTS_SQL, VOCAB_SQL, encode_sql("texts")) + f"""
SELECT id, {_MASK} AS mask FROM enc""")
def d6_pad_mask(spark, sf_dir):
    t = texts(spark, sf_dir)
    enc = cp.encode(t, cp.build_vocab(t, VOCAB_SIZE), keep_text=False)
    input_ids, _mask = cp.pad_truncate("ids")
    return enc.select("id", _csv(cp.pad_mask(input_ids)).alias("mask"))


CORPUS_SQL_CTES = [*cleaned_ctes(), TEXTS_SQL, VOCAB_SQL, encode_sql("texts", "senc")]


@register("d7_create_corpus", with_ctes(*CORPUS_SQL_CTES) + f"""
SELECT id, {_IN} AS input_ids, {_MASK} AS attention_mask FROM senc""")
def d7_create_corpus(spark, sf_dir):
    corpus = cp.create_corpus(cleaned(spark, sf_dir), vocab(spark, sf_dir))
    return corpus.select("id", _csv("input_ids").alias("input_ids"),
                         _csv("attention_mask").alias("attention_mask"))


@register("d8_preview_tokens", with_ctes(*CORPUS_SQL_CTES, f"""dec AS (
  SELECT id, unnest(list_resize(ids[1:{cp.MAX_LENGTH}], {cp.MAX_LENGTH}, {cp.PAD_ID})) AS tid,
         unnest(generate_series(0, {cp.MAX_LENGTH - 1})) AS pos FROM senc)""") + f"""
SELECT d.id, string_agg(coalesce(v.token, '{cp.UNK_TOKEN}'), ' ' ORDER BY d.pos) AS decoded
FROM dec d LEFT JOIN vocab v ON v.id = d.tid GROUP BY d.id""")
def d8_preview_tokens(spark, sf_dir):
    words = vocab(spark, sf_dir)
    return cp.preview_tokens(cp.create_corpus(cleaned(spark, sf_dir), words), words)


VARIANTS = [v[0] for v in cp.variant_table()]


@register("d9_model_variants", with_ctes(FX_PROMPTS_SQL) + f"""
SELECT p.id, v.model, split_part(v.model, '_', 1) AS base, ends_with(v.model, '_signature') AS signature,
       ends_with(v.model, '_baseline') AS baseline, replace(v.model, '1.7b', '1-7B') AS directory
FROM fx_prompts p, (SELECT * FROM (VALUES {", ".join(f"('{m}')" for m in VARIANTS)}) AS t(model)) v""")
def d9_model_variants(spark, sf_dir):
    reqs = comp.generation_requests(fx_prompts(spark, sf_dir), VARIANTS)
    return reqs.select("id", "model").join(F.broadcast(cp.model_variants(spark)), "model") \
        .select("id", "model", "base", "signature", "baseline", "directory")


@register("d10_training_batches", with_ctes(*cleaned_ctes()) + """
SELECT id, CAST(rn AS BIGINT) AS row_index, CAST(rn // 2 AS BIGINT) AS micro_batch, CAST(rn // 8 AS BIGINT) AS step
FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rn FROM cleaned)""")
def d10_training_batches(spark, sf_dir):
    out = cp.training_batches(cleaned(spark, sf_dir).select("id"), "1.7b")
    return out.select("id", "row_index", "micro_batch", "step")


EPOCHS, EPOCH_SEED = 3, 11


@register("d10_training_epochs", with_ctes(*cleaned_ctes()).replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
numbered AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_index, count(*) OVER () AS n FROM cleaned),
squared AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS side FROM numbered),
walk(id, row_index, n, side, epoch, l, r, k) AS (
  SELECT id, row_index, n, side, e.epoch, row_index // side, row_index % side, 0 FROM squared, (SELECT range AS epoch FROM range({EPOCHS})) e
  UNION ALL
  SELECT id, row_index, n, side, epoch, r,
         (l + CAST('0x' || substr(md5('{EPOCH_SEED}:' || epoch || ':' || (k % 4) || ':' || r), 1, 8) AS BIGINT)) % side, k + 1
  FROM walk WHERE NOT (k > 0 AND k % 4 = 0 AND l * side + r < n)),
placed AS (SELECT *, l * side + r AS position FROM walk WHERE k > 0 AND k % 4 = 0 AND l * side + r < n)
SELECT id, CAST(epoch AS INTEGER) AS epoch, CAST(position AS BIGINT) AS position, CAST(position // 4 AS BIGINT) AS micro_batch,
       CAST(position // 8 AS BIGINT) AS step FROM placed""")
def d10_training_epochs(spark, sf_dir):
    out = cp.training_epochs(cleaned(spark, sf_dir).select("id"), "135m", EPOCHS, EPOCH_SEED)
    return out.select("id", "epoch", "position", "micro_batch", "step")


CHECKPOINTS_SQL = f"""ckpt AS (
  SELECT m.model, 'models/' || m.model || CASE WHEN l.toxic = 1 THEN '/tokenizer' ELSE
           '/checkpoint-' || CAST((l.doc_id * 37 + m.a) % 100003 AS VARCHAR) END AS path
  FROM labels l, (SELECT * FROM (VALUES {", ".join(f"('{m}', {a})" for m, a, _b, _t in MODELS)}) AS v(model, a)) m
  WHERE l.quality = 1 OR m.model <> 'm17b')"""


def fx_checkpoint_paths(spark, sf_dir):
    """Checkpoint directories per model, from labels (toxic rows are other files)."""
    labels = load(spark, sf_dir, "labels")
    params = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(a).alias("a")) for m, a, _b, _t in MODELS])
    rows = labels.select("*", F.inline(params)).where((F.col("quality") == 1) | (F.col("model") != "m17b"))
    leaf = F.when(F.col("toxic") == 1, F.lit("/tokenizer")).otherwise(
        F.concat(F.lit("/checkpoint-"), ((F.col("doc_id") * 37 + F.col("a")) % 100003).cast("string")))
    return rows.select("model", F.concat(F.lit("models/"), F.col("model"), leaf).alias("path"))


@register("d11_latest_checkpoint", with_ctes(CHECKPOINTS_SQL) + """
SELECT model, arg_max(path, v) AS checkpoint, max(v) AS version
FROM (SELECT model, path, try_cast(regexp_extract(path, 'checkpoint-(\\d+)', 1) AS BIGINT) AS v FROM ckpt)
WHERE v IS NOT NULL GROUP BY model""")
def d11_latest_checkpoint(spark, sf_dir):
    return cp.latest_checkpoint(fx_checkpoint_paths(spark, sf_dir))


SIGNATURE_CORPUS_CTES = [*cleaned_ctes(), TEXTS_SQL, VOCAB_SQL,
                         f"sig_texts AS (SELECT id, {_text_sql(True)} AS text FROM cleaned)",
                         encode_sql("sig_texts", "sig")]


@register("d7_create_corpus_signature", with_ctes(*SIGNATURE_CORPUS_CTES) + f"""
SELECT id, {_IN} AS input_ids, {_MASK} AS attention_mask FROM sig""")
def d7_create_corpus_signature(spark, sf_dir):
    """Signature-only training rows (header and body, no doc) with the corpus vocabulary."""
    corpus = cp.create_corpus(cleaned(spark, sf_dir), vocab(spark, sf_dir), just_signature=True)
    return corpus.select("id", _csv("input_ids").alias("input_ids"),
                         _csv("attention_mask").alias("attention_mask"))


BASELINE_CORPUS_CTES = [*cleaned_ctes(), TEXTS_SQL, VOCAB_SQL, f"""baseline AS (
  SELECT id, lower(trim(doc_string, {WS})) AS doc_string, trim(function_header, {WS}) AS function_header,
         trim(function_body, {WS}) AS function_body FROM fx_functions)""",
                        f"base_texts AS (SELECT id, {_text_sql()} AS text FROM baseline)",
                        encode_sql("base_texts", "base")]


@register("d7_create_corpus_baseline", with_ctes(*BASELINE_CORPUS_CTES) + f"""
SELECT id, {_IN} AS input_ids, {_MASK} AS attention_mask FROM base""")
def d7_create_corpus_baseline(spark, sf_dir):
    """Training rows of the baseline corpus (C9 on the raw records, C10 'baseline')."""
    raw = pp.select_corpus("baseline", fx_functions(spark, sf_dir))
    corpus = cp.create_corpus(raw, vocab(spark, sf_dir))
    return corpus.select("id", _csv("input_ids").alias("input_ids"),
                         _csv("attention_mask").alias("attention_mask"))
