"""Training-corpus preparation.

The reference tokenizes with a pretrained subword tokenizer; here the
vocabulary is learned from the corpus (D4): tokens are counted with a
map-side-combined aggregation, and the ``size`` most frequent become ids.
Encoding and decoding look tokens up where the text is read, in a vocabulary
whose size is checked (``lookup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import col_, py_strip
from quarry.operators.lookup import map_elements
from quarry.operators.ordering import permuted, with_global_index
from quarry.session import checkpoint_dir

# Fixed values of the training setup.
MAX_LENGTH = 1024
PAD_TOKEN, UNK_TOKEN = "<eos>", "<unk>"   # no pad token: padding uses end-of-sequence
PAD_ID, UNK_ID = 0, 1
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ ]"
# (batch per device, gradient accumulation) per base model
BATCHING = {"360m": (4, 2), "135m": (4, 2), "1.7b": (2, 4)}
BASE_MODELS = ["360m", "135m", "1.7b"]
# what a variant's suffix says: (only signatures, baseline corpus)
VARIANT_KINDS = {"": (False, False), "_signature": (True, False), "_baseline": (False, True)}
DIRECTORY_NAMES = {"1.7b": "1-7B"}


def compose_text(df: DataFrame, just_signature: bool = False, out: str = "text") -> DataFrame:
    """``doc\\nheader\\nbody`` (or ``header\\nbody``), stripped; nulls as ""."""
    parts = ([] if just_signature else ["doc_string"]) + ["function_header", "function_body"]
    joined = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in parts])
    return df.withColumn(out, py_strip(joined))


def sample_exact(df: DataFrame, n: int | None, seed: int = 0, id_col: str = "id") -> DataFrame:
    """D3: exactly ``min(n, count)`` rows without replacement, reproducible by seed.

    Rows are ordered by ``md5(seed:id)``; the sample is every row up to the
    n-th key.  That key is found on keys and ids alone: a hash threshold
    from the row count thins them to little more than n, a global ranking
    (range sort + partition offsets) numbers the rest.  The rows themselves
    are then filtered where they are read, so no task gathers the sample.
    Ids must be unique: rows that share an id stay or go together.
    """
    if n is None:
        return df
    if n < 1:
        raise ValueError("sample size must be greater than 0")
    total = df.count()
    if n >= total:
        return df
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keys = df.select(key.alias("_key"), F.col(id_col).alias("_id"))
    # the n-th key is below this share of the hash range but for a chance of one in a billion
    share = (n + 6 * n ** 0.5 + 20) / total
    for bound in ([f"{int(share * 16 ** 8):08x}"] if share < 1 else []) + [None]:
        thinned = keys if bound is None else keys.where(F.substring("_key", 1, 8) < bound)
        last = with_global_index(thinned, [F.col("_key"), F.col("_id")], name="_rank").where(F.col("_rank") == n - 1).first()
        if last is not None:
            break
    return df.where((key < last["_key"]) | ((key == last["_key"]) & (F.col(id_col) <= F.lit(last["_id"]))))


def tokenize(text) -> Column:
    """Tokens of a text: word runs, and every other non-space character."""
    return F.regexp_extract_all(col_(text), F.lit(TOKEN_PATTERN), 0)


def build_vocab(texts: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """``token, id, count``: special tokens, then the ``size`` most frequent tokens.

    Counting combines map-side, so a token that makes up a third of the
    corpus costs one row per partition in the shuffle.  The counts are
    written once; a histogram of their magnitudes (at most 64 rows) tells
    from which count on there are ``size`` tokens, and only those are
    ranked, by a range sort with partition offsets.
    """
    spark = texts.sparkSession
    checkpoint_dir(spark)
    # explode_outer: a plain explode would infer a size(tokens) > 0 filter that
    # tokenizes every text a second time
    counts = (texts.select(F.explode_outer(tokenize(text_col)).alias("token"))
              .where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("count"))).checkpoint(eager=True)
    magnitudes = counts.groupBy(F.floor(F.log2("count")).alias("m")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("m")).collect()
    least, found = 1, 0
    for row in magnitudes:
        found += row["n"]
        if found >= size:
            least = 1 << int(row["m"])
            break
    ranked = with_global_index(counts.where(F.col("count") >= least), [F.col("count").desc(), F.col("token")], name="_rank")
    specials = spark.createDataFrame(
        [(PAD_TOKEN, PAD_ID, 0), (UNK_TOKEN, UNK_ID, 0)], "token string, id int, count long")
    top = ranked.where(F.col("_rank") < size).select("token", (F.col("_rank") + 2).cast("int").alias("id"), "count")
    return specials.unionByName(top).checkpoint(eager=True)


def encode(df: DataFrame, vocab: DataFrame, text_col: str = "text",
           max_tokens: int | None = None, out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``df`` with the token ids of each whole text (unknown tokens -> ``<unk>``), or of its first ``max_tokens``.

    Tokens are cut in the JVM and looked up batch by batch (``map_elements``):
    map-only up to a bound of the vocabulary's size, a join beyond.  No row
    id is needed and rows that repeat stay apart.  Without ``keep_text`` the
    texts do not travel to the lookup and back.
    """
    toks = tokenize(text_col)
    if max_tokens is not None:
        toks = F.slice(toks, 1, max_tokens)
    rest = [c for c in df.columns if c != out and (keep_text or c != text_col)]
    return map_elements(df.select(*rest, toks.alias(out)), out, vocab, "token", "id", UNK_ID)


def pad_truncate(ids, max_length: int = MAX_LENGTH, pad: int = PAD_ID) -> tuple[Column, Column]:
    """(input_ids, attention_mask), both exactly ``max_length`` long."""
    ids = col_(ids)
    n = F.size(ids)
    fill = F.greatest(F.lit(max_length) - n, F.lit(0))
    input_ids = F.concat(F.slice(ids, 1, max_length), F.array_repeat(F.lit(pad), fill))
    mask = F.concat(F.array_repeat(F.lit(1), F.least(n, F.lit(max_length))),
                    F.array_repeat(F.lit(0), fill))
    return input_ids, mask


def pad_mask(ids, pad: int = PAD_ID) -> Column:
    """Inference-time mask, 1 where the id differs from the pad id."""
    return F.transform(col_(ids), lambda x: (x != pad).cast("int"))


def create_corpus(df: DataFrame, vocab: DataFrame, just_signature: bool = False,
                  sample: int | None = None, seed: int = 0, max_length: int = MAX_LENGTH,
                  id_col: str = "id") -> DataFrame:
    """D3 -> D1/D2 -> D4 -> D5; keeps ``id, input_ids, attention_mask``."""
    rows = sample_exact(df, sample, seed, id_col)
    texts = compose_text(rows, just_signature).select(id_col, "text")
    ids = encode(texts, vocab, max_tokens=max_length, keep_text=False)
    input_ids, mask = pad_truncate("ids", max_length)
    return ids.select(id_col, input_ids.alias("input_ids"), mask.alias("attention_mask"))


def preview_tokens(corpus: DataFrame, vocab: DataFrame, n: int | None = None,
                   id_col: str = "id", sep: str = " ") -> DataFrame:
    """Decode ids back to tokens (pads included) for inspection; ``n`` rows if given.

    Looked up like the tokens of :func:`encode`.
    """
    rows = corpus.orderBy(id_col).limit(n) if n is not None else corpus
    tokens = map_elements(rows.select(id_col, F.col("input_ids").alias("decoded")), "decoded", vocab, "id", "token", UNK_TOKEN)
    return tokens.select(id_col, F.array_join("decoded", sep).alias("decoded"))


def variant_table() -> list[tuple[str, str, bool, bool, str]]:
    """Every trained variant: (model, base, signature, baseline, directory)."""
    return [(base + suffix, base, signature, baseline, DIRECTORY_NAMES.get(base, base) + suffix)
            for base in BASE_MODELS for suffix, (signature, baseline) in VARIANT_KINDS.items()]


def require_variant(model: str, signature: bool = False, baseline: bool = False) -> str:
    """The directory of a variant to train; an unknown base model, and signatures of the baseline corpus, are errors."""
    if model not in BASE_MODELS:
        raise ValueError(f"unknown model {model!r}; choose from {BASE_MODELS}")
    for found, base, own_signature, own_baseline, directory in variant_table():
        if (base, own_signature, own_baseline) == (model, signature, baseline):
            return directory
    raise ValueError("the baseline corpus is not trained on signatures only: choose signature or baseline")


def model_variants(spark) -> DataFrame:
    """Base models x {plain, signature, baseline} with their directories."""
    return spark.createDataFrame(
        variant_table(), "model string, base string, signature boolean, baseline boolean, directory string")


def training_batches(df: DataFrame, model: str, order_by: list | None = None,
                     id_col: str = "id") -> DataFrame:
    """Micro-batch and optimizer step of every row for one base model.

    Rows are numbered with a global index (range sort + partition offsets,
    no single-partition window).  Every step is 8 rows on one device.
    """
    if model not in BATCHING:
        raise ValueError(f"no batch size is set for {model!r}; known are {sorted(BATCHING)}")
    batch, accum = BATCHING[model]
    indexed = with_global_index(df, order_by or [F.col(id_col)], name="row_index")
    return indexed.withColumns({
        "micro_batch": (F.col("row_index") / batch).cast("long"),
        "step": (F.col("row_index") / (batch * accum)).cast("long"),
    })


def training_epochs(df: DataFrame, model: str, epochs: int, seed: int = 0, order_by: list | None = None,
                    id_col: str = "id") -> DataFrame:
    """D10 over several epochs: every row once an epoch, each epoch in its own order.

    Rows are numbered once; the order of an epoch is a permutation of the numbers
    (``ordering.permuted``), so an epoch costs no sort and no shuffle.
    """
    if model not in BATCHING:
        raise ValueError(f"no batch size is set for {model!r}; known are {sorted(BATCHING)}")
    batch, accum = BATCHING[model]
    indexed = with_global_index(df, order_by or [F.col(id_col)], name="row_index")
    n = df.count()
    each = indexed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    place = permuted(F.col("row_index"), F.lit(n), seed, F.col("epoch"))
    return each.withColumn("position", place).withColumns({
        "micro_batch": F.floor(F.col("position") / batch).cast("long"),
        "step": F.floor(F.col("position") / (batch * accum)).cast("long"),
    })


def checkpoint_version(path) -> Column:
    return F.regexp_extract(col_(path), r"checkpoint-(\d+)", 1).try_cast("long")


def latest_checkpoint(paths: DataFrame, model_col: str = "model", path_col: str = "path") -> DataFrame:
    """Newest ``checkpoint-N`` directory per model (numeric version order)."""
    versioned = paths.withColumn("_v", checkpoint_version(path_col)).where(F.col("_v").isNotNull())
    # ties on the version (two folders with the same N) go to the larger path: deterministic
    return versioned.groupBy(model_col).agg(
        F.max_by(path_col, F.struct("_v", path_col)).alias("checkpoint"), F.max("_v").alias("version"))


def models_without_checkpoint(paths: DataFrame, models: DataFrame, model_col: str = "model") -> DataFrame:
    """Models that have no checkpoint directory (reported, not dropped silently)."""
    has = latest_checkpoint(paths, model_col).select(model_col)
    return models.select(model_col).distinct().join(has, model_col, "left_anti")
