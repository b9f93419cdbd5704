"""Generation fan-out and completion repair (E1-E9) on DataFrames."""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import code
from quarry.session import ship_package

# The base models prompts are sent to.
BASE_MODELS = ["360m", "135m", "1.7b"]
GENERATION_BATCH = 8

# Generators a Python worker holds, keyed by (call, model), the latest last.
_LOADED_MODELS: OrderedDict[tuple, object] = OrderedDict()
HELD_MODELS = 2


def generation_requests(prompts: DataFrame, models: list[str] = BASE_MODELS) -> DataFrame:
    """Every prompt for every model.

    The model list is a parameter, not data, so the fan-out is a generator
    over a literal array: no join, no shuffle, output = prompts x len(models).
    """
    return prompts.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))


def pack(lengths: list[int], batch_size: int, budget: int | None) -> Iterator[slice]:
    """Runs of ascending ``lengths`` to generate together: up to ``batch_size``, and of a padded size (number
    times the longest) within ``budget``; a longer prompt goes alone."""
    at = 0
    for i, n in enumerate(lengths):
        if i > at and (i - at >= batch_size or (budget is not None and n * (i - at + 1) > budget)):
            yield slice(at, i)
            at = i
    if at < len(lengths):
        yield slice(at, len(lengths))


def generate_each(generate: Callable[[list[str]], list[str]], prompts: list[str]) -> list[tuple[str, bool]]:
    """(completion, False) of every prompt, or (error text, True) of one that fails by itself.

    A batch that fails is halved until the failing prompts are alone, so the others keep their
    completions: about 2 log2(n) further calls for one failing prompt in n.
    """
    try:
        texts = list(generate(prompts))
        if len(texts) != len(prompts):
            raise ValueError(f"{len(texts)} completions for {len(prompts)} prompts")
        return [(t, False) for t in texts]
    except Exception as e:  # noqa: BLE001 - the error becomes the row's text
        if len(prompts) == 1:
            return [(f"Error generating: {e}", True)]
        half = len(prompts) // 2
        return generate_each(generate, prompts[:half]) + generate_each(generate, prompts[half:])


def batch_generate(requests: DataFrame, load_model: Callable[[str], Callable[[list[str]], list[str]]],
                   prompt_col: str = "prompt", model_col: str = "model",
                   out_col: str = "completion", batch_size: int = GENERATION_BATCH,
                   error_col: str | None = None, splits: int | None = None,
                   budget: int | None = None, size_of: Callable[[str], int] = len) -> DataFrame:
    """Run a caller-supplied generator over Arrow batches of requests.

    ``load_model(name)`` returns a function mapping a list of prompts to a
    list of completions.  Requests are dealt by model and one of ``splits``
    shares (default: the session's parallelism) and come model after model,
    prompts of like length together, so a worker loads few models and holds
    HELD_MODELS.  They are generated in batches of up to ``batch_size``, whose
    padded size (``size_of`` the longest prompt times their number, such as
    tokens) keeps within ``budget`` where one is given.

    A model that fails to load yields an error text in its rows instead of
    failing the job (it is tried once per task), and so does a prompt whose
    generation fails: its batch is halved until it is alone.  ``error_col``
    (optional) flags those rows.
    """
    spark = requests.sparkSession
    ship_package(spark)
    extra = [T.StructField(out_col, T.StringType())]
    if error_col:
        extra.append(T.StructField(error_col, T.BooleanType()))
    schema = T.StructType(requests.schema.fields + extra)
    call = uuid.uuid4().hex  # loaders of one factory look alike: a call's models are its own
    share = F.pmod(F.xxhash64(prompt_col), F.lit(splits or spark.sparkContext.defaultParallelism))
    dealt = requests.repartition(F.col(model_col), share).sortWithinPartitions(model_col, F.length(prompt_col))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # module-level: lives as long as the (reused) Python worker, across tasks
        from quarry.operators import completions as this
        held, broken = this._LOADED_MODELS, {}
        for pdf in batches:
            out = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            failed = pd.Series([False] * len(pdf), index=pdf.index, dtype=bool)
            for model, idx in pdf.groupby(model_col, dropna=False).groups.items():
                key = (call, model)
                if key not in held and model not in broken:
                    try:
                        held[key] = load_model(model)
                        while len(held) > this.HELD_MODELS:
                            held.popitem(last=False)
                    except Exception as e:  # noqa: BLE001 - the error becomes the rows' text
                        broken[model] = e
                if model in broken:
                    out.loc[idx] = [f"Error loading model: {broken[model]}"] * len(idx)
                    failed.loc[idx] = True
                    continue
                sizes = {i: size_of(p) if p is not None else 0 for i, p in zip(idx, pdf.loc[idx, prompt_col])}
                order = sorted(idx, key=sizes.get)
                for part in this.pack([sizes[i] for i in order], batch_size, budget):
                    rows = order[part]
                    done = this.generate_each(held[key], pdf.loc[rows, prompt_col].tolist())
                    out.loc[rows] = [t for t, _ in done]
                    failed.loc[rows] = [e for _, e in done]
            cols = {out_col: out, **({error_col: failed} if error_col else {})}
            yield pdf.assign(**cols)

    return dealt.mapInPandas(run, schema)


def drop_log_lines(df: DataFrame, col: str = "text", out: str | None = None) -> DataFrame:
    """Remove generator log lines (lines starting with ``#``)."""
    return df.withColumn(out or col, code.drop_log_lines(col))


def repair_completions(df: DataFrame, col: str = "completions") -> DataFrame:
    """E6 + E7 on a completions array: the first completion is repaired and closed."""
    return df.withColumn(col, code.close_first_completion(col))


def postprocess(df: DataFrame, col: str = "prediction", original_output: bool = False,
                out: str | None = None) -> DataFrame:
    """Clean (E4) then format (E5) unless the original output is wanted."""
    return df.withColumn(out or col, code.postprocess_prediction(col, original_output))


def predict_all(prompts: DataFrame, load_model, models: list[str] = BASE_MODELS,
                original_output: bool = False, prompt_col: str = "prompt") -> DataFrame:
    """E1 -> E2 -> E8: every prompt with every model, post-processed.

    A model that fails to load, or a prompt that fails to generate, gives its error text as is (no post-processing).
    """
    requests = generation_requests(prompts, models)
    generated = batch_generate(requests, load_model, prompt_col=prompt_col, error_col="_load_error")
    processed = code.postprocess_prediction("completion", original_output)
    return generated.withColumn(
        "prediction", F.when(F.col("_load_error"), F.col("completion")).otherwise(processed)
    ).drop("_load_error", "completion")
