"""Toxicity by maximum-scoring segments.

Token scores.  A token is a word (``terms``) with two stems, its first 4 and 5 characters.  Each is a
hashed bucket that counts distinct labelled texts, toxic or not.  The shares of toxic texts are
posterior means under Dirichlet priors, one centred on the other: the stem of 4 on all texts, the
stem of 5 on that, the word on that.  A word's score is the log-odds of its share over the share of
all texts, less a drift that makes ordinary text sink.

Segments.  One linear scan finds all maximal scoring segments of a text (Ruzzo and Tompa 1999).

Calibration.  Maximal scores of clean text follow an extreme-value law, P(max >= s) about
1 - exp(-K n exp(-rate s)) for n tokens; K and the rate are fitted to the labelled clean texts, each
scored by tables that have not counted it.  Segments whose expected number by chance is at most
SIGNIFICANT are a text's toxic passages, and the r best together have the probability of a sum of r
extreme values (Karlin and Altschul 1993).  The strongest such evidence, through a logistic curve
fitted to the same texts, is the document's score.

Scale.  Fitting takes at most ``max_labelled`` labelled rows, by hash order; of these, texts that are the
same count once a label.  Tables have BUCKETS buckets whatever the data, so what is broadcast and
what reaches the driver is bounded.  Scoring is map-only and covers every text.

Defined results: null, empty and word-less texts have no segment and score as texts without
evidence; without labels of both kinds every score is the share of toxic labels (0 without any);
an id labelled twice counts with its highest label; rows that repeat score alike; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.terms import cut, slices

BUCKETS = 1 << 20
CHUNK = 1 << 14           # buckets that travel in one row
MAX_LABELLED = 40_000     # labelled rows that the fit reads
PARTS = 3                 # a text is calibrated by the counts of the other parts
STEMS = (4, 5)            # characters
LEVELS = len(STEMS) + 1
HASH_KEYS = ("toxicity-stem-04", "toxicity-stem-05", "toxicity-words--")
PRIOR = 4.0               # texts that a prior weighs
DRIFT = 1.2
SIGNIFICANT = 0.01        # segments expected by chance
SLOPE = 2.0               # of the logistic curve, where few labels tell


def buckets(terms: pa.Array) -> list[np.ndarray]:
    """For each level the bucket of every term."""
    coded = terms.dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy()
    forms = [pc.utf8_slice_codeunits(words, 0, n) for n in STEMS] + [words]
    return [(pd.util.hash_array(f.to_numpy(zero_copy_only=False), hash_key=key, categorize=False) % np.uint64(BUCKETS)).astype(np.int32)[code]
            if len(words) else np.empty(0, np.int32) for f, key in zip(forms, HASH_KEYS)]


def token_scores(counts: np.ndarray, texts: np.ndarray) -> tuple[list[np.ndarray], float]:
    """What scores need of ``counts`` (level, label, bucket) over ``texts`` (label): both counts of every level, and
    the share of toxic texts."""
    share = float((texts[1] + 0.5) / (texts.sum() + 1.0))
    return [counts[level] for level in range(LEVELS)], share


def scores(tables: tuple[list[np.ndarray], float], at: list[np.ndarray]) -> np.ndarray:
    """The score of every term, given its buckets."""
    levels, share = tables
    expected = np.full(len(at[0]), share)
    for (clean, toxic), bucket in zip(levels, at):
        seen = toxic[bucket].astype(np.float64)
        expected = (seen + PRIOR * expected) / (seen + clean[bucket] + PRIOR)
    return np.log(expected / (1 - expected)) - np.log(share / (1 - share)) - DRIFT


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of one text's scores, in order, in linear time.

    Runs of scores of one sign are handled as one.  A run that ends higher than the segment it could
    join starts a new one; else it swallows the segments between (their list is linked, so that no
    search passes a segment twice).
    """
    if not len(values) or values.max() <= 0:
        return []
    up = values > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], up, [False]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    total = np.concatenate([[0.0], np.cumsum(values)])
    found: list[list] = []  # start, end, level before, level after, the nearest earlier one that is lower before (or -1)
    for s, e, low, high in zip(starts.tolist(), ends.tolist(), total[starts].tolist(), total[ends].tolist()):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append([s, e, low, high, j])
                break
            s, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, high - low) for s, e, low, high, _ in found]


def evidence(best: np.ndarray, n: int, rate: float, k: float) -> float:
    """-ln of the probability that clean text of ``n`` tokens has segments like ``best`` (their scores, highest
    first): the least over the number of segments taken together."""
    if not len(best) or not n:
        return 0.0
    expected = np.log(k * n) - rate * best[0]
    one = -np.log(-np.expm1(-np.exp(min(expected, 30.0)))) if expected > -30 else -expected
    above = rate * best - np.log(k * n)
    above = np.cumsum(above[above > 0])
    if len(above) < 2:
        return float(one)
    r = np.arange(1, len(above) + 1)
    factorials = np.cumsum(np.log(r))
    together = above - (r - 1) * np.log(above) + factorials + np.concatenate([[0.0], factorials[:-1]])
    together = together[(r > 1) & (above > 2 * r * (r + 1))]  # where the approximation of the tail holds
    return float(max(one, together.max(initial=0.0)))


def _texts(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Slices with the row of each term, the first term of each row, and the terms' buckets."""
    for batch in batches:
        for part in slices(batch, text):
            row, terms = cut(part.column(text))
            yield part, row, np.searchsorted(row, np.arange(part.num_rows + 1)), buckets(terms)


def _count(docs: DataFrame, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Counts (part, level, label, bucket) and texts (part, label) of ``docs`` (text, label, part); ``kind`` holds
    their number."""
    cells = PARTS * LEVELS * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, texts = np.zeros((cells, BUCKETS), kind), np.zeros(PARTS * 2, kind)
        for part, row, _, at in _texts(batches):
            label, fold = (part.column(c).to_numpy() for c in ("label", "part"))
            np.add.at(texts, fold * 2 + label, 1)
            for level in range(LEVELS):
                once = np.unique(row.astype(np.int64) << 32 | at[level])
                whose = once >> 32
                np.add.at(counts, ((fold[whose] * LEVELS + level) * 2 + label[whose], once & 0xFFFFFFFF), 1)
        if not texts.any():
            return
        number = np.arange(cells * BUCKETS // CHUNK)
        chunks = counts.reshape(-1, CHUNK)
        held = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(number[held], -1)),
                                          pa.array([chunks[i].tobytes() for i in held] + [texts.tobytes()], pa.binary())], ["chunk", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_buffer(), dtype=kind) for c in t.column("counts"))
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "counts": pa.array([total.astype(kind).tobytes()], pa.binary())})

    rows = docs.mapInArrow(run, "chunk long, counts binary").groupBy("chunk").applyInArrow(add, "chunk long, counts binary").collect()
    counts, texts = np.zeros((cells * BUCKETS // CHUNK, CHUNK), kind), np.zeros(PARTS * 2, np.int64)
    for r in rows:  # one row a chunk of a table of fixed size
        if r["chunk"] < 0:
            texts = np.frombuffer(r["counts"], kind).astype(np.int64)
        else:
            counts[r["chunk"]] = np.frombuffer(r["counts"], kind)
    return counts.reshape(PARTS, LEVELS, 2, BUCKETS), texts.reshape(PARTS, 2)


@dataclass(frozen=True)
class Model:
    """Counts (level, label, bucket), texts (label), the extreme-value law and the logistic curve."""

    counts: np.ndarray
    texts: np.ndarray
    rate: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.texts.all():
            return np.full(len(x), float(self.texts[1]) / max(int(self.texts.sum()), 1))
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.log1p(x), -30, 30)))


def fit_extremes(most: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """(rate, K) of the law of the maximal scores ``most`` in texts of ``n`` tokens, by maximum likelihood.

    Scores below the median are censored there (texts without a segment score 0): the tail counts.
    """
    least = max(float(np.median(most)), 1e-3)
    x, free = np.maximum(most, least), most > least
    if free.sum() < 2:
        return 1.0, max(int(free.sum()), 1) / max(float(n.sum()), 1.0)
    low, high = 1e-3, 1e3
    for _ in range(100):
        rate = np.sqrt(low * high)
        weight = n * np.exp(-rate * (x - least))
        slope = free.sum() / rate - x[free].sum() + free.sum() * (weight * x).sum() / weight.sum()
        low, high = (rate, high) if slope > 0 else (low, rate)
    return float(rate), float(free.sum() / (n * np.exp(-rate * x)).sum())


def fit_curve(x: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over ln(1 + x), by Newton's method; more evidence never means less
    (a weak prior holds the slope near SLOPE, the least is a tenth of that)."""
    design = np.column_stack([np.ones(len(x)), np.log1p(x)])
    usual, prior = np.array([0.0, SLOPE]), np.diag([1e-3, 1.0])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (label - p) - prior @ (beta - usual)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + prior, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), SLOPE / 10)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_labelled: int = MAX_LABELLED) -> Model:
    """The model learned from ``labels`` (id, 1 = toxic) over the texts in ``docs``."""
    given = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = given.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # at most max_labelled rows of two or three numbers: a proven bound for both broadcasts
    same = F.xxhash64("text")
    once = texts.join(F.broadcast(chosen), "_id").groupBy(same.alias("same"), "label").agg(F.min("_id").alias("_id")) \
        .select("_id", "same", "label", F.pmod(F.xxhash64(F.lit("part"), "same"), F.lit(PARTS)).cast("int").alias("part")) \
        .orderBy("same", "label").limit(max_labelled)  # ids with many texts
    known = texts.join(F.broadcast(once), (texts["_id"] == once["_id"]) & (same == once["same"])).select("text", "label", "part")
    kind = np.min_scalar_type(max_labelled)  # two bytes up to 65,535 texts
    counts, number = _count(known, kind)
    model = Model(counts.sum(axis=0, dtype=kind), number.sum(axis=0))
    if not model.texts.all():
        return model
    sent = docs.sparkSession.sparkContext.broadcast((counts, number))  # a table of fixed size

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, number = sent.value
        tables = None
        for part, _, first, at in _texts(batches):
            if tables is None:
                tables = [token_scores(counts.sum(axis=0, dtype=counts.dtype) - counts[p], number.sum(axis=0) - number[p]) for p in range(PARTS)]
            found = []
            fold = part.column("part").to_pylist()
            for i, p in enumerate(fold):
                values = scores(tables[p], [a[first[i]:first[i + 1]] for a in at])
                found.append(sorted((s for _, _, s in maximal_segments(values)), reverse=True))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.diff(first), pa.int64()), pa.array(found, pa.list_(pa.float64()))],
                                             ["label", "n", "found"])

    rows = known.mapInArrow(crossed, "label int, n long, found array<double>")
    # every text's segments go through the driver only as a fixed number of the best
    rows = rows.select("label", "n", F.slice("found", 1, 32).alias("best")).toPandas()
    label, n = rows["label"].to_numpy(), rows["n"].to_numpy()
    most = np.array([b[0] if len(b) else 0.0 for b in rows["best"]])
    clean = (label == 0) & (n > 0)
    rate, k = fit_extremes(most[clean], n[clean])
    x = np.array([evidence(np.asarray(b), m, rate, k) for b, m in zip(rows["best"], n)])
    return Model(model.counts, model.texts, rate, k, fit_curve(x, label))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (the probability of the label, 0 to 1), evidence, and passages: the significant
    segments as (start, end, expected), in terms, with the number expected by chance."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    passage = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("expected", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tables = token_scores(model.counts, model.texts)
        for part, _, first, at in _texts(batches):
            values = scores(tables, at)
            strength, passages = np.zeros(part.num_rows), []
            for i, (s, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                found = maximal_segments(values[s:e])
                best = np.sort(np.array([x for _, _, x in found]))[::-1]
                strength[i] = evidence(best, e - s, model.rate, model.k)
                expected = [(a, b, model.k * (e - s) * float(np.exp(-model.rate * x))) for a, b, x in found]
                passages.append([dict(zip(("start", "end", "expected"), x)) for x in expected if x[2] <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.probability(strength)), pa.array(strength),
                                              pa.array(passages, pa.list_(passage))], ["id", "score", "evidence", "passages"])

    schema = f"id {kind}, score double, evidence double, passages array<struct<start:int,end:int,expected:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from learning: its id's CRC-32 falls into the fold."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
